"""Linking the spellings of one person or organisation within a book.

Each distinct spelling is parsed once into keys: the whole name (both orders, nicknames replaced by
the names they stand for, scripts folded to one), initial and surname, single parts, and for
organisations the whole name, its initials and its short forms. Keys of a kind are joined within a
radius of the edit distance, a true metric: the keys of a book are assigned to pivots, a key that lies
near a border is replicated to every cell whose pivot is at most twice the radius farther than its own
(the triangle inequality allows no other cell to hold a partner), and an exact radius join runs inside
each cell. Whole names within one typing error, and all spellings of one profile, are one entity;
a part of a name is linked where only one entity of the book can be meant. Books of every size take the
same way: joins, and connected components by minimum labels; no book is gathered in a task.

The result is a row per spelling with its entity; ``spelling_pairs`` makes pairs of it where those are asked.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.session import cut

#: Levenshtein radius of the join: one insertion, deletion or substitution, or a transposition, which costs two.
RADIUS = 2
#: Single parts shorter than this must match exactly.
TYPO_LENGTH = 5
#: The nickname list is given to every task, so it is held to this many rows.
NICKNAMES = 100_000

#: Voices that are no entity, beside all spellings without a capital.
GENERIC = frozenset("旁白 路人 众人 无名 未知 某人 叙述者 旁白者 画外音 narrator unknown voice рассказчик неизвестный автор голос баяндаушы белгісіз hikoyachi noma'lum ovoz".split())
#: Titles and forms of address.
TITLES = frozenset("doctor dr mr mrs ms miss sir lady madam madame uncle aunt captain capt professor prof judge father mother doktor kapitan usta aka opa xola amaki domla доктор капитан дядюшка дядя тётушка тетушка тётя тетя мадам госпожа господин профессор месье дәрігер молда апай ханым аға апа көке мырза капитан".split())
TITLES_HAN = ("掌柜", "大夫", "先生", "女士", "小姐", "夫人", "太太", "老师", "师傅", "医生")
#: Cyrillic letters and the Latin ones they are written with.
CYRILLIC = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюяёәғқңөұүһі", "a b v g d e zh z i y k l m n o p r s t u f kh ts ch sh shch _ y _ e yu ya yo a gh q ng o u u h i".replace("_", "\0").split(" ")))
#: Words that make a name that of an organisation, and their short forms.
ORGANISATIONS = frozenset("association company society club guild union trust bank co assoc soc общество товарищество управление артель контора об-во т-во упр қоғамы ұйымы серіктестігі қ-мы ұй серікт uyushmasi jamiyati shirkati uyushm jam shirk".split())
ORGANISATIONS_HAN = ("商会", "协会", "公司", "学会", "书局")


def letters_of(text: str) -> str:
    """Lower case letters and digits without marks and apostrophes, in their own script."""
    plain = unicodedata.normalize("NFD", text.casefold())
    return "".join(c for c in plain if c.isalnum() and unicodedata.category(c) != "Lm")


def fold(text: str) -> str:
    """One form of a name part across scripts: as ``letters_of``, in Latin letters."""
    plain = letters_of("".join(CYRILLIC.get(c, c).replace("\0", "") for c in unicodedata.normalize("NFC", text.casefold())))
    for a, b in (("yo", "e"), ("ye", "e"), ("gh", "g"), ("zh", "j"), ("kh", "x"), ("q", "k")):
        plain = plain.replace(a, b)
    return plain


def forms(part: str) -> list[str]:
    """The keys of a part of a name: in its own script, where errors of typing are made, and in Latin letters."""
    return list(dict.fromkeys((letters_of(part), fold(part))))


def parse(name: str, nicknames: dict[str, list[str]]) -> tuple[bool, list[tuple[str, str, bool]]]:
    """(is an entity, keys) of a spelling; a key is (kind, key, whole): ``whole`` keys come from whole names.

    Kinds: ``F`` whole person, ``I`` initial and surname, ``T`` a single part, ``O`` whole organisation,
    ``A`` its initials, ``D`` its first and last words, ``B`` its words but the last.
    """
    text = unicodedata.normalize("NFKC", name).strip()
    text = re.sub(r"[«»“”„\"「」『』《》]", "", text)
    text = re.sub(r"\s+", " ", text).strip()
    if not any(c.isalpha() for c in text):
        return False, []
    han = re.fullmatch(r"[㐀-鿿 ·・‧•]+", text)
    if han:
        plain = re.sub(r"[ ·・‧•]", "", text)
        if plain in GENERIC:
            return False, []
        return True, _han_keys(plain, nicknames)
    if text.casefold() in GENERIC or not any(c.isupper() for c in text):
        return False, []
    words = text.replace(",", " , ").split()
    if words[0].casefold() == "the":
        words = words[1:]
    bare = [w.casefold().strip(".") for w in words]
    letters = [w for w in words if w != ","]
    if any(b in ORGANISATIONS for b in bare) and len(letters) > 1:
        return True, _organisation_keys(letters)
    if len(letters) == 1 and letters[0].isupper() and 2 <= len(letters[0]) <= 6 and letters[0].isalpha():
        keys = [("A", fold(letters[0]), False)]
        if len(letters[0]) >= 4:
            keys += [("T", k, False) for k in _full(letters[0], nicknames)]
        return True, keys
    joined = "".join(fold(w) for w in letters)
    if joined in nicknames and len(letters) > 1:  # a nickname of several words
        return True, [("T", q, False) for k in nicknames[joined] for q in forms(k)]
    kept = [w for w in letters if w.casefold().strip(".") not in TITLES or (len(letters) == 1)]
    for size in (2,):  # nicknames of two words before a surname
        if len(kept) == size + 1 and "".join(map(fold, kept[:size])) in nicknames:
            kept = ["".join(kept[:size]), kept[size]]
    titled = len(kept) < len(letters)
    initials = [w for w in kept if len(w.strip(".")) == 1]
    parts = [w for w in kept if len(w.strip(".")) > 1]
    if not parts:
        return True, []
    if len(parts) == 1:
        if initials:
            return True, list(dict.fromkeys(("I", f"{i[:1]} {q}", False) for i, q in zip(forms(initials[0]) * 2, forms(parts[0]))))
        if titled:
            return True, [("T", q, False) for q in forms(parts[0])]
        return True, [("T", k, False) for k in _full(parts[0], nicknames)]
    if len(parts) > 3:
        return True, [("O", " ".join(map(fold, letters)), True)]
    # a person: given name and surname in either order; of three parts the first and last count too
    pairs = [(g, s) for write in (letters_of, fold) for g in _full(parts[0], nicknames, write) for s in _full(parts[-1], nicknames, write)]
    keys: list[tuple[str, str, bool]] = []
    for a, b in pairs:
        keys += [("F", f"{a} {b}", True), ("F", f"{b} {a}", True), ("I", f"{a[:1]} {b}", True), ("I", f"{b[:1]} {a}", True), ("T", a, True), ("T", b, True)]
    # an initial may be that of the nickname's own spelling
    for write in (letters_of, fold):
        a, b = write(parts[0]), write(parts[-1])
        keys += [("I", f"{a[:1]} {b}", True), ("I", f"{b[:1]} {a}", True)]
    if len(parts) == 3:
        keys.append(("O", " ".join(map(fold, letters)), True))
    return True, list(dict.fromkeys(keys))


def _full(part: str, nicknames: dict[str, list[str]], write: Callable[[str], str] | None = None) -> list[str]:
    """The names that a part stands for, in one or both ways of writing them."""
    names = nicknames.get(fold(part), [part])
    return [write(x) for x in names] if write else list(dict.fromkeys(q for x in names for q in forms(x)))


def _han_keys(plain: str, nicknames: dict[str, list[str]]) -> list[tuple[str, str, bool]]:
    if plain.endswith(ORGANISATIONS_HAN) and len(plain) >= 4:
        body, kind = plain[:-2].removesuffix("有限"), plain[-2:]
        keys = [("O", body + kind, True)]
        if len(body) >= 4:
            return keys + [("D", body[:2] + kind, True), ("B", body, True)]
        return [("D", body + kind, False)]
    for title in TITLES_HAN:
        if plain.endswith(title) and len(plain) > len(title):
            plain = plain[: -len(title)]
            if len(plain) == 1:
                return [("T", plain, False)]
            break
    if len(plain) == 2 and plain[0] in "老小":
        return [("T", plain[1], False)]
    if plain in nicknames:
        return [("T", x, False) for x in nicknames[plain]]
    if len(plain) == 2:
        return [("T", plain, False)]
    if len(plain) == 3:
        given = plain[1:]
        given = (nicknames.get(given) or [given])[0]
        return [("F", plain[0] + given, True), ("T", plain[0], True), ("T", given, True)]
    if len(plain) == 4:
        return [("B", plain, False)]
    return [("O", plain, True)] if len(plain) > 1 else [("T", plain, False)]


def _organisation_keys(words: list[str]) -> list[tuple[str, str, bool]]:
    f = [fold(w) for w in words]
    last = words[-1].casefold()
    stem = f[-1]
    short = last.endswith(".") or "-" in last
    if short:
        # a shortened last word keeps its first letter
        return [("S", " ".join(f[:-1]) + " " + stem[:1], False)]
    keys = []
    if len(f) >= 3:
        keys += [("O", " ".join(f), True), ("D", f"{f[0]} {f[-1]}", True), ("D", " ".join([*f[:-2], f[-1]]), True), ("B", " ".join(f[:-1]), True), ("S", " ".join(f[:-1]) + " " + stem[:1], True), ("A", fold("".join(w[0] for w in words)), True)]
        keys += [("S", f"{f[0]} {stem[:1]}", True)]
    else:
        keys += [("D", " ".join(f), False)]
    return list(dict.fromkeys(keys))


def _one_error(a: str, b: str) -> bool:
    """At most one insertion, deletion, substitution or transposition of neighbours."""
    if a == b:
        return True
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])


def cells(left: DataFrame, right: DataFrame, group: list[str], radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """(home cell of each left key, cells of each right key): (*group, key, pivot, ring).

    A group of n keys has about sqrt(n) / 8 pivots, drawn by hash from its right side, and they go to its rows as one
    array. A key's home is its nearest pivot; a right key lies in every cell whose pivot is at most ``2 * radius`` farther
    than its own nearest one. ``ring`` is the distance to the cell's pivot: keys within the radius lie in rings
    within the radius (the triangle inequality again).
    """
    n = right.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.min_by("key", F.xxhash64("key")).alias("_first"))
    pivots = (
        right.join(n, group)
        .filter((F.col("key") == F.col("_first")) | (F.pmod(F.xxhash64("key", F.lit(1)), F.col("_n")) < F.floor(F.sqrt("_n") / 8)))
        .groupBy(*group)
        .agg(F.collect_set("key").alias("_pivots"))
    )

    def measured(side: DataFrame) -> DataFrame:
        far = F.transform("_pivots", lambda p: F.struct(F.levenshtein(F.col("key"), p).alias("ring"), p.alias("pivot")))
        return side.join(pivots, group).select(*group, "key", far.alias("_all")).withColumn("_home", F.array_min("_all"))

    home = measured(left).select(*group, "key", "_home.pivot", "_home.ring")
    near = measured(right).select(*group, "key", F.inline(F.filter("_all", lambda p: p["ring"] <= F.col("_home.ring") + 2 * radius)))
    return home, near.select(*group, "key", "pivot", "ring")


def radius_join(left: DataFrame, right: DataFrame, group: list[str], radius: int = RADIUS) -> DataFrame:
    """All pairs ``(*group, lkey, rkey, d)`` with an edit distance of at most ``radius`` within a group.

    ``left``, ``right``: distinct rows (*group, key). Exact: see ``cells``.
    """
    home, near = cells(left, right, group, radius)
    home, near = (side.withColumnRenamed("key", name).withColumnRenamed("ring", f"_{name}") for side, name in ((home, "lkey"), (near, "rkey")))
    within = (F.abs(F.col("_lkey") - F.col("_rkey")) <= radius) & (F.abs(F.length("lkey") - F.length("rkey")) <= radius)
    pairs = home.join(near, [*group, "pivot"]).filter(within).withColumn("d", F.levenshtein("lkey", "rkey", radius)).filter("d >= 0")
    return pairs.select(*group, "lkey", "rkey", "d")


def components(edges: DataFrame, nodes: DataFrame, rounds: int | None = None) -> DataFrame:
    """``(book_id, name, root)``: the smallest name of each connected component, by minimum labels with
    pointer jumping; ``edges``: (book_id, a, b). For books of any size. It goes on until no label changes;
    where ``rounds`` are not enough for that it is an error."""
    both = cut(edges.select("book_id", "a", "b").union(edges.select("book_id", F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    label = nodes.select("book_id", "name", F.col("name").alias("root"))
    for done in itertools.count(1):
        offered = both.join(label.select("book_id", F.col("name").alias("b"), "root"), ["book_id", "b"]).groupBy("book_id", F.col("a").alias("name")).agg(F.min("root").alias("_offer"))
        step = label.join(offered, ["book_id", "name"], "left").select("book_id", "name", "root", F.least("root", F.coalesce("_offer", "root")).alias("_new"))
        jump = step.select("book_id", F.col("name").alias("_new"), F.col("_new").alias("_far"))
        step = cut(step.join(jump, ["book_id", "_new"], "left").select("book_id", "name", "root", F.least("_new", F.coalesce("_far", "_new")).alias("_next")))
        changed = step.filter("root <> _next").limit(1).count()
        label = step.select("book_id", "name", F.col("_next").alias("root"))
        if not changed:
            return label
        if done == rounds:
            raise RuntimeError(f"components have not settled in {rounds} rounds")


def spellings(speakers: DataFrame, profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct (book_id, name) of all three fields, (book_id, profile, name) of the profiles)."""
    members = profiles.select("book_id", F.col("profile_id").alias("profile"), F.explode(F.concat(F.array("display_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    members = members.filter("name IS NOT NULL AND trim(name) <> '' AND book_id IS NOT NULL").distinct()
    spoken = speakers.select("book_id", F.col("speaker").alias("name")).filter("name IS NOT NULL AND trim(name) <> '' AND book_id IS NOT NULL")
    return spoken.union(members.select("book_id", "name")).distinct(), members


def nicknames_of(nickname_list: DataFrame) -> dict[str, list[str]]:
    """The full names of each nickname; a list of more than ``NICKNAMES`` rows is an error, as every task holds it."""
    rows = nickname_list.select("full_name", "nickname").filter("full_name <> '' AND nickname <> ''").distinct().limit(NICKNAMES + 1).collect()
    if len(rows) > NICKNAMES:
        raise ValueError(f"a list of more than {NICKNAMES} nicknames")
    nick: dict[str, list[str]] = {}
    for row in sorted(rows):
        han = re.match(r"[㐀-鿿]", row.nickname)
        nick.setdefault(row.nickname if han else fold(row.nickname), []).append(row.full_name)
    return nick


def name_keys(names: DataFrame, nick: dict[str, list[str]]) -> DataFrame:
    """``(book_id, name, kind, key, whole)`` of the spellings that name an entity."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for book, name in zip(pdf.book_id, pdf.name):
                entity, found = parse(name, nick)
                if entity:
                    rows += [(book, name, kind, key, whole) for kind, key, whole in found] or [(book, name, "", "", False)]
            yield pd.DataFrame(rows, columns=["book_id", "name", "kind", "key", "whole"])

    return names.mapInPandas(keys, "book_id bigint, name string, kind string, key string, whole boolean")


def link_names(speakers: DataFrame, profiles: DataFrame, nickname_list: DataFrame) -> DataFrame:
    """``(book_id, name, entity)``: each spelling with the smallest spelling of its entity.

    ``speakers``: (book_id, speaker); ``profiles``: (book_id, profile_id, display_name, aliases);
    ``nickname_list``: (lang, full_name, nickname), a fixed list. Null, empty and blank names, names
    without a letter, generic voices and rows without a book are no spellings. A redelivered profile adds
    nothing. A part of a name that fits several entities is linked only by its profile.
    """
    names, members = spellings(speakers, profiles)
    k = cut(name_keys(names, nicknames_of(nickname_list)))
    one_error = F.pandas_udf(lambda a, b: pd.Series([_one_error(x, y) for x, y in zip(a, b)]), "boolean")
    keyed = k.filter("key <> ''").select("book_id", "kind", "key").distinct()
    wholes = k.filter("whole AND key <> ''").select("book_id", "kind", "key").distinct()
    close = radius_join(keyed, wholes, ["book_id", "kind"])
    # what is short must be the same; two edits must be one transposition
    close = close.filter((F.col("d") == 0) | F.col("kind").isin("F", "I", "O", "T", "D", "B") & (F.length("lkey") >= TYPO_LENGTH) & (F.length("rkey") >= TYPO_LENGTH) & ~F.col("lkey").rlike("[\\x{3400}-\\x{9FFF}]"))
    close = cut(close.filter((F.col("d") < 2) | F.when(F.col("d") == 2, one_error("lkey", "rkey"))))

    nodes = k.select("book_id", "name").distinct()
    own = members.join(nodes, ["book_id", "name"], "left_semi")
    star = own.withColumn("a", F.min("name").over(Window.partitionBy("book_id", "profile"))).select("book_id", "a", F.col("name").alias("b"))
    whole_names = k.filter("whole AND kind IN ('F', 'O')").select("book_id", "kind", "key", "name").distinct()
    hub = cut(whole_names.groupBy("book_id", "kind", "key").agg(F.min("name").alias("hub")))
    same_key = whole_names.join(hub, ["book_id", "kind", "key"]).select("book_id", F.col("hub").alias("a"), F.col("name").alias("b"))
    across = (
        close.filter("kind IN ('F', 'O') AND lkey <> rkey")
        .join(hub.select("book_id", "kind", F.col("key").alias("lkey"), F.col("hub").alias("a")), ["book_id", "kind", "lkey"])
        .join(hub.select("book_id", "kind", F.col("key").alias("rkey"), F.col("hub").alias("b")), ["book_id", "kind", "rkey"])
        .select("book_id", "a", "b")
    )
    first = components(cut(star.union(same_key).union(across).filter("a <> b").distinct()), nodes)

    # parts of names: to the only entity they fit, unless their profile has told already
    rooted = cut(k.filter("key <> ''").join(first, ["book_id", "name"]))
    settled = rooted.filter("whole").select("book_id", "root").distinct()
    loose = cut(rooted.filter("NOT whole").join(settled, ["book_id", "root"], "left_anti").select("book_id", "name", "root", "kind", "key"))
    targets = rooted.filter("whole").select("book_id", "kind", F.col("key").alias("rkey"), F.col("root").alias("target")).distinct()
    fits = loose.withColumnRenamed("key", "lkey").join(close, ["book_id", "kind", "lkey"]).join(targets, ["book_id", "kind", "rkey"]).groupBy("book_id", "name", "root", "target").agg(F.min("d").alias("d"))
    nearest = cut(fits.groupBy("book_id", "name", "root").agg(F.min(F.struct("d", "target")).alias("best"), F.count_if(F.col("d") == 0).alias("exact"), F.count(F.lit(1)).alias("n")))
    only = nearest.filter("exact = 1 OR exact = 0 AND n = 1").select("book_id", F.col("best.target").alias("a"), F.col("root").alias("b"))
    # parts that fit nobody whole are one entity with their like
    unfit = loose.join(nearest.select("book_id", "name"), ["book_id", "name"], "left_anti").select("book_id", "kind", "key", "root").distinct()
    lone = unfit.withColumn("a", F.min("root").over(Window.partitionBy("book_id", "kind", "key"))).select("book_id", "a", F.col("root").alias("b"))
    roots = first.select("book_id", F.col("root").alias("name")).distinct()
    second = components(only.union(lone).filter("a <> b").distinct(), roots)
    return first.join(second.select("book_id", F.col("name").alias("root"), F.col("root").alias("entity")), ["book_id", "root"]).select("book_id", "name", "entity")


def spelling_pairs(linked: DataFrame) -> DataFrame:
    """``(book_id, name_a, name_b)``: every pair of spellings of one entity, ``name_a`` < ``name_b``, from rows of ``link_names``."""
    a, b = linked.select("book_id", "entity", F.col("name").alias("name_a")), linked.select("book_id", "entity", F.col("name").alias("name_b"))
    return a.join(b, ["book_id", "entity"]).filter("name_a < name_b").select("book_id", "name_a", "name_b")
