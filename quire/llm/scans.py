"""Print and scan noise: words cut at line ends, misread words, running headers, page numbers.

Each field is taken apart into lines. What is furniture and which lines are to be joined is told by
classifiers over pairs of neighbouring lines; misread words are corrected from the corpus itself:
candidates for a rare word come from an inverted join over its rarest character q-grams (a prefix
filter, so no pair within the distance is missed), and a gradient-boosted ranking chooses among them; where a
script has no words, three characters with one place open take the place of the grams, with a ranking of their own. All
models are trained here, on at most ``TRAIN`` rows drawn by hash that the data label themselves: lines equal to a
title of their book, line ends whose joined or hyphenated form the corpus knows, and frequent words
with the corpus's own confusions put into them. Counts, candidates and decisions cover all rows.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType

from quire.llm import boost
from quire.llm.names import radius_join
from quire.session import cut

TRAIN = 20_000
#: The most frequent confusions of the corpus that training words are misread with; only the training looks at them.
CONFUSIONS = 400
#: A candidate must be seen this often, and this many times as often as the word it replaces.
FREQUENT, RATIO = 4, 20
#: q-gram length and largest edit distance (a letter read as two costs two).
Q, DISTANCE = 2, 2

#: Words that open a chapter heading, and marks that cut a word at a line's end.
HEADINGS = r"(?:Глава|ГЛАВА|Часть|Chapter|CHAPTER|Part|Тарау|ТАРАУ|Бөлім|Bob|BOB|Bo[ʻ'’]lim)\s+[\dIVXLCivxlc]+|第[\d一二三四五六七八九十百]+[章回节]"
CUT_MARKS = "-‐‑\xad¬("
#: Characters that scanning takes for digits, and letters of two scripts that look the same.
_DIGITS = str.maketrans("lIіІ|OoОоSЅБбВBЗзgqZ", "11111000055668833992"[:20])
_LIKE = str.maketrans("аеосрухкнвмті01", "aeocpyxkhbmtiol")

_HEADING = regex.compile(rf"^\s*(?:{HEADINGS})\s*[.:]?\s*$")
_NUMBER = regex.compile(r"^[\s\-–—·•*\[\](){}|~.]*(?:(?:стр|с|page|p|pg|bet|б|бет|pag)\.?\s*|第\s*)?([\dlIіІ|OoОоSБВBЗзgqZ]{1,6}|[ivxlcIVXLC]{1,8})\s*(?:页|頁|-?бет|-?bet|б\.)?[\s\-–—·•*\[\](){}|~.]*$")
_BESIDE = regex.compile(r"^(.*?\S)\s{2,}(\S.{0,9}?)\s*$|^\s*(\S.{0,9}?)\s{2,}(\S.*?)\s*$")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:[ʻʼ'’`‘-][\p{L}\p{M}\p{N}]+)*ʻ?")
_HAN = regex.compile(r"\p{Han}+")
_TERMINAL = frozenset(".!?…。！？»”’\"'」,;:，；：、")
_CUT = regex.compile(rf"([\p{{L}}\p{{M}}ʻʼ'’-]*[\p{{L}}ʻʼ])([{re.escape(CUT_MARKS)}])[ \t\f]*$")
_RIGHT = regex.compile(r"^[ \t\f]*([\p{Ll}][\p{Ll}\p{M}ʻʼ'’]*(?:-[\p{L}]+)*)")
_FIELDS = "src string, row_id bigint, book_id bigint"


def _closed(text: str) -> bool:
    """Whether a line ends with a mark."""
    end = text.rstrip()
    return bool(end) and end[-1] in _TERMINAL


def _cut_of(line: str) -> regex.Match | None:
    """The word and the mark at a line's end where the word may be cut."""
    end = line.rstrip(" \t\f")
    return _CUT.search(line, max(0, len(end) - 400)) if end and end[-1] in CUT_MARKS else None


def skeleton(line: str) -> str:
    """A line for comparison: small letters and digits only, look-alikes and usual confusions made one."""
    return "".join(c for c in line.casefold().translate(_LIKE) if c.isalnum())


def roman(s: str) -> int:
    values = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
    total = 0
    for a, b in zip(s.lower(), [*s.lower()[1:], "i"]):
        total += -values[a] if values[a] < values[b] and len(s) > 1 else values[a]
    return total


def page_of(text: str, first: int, last: int) -> bool:
    """Whether a text is the printed number of one of the pages."""
    m = _NUMBER.match(text)
    if not m:
        return False
    n = m.group(1)
    if regex.fullmatch(r"[ivxlcIVXLC]+", n) and first <= roman(n) <= last:
        return True
    n = n.translate(_DIGITS)
    return n.isdigit() and first <= int(n) <= last


def rows_of_lines(blocks: list[str | None]) -> list[tuple[int, int, int, str]]:
    """(block, line in it, lines in it, line) of all lines."""
    out = []
    for i, block in enumerate(blocks):
        lines = re.split(r"\r\n?|\n", block or "")
        out += [(i, j, len(lines), line) for j, line in enumerate(lines)]
    return out


def fields(pages: DataFrame, variants: DataFrame) -> DataFrame:
    """``(src, row_id, book_id, first_page, last_page, blocks)`` of the three text fields; nulls and empty ones left out."""
    own = [F.col("row_id"), F.col("book_id")]
    parts = [pages.select(F.lit(f"pdf_pages.{f}").alias("src"), *own, F.col("page_number").alias("first_page"), F.col("page_number").alias("last_page"), F.col(f).alias("blocks")) for f in ("page_text", "text_from_images")]
    text = F.split("text", r"\n[ \t]*\n+")
    parts.append(variants.select(F.lit("pdf_text_variants.text").alias("src"), *own, "first_page", (F.col("first_page") + F.greatest(F.coalesce("page_count", F.lit(1)), F.lit(1)) - 1).alias("last_page"), text.alias("blocks")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).filter("size(blocks) > 0")


_TURN = str.maketrans(dict.fromkeys("`´‘’ʼ'", "ʻ"))


def _words(text: str) -> Iterator[str]:
    """The words of a text as they are counted: small letters, and three characters at a time of scripts without words."""
    wide = False
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        wide = bool(text) and max(text) >= "\u2e80"
    for w in _WORD.findall(text.lower()):
        if len(w) > 2 and not w.isdigit() and not (wide and _HAN.match(w)):
            yield w if w.isalpha() else w.translate(_TURN)
    if wide:
        for run in _HAN.findall(text):
            run = f"^{run}$"  # so that every character is in the middle once
            for q in range(len(run) - 2):
                yield run[q : q + 3]


#: What a line and its neighbours tell: see ``pair_features``.
PAIR = 9


def pair_features(before: str, line: str, after: str, first: bool, last: bool, page_edge: bool) -> list[float]:
    """A line against the lines above and below it: whether the text above goes on below it, how long they are, how it is set."""
    above, below = before.rstrip(), after.lstrip()
    open_above = float(bool(above) and not _closed(above))
    goes_on = float(bool(regex.match(r"\p{Ll}|\p{Han}", below)))
    letters = sum(c.isalpha() for c in line)
    return [
        open_above, goes_on, open_above * goes_on, min(len(above), 90) / 90, min(len(below), 90) / 90, min(len(line.strip()), 90) / 90,
        sum(c.isdigit() for c in line) / max(len(line.strip()), 1), sum(c.isupper() for c in line) / max(letters, 1), first + last + 2.0 * page_edge,
    ]


def _analyse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines that may be furniture, printed numbers, cut words, and the words of each line."""
    for batch in batches:
        rows: list[tuple] = []
        for src, row_id, book, first, last, blocks in zip(*(c.to_pylist() for c in batch.columns)):
            lines = rows_of_lines(blocks)
            n_blocks = len(blocks)
            after_heading = False
            # what each line is to a word cut above it: "" passed over, "line" passed over if it is a header, "stop" neither
            state = ["stop"] * len(lines)

            def emit(kind: str, at: int, a: str = "", b: str = "", x: float = 0.0, y: float = 0.0, z: float = 0.0, pair: list[float] | None = None, words: list[str] | None = None) -> None:
                rows.append((src, row_id, book, kind, at, a, b, x, y, z, pair, words))

            full = [k for k, x in enumerate(lines) if x[3].strip()]
            place = {k: n for n, k in enumerate(full)}

            def pair(k: int) -> list[float]:
                i, j, n, line = lines[k]
                at = place[k]
                before = lines[full[at - 1]][3] if at else ""
                after = lines[full[at + 1]][3] if at + 1 < len(full) else ""
                return pair_features(before, line, after, j == 0, j == n - 1, at in (0, len(full) - 1))

            spoken: list[int] = []
            for k, (i, j, n, line) in enumerate(lines):
                bare = line.strip()
                if not bare:
                    state[k] = ""
                    continue
                edge = j == 0 or j == n - 1
                if _HEADING.match(bare):
                    after_heading = True
                    continue
                if after_heading:
                    after_heading = False
                    if not _closed(bare):
                        emit("title", k, skeleton(bare), bare)
                        continue
                if edge or src.startswith("pdf_text"):
                    if first is not None and page_of(bare, first, last):
                        emit("number", k, pair=pair(k))
                        state[k] = ""
                        continue
                    if _NUMBER.match(bare):
                        emit("other", k, pair=pair(k))  # a number that is not the page's
                    rest = bare
                    m = _BESIDE.match(bare)
                    if m and first is not None:
                        text, number = (m.group(1), m.group(2)) if m.group(2) else (m.group(4), m.group(3))
                        if page_of(number, first, last):
                            emit("number", k, z=1.0, pair=pair(k))
                            rest = text
                        elif m.group(4) and page_of(m.group(3), first, last):
                            emit("number", k, z=1.0, pair=pair(k))
                            rest = m.group(4)
                        else:
                            left = regex.match(r"^\s*(\S.{0,9}?)\s{2,}(\S.*)$", bare)
                            if left and page_of(left.group(1), first, last):
                                emit("number", k, z=1.0, pair=pair(k))
                                rest = left.group(2)
                        if rest != bare:
                            state[k] = ""
                    if len(rest) <= 90 and (not _closed(rest) or rest != bare or rest.isupper()):
                        letters = [c for c in rest if c.isalpha()]
                        upper = sum(c.isupper() for c in letters) / max(len(letters), 1)
                        alone = float(n == 1)
                        where = float(i == 0 and j == 0 or i == n_blocks - 1 and j == n - 1)
                        if letters:
                            emit("line", k, skeleton(rest), rest, alone + 2 * where, upper, float(rest != bare), pair(k))
                            if rest == bare:
                                state[k] = "line"
                spoken.append(k)
            heads: dict[int, int] = {}  # length of the right half that a line begins with
            for k in spoken:
                line = lines[k][3]
                body = line
                m = None if (m := _cut_of(line)) and _NO_JOIN.search(line) else m
                passed: list[int] = []
                ends = []
                for t in range(k + 1, len(lines) if m else 0):
                    follow = lines[t][3]
                    if state[t] and (r := _RIGHT.match(follow)):
                        emit("cut", k, "\t".join((m.group(1), r.group(1), " ".join(map(str, passed)))), m.group(2), float(t))
                        ends.append((t, r))
                    if state[t] == "stop" or _cut_of(follow):
                        break
                    if state[t] == "line":
                        passed.append(t)
                if ends:
                    body = body[: m.start()]
                    # which end is right is told with the headers; the halves of no cut are words again then
                    for w in _words(m.group(1)):
                        emit("half", k, w, "", float(k), -1.0)
                    for t, r in ends:
                        heads[t] = r.end()
                        for w in _words(r.group(1)):
                            emit("half", t, w, "", float(k), float(t))
                if words := list(_words(body[heads.get(k, 0) :])):
                    emit("words", k, words=words)
        names = ["src", "row_id", "book_id", "kind", "at", "a", "b", "x", "y", "z", "pair", "words"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


_NO_JOIN = regex.compile(r"\s[-–—(]\s*$")
_PARTS = f"{_FIELDS}, kind string, at int, a string, b string, x double, y double, z double, pair array<double>, words array<string>"


def analyse(table: DataFrame) -> DataFrame:
    """The parts of all fields, one row each; written once, as several steps read them."""
    return cut(table.mapInArrow(_analyse, _PARTS))


def _drawn(seeds: DataFrame, features: list[str]) -> pd.DataFrame:
    """At most about ``TRAIN`` seed rows, drawn by a hash of their place."""
    n = max(seeds.count(), 1)
    share = F.lit((1 << 20) * min(1.0, TRAIN / n))
    return seeds.filter(F.pmod(F.xxhash64("src", "row_id", "at"), F.lit(1 << 20)) < share).select(*[F.col(f).cast("double").alias(f) for f in features], "label").toPandas()


def _with_pair(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The features of the pairs of lines as columns."""
    names = [f"p{i}" for i in range(PAIR)]
    return df.withColumns({n: F.coalesce(F.get("pair", F.lit(i)), F.lit(0.0)) for i, n in enumerate(names)}), names


def numbers(parts: DataFrame) -> DataFrame:
    """``(src, row_id, at)`` of the printed page numbers, told by a classifier over pairs of lines.

    Trained on numbers of their page at the edge of a block against numbers that are not their page's. What tells the seeds apart for sure is hidden in half of them.
    """
    told, names = _with_pair(parts.filter("kind IN ('number', 'other')"))
    told = cut(told.withColumn("right", (F.col("kind") == "number").cast("double")).withColumnRenamed("z", "beside").select("src", "row_id", "at", "right", "beside", *names))
    features = ["right", "beside", *names]
    seeds = told.withColumn("label", F.when((F.col("right") == 1) & (F.col("p8") >= 1), 1).when(F.col("right") == 0, 0)).filter("label IS NOT NULL")
    sample = _drawn(seeds, features)
    x, y = sample[features].to_numpy(float), sample.label.to_numpy(float)
    blind = x[::2].copy()
    blind[:, 0] = 0.5
    model = boost.fit(np.vstack([x, blind]), np.concatenate([y, y[::2]]))

    @F.pandas_udf("double")
    def odds(*columns: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.column_stack([c.to_numpy(float) for c in columns])))

    return told.filter("right = 1").withColumn("odds", odds(*features)).filter("odds > 0").select("src", "row_id", "at").distinct()


def headers(parts: DataFrame, books: DataFrame) -> DataFrame:
    """``(src, row_id, at)`` of the running headers, told by a classifier over pairs of lines.

    Titles are found by an exact radius join; that a line is near one is a feature, hidden in half of the seeds. A line that is
    near none must repeat in other fields.
    """
    clean = _vector(skeleton, StringType())
    known = books.select("book_id", F.explode(F.array("book_title", "author", F.concat_ws(". ", "author", "book_title"), F.concat_ws(" ", "book_title", "author"))).alias("t")).filter("t IS NOT NULL AND t <> ''").select("book_id", clean("t").alias("key"))
    titles = known.unionByName(parts.filter("kind = 'title'").select("book_id", F.col("a").alias("key"))).filter("length(key) > 1").distinct()
    lines, names = _with_pair(parts.filter("kind = 'line' AND length(a) > 1"))
    keys = lines.select("book_id", F.col("a").alias("key")).distinct()
    near = radius_join(keys, titles, ["book_id"]).filter("d = 0 OR length(lkey) >= 8 AND d <= 0.15 * length(lkey)").groupBy("book_id", F.col("lkey").alias("a")).agg(F.min("d").alias("d"))
    often = lines.groupBy("book_id", "a").agg(F.countDistinct("src", "row_id").alias("rows"))
    told = lines.join(often, ["book_id", "a"]).join(near, ["book_id", "a"], "left").withColumns({
        "near": F.col("d").isNotNull().cast("double"), "terminal": F.col("b").rlike(r"[.!?…。！？»”」,;:，；：]\s*$").cast("double"), "chars": F.length("a").cast("double"),
        "often": F.least(F.col("rows"), F.lit(5)).cast("double"),  # beyond a few repetitions more say nothing
    })
    features = ["near", "x", "y", "z", "often", "terminal", "chars", *names]
    told = cut(told.select("src", "row_id", "at", "d", *features))
    lone = F.col("x").isin(1.0, 3.0)
    seeds = told.withColumn("label", F.when(F.col("d") == 0, 1).when(F.col("d").isNull() & ~lone, 0)).filter("label IS NOT NULL")
    sample = _drawn(seeds, features)
    x, y = sample[features].to_numpy(float), sample.label.to_numpy(float)
    blind = x[::2].copy()
    blind[:, 0] = 0.0
    model = boost.fit(np.vstack([x, blind]), np.concatenate([y, y[::2]]))

    @F.pandas_udf("double")
    def odds(*columns: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.column_stack([c.to_numpy(float) for c in columns])))

    return told.withColumn("odds", odds(*features)).filter("odds > 0 AND (near = 1 OR often > 1)").select("src", "row_id", "at").distinct()


def whole_cuts(parts: DataFrame, running: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cuts, words): cuts whose word goes on in the next line that is no furniture, and the words of the halves of all others.

    A cut names the line where its word may go on (``x``) and the lines between that may be headers.
    """
    line = ["src", "row_id", "at"]
    cuts = parts.filter("kind = 'cut'").select(*line, "a", "b", F.col("x").cast("int").alias("end"), F.split(F.split("a", "\t")[2], " ").alias("passed"))
    heads = running.select("src", "row_id", F.col("at").alias("head"))
    passed = cuts.select(*line, "end", F.explode("passed").alias("head")).filter("head <> ''").withColumn("head", F.col("head").cast("int"))
    spoken = passed.join(heads, ["src", "row_id", "head"], "left_anti").select(*line, "end").distinct()
    cuts = cut(cuts.drop("passed").join(spoken, [*line, "end"], "left_anti").join(heads.withColumnRenamed("head", "end"), ["src", "row_id", "end"], "left_anti"))
    halves = parts.filter("kind = 'half'").select(*line, F.col("a").alias("word"), F.col("x").cast("int").alias("_at"), F.col("y").cast("int").alias("_end"))
    taken = cuts.select("src", "row_id", F.col("at").alias("_at"), F.explode(F.array("end", F.lit(-1))).alias("_end"))
    words = halves.join(taken, ["src", "row_id", "_at", "_end"], "left_anti").join(running, line, "left_anti")
    return cuts, words.groupBy(*line, "word").agg(F.count(F.lit(1)).cast("int").alias("k"))


def cut_words(cuts: DataFrame, counts: DataFrame) -> DataFrame:
    """``(src, row_id, at, joined)`` of line ends where a word is cut by a mark that is not its own."""
    pair = F.split("a", "\t")
    lower = lambda c: F.lower(F.regexp_replace(c, "[`´‘’ʼ']", "ʻ"))
    cuts = cuts.select("src", "row_id", "at", F.col("b").alias("mark"), lower(pair[0]).alias("l"), lower(pair[1]).alias("r"))
    cuts = cuts.withColumns({"joined": F.concat("l", "r"), "hyphened": F.concat_ws("-", "l", "r")})
    vocabulary = counts.select(F.col("word"), F.col("n"))
    asked = cuts.select(F.explode(F.array("l", "r", "joined", "hyphened")).alias("word")).distinct()
    known = cut(vocabulary.join(asked, "word"))
    for c in ("l", "r", "joined", "hyphened"):
        cuts = cuts.join(known.select(F.col("word").alias(c), F.col("n").alias(f"n_{c}")), c, "left").fillna(0, [f"n_{c}"])
    cuts = cut(cuts.select("src", "row_id", "at", "mark", "joined", F.length("l").alias("len_l"), F.length("r").alias("len_r"), *[F.log1p(f"n_{c}").alias(f"n_{c}") for c in ("l", "r", "joined", "hyphened")]))
    features = ["n_l", "n_r", "n_joined", "n_hyphened", "len_l", "len_r"]
    seeds = cuts.filter("mark NOT IN ('\\u00ad', '¬', '(')").withColumn("label", F.when((F.col("n_joined") > F.log1p(F.lit(4))) & (F.col("n_hyphened") == 0), 1).when((F.col("n_hyphened") > F.log1p(F.lit(2))) & (F.col("n_joined") == 0), 0)).filter("label IS NOT NULL")
    n = max(seeds.count(), 1)
    sample = seeds.filter(F.pmod(F.xxhash64("src", "row_id", "at"), F.lit(1 << 20)) < F.lit((1 << 20) * min(1.0, TRAIN / n))).select(*[F.col(f).cast("double") for f in features], "label").toPandas()
    # what the seeds are told by is hidden in half of them, so the rest is learned too
    x, y = sample[features].to_numpy(float), sample.label.to_numpy(float)
    blind = x.copy()
    blind[:, 2:4] = 0
    model = boost.fit(np.vstack([x, blind]), np.concatenate([y, y]))

    @F.pandas_udf("double")
    def odds(*columns: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.column_stack([c.to_numpy(float) for c in columns])))

    # where neither part is a word anywhere, nothing but a cut explains them
    sure = F.col("mark").isin("\xad", "¬", "(") | (F.col("n_l") == 0) & (F.col("n_r") == 0) & (F.col("n_hyphened") == 0)
    return cuts.withColumn("odds", odds(*[F.col(f).cast("double") for f in features])).filter(sure | (F.col("odds") > 0) & ~((F.col("n_hyphened") > 0) & (F.col("n_joined") == 0))).select("src", "row_id", "at", "joined")


def edit_operation(right: str, wrong: str) -> str:
    """What was read instead of what, as ``right>wrong`` without common ends."""
    i = 0
    while i < min(len(right), len(wrong)) and right[i] == wrong[i]:
        i += 1
    j = 0
    while j < min(len(right), len(wrong)) - i and right[len(right) - 1 - j] == wrong[len(wrong) - 1 - j]:
        j += 1
    return f"{right[i:len(right) - j]}>{wrong[i:len(wrong) - j]}"


def single_operations(right: str, wrong: str) -> list[str]:
    """The substitutions that make ``wrong`` of ``right``: one, which may change the length, or up to ``DISTANCE``
    of one character each; none where something is only added or left out."""
    if len(right) == len(wrong):
        ops = [f"{a}>{b}" for a, b in zip(right, wrong) if a != b]
        # words of fewer than four letters need not share a gram with one of two differences
        return ops if len(ops) <= (DISTANCE if len(wrong) > 3 else 1) else []
    op = edit_operation(right, wrong)
    return [op] if len(op) <= 4 and not op.startswith(">") and not op.endswith(">") else []


def _vector(f: Callable, kind: DataType) -> Callable:
    """A function of texts over Arrow batches; a null gives null."""

    @F.pandas_udf(kind)
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([f(*row) if None not in row else None for row in zip(*columns)], dtype=object)

    return run


def corrections(counts: DataFrame) -> DataFrame:
    """``(word, right)``: misread words of a table ``(word, n)`` of all words, and what they are to be."""
    words = counts.filter("length(word) >= 3 AND NOT word RLIKE '^[0-9]+$'")
    marked = words.withColumn("han", F.col("word").rlike(r"\p{IsHan}"))
    # q-grams of both sides, rarest first; two words within DISTANCE share one of the first Q * DISTANCE + 1
    rare = marked.filter("NOT han")
    gram = lambda c: F.transform(F.sequence(F.lit(0), F.length(c) - 1), lambda i: F.substring(F.concat(F.lit("^"), c, F.lit("$")), i + 1, Q))
    grams = rare.select("word", "n", F.explode(F.array_distinct(gram(F.col("word")))).alias("g"))
    weight = grams.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    place = F.row_number().over(Window.partitionBy("word").orderBy("df", "g"))
    prefix = cut(grams.join(weight, "g").withColumn("place", place).filter(F.col("place") <= Q * DISTANCE + 1).select("word", "n", "g"))
    left = prefix.select(F.col("word"), F.col("n").alias("n_word"), "g", F.length("word").alias("lw"))
    right = prefix.filter(F.col("n") >= FREQUENT).select(F.col("word").alias("right"), F.col("n").alias("n_right"), "g", F.length("word").alias("lr"))
    found = left.join(right, "g").filter((F.abs(F.col("lw") - F.col("lr")) <= 1) & (F.col("n_right") >= RATIO * F.col("n_word")) & (F.col("word") != F.col("right")))
    pairs = found.select("word", "right", "n_word", "n_right").distinct().filter(F.levenshtein("word", "right", DISTANCE) > 0)
    operation = _vector(single_operations, ArrayType(StringType()))
    # words of one script; mixed ones are another problem's
    mixed = F.col("word").rlike(r"\p{IsLatin}") & F.col("word").rlike(r"\p{IsCyrillic}") | F.col("word").rlike(r"[\p{IsGreek}\p{Cf}]")
    pairs = cut(pairs.filter(~mixed).withColumn("ops", operation("right", "word")).filter(F.size("ops") > 0))
    spread = cut(pairs.filter(F.size("ops") == 1).groupBy(F.col("ops")[0].alias("op")).agg(F.countDistinct("right").alias("op_words")))
    # every operation of a word needs its own support; the weakest counts
    pairs = pairs.withColumns({"op": F.col("ops")[0], "op_2": F.get("ops", F.lit(1))}).join(spread, "op").join(spread.select(F.col("op").alias("op_2"), F.col("op_words").alias("op_words_2")), "op_2", "left")
    pairs = pairs.withColumn("op_words", F.when(F.col("op_2").isNull(), F.col("op_words")).otherwise(F.least("op_words", F.coalesce("op_words_2", F.lit(1)))))
    pairs = pairs.filter((F.col("op_words") >= 3) | F.col("word").rlike(r"\p{L}\d|\d\p{L}")).select("word", "right", "n_right", "op_words")
    # the corpus's own confusions: operations between a rare and a frequent word that many words share
    operations = {r.op: r.op_words for r in spread.filter("op_words >= 3").orderBy(F.desc("op_words"), "op").limit(CONFUSIONS).toLocalIterator()}
    n = max(rare.filter(F.col("n") >= FREQUENT).count(), 1)
    vocabulary = [r.word for r in rare.filter(F.col("n") >= FREQUENT).filter(F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < F.lit((1 << 20) * min(1.0, TRAIN / n))).orderBy("word").toLocalIterator()]
    model = _ranker(vocabulary, operations)

    @F.pandas_udf("double")
    def odds(word: pd.Series, right: pd.Series, op_words: pd.Series) -> pd.Series:
        if not len(word):
            return pd.Series([], dtype=float)
        return pd.Series(model.score(np.array([_features(w, r, o) for w, r, o in zip(word, right, op_words)], float)))

    ranked = pairs.withColumn("odds", odds("word", "right", "op_words")).filter("odds > 0")
    best = ranked.groupBy("word").agg(F.max_by("right", F.struct("odds", "n_right", "right")).alias("right"))
    return best.unionByName(_han_corrections(marked.filter("han").select("word", "n")))


def _han_corrections(words: DataFrame) -> DataFrame:
    """``(word, right)`` in scripts without words: three characters of a run, ``^`` and ``$`` standing for its ends.

    Candidates come from a join over the grams that are left with one place open: first, middle or last. A wrong
    character must be ``RATIO`` times as rare as the right one. The ranking is told by the share of a wrong
    character's places that one right character explains, which is hidden in half of its training rows.
    """
    three = words.filter(F.col("word").rlike(r"^[\^\p{IsHan}]\p{IsHan}[$\p{IsHan}]$"))
    slots = F.array(*[F.struct(F.lit(i).alias("slot"), F.substring("word", i + 1, 1).alias("c"), F.concat(F.substring("word", 1, i), F.lit("_"), F.substring("word", i + 2, 3)).alias("frame")) for i in range(3)])
    grams = cut(three.select("word", "n", F.inline(slots)).filter("NOT c IN ('^', '$')"))
    single = grams.groupBy("c").agg(F.sum("n").alias("n_c"))
    grams = grams.join(single, "c")
    left = grams.select("word", F.col("n").alias("n_word"), "slot", "frame", "c", "n_c")
    right = grams.filter(F.col("n") >= FREQUENT).select(F.col("word").alias("right"), F.col("n").alias("n_right"), "slot", "frame", F.col("c").alias("rc"), F.col("n_c").alias("n_rc"))
    pairs = left.join(right, ["slot", "frame"]).filter((F.col("c") != F.col("rc")) & (F.col("n_c") * RATIO <= F.col("n_rc")) & (F.col("n_right") >= FREQUENT * F.col("n_word")))
    pairs = cut(pairs.withColumn("op", F.concat_ws(">", "rc", "c")).drop("frame"))
    spread = pairs.groupBy("op", "c").agg(F.countDistinct("right").alias("op_words"), F.countDistinct("slot").alias("slots"), (F.sum("n_word") / F.first("n_c")).alias("share")).filter("op_words >= 3")
    spread = spread.join(spread.groupBy("c").agg(F.max("share").alias("top")), "c").drop("c")
    features = ["op_words", "slots", "share", "char_ratio", "word_ratio", "slot", "at_end"]
    told = pairs.join(spread, "op").withColumns({"op_words": F.log1p("op_words"), "char_ratio": F.log(F.col("n_rc") / F.col("n_c")), "word_ratio": F.log(F.col("n_right") / F.col("n_word")), "at_end": F.col("word").rlike(r"[\^$]")})
    told = cut(told.select("word", "right", "n_right", "top", *[F.col(f).cast("double") for f in features]))
    seeds = told.withColumn("label", F.when(F.col("share") < F.when(F.col("top") >= 1 - 1 / FREQUENT, F.col("top")).otherwise(0.5), 0).when(F.col("share") >= 1 - 1 / FREQUENT, 1)).filter("label IS NOT NULL")
    n = max(seeds.count(), 1)
    sample = seeds.filter(F.pmod(F.xxhash64("word", "right"), F.lit(1 << 20)) < F.lit((1 << 20) * min(1.0, TRAIN / n))).orderBy("word", "right").select(*features, "label").toPandas()
    x, y = sample[features].to_numpy(float), sample.label.to_numpy(float)
    blind = x.copy()
    blind[:, 2] = 0.5
    model = boost.fit(np.vstack([x, blind]), np.concatenate([y, y]))

    @F.pandas_udf("double")
    def odds(*columns: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.column_stack([c.to_numpy(float) for c in columns])))

    return told.withColumn("odds", odds(*features)).filter("odds > 0").groupBy("word").agg(F.max_by("right", F.struct("odds", "share", "n_right", "right")).alias("right"))


def _features(word: str, right: str, op_words: int) -> tuple[float, ...]:
    ops = single_operations(right, word) or [edit_operation(right, word)]
    a, _, b = ops[0].partition(">")
    at = next((i for i, (x, y) in enumerate(zip(word, right)) if x != y), min(len(word), len(right)))
    inner_digit = float(bool(regex.search(r"\p{L}\d|\d\p{L}", word)))
    return (np.log1p(float(op_words)), inner_digit, float(len(word)), at / max(len(word), 1), float(len(a)), float(len(b)), float(b.isdigit()), float(at == 0), float("-" in word), float(len(ops)))


def _ranker(vocabulary: list[str], operations: dict[str, int]) -> boost.Boosted:
    """Trained on frequent words: with a confusion put in (1), and against their frequent neighbours (0)."""
    rng = random.Random(5)
    known = set(vocabulary)
    x, y = [], []
    ops = [(o.partition(">")[0], o.partition(">")[2], n) for o, n in operations.items() if o.partition(">")[0]]
    strong = [(a, b, n) for a, b, n in ops if n >= max(3, 0.05 * max((n for *_, n in ops), default=0))]
    for word in vocabulary:
        fits = [(a, b, n) for a, b, n in strong if a in word]
        if fits:
            a, b, n = rng.choices(fits, [n for *_, n in fits])[0]
            i = rng.choice([m.start() for m in re.finditer(re.escape(a), word)])
            wrong = word[:i] + b + word[i + len(a) :]
            if wrong not in known:
                x.append(_features(wrong, word, n))
                y.append(1.0)
            # and a second one in every other word, where it has room
            again = [(c, d, m, q) for c, d, m in strong for q in range(len(word)) if len(c) == len(d) == len(a) == len(b) == 1 and word[q] == c and q != i]
            if len(word) > 3 and again and rng.random() < 0.5:
                c, d, m, q = rng.choices(again, [m for _, _, m, _ in again])[0]
                twice = wrong[:q] + d + wrong[q + 1 :]
                if twice not in known:
                    x.append(_features(twice, word, min(n, m)))
                    y.append(1.0)
    shapes: dict[str, list[str]] = {}
    for word in vocabulary:
        for i in range(len(word)):
            shapes.setdefault(word[:i] + "*" + word[i + 1 :], []).append(word)
    for group in shapes.values():
        for w, r in zip(group, group[1:]):
            for p, q in ((w, r), (r, w)):
                x.append(_features(p, q, operations.get(edit_operation(q, p), 1)))
                y.append(0.0)
    doubles: dict[str, list[str]] = {}
    for word in vocabulary[::4]:
        for i in range(len(word)):
            for j in range(i + 1, len(word)):
                doubles.setdefault(word[:i] + "*" + word[i + 1 : j] + "*" + word[j + 1 :], []).append(word)
    for group in doubles.values():
        for w, r in zip(group, group[1:]):
            for p, q in ((w, r), (r, w)):
                if len(ops := single_operations(q, p)) == 2:
                    x.append(_features(p, q, min(operations.get(o, 1) for o in ops)))
                    y.append(0.0)
    # a letter that the ranking has only seen once or twice replaced is no confusion
    for word in vocabulary[::2]:
        i = rng.randrange(len(word))
        c = rng.choice(rng.choice(vocabulary))
        if c != word[i]:
            wrong = word[:i] + c + word[i + 1 :]
            x.append(_features(wrong, word, min(2, operations.get(edit_operation(word, wrong), 1))))
            y.append(0.0)
    return boost.fit(np.array(x, float).reshape(len(x), 10), np.array(y, float))


def find_noise(table: DataFrame, books: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(page numbers, headers, cuts, misread (src, row_id, at, word, right), parts) of the fields of ``fields``."""
    parts = analyse(table)
    paged = cut(numbers(parts))
    running = cut(headers(parts, books))
    ends, halves = whole_cuts(parts, running)
    body = parts.filter("kind = 'words'").select("src", "row_id", "at", "words").join(running, ["src", "row_id", "at"], "left_anti")
    counts = cut(body.select(F.explode("words").alias("word"), F.lit(1).alias("k")).unionByName(halves.select("word", "k")).groupBy("word").agg(F.sum("k").alias("n")))
    cuts = cut(cut_words(ends, counts))
    each = body.select("src", "row_id", "at", F.explode(F.array_distinct("words")).alias("word"))
    whole = each.unionByName(halves.select("src", "row_id", "at", "word")).unionByName(cuts.select("src", "row_id", "at", F.col("joined").alias("word")))
    counts = cut(whole.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    wrong = cut(corrections(counts))
    misread = whole.join(wrong, "word").select("src", "row_id", "at", "word", "right").distinct()
    return paged, running, cuts, misread, parts


def noise(table: DataFrame, books: DataFrame) -> DataFrame:
    """``(src, row_id, noise)``: a row per field and kind of noise in it."""
    paged, running, cuts, misread, _ = find_noise(table, books)
    named = [(paged, "page_number"), (running, "header"), (cuts, "hyphen"), (misread, "misread")]
    out = None
    for rows, name in named:
        part = rows.select("src", "row_id", F.lit(name).alias("noise")).distinct()
        out = part if out is None else out.unionByName(part)
    return out


def paragraphs(table: DataFrame, books: DataFrame) -> DataFrame:
    """``(src, row_id, text)``: each field as continuous paragraphs, without furniture, words joined and corrected."""
    paged, running, cuts, misread, _ = find_noise(table, books)
    drop = running.unionByName(paged).groupBy("src", "row_id").agg(F.collect_set("at").alias("drop"))
    join = cuts.groupBy("src", "row_id").agg(F.collect_set("at").alias("join"))
    fix = misread.groupBy("src", "row_id").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("word", "right")))).alias("fix"))
    # furniture beside a number is one line, so what is dropped is dropped whole
    rows = table.select("src", "row_id", "blocks").join(drop, ["src", "row_id"], "left").join(join, ["src", "row_id"], "left").join(fix, ["src", "row_id"], "left")

    def rebuild(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = []
            for blocks, gone, joined, fixes in zip(pdf.blocks, pdf["drop"], pdf["join"], pdf.fix):
                gone = set() if gone is None else set(gone)
                joined = set() if joined is None else set(joined)
                fixes = dict(fixes) if fixes is not None else {}
                han = [(_run_pattern(w), r.strip("^$")) for w, r in fixes.items() if regex.search(r"\p{Han}", w)]
                done: list[str] = []
                glue = True
                for k, (_, j, _, line) in enumerate(rows_of_lines(list(blocks))):
                    if k in gone or not line.strip():
                        continue
                    line = line.strip()
                    for pattern, right in han:
                        line = pattern.sub(right, line)
                    if j == 0 and not glue or not done:
                        done.append("")
                    heading = bool(_HEADING.match(line))
                    space = "" if not done[-1] or glue else "" if regex.search(r"[\p{Han}，。、；：？！”」]$", done[-1]) and regex.match(r"[\p{Han}“「《]", line) else " "
                    glue = k in joined
                    if glue:
                        line = _CUT.sub(r"\1", line)
                    done[-1] += space + line + ("\n" if heading else "")
                text = "\n\n".join(d.strip() for d in done if d.strip())
                if fixes:
                    text = _WORD.sub(lambda m: _case(m.group(), fixes.get(m.group().lower())), text)
                texts.append(text)
            yield pd.DataFrame({"src": pdf.src, "row_id": pdf.row_id, "text": texts})

    return rows.mapInPandas(rebuild, "src string, row_id bigint, text string")


def _run_pattern(word: str) -> regex.Pattern:
    """Three characters of a run; ``^`` and ``$`` match at its ends only."""
    return regex.compile((r"(?<!\p{Han})" if word[0] == "^" else "") + regex.escape(word.strip("^$")) + (r"(?!\p{Han})" if word[-1] == "$" else ""))


def _case(word: str, right: str | None) -> str:
    if right is None:
        return word
    return right.upper() if word.isupper() else right[:1].upper() + right[1:] if word[:1].isupper() else right
