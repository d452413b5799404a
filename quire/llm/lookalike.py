"""One consistent form for text that looks the same but is written with different characters.

Strings and code points are the nodes of a union-find structure: compatibility forms, decomposed
letters, radicals, spaces, apostrophes and look-alikes of other scripts are united with what they look like, and the
classes are transitive (full-width ａ, Latin a, Cyrillic а and Greek α are one). In a class each script has one
representative, the member that the corpus uses most, each count being weighed by how usual its form (plain, full-width,
decomposed ...) is in the whole corpus. Which script's representative stands in a word is decided by frequency, too: the
script of most of the word's letters that have no twin, else the spelling whose neighbours the corpus knows best. The
texts are rewritten greedily, leftmost longest, with an automaton over all members that are no
representatives (Aho-Corasick).

Rows are first sifted as vectors of code points, so only rows that hold a variant reach the automaton.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.codepoints import GAP, batched, codes
from quire.llm.encoding import wrong_rows
from quire.llm.pairs import PairModel

FORMS = ("compat", "combining", "invisible", "space", "lookalike")
COMPAT, COMBINING, INVISIBLE, SPACE, LOOKALIKE = (1, 2, 4, 8, 16)

#: Letters of Latin, Cyrillic and Greek that look the same, one column per script; a dot where a script has none.
TWINS = (
    ("A", "А", "Α"), ("B", "В", "Β"), ("C", "С", "Ϲ"), ("E", "Е", "Ε"), ("H", "Н", "Η"), ("I", "І", "Ι"), ("J", "Ј", "Ϳ"), ("K", "К", "Κ"),
    ("M", "М", "Μ"), ("N", ".", "Ν"), ("O", "О", "Ο"), ("P", "Р", "Ρ"), ("S", "Ѕ", "."), ("T", "Т", "Τ"), ("X", "Х", "Χ"), ("Y", "У", "Υ"),
    ("Z", ".", "Ζ"), ("a", "а", "α"), ("c", "с", "ϲ"), ("e", "е", "."), ("h", "һ", "."), ("i", "і", "ι"), ("j", "ј", "ϳ"), ("k", "к", "κ"),
    ("o", "о", "ο"), ("p", "р", "ρ"), ("s", "ѕ", "."), ("v", "ѵ", "ν"), ("x", "х", "χ"), ("y", "у", "γ"), ("q", "ԛ", "."), ("w", "ԝ", "ω"),
    ("d", "ԁ", "."), ("u", "ս", "υ"), ("g", "ɡ", "."), ("n", "ո", "η"), ("l", "ӏ", "."), ("ä", "ӓ", "."), ("ë", "ё", "."), ("ï", "ї", "ϊ"), ("ö", "ӧ", "."),
)
#: Marks that stand for the turned comma of oʻ and gʻ.
APOSTROPHES = "'`´‘’ʼʹʽˈ′ˊ"
TURNED_COMMA = "ʻ"
#: Those among them that are no quotation marks.
_NO_QUOTES = "`´ʼʹʽˈ′ˊ"
#: Endings after o' and g' that make an English word of it.
_ENGLISH = regex.compile(r"(?:s|d|ll|re|ve|t|m|er|clock)?\b(?!\p{L})", regex.I)


class UnionFind:
    """Disjoint sets of strings."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def script_of(c: str) -> str:
    name = unicodedata.name(c, "").removeprefix("FULLWIDTH ").replace("KANGXI", "CJK")
    for s in ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "CJK"):
        if name.startswith(s):
            return s
    return ""


class Classes:
    """The look-alike classes of a corpus and the tables made from them.

    ``plain``: the representative of every member that is none itself, with ``kind`` for what makes it differ;
    ``scripts``: of a letter of a class with several scripts, the representative in each.
    """

    def __init__(self, model: PairModel) -> None:
        sets = UnionFind()
        self.kind: dict[str, int] = {}
        for cp in range(0x80, 0x30000):
            c = chr(cp)
            category = unicodedata.category(c)
            if category in ("Cn", "Cs", "Co"):
                continue
            if category == "Zs":
                self._add(sets, c, " ", SPACE)
                continue
            if category == "Cf" and not (0x600 <= cp < 0x900) and cp not in (0x110BD, 0x110CD) or 0xFE00 <= cp < 0xFE10:
                self._add(sets, c, "", INVISIBLE)
                continue
            shape = unicodedata.decomposition(c)
            if not shape:
                continue
            plain = unicodedata.normalize("NFKC", c)
            if shape.startswith("<wide>") and plain.isascii() and plain.isalnum():
                self._add(sets, c, plain, COMPAT)
            elif shape.startswith("<compat>") and category in ("Ll", "Lu", "Lt") and len(plain) > 1 and plain.isalpha():
                self._add(sets, c, plain, COMPAT)
            elif shape.startswith("<compat>") and 0x2E80 <= cp < 0x2FE0:
                self._add(sets, c, plain, LOOKALIKE)
            elif 0xF900 <= cp < 0xFB00 or 0x2F800 <= cp < 0x2FA20:
                self._add(sets, c, plain, LOOKALIKE)
            elif not shape.startswith("<") and category[0] == "L" and plain == c:
                parts = unicodedata.normalize("NFD", c)
                if len(parts) > 1 and unicodedata.normalize("NFC", parts) == c and all(0x300 <= ord(m) < 0x370 for m in parts[1:]):
                    self._add(sets, parts, c, COMBINING)
                    base = unicodedata.normalize("NFC", parts[:-1])
                    if len(base) == 1:
                        self._add(sets, base + parts[-1], c, COMBINING)
        for row in TWINS:
            members = [c for c in row if c != "."]
            for c in members:
                sets.union(c, members[0])
        for letter in "oOgG":
            for mark in APOSTROPHES:
                self._add(sets, letter + mark, letter + TURNED_COMMA, LOOKALIKE)
        classes: dict[str, list[str]] = {}
        for member in list(sets.up):
            classes.setdefault(sets.find(member), []).append(member)
        count = {m: model.count(m) for ms in classes.values() for m in ms}
        usual: dict[int, float] = {}
        for m, n in count.items():
            usual[self.kind.get(m, 0)] = usual.get(self.kind.get(m, 0), 1.0) + n
        weight = lambda m: ((count[m] + 0.5) * usual[self.kind.get(m, 0)], m)
        self.plain: dict[str, str] = {}
        self.scripts: dict[str, dict[str, str]] = {}
        self.turned: dict[str, str] = {}
        for members in classes.values():
            by_script: dict[str, list[str]] = {}
            for m in members:
                by_script.setdefault(script_of(m[0]) if m else "", []).append(m)
            best = {s: max(ms, key=weight) for s, ms in by_script.items()}
            for s, ms in by_script.items():
                for m in ms:
                    if m != best[s] and m not in ("", " "):
                        self.plain[m] = best[s]
                        self.kind.setdefault(m, self.kind.get(best[s], 0) or LOOKALIKE)
            if len(best) > 1:
                self.scripts.update({m: best for m in members if len(m) == 1})
        # what an apostrophe is depends on what stands around it, so these are no words of the automaton
        for m in [m for m in self.plain if m[0] in "oOgG" and m[1:] in (*APOSTROPHES, TURNED_COMMA)]:
            self.turned[m] = self.plain.pop(m)
        self.sets = sets
        self.automaton = ahocorasick.Automaton()
        for variant, plain in self.plain.items():
            self.automaton.add_word(variant, (variant, plain, self.kind[variant]))
        self.automaton.make_automaton()
        self.kinds, self.letters = self._tables()

    def _add(self, sets: UnionFind, variant: str, plain: str, kind: int) -> None:
        if variant == plain or variant in self.kind:
            return
        sets.find(variant), sets.find(plain)
        sets.union(variant, plain)
        self.kind[variant] = kind

    def _tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Per code point: the kind of variant it is alone (or may begin, for combining marks), and a letter's script:
        1 Latin, 2 Cyrillic, 4 Greek or Armenian, with 8 added if it has no twin."""
        kind = np.zeros(GAP + 1, np.uint8)
        for variant in self.plain:
            kind[ord(variant) if len(variant) == 1 else ord(variant[-1])] |= self.kind[variant]
        script = np.zeros(GAP + 1, np.uint8)
        bits = {"LATIN": 1, "CYRILLIC": 2, "GREEK": 4, "ARMENIAN": 4}
        for cp in range(0x41, 0x600):
            c = chr(cp)
            if c.isalpha() and (s := script_of(c)) in bits:
                script[cp] = bits[s] | (0 if c in self.scripts else 8)
        return kind, script


def classes(model: PairModel) -> Classes:
    """The classes of a model's corpus, made once per process."""
    made = getattr(model, "_classes", None)
    if made is None:
        made = model._classes = Classes(model)
    return made


_LETTERS = regex.compile(r"[\p{Latin}\p{Cyrillic}\p{Greek}\p{Armenian}]+")
_TURNED = regex.compile(rf"(?<=[oOgG])[{APOSTROPHES}](?=(\p{{Latin}}*))")


def _spaces_right(text: str, at: int) -> bool:
    """An ideographic space is right where it opens a paragraph, in front of its text."""
    i = at
    while i > 0 and text[i - 1] == "　":
        i -= 1
    return i == 0 or text[i - 1] == "\n"


def _rewrite(text: str, k: Classes) -> tuple[str, int]:
    """Replace all variants, leftmost longest; returns the text and the kinds met."""
    found = 0
    out, at = [], 0
    matches: dict[int, tuple[int, str, int]] = {}
    for end, (variant, plain, kind) in k.automaton.iter(text):
        start = end + 1 - len(variant)
        if start not in matches or matches[start][0] <= end:
            matches[start] = (end + 1, plain, kind)
    for start in sorted(matches):
        end, plain, kind = matches[start]
        if start < at:
            continue
        if text[start] == "　" and _spaces_right(text, start):
            continue
        if text[start] == "\xad" and text[end : end + 1] in ("\n", "\r"):
            continue
        found |= kind
        out += [text[at:start], plain]
        at = end
    return ("".join(out) + text[at:], found) if found else (text, 0)


def _word_script(word: str, k: Classes) -> tuple[dict[str, int], set[str]]:
    """Letters without a twin per script, and all scripts of the word."""
    own: dict[str, int] = {}
    all_scripts: set[str] = set()
    for c in word:
        s = script_of(c)
        all_scripts.add(s)
        if c not in k.scripts:
            own[s] = own.get(s, 0) + 1
    return own, all_scripts


def _spell(word: str, script: str, k: Classes) -> str | None:
    """The word with all letters of one script, if each has one there."""
    out = []
    for c in word:
        if script_of(c) == script:
            out.append(c)
        elif (twin := k.scripts.get(c, {}).get(script)) is not None:
            out.append(twin)
        else:
            return None
    return "".join(out)


#: Bits by which the corpus must know the other spelling better before a word of one script is rewritten.
PURE_GAIN = 14.0


def unify(text: str, model: PairModel) -> tuple[str, int]:
    """The consistent form of a text and the kinds of variants in it (bits of ``FORMS``)."""
    k = classes(model)
    text, found = _rewrite(text, k)
    words = list(_LETTERS.finditer(text))
    scripts = [_word_script(w.group(), k) for w in words]
    out, at = [], 0
    for i, (w, (own, every)) in enumerate(zip(words, scripts)):
        word = w.group()
        if len(every) == 1:
            if own:
                continue
            beside = [s for own2, _ in scripts[max(0, i - 2) : i + 3] for s in own2]
            if not beside or next(iter(every)) in beside:
                continue
        left, right = text[max(0, w.start() - 1) : w.start()], text[w.end() : w.end() + 1]
        spellings = {s: x for s in ("LATIN", "CYRILLIC", "GREEK") if (x := _spell(word, s, k)) is not None}
        if len(every) > 1 and own:
            spellings = {s: x for s, x in spellings.items() if s in own} or spellings
        if not spellings:
            continue
        score = {s: float(model.of(left + x + right)[bool(left) : len(left + x + right) + 1 - bool(right)].sum()) for s, x in spellings.items()}
        best = max(score, key=lambda s: (score[s], s))
        new = spellings[best]
        if new == word or len(every) == 1 and score[best] - score[next(iter(every))] < PURE_GAIN:
            continue
        found |= LOOKALIKE
        out += [text[at : w.start()], new]
        at = w.end()
    text = "".join(out) + text[at:]

    def turn(m: regex.Match) -> str:
        """The apostrophe after o or g as the class has it, where it makes no English word."""
        own = k.turned.get(text[m.start() - 1] + m.group(), "")[1:]
        english = m.group(1) and _ENGLISH.fullmatch(m.group(1))
        sure = m.group(1) or m.group() in _NO_QUOTES or TURNED_COMMA in text
        return own if own and sure and not english else m.group()

    new = _TURNED.sub(turn, text)
    return (new, found | LOOKALIKE) if new != text else (text, found)


def holds_variants(texts: list[str | None], k: Classes) -> np.ndarray:
    """Rows of a batch that may hold a variant."""
    c = codes(texts)
    mark = np.zeros(len(c), bool)
    if not len(c):
        return mark
    odd = k.kinds[c.cp] != 0
    # an ideographic space at the start of a line and a soft hyphen at its end are right
    before = np.concatenate(([GAP], c.cp[:-1]))
    odd &= ~((c.cp == 0x3000) & ((before == GAP) | (before == 0x0A)))
    mark[c.row[odd]] = True
    s = k.letters[c.cp]
    letter = s & 7
    clash = (letter[:-1] != 0) & (letter[1:] != 0) & (letter[:-1] != letter[1:])
    mark[c.row[:-1][clash]] = True
    apostrophe = np.isin(c.cp[1:], [ord(x) for x in APOSTROPHES]) & np.isin(c.cp[:-1], [ord(x) for x in "oOgG"])
    mark[c.row[1:][apostrophe]] = True
    # words without a letter of their own script, in a text that has letters of another script
    edge = np.flatnonzero((letter[1:] != 0) & (letter[:-1] == 0)) + 1
    if len(edge):
        # letters of a word, its letters without a twin; a word ends where the next one begins, what lies between counts nothing
        own = np.add.reduceat((s & 8 != 0).astype(np.int32), edge)
        twinned = own == 0
        per_script = np.stack([np.bincount(c.row[edge], weights=((letter[edge] == b) & ~twinned), minlength=len(c)) for b in (1, 2, 4)])
        other = per_script.sum(0)[c.row[edge]] - np.select([letter[edge] == 1, letter[edge] == 2], [per_script[0][c.row[edge]], per_script[1][c.row[edge]]], per_script[2][c.row[edge]])
        mark[c.row[edge][twinned & (other > 0)]] = True
    return mark


def find_forms(texts: DataFrame, model: PairModel) -> DataFrame:
    """``unify_forms`` of a table (src, row_id, text), without the texts that were decoded wrongly."""
    return unify_forms(texts, ["src", "row_id"], "text", model, skip_wrong=True)


def unify_forms(df: DataFrame, keys: list[str], text: str, model: PairModel, skip_wrong: bool = False) -> DataFrame:
    """``(*keys, forms, unified)`` of the rows whose text is written with variants; other rows give none.

    ``forms`` is an array of names out of ``FORMS``. Null and empty texts hold no variant. With
    ``skip_wrong`` texts that were decoded with a wrong encoding, whose characters are none of their own, give no row.
    """
    part = df.select(*keys, F.col(text).alias("_text")).filter(F.length("_text") > 0)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema if f.name in keys) + ", forms array<string>, unified string"
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keys)).to_pylist()
            rows, forms, unified = [], [], []
            for a, b in batched(column):
                some = np.flatnonzero(holds_variants(column[a:b], classes(shared.value))).tolist()
                if skip_wrong:
                    wrong = set(wrong_rows([column[a + i] for i in some], shared.value))
                    some = [i for k, i in enumerate(some) if k not in wrong]
                for i in some:
                    new, kinds = unify(column[a + i], shared.value)
                    if kinds:
                        rows.append(a + i)
                        forms.append([name for j, name in enumerate(FORMS) if kinds >> j & 1])
                        unified.append(new)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(len(keys))), pa.array(forms, pa.list_(pa.string())), pa.array(unified, pa.string())], names=[*keys, "forms", "unified"])

    return part.mapInArrow(run, schema)
