"""How two texts differ: error rates, matching blocks, repetitions; and whether a corrected text kept its source.

Character rates are built-in. What needs an alignment of words runs over Arrow batches; the distance is worked out
with a whole column of the table in the bits of an integer.
"""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

_SPAN = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("words", ArrayType(StringType()))]))
ALIGNED = StructType([StructField("wer", DoubleType()), StructField("matched_ratio", DoubleType()), StructField("repeated_score", DoubleType()), StructField("missing_spans", _SPAN), StructField("extra_spans", _SPAN)])
#: Spans told of each kind; the longest repetition looked for, in words.
SPANS, LONGEST = 20, 8


def char_error_rate(expected: Column, actual: Column) -> Column:
    """Edit distance over the length of what was expected; without an expectation 0 if nothing came, else 1."""
    return F.when(F.length(expected) == 0, F.when(F.length(actual) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(expected, actual) / F.length(expected))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def edit_distance(a: list[str], b: list[str]) -> int:
    """Levenshtein distance of two word lists of any length: a column of the table at a time, its differences up and down
    as the bits of two integers."""
    if not a or not b:
        return len(a) or len(b)
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    for w in b:
        same = places.get(w, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        right = (down | ~(diagonal | up)) & full
        left = up & diagonal
        distance += bool(right & last) - bool(left & last)
        right, left = right << 1 | 1, left << 1
        up = (left | ~((same | down) | right)) & full
        down = right & (same | down) & full
    return distance


def repeated_score(ws: list[str]) -> float:
    """Share of words that repeat the run of up to ``LONGEST`` words before them."""
    repeated = i = 0
    while i < len(ws) - 1:
        best = next((n for n in range(min(LONGEST, (len(ws) - i) // 2), 0, -1) if ws[i : i + n] == ws[i + n : i + 2 * n]), 0)
        repeated += best
        i += 2 * best or 1
    return repeated / len(ws) if len(ws) > 1 else 0.0


def align(expected: str, actual: str) -> tuple[float, float, float, list[dict], list[dict]]:
    a, b = expected.split(), actual.split()
    blocks = difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    same = sum(j - i for tag, i, j, *_ in blocks if tag == "equal")
    span = lambda ws, i, j: {"start": i, "end": j, "words": ws[i:j]}
    missing = [span(a, i, j) for tag, i, j, *_ in blocks if tag in ("replace", "delete")][:SPANS]
    extra = [span(b, i, j) for tag, _, _, i, j in blocks if tag in ("replace", "insert")][:SPANS]
    none = 0.0 if not b else 1.0
    return (edit_distance(a, b) / len(a) if a else none), (same / len(a) if a else 1.0 - none), repeated_score(b), missing, extra


def aligned(expected: Column, actual: Column) -> Column:
    """Struct of word error rate, share of matching words, repetition and unmatched spans; null if a text is null."""

    @F.pandas_udf(ALIGNED)
    def run(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        rows = [align(a, b) if a is not None and b is not None else (None,) * 5 for a, b in zip(left, right)]
        return pd.DataFrame(rows, columns=[f.name for f in ALIGNED.fields])

    return F.when(expected.isNotNull() & actual.isNotNull(), run(expected, actual))


def word_error_rate(expected: Column, actual: Column) -> Column:
    """As the character error rate, over words."""

    @F.pandas_udf(DoubleType())
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right):
            a, b = (x or "").split(), (y or "").split()
            out.append(edit_distance(a, b) / len(a) if a else float(bool(b)))
        return pd.Series(out, dtype=float)

    return F.when(expected.isNotNull() & actual.isNotNull(), run(expected, actual))


#: Limits of a transcript that passes.
MAX_WER, MAX_CER, MIN_MATCH, MIN_CONFIDENCE, MAX_REPEATED = 0.30, 0.18, 0.78, 0.40, 0.18


def transcript_issues(expected: Column, transcript: Column, a: Column, cer: Column, language: Column, heard: Column, confidence: Column) -> Column:
    """What is wrong with a transcript, as an array of names; texts are normalised ones, ``a`` their alignment."""
    found = [
        ("empty_transcript", transcript == ""), ("language_mismatch", (heard != "") & (heard != language)), ("low_confidence", confidence < MIN_CONFIDENCE), ("high_wer", a["wer"] > MAX_WER), ("high_cer", cer > MAX_CER),
        ("missing_words", a["matched_ratio"] < MIN_MATCH), ("extra_words", F.size(a["extra_spans"]) > 0), ("repeated_text", a["repeated_score"] > MAX_REPEATED),
    ]
    return F.filter(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in found]), lambda x: x.isNotNull())


def transcript_status(issues: Column) -> Column:
    severe = F.array(*[F.lit(x) for x in ("empty_transcript", "language_mismatch", "high_wer", "high_cer", "repeated_text")])
    return F.when(F.arrays_overlap(issues, severe), "failed").when(F.size(issues) > 0, "warning").otherwise("passed")


#: Limits of a correction that is taken.
MIN_SIMILAR, WORD_RATIO, SENTENCE_RATIO = 0.82, (0.88, 1.12), (0.80, 1.20)
TITLE_SIMILAR, TITLE_WORD = 0.72, 0.67
_MARKS = re.compile(r"[.!?…]+")


def correction_issues(original: str, corrected: str, title: bool = False) -> list[str]:
    """Why a corrected text is no mere correction of the original: its letters, words, sentences, marks or capitals differ too much."""
    if not corrected.strip():
        return ["empty"] if original.strip() else []
    similar = difflib.SequenceMatcher(None, original, corrected).ratio()
    a, b = original.split(), corrected.split()
    issues = ["similarity"] if similar < (TITLE_SIMILAR if title else MIN_SIMILAR) else []
    if title:
        if len(a) != len(b):
            return [*issues, "words"]
        return issues + (["word"] if any(difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio() < TITLE_WORD for x, y in zip(a, b)) else [])
    if not WORD_RATIO[0] <= len(b) / max(len(a), 1) <= WORD_RATIO[1]:
        issues.append("words")
    s, t = (max(len(_MARKS.findall(x)), 1) for x in (original, corrected))
    if not SENTENCE_RATIO[0] <= t / s <= SENTENCE_RATIO[1]:
        issues.append("sentences")
    for name, mark in (("quotes", "«»“”\"„"), ("brackets", "()[]"), ("dialogue", "—")):
        if sum(c in mark for c in original) != sum(c in mark for c in corrected):
            issues.append(name)
    if [w[:1].isupper() for w in a] != [w[:1].isupper() for w in b] and len(a) == len(b):
        issues.append("capitals")
    return issues


def validated(original: Column, corrected: Column, title: bool = False) -> Column:
    """Struct (accepted, issues): the corrected text if it passes, else the original; null texts give null."""

    @F.pandas_udf(ArrayType(StringType()))
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([correction_issues(a, b, title) if a is not None and b is not None else None for a, b in zip(left, right)])

    checked = F.when(original != corrected, run(original, corrected)).when(original == corrected, F.array().cast("array<string>"))
    return F.transform(F.array(checked), lambda i: F.struct(F.when(F.size(i) == 0, corrected).otherwise(original).alias("accepted"), i.alias("issues")))[0]
