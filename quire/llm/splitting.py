"""Splitting oversized texts at natural boundaries, with overlap.

Only rows beyond their limit leave the JVM. For each of them the text is taken apart into tokens
(words and the marks and white space after them); prefix sums of the token lengths give the offsets
of all boundaries, ranked by kind (paragraph, line, sentence, clause, word). The end of a piece is
found by binary search in the sorted offsets of each kind: the last boundary that is within the
limit. A kind is taken only if its piece is filled to at least ``FILL`` of the limit; if no kind
gives such an offset the text is cut hard at the limit (never between a base character and its
combining marks). The next piece begins ``overlap`` code points before that end.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A boundary of a better kind is preferred while it leaves the piece at least this full.
FILL = 0.5

_TOKEN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]|[^\s\p{Han}\p{Hiragana}\p{Katakana}]+|\s+")
_SENTENCE_END = regex.compile(r"[.!?…。！？][\"'”’»」』)\]]*$")
_CLAUSE_END = regex.compile(r"[,;:，；：、—–][\"'”’»)]*$")
_MARK = regex.compile(r"\p{M}|[‍︎️]")

PIECE = "struct<piece_no:int,start_char:int,end_char:int,text:string,boundary_after:string>"


def boundaries(text: str) -> list[list[int]]:
    """Sorted offsets of the boundaries of a text: paragraphs, lines, sentences, clauses, words.

    An offset is where the next piece may begin, so white space stays with the piece before it.
    """
    tokens = _TOKEN.findall(text)
    offsets = list(accumulate(map(len, tokens)))
    kinds: list[list[int]] = [[], [], [], [], []]
    for i, (token, end) in enumerate(zip(tokens, offsets)):
        if token[0].isspace():
            if "\n" in token:
                kinds[0 if token.count("\n") > 1 else 1].append(end)
            kinds[4].append(end)
            before = tokens[i - 1] if i else ""
        elif i + 1 < len(tokens) and tokens[i + 1][0].isspace():
            continue
        else:
            before = token
            if len(token) == 1 and regex.match(r"\p{Han}", token) and i + 1 < len(tokens) and len(tokens[i + 1]) == 1:
                kinds[4].append(end)
        if _SENTENCE_END.search(before):
            kinds[2].append(end)
        elif _CLAUSE_END.search(before):
            kinds[3].append(end)
    return kinds


def cut_text(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Half-open spans that cover ``text``; neighbours share exactly ``overlap`` code points."""
    if len(text) <= limit or limit < 1:
        return [(0, len(text))]
    overlap = max(0, min(overlap, limit - 1))
    kinds = boundaries(text)
    spans, start = [], 0
    while len(text) - start > limit:
        end = 0
        for offsets in kinds:
            i = bisect_right(offsets, start + limit)
            if i and offsets[i - 1] >= start + max(overlap + 1, int(FILL * limit)):
                end = offsets[i - 1]
                break
        if not end:
            words = kinds[4]
            i = bisect_right(words, start + limit)
            end = words[i - 1] if i and words[i - 1] > start + overlap else 0
        if not end:
            end = start + limit
            while end > start + overlap + 1 and _MARK.match(text[end]):
                end -= 1
        spans.append((start, end))
        start = end - overlap
    spans.append((start, len(text)))
    return spans


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for text, limit, overlap, boundary in zip(pdf.pop("_text"), pdf.pop("_limit"), pdf.pop("_overlap"), pdf.pop("_boundary")):
            spans = cut_text(text, int(limit), int(overlap))
            out.append([(i, a, b, text[a:b], boundary if i + 1 == len(spans) else "") for i, (a, b) in enumerate(spans)])
        yield pdf.assign(pieces=out)


def split_oversized(df: DataFrame, keys: list[str], text: Column, limit: Column, overlap: Column, boundary: Column) -> DataFrame:
    """Rows of ``df`` whose text exceeds ``limit`` code points, as ``(*keys, pieces)``.

    ``pieces`` is an array of structs of type ``PIECE``; every piece but the last has an empty
    ``boundary_after``, the last keeps that of the row (null stays null). Rows within the limit, with
    a null text or a null or non-positive limit, give no row: they need no cut. A null overlap is 0.
    An overlap of the limit or more counts as limit - 1, so that each piece makes progress.
    Repeated rows each give their row.
    """
    over = df.select(
        *keys, text.alias("_text"), limit.cast("int").alias("_limit"), F.coalesce(overlap.cast("int"), F.lit(0)).alias("_overlap"), boundary.alias("_boundary")
    ).filter((F.col("_limit") > 0) & (F.length("_text") > F.col("_limit")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in over.schema if f.name in keys)
    return over.mapInPandas(_pieces, f"{schema}, pieces array<{PIECE}>")


def with_profile(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """Add ``max_chunk_chars`` and ``overlap_chars`` of each row's ``chunker``; null or empty means ``default``.

    A chunker that no profile has gets nulls, so its rows have no limit. No broadcast is forced: the
    planner checks the size of ``profiles`` itself. Several profiles of one chunker: the largest values.
    """
    p = profiles.groupBy(F.col("chunker").alias("_chunker")).agg(F.max("max_chunk_chars").alias("max_chunk_chars"), F.max("overlap_chars").alias("overlap_chars"))
    name = F.when(F.coalesce(F.trim("chunker"), F.lit("")) == "", "default").otherwise(F.trim("chunker"))
    return rows.withColumn("_chunker", name).join(p, "_chunker", "left").drop("_chunker")
