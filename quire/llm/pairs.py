"""Statistics of adjacent characters over the whole corpus.

Two passes over the texts, each a map-side count and one small shuffle: code points, then pairs of
symbols. The ``OWN`` most frequent code points are symbols of their own and all others fold into one
symbol per block of 256 code points, so there are never more than ``SYMBOLS`` ** 2 pairs however large the corpus
is; that is the proven bound of what the driver gathers and hands to the tasks (16 MB of scores).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.codepoints import GAP, batched, codes

SYMBOLS = 2048
BINS = 256
OWN = SYMBOLS - BINS


def _digits(cp: np.ndarray) -> np.ndarray:
    """All decimal digits of ASCII count as one character, and a gap as a line feed."""
    cp = np.where((cp >= 0x30) & (cp <= 0x39), 0x30, cp)
    return np.where(cp == GAP, 0x0A, cp)


def _count_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(GAP + 1, np.int64)
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for a, b in batched(texts):
            total += np.bincount(_digits(codes(texts[a:b]).cp), minlength=GAP + 1)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["cp", "n"])


@dataclass
class PairModel:
    """``symbol``: of each code point; ``score``: of each pair of symbols, in bits; ``usual``: the score that
    a pair of the corpus reaches on average; ``points``: how often each code point occurs; ``first``, ``second``: the share of
    each symbol among the first and second places of the ``total`` pairs."""

    symbol: np.ndarray
    score: np.ndarray
    usual: float
    points: np.ndarray
    first: np.ndarray
    second: np.ndarray
    total: float

    def count(self, text: str) -> float:
        """How often a code point occurs, or at most how often a longer string does, by its rarest pair."""
        if len(text) < 2:
            return float(self.points[ord(text)]) if text else self.total
        s = self.symbol[[ord(c) for c in text]]
        joint = (self.score[s[:-1], s[1:]] + np.log2(self.first[s[:-1]]) + np.log2(self.second[s[1:]])) / 3
        return float(max(2.0 ** joint.min() * self.total - 0.25, 0.0))

    def of(self, text: str) -> np.ndarray:
        """Scores of the adjacent pairs of a text, a line feed standing before and after it."""
        s = self.symbol[np.frombuffer(f"\n{text}\n".encode("utf-32-le", "surrogatepass"), np.int32)]
        return self.score[s[:-1], s[1:]]

    def pairs(self, cp: np.ndarray) -> np.ndarray:
        s = self.symbol[cp]
        return self.score[s[:-1], s[1:]]


def fit_pairs(texts: DataFrame) -> PairModel:
    """Fit the model over a DataFrame of one text column; null texts and empty tables are fine.

    The score of a pair is mutual information to the third power, log2 p(ab)^3 / (p(a) p(b)): plain
    mutual information is highest for pairs of rare characters that only meet each other, which is just
    what a wrong decoding makes; the higher power gives the joint frequency its weight.
    """
    spark = texts.sparkSession
    points = texts.mapInArrow(_count_points, "cp int, n bigint").groupBy("cp").agg(F.sum("n").alias("n")).toPandas().sort_values(["n", "cp"], ascending=[False, True])
    symbol = (OWN + (np.arange(GAP + 1) >> 8) % BINS).astype(np.uint16)
    own = points.cp.to_numpy()[:OWN]
    often = np.zeros(GAP + 1, np.float32)
    often[points.cp.to_numpy()] = points.n.to_numpy()
    symbol[own] = np.arange(len(own), dtype=np.uint16)
    symbol[0x31:0x3A] = symbol[0x30]
    symbol[GAP] = symbol[0x0A]
    shared = spark.sparkContext.broadcast(symbol)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS * SYMBOLS, np.int64)
        for batch in batches:
            rows = batch.column(0).to_pylist()
            for a, b in batched(rows):
                s = shared.value[codes(rows[a:b]).cp].astype(np.int32)
                total += np.bincount(s[:-1] * SYMBOLS + s[1:], minlength=SYMBOLS * SYMBOLS)
        seen = np.flatnonzero(total)
        for a in range(0, len(seen), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(seen[a : a + 50_000].astype(np.int32)), pa.array(total[seen[a : a + 50_000]])], names=["pair", "n"])

    counted: pd.DataFrame = texts.mapInArrow(count_pairs, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    shared.unpersist()
    n = np.zeros(SYMBOLS * SYMBOLS, np.float32)
    n[counted.pair.to_numpy()] = counted.n.to_numpy()
    n = n.reshape(SYMBOLS, SYMBOLS)
    total = max(float(n.sum()), 1.0)
    first, second = (n.sum(1) + 1) / total, (n.sum(0) + 1) / total
    score = 3 * np.log2(np.maximum((n + 0.25) / total, 1e-9)) - np.log2(first)[:, None] - np.log2(second)[None, :]
    usual = float((score * n).sum() / total)
    return PairModel(symbol, score.astype(np.float32), usual, often, first, second, total)
