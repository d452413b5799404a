"""Measures of speech recordings in WAV form: loudness, clipping, drop-outs, silences, repetitions.

A file is one binary cell; it is decoded once into samples and all measures are vector operations over them.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Windows of silence and of drop-outs in milliseconds; the silence allowed at the beginning, inside and at the end.
SILENCE_MS, DROPOUT_MS, LEADING_MS, INNER_MS, TRAILING_MS = 20, 80, 80, 450, 140
SILENT_RMS, SILENT_SHARE, CLIPPED, NEAR_PEAK = 0.003, 0.018, 0.99, 0.95
#: Repeated sound is looked for over these lengths, in bins whose loudness must agree this closely.
REPEAT_MS, BINS, ALIKE = (100, 200, 400, 800), 12, 0.02

MEASURES = "sample_rate int, channels int, duration_ms double, rms double, peak double, clipping_ratio double, near_peak_ratio double, crest_db double, dropout_score double, repeat_score double, silences array<struct<start_ms:int,end_ms:int,kind:string>>, error string"


def samples(data: bytes) -> tuple[np.ndarray, int, int]:
    """(samples of the mean channel in -1..1, rate, channels) of PCM data of 8, 16, 24 or 32 bits."""
    with wave.open(io.BytesIO(data)) as w:
        raw, width, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8)[: len(raw) // 3 * 3].reshape(-1, 3).astype(np.int32)
        x = (((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000) / 0x800000
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float64) / (1 << (8 * width - 1))
    return (x[: len(x) // channels * channels].reshape(-1, channels).mean(1) if len(x) else x), rate, channels


def window_rms(x: np.ndarray, size: int) -> np.ndarray:
    """Loudness of consecutive windows; a last incomplete one counts."""
    if not len(x):
        return np.zeros(0)
    starts = np.arange(0, len(x), max(size, 1))
    lengths = np.diff(np.append(starts, len(x)))
    return np.sqrt(np.add.reduceat(x * x, starts) / lengths)


def dropout_score(x: np.ndarray, rate: int) -> float:
    """Share of inner windows that are a third as loud as the quieter of their neighbours, or less."""
    r = window_rms(x, rate * DROPOUT_MS // 1000)
    if len(r) < 3:
        return 0.0
    beside = np.minimum(r[:-2], r[2:])
    return float(((beside > SILENT_RMS) & (r[1:-1] * 3 < beside)).sum() / (len(r) - 2))


def repeat_score(x: np.ndarray, rate: int) -> float:
    """Largest share of neighbouring stretches of one length that sound alike, silence aside."""
    best = 0.0
    for ms in REPEAT_MS:
        size = rate * ms // 1000 // BINS
        r = window_rms(x, size) if size else np.zeros(0)
        n = len(r) // BINS
        if n < 2:
            continue
        shape = r[: n * BINS].reshape(n, BINS)
        peak = shape.max(1)
        print_ = shape / np.maximum(peak, 1e-9)[:, None]
        loud = (peak[1:] > SILENT_RMS) & (peak[:-1] > SILENT_RMS) & (print_.std(1)[1:] > ALIKE)
        best = max(best, float((loud & (np.abs(print_[1:] - print_[:-1]).mean(1) <= ALIKE)).sum() / (n - 1)))
    return best


def silences(x: np.ndarray, rate: int) -> list[dict]:
    """Silent stretches that are longer than they may be at their place."""
    size = max(rate * SILENCE_MS // 1000, 1)
    r = window_rms(x, size)
    quiet = r < max(SILENT_RMS, SILENT_SHARE * float(r.max(initial=0.0)))
    edge = np.flatnonzero(np.diff(np.concatenate(([False], quiet, [False])).astype(int)))
    out = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        kind, allowed = ("leading", LEADING_MS) if a == 0 else ("trailing", TRAILING_MS) if b == len(r) else ("internal", INNER_MS)
        if (b - a) * SILENCE_MS > allowed:
            out.append({"start_ms": a * SILENCE_MS, "end_ms": b * SILENCE_MS, "kind": kind})
    return out


def measure(data: bytes | None) -> tuple:
    """All measures of one file, or the error that it gives."""
    try:
        x, rate, channels = samples(bytes(data or b""))
    except (wave.Error, EOFError, KeyError, ValueError) as e:
        return (*[None] * 11, f"{type(e).__name__}: {e}"[:200])
    peak = float(np.abs(x).max(initial=0.0))
    rms = float(np.sqrt((x * x).mean())) if len(x) else 0.0
    own = np.abs(x) / peak if peak else np.abs(x)
    return (
        rate, channels, len(x) * 1000 / rate, rms / peak if peak else 0.0, peak, float((own >= CLIPPED).mean()) if peak else 0.0, float((own >= NEAR_PEAK).mean()) if peak else 0.0,
        float(20 * np.log10(peak / rms)) if rms else 0.0, dropout_score(x, rate), repeat_score(x, rate), silences(x, rate), None,
    )


def inspect(files: DataFrame, keys: list[str], *content: str, render: Callable[..., bytes] | None = None) -> DataFrame:
    """``(*keys, measures...)`` of WAV files; one that cannot be read has an ``error`` and nulls.

    ``render`` makes a file of the columns ``content``, one at a time: recordings that are made need not be a column,
    of which Spark would hold those of many rows at once.
    """
    content = content or ("content",)
    data = [f"_data{i}" for i in range(len(content))]
    part = files.select(*keys, *[F.col(c).alias(d) for c, d in zip(content, data)])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema if f.name in keys)
    names = [c.split()[0] for c in MEASURES.replace("array<struct<start_ms:int,end_ms:int,kind:string>>", "array").split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cells = zip(*[pdf[d] for d in data])
            rows = pd.DataFrame([measure(render(*x) if render else x[0]) for x in cells], columns=names).astype(object)
            yield pd.concat([pdf[keys].reset_index(drop=True), rows.where(rows.notna(), None)], axis=1)

    return part.mapInPandas(run, f"{schema}, {MEASURES}")


#: Limits of a recording that passes.
MIN_MS, MIN_RMS, MAX_CLIPPING, MAX_DROPOUT, MAX_REPEAT, MIN_CREST, MAX_SILENCE_MS = 200.0, 0.01, 0.02, 0.05, 0.25, 3.0, 2500


def issues(expected_ms: Column) -> Column:
    """What is wrong with a measured recording, as an array of names; ``expected_ms``: how long it should about be (null if unknown)."""
    c = F.col
    longest = F.coalesce(F.array_max(F.transform("silences", lambda s: s["end_ms"] - s["start_ms"])), F.lit(0))
    found = [
        ("unreadable", c("error").isNotNull()), ("too_short", c("duration_ms") < MIN_MS), ("silent", c("peak") == 0), ("quiet", (c("peak") > 0) & (c("rms") * c("peak") < MIN_RMS)), ("clipping", c("clipping_ratio") > MAX_CLIPPING),
        ("flat", (c("peak") > 0) & (c("crest_db") < MIN_CREST)), ("dropout", c("dropout_score") > MAX_DROPOUT), ("repeated_audio", c("repeat_score") > MAX_REPEAT), ("long_silence", longest > MAX_SILENCE_MS),
        ("too_long", c("duration_ms") > 3 * expected_ms), ("cut_short", c("duration_ms") < expected_ms / 3),
    ]
    return F.filter(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in found]), lambda x: x.isNotNull())


def kept_ranges(silent: Column, duration_ms: Column) -> Column:
    """The stretches (start_ms, end_ms) of a recording that are left when each over-long silence is cut to what its place allows."""
    allowed = lambda s: F.when(s["kind"] == "leading", LEADING_MS).when(s["kind"] == "trailing", TRAILING_MS).otherwise(INNER_MS)
    start = F.struct(F.array().cast("array<struct<start_ms:int,end_ms:int>>").alias("done"), F.lit(0).alias("at"))

    def step(a: Column, s: Column) -> Column:
        # a leading silence keeps its end, the others their beginning
        first = F.when(s["kind"] == "leading", s["end_ms"] - allowed(s)).otherwise(a["at"])
        done = F.when(s["kind"] == "leading", a["done"]).otherwise(F.concat(a["done"], F.array(F.struct(first.alias("start_ms"), (s["start_ms"] + allowed(s)).alias("end_ms")))))
        return F.struct(done.alias("done"), F.when(s["kind"] == "leading", first).otherwise(s["end_ms"]).alias("at"))

    end = duration_ms.cast("int")
    return F.aggregate(silent, start, step, lambda a: F.when(a["at"] < end, F.concat(a["done"], F.array(F.struct(a["at"].alias("start_ms"), end.alias("end_ms"))))).otherwise(a["done"]))
