"""The language of every text and of every segment of a mixed text, by rank-order profiles.

A profile is the list of a language's most frequent character n-grams in order of frequency: trigrams of letters, and
single characters of the Han script, which weigh as much as ``HAN_WEIGHT`` trigrams. A piece
of text is compared with it by the out-of-place distance: for each of its own n-grams, ranked the same
way, how far its rank lies from the rank in the profile (``PROFILE`` if the profile lacks it). The
language with the smallest mean distance wins; the confidence tells how far the next one is off.

Profiles are fitted on a sample of labelled rows of at most about ``SAMPLE`` per language, drawn by a
hash of their id; everything else looks at all rows. Distances are computed for whole batches as
vectors: first for the rough pieces between terminators, and only texts whose pieces differ are taken
apart into exact sentences.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.codepoints import GAP, batched, codes
from quire.llm.encoding import wrong_rows
from quire.llm.pairs import PairModel
from quire.llm.sentences import SentenceModel, sentence_ends

#: Trigrams of a profile.
PROFILE = 1500
#: Labelled rows per language that profiles are fitted on.
SAMPLE = 3000
#: A script belongs to a language if it makes at least this share of its sample.
OWN_SCRIPT = 0.1
#: A Han character weighs as much as this many letters.
HAN_WEIGHT = 4
#: Rank tables have a place for each code of three letters, then one for each Han character (those of the higher planes share places).
HAN_BASE, HAN_CODES = 1 << 21, 1 << 16
#: Pieces of fewer letters say nothing on their own against their neighbours.
SHORT = 12
MIN_LETTERS, MIN_LETTERS_HAN, MIN_DIFFERENT = 25, 10, 9
_ENDS = ".!?…。！？\n\r"


@dataclass
class Profiles:
    """``letter``: small code of each code point (0: no letter, 127: a rare letter); ``rank``: (language, trigram)."""

    languages: list[str]
    letter: np.ndarray
    rank: np.ndarray


def _base_tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of each code point, and whether it is a letter (2: Han)."""
    lower = np.arange(GAP + 1, dtype=np.int32)
    letter = np.zeros(GAP + 1, np.uint8)
    for cp in range(0x41, 0x3000):
        c = chr(cp)
        if c.isalpha():
            letter[cp] = 1
            low = c.lower()
            if len(low) == 1:
                lower[cp] = ord(low)
    letter[0x2BB] = letter[0x2BC] = 1
    for a, b in ((0x3400, 0xA000), (0xF900, 0xFB00), (0x20000, 0x32000)):
        letter[a:b] = 2
    for a, b in ((0x3040, 0x3100), (0xAC00, 0xD7A4), (0xFF21, 0xFF3B), (0xFF41, 0xFF5B)):
        letter[a:b] = 1
    return lower, letter


_LOWER, _LETTER = _base_tables()


def with_label(df: DataFrame, label: str, codes_table: DataFrame) -> DataFrame:
    """Add ``labelled``: the language that the label names, null if it names none."""
    names = codes_table.filter("label IS NOT NULL AND lang IS NOT NULL").groupBy(F.col("label").alias("_label")).agg(F.min("lang").alias("labelled"))
    return df.join(names, F.col(label) == F.col("_label"), "left").drop("_label")


def fit_profiles(labelled: DataFrame) -> Profiles:
    """Fit profiles on ``(id, text, labelled)``; rows without a language or a text are left out."""
    rows = labelled.filter("labelled IS NOT NULL AND length(text) >= 25")
    counts = rows.groupBy("labelled").count().collect()  # a row per language
    share = F.lit(0.0)
    for lang, n in counts:
        share = F.when(F.col("labelled") == lang, min(1.0, SAMPLE / n)).otherwise(share)
    drawn = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * float(1 << 30)).select("labelled", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                c = codes([text])
                low = _LOWER[c.cp]
                low = np.where(_LETTER[c.cp] == 1, low, 0x20)
                grams = np.stack([low[:-2], low[1:-1], low[2:]], 1)
                grams = grams[(grams != 0x20).any(1)]
                counts.setdefault(lang, Counter()).update(map(tuple, grams.tolist()))
                counts[lang].update((x,) for x in c.cp[_LETTER[c.cp] == 2].tolist())
        flat = [(lang, "".join(map(chr, g)), n) for lang, cs in counts.items() for g, n in cs.items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.string()), pa.array([x[2] for x in flat], pa.int64())], names=["lang", "gram", "n"])

    grams: pd.DataFrame = drawn.mapInArrow(count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    letters: Counter = Counter()
    for gram, n in zip(grams.gram, grams.n):
        if gram[1:2].strip():
            letters[gram[1]] += n
    letter = np.where(_LETTER == 1, 127, 0).astype(np.uint8)
    for i, (c, _) in enumerate(sorted(letters.items(), key=lambda x: (-x[1], x[0]))[:126]):
        letter[ord(c)] = i + 1
    # capitals have the code of their small letter
    letter = np.where(_LETTER == 1, letter[_LOWER], 0).astype(np.uint8)
    languages = sorted(set(grams.lang)) or ["und"]
    rank = np.full((len(languages), HAN_BASE + HAN_CODES), PROFILE, np.int16)
    # what texts of several languages bring in from another script is no part of a profile
    script = grams.gram.map(lambda g: 2 if len(g) == 1 else int(max(g) >= "\u0370"))
    size = grams.n * np.where(script == 2, HAN_WEIGHT, 1)
    grams = grams[size.groupby([grams.lang, script]).transform("sum") >= OWN_SCRIPT * size.groupby(grams.lang).transform("sum")] if len(grams) else grams
    for i, lang in enumerate(languages):
        own = grams[grams.lang == lang].sort_values(["n", "gram"], ascending=[False, True]).head(PROFILE)
        for r, g in enumerate(own.gram):
            if len(g) == 1:
                code = HAN_BASE | ord(g) & (HAN_CODES - 1)
            else:
                code = int(letter[ord(g[0])]) << 14 | int(letter[ord(g[1])]) << 7 | int(letter[ord(g[2])])
            rank[i, code] = min(rank[i, code], r)
    return Profiles(languages, letter, rank)


def _distances(cp: np.ndarray, unit: np.ndarray, n_units: int, p: Profiles) -> tuple[np.ndarray, np.ndarray]:
    """Mean out-of-place distance of each unit to each profile, and letters per unit (alphabetic, Han)."""
    kind = _LETTER[cp]
    letters = np.stack([np.bincount(unit[kind == k], minlength=n_units) for k in (1, 2)])
    code = p.letter[cp].astype(np.int64)
    gram = code[:-2] << 14 | code[1:-1] << 7 | code[2:]
    # white space, stops and gaps are all 0, so a unit's first and last trigram reach over its edge
    keep = gram != 0
    han = np.flatnonzero(kind == 2)
    key = np.sort(np.concatenate((unit[1:-1][keep].astype(np.int64) << 22 | gram[keep], unit[han].astype(np.int64) << 22 | HAN_BASE | cp[han] & (HAN_CODES - 1))))
    distance = np.full((len(p.languages), n_units), float(PROFILE))
    if not len(key):
        return distance, letters
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    u, gram = key >> 22, key & ((1 << 22) - 1)
    weight = np.where(gram >= HAN_BASE, float(HAN_WEIGHT), 1.0)
    # rank within the unit: trigrams of equal count share their middle rank
    order = np.argsort((u << 20) - np.minimum(count, (1 << 20) - 1), kind="stable")
    su, sc = u[order], count[order]
    begin = np.flatnonzero(np.concatenate(([True], su[1:] != su[:-1])))
    place = np.arange(len(su)) - np.repeat(begin, np.diff(np.append(begin, len(su))))
    tie = np.flatnonzero(np.concatenate(([True], (su[1:] != su[:-1]) | (sc[1:] != sc[:-1]))))
    width = np.diff(np.append(tie, len(su)))
    own = np.empty(len(su))
    own[order] = np.repeat(place[tie] + (width - 1) / 2, width)
    n = np.bincount(u, weights=weight, minlength=n_units)
    for i in range(len(p.languages)):
        r = p.rank[i][gram]
        out = np.where(r < PROFILE, np.minimum(np.abs(r - own), PROFILE), PROFILE) * weight
        distance[i] = np.bincount(u, weights=out, minlength=n_units) / np.maximum(n, 1)
    distance[:, n == 0] = PROFILE
    return distance, letters


def classify(cp: np.ndarray, unit: np.ndarray, n_units: int, p: Profiles) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language index, confidence, letters) of each unit; -1 where a unit has no letter."""
    distance, letters = _distances(cp, unit, n_units, p)
    best = distance.argmin(0)
    part = np.partition(distance, min(1, len(distance) - 1), axis=0)
    confidence = (part[min(1, len(part) - 1)] - part[0]) / np.maximum(part[min(1, len(part) - 1)], 1e-9)
    total = letters.sum(0)
    return np.where(total > 0, best, -1), np.clip(np.where(total > 0, confidence, 0.0), 0, 1), total


def _smooth(lang: np.ndarray, confidence: np.ndarray, letters: np.ndarray, script: np.ndarray) -> np.ndarray:
    """Short or doubtful pieces take the language of the nearest sure piece of their script, of two the one before."""
    weigh = np.where(script == 2, letters * HAN_WEIGHT, letters)
    sure = (lang >= 0) & ((weigh >= SHORT) & (confidence >= 0.08) | (weigh >= 2 * SHORT))
    out = lang.copy()
    for s in np.unique(script[(lang >= 0) & ~sure]):
        ask, near = np.flatnonzero((lang >= 0) & ~sure & (script == s)), np.flatnonzero(sure & (script == s))
        if len(near):
            at = np.searchsorted(near, ask)
            before, after = near[np.maximum(at - 1, 0)], near[np.minimum(at, len(near) - 1)]
            out[ask] = lang[np.where((at > 0) & ((ask - before <= after - ask) | (at == len(near))), before, after)]
    return out


def _scripts(cp: np.ndarray, unit: np.ndarray, n_units: int) -> np.ndarray:
    """The script of most letters of each unit: 0 Latin, 1 Cyrillic, 2 Han."""
    counts = np.stack([np.bincount(unit[m], minlength=n_units) for m in ((cp < 0x370) & (_LETTER[cp] == 1), (cp >= 0x370) & (cp < 0x600) & (_LETTER[cp] == 1), _LETTER[cp] == 2)])
    counts[2] *= HAN_WEIGHT
    return counts.argmax(0)


def segments(text: str, p: Profiles, model: SentenceModel) -> tuple[int, list[tuple[int, int, int, float]]]:
    """(main language, segments) of a text; a segment is (start, end, language, confidence)."""
    spans = sentence_ends(text, model)
    c = codes([text])
    unit = np.zeros(len(c.cp), np.int64)
    for i, (a, b) in enumerate(spans):
        unit[1 + a : 1 + b] = i + 1
    lang, confidence, letters = classify(c.cp, unit, len(spans) + 1, p)
    script = _scripts(c.cp, unit, len(spans) + 1)
    lang, confidence, letters, script = lang[1:], confidence[1:], letters[1:], script[1:]
    lang = _smooth(lang, confidence, letters, script)
    totals = np.bincount(lang[lang >= 0], weights=letters[lang >= 0], minlength=len(p.languages))
    runs: list[list] = []
    for (a, b), one, conf, n in zip(spans, lang.tolist(), confidence.tolist(), letters.tolist()):
        if one < 0:
            continue
        if runs and runs[-1][2] == one:
            runs[-1][1] = b
            runs[-1][3] += conf * n
            runs[-1][4] += n
        else:
            runs.append([a, b, one, conf * n, n])
    return (int(totals.argmax()) if totals.sum() else -1), [(a, b, one, conf / max(n, 1)) for a, b, one, conf, n in runs]


def _label_batch(texts: list[str | None], p: Profiles, model: SentenceModel) -> list[tuple[int, float, int, int, list]]:
    """(main language, confidence, letters, different characters, segments) of each text of a batch."""
    c = codes(texts)
    stop = np.zeros(GAP + 1, bool)
    stop[[ord(x) for x in _ENDS] + [GAP]] = True
    ends = stop[c.cp]
    unit = np.cumsum(ends) - ends  # a terminator closes its unit; a gap, which opens a text, starts one
    unit = unit.astype(np.int64)
    n_units = int(unit[-1]) + 2 if len(unit) else 1
    lang, confidence, letters = classify(c.cp, unit, n_units, p)
    row_of = np.zeros(n_units, np.int64)
    inside = c.cp != GAP  # the gap that ends a unit counts to the text after it, the unit doesn't
    row_of[unit[inside]] = c.row[inside]
    has = letters > 0
    n_lang = len(p.languages)
    key = row_of[has] * n_lang + lang[has]
    per = np.bincount(key, weights=letters[has], minlength=len(c) * n_lang).reshape(len(c), n_lang)
    conf = np.bincount(key, weights=letters[has] * confidence[has], minlength=len(c) * n_lang).reshape(len(c), n_lang)
    total = per.sum(1)
    main = np.where(total > 0, per.argmax(1), -1)
    out = []
    mixed = ((per > 0).sum(1) > 1)
    for i in range(len(c)):
        text = texts[i] or ""
        if not total[i]:
            out.append((-1, 0.0, 0, 0, []))
            continue
        runs: list = []
        best, cf = int(main[i]), float(conf[i, main[i]] / max(per[i, main[i]], 1))
        if mixed[i]:
            best, runs = segments(text, p, model)
            if len(runs) < 2:
                runs = []
            cf = next((r[3] for r in runs if r[2] == best), cf)
        out.append((best, cf, int(total[i]), -1, runs))
    return out


def label_languages(df: DataFrame, keys: list[str], text: str, label: str, codes_table: DataFrame, profiles: Profiles, model: SentenceModel, pairs: PairModel, cases: bool = False) -> DataFrame:
    """``(*keys, labelled, lang, confidence, label_counts, mangled, segments)`` of every row whose text has a letter.

    ``mangled``: whether the text was decoded with a wrong encoding. ``label_counts``: whether the text is long and varied enough for its label to be judged. ``segments``
    is an array of (start_char, end_char, lang, confidence), empty for a text in one language. Rows with
    a null, empty or letterless text give none; a label that no row of the code table has counts as null. With ``cases`` only
    rows with a missing or wrong label or with segments are given, so only those are looked at for wrong decodings.
    """
    part = with_label(df, label, codes_table).select(*keys, "labelled", F.col(text).alias("_text")).filter(F.length("_text") > 0)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema if f.name in keys)
    schema += ", labelled string, lang string, confidence double, label_counts boolean, mangled boolean, segments array<struct<start_char:int,end_char:int,lang:string,confidence:double>>"
    shared = df.sparkSession.sparkContext.broadcast((profiles, model, pairs))
    kind = pa.list_(pa.struct([("start_char", pa.int32()), ("end_char", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, m, pair_model = shared.value
        for batch in batches:
            column = batch.column(len(keys) + 1).to_pylist()
            labels = batch.column(len(keys)).to_pylist()
            rows, langs, conf, counts, segs = [], [], [], [], []
            for a, b in batched(column):
                for i, (best, cf, letters, _, runs) in enumerate(_label_batch(column[a:b], p, m)):
                    if best < 0:
                        continue
                    name = p.languages[best]
                    judged = letters >= (MIN_LETTERS_HAN if name == "zh" else MIN_LETTERS) and len(set(column[a + i])) >= MIN_DIFFERENT
                    if cases and not runs and not (judged and labels[a + i] != name):
                        continue
                    rows.append(a + i)
                    langs.append(name)
                    conf.append(cf)
                    counts.append(judged)
                    segs.append([(x, y, p.languages[one], c) for x, y, one, c in runs])
            wrong = {rows[k] for k in wrong_rows([column[i] for i in rows], pair_model)}
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(take) for i in range(len(keys) + 1)), pa.array(langs, pa.string()), pa.array(conf, pa.float64()), pa.array(counts, pa.bool_()), pa.array([i in wrong for i in rows], pa.bool_()), pa.array([[dict(zip(("start_char", "end_char", "lang", "confidence"), s)) for s in ss] for ss in segs], kind)],
                names=[*keys, "labelled", "lang", "confidence", "label_counts", "mangled", "segments"],
            )

    return part.mapInArrow(run, schema)
