"""Sentences in any script, as the best sequence of whole spans (a semi-Markov model).

A line is cut into candidates at its terminators; a dynamic program chooses the spans between them that
score best together. A span scores by its opening and closing words (log odds counted over the whole
corpus: how often a word opens a line against how often it stands capitalised inside one; how often a
word with a stop closes a line against how often text goes on after it), by its length, and by its
structure: quotations must be balanced within it, and speech stays with the clause that reports it,
also when it resumes after that clause. A line break always ends a sentence.

The counts are kept in ``BUCKETS`` hashed counters per feature, so what the tasks are given has a fixed
size. Every line with more than one candidate goes through the program. A span is given up only where no continuation
of it can win (see ``_search``), so long lines cost little more than their length.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.encoding import wrong_rows
from quire.llm.pairs import PairModel

BUCKETS = 1 << 17
FEATURES = ("open", "inside", "close", "goes_on")

#: Abbreviations that come before a name or number, and such as may well end a sentence.
BEFORE = frozenset("проф ул см стр им акад гр кн рис табл пл просп бул mr mrs ms dr st lt prof no nos vol vols pp p ch fig rev capt col gen hon sh dots ko'ch mashh д-р".split())
MAY_END = frozenset("г гг в вв т.д д пр др т.п п руб коп кг км etc ltd inc co jr sr p.m a.m h.k y yy ж жж т.б б т.с.с с lb oz b.c".split())
#: Verbs that report speech where the clause begins with a capital or has no case.
REPORTS_HAN = re.compile(r"(?:说|道|问|喊|答|叫|嚷|笑|叹|吼)(?:着|了)?[。！？]")
REPORTS_LATIN = re.compile(r"\b(?:wanted to know|said|asked|cried|muttered|whispered|replied|answered|shouted|called|added|murmured|wondered)\b(?!,? *[“\":])")

_OPENERS, _CLOSERS = "«“„「『", "»”“」』"
_MATCH = {"«": "»", "“": "”", "„": "“", "「": "」", "『": "』"}
_TERM = re.compile(r"[.!?…。！？]+[\"'”’»」』)\]]*")
_REPORT_DASH = regex.compile(r"[,!?…»”.\"]\s*[—–-]\s+(?=\p{Ll})")
_SPEECH_DASH = regex.compile(r"(?:^|(?<=[.!?…»”\"。]\s))\s*[—–-]\s+(?=[\p{Lu}\p{N}«“?!…])")
_WORD_AFTER = regex.compile(r"[\s—–«“„\"'「『(\[-]*([\p{L}\p{M}\p{N}ʻʼ'’-]+)")
_DATE = regex.compile(r"(?:\d{1,2}\.\d{1,2}\.)?\d{4}(?:\s|$)")
_ALNUM = regex.compile(r"[\p{L}\p{N}]")
_LINES = re.compile(r"[^\n\r\x0b\x0c\x85  ]+")
#: Counting patterns over whole batches; the joined texts have a line break between them.
_OPEN_LINE = re.compile(r"^[^\w\n]*([^\W\d_a-zа-яё㐀-鿿][\w'’-]*)", re.M)
_INSIDE = regex.compile(r"(?<=[\p{Ll}\p{N},;] )(\p{Lu}[\p{L}\p{M}ʻʼ'’-]*)")
_STOP = regex.compile(r"\.(?:(?=[\"'”’»)]*$)|(?= [\p{Ll}\p{N}]))", regex.M)
_HAN_OPEN = regex.compile(r"(?:^|(?<=[。！？]))([\p{Han}]{2})", regex.M)


def bucket(word: str) -> int:
    return zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % BUCKETS


@dataclass
class SentenceModel:
    """Hashed counts, one row per feature."""

    counts: np.ndarray

    def odds_open(self, word: str) -> float:
        b = bucket(word)
        return max(-4.0, min(4.0, math.log((float(self.counts[0, b]) + 0.5) / (float(self.counts[1, b]) + 0.5))))

    def odds_close(self, word: str) -> float:
        b = bucket(word)
        return max(-4.0, min(4.0, math.log((float(self.counts[2, b]) + 0.5) / (float(self.counts[3, b]) + 0.5))))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((len(FEATURES), BUCKETS), np.int64)
    patterns = ((0, _OPEN_LINE), (1, _INSIDE), (0, _HAN_OPEN))
    for batch in batches:
        joined = "\n".join(t for t in batch.column(0).to_pylist() if t)
        for row, pattern in patterns:
            for word, n in Counter(pattern.findall(joined)).items():
                total[row, bucket(word)] += n
        stops: tuple[Counter, Counter] = (Counter(), Counter())
        for m in _STOP.finditer(joined):
            at = m.start()
            before = joined[max(0, at - 25) : at]
            cut = max(before.rfind(c) for c in " \n«“„\"(")
            word = before[cut + 1 :]
            if word and (cut >= 0 or len(before) < 25):
                stops[joined[at + 1 : at + 2] == " "][word] += 1
        for row, counter in zip((2, 3), stops):
            for word, n in counter.items():
                total[row, bucket(word)] += n
    flat = total.ravel()
    seen = np.flatnonzero(flat)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(flat[seen])], names=["k", "n"])


def fit_sentences(texts: DataFrame) -> SentenceModel:
    """Count opening and closing words over a DataFrame of one text column; nulls and no rows are fine."""
    rows = texts.mapInArrow(_count, "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(FEATURES) * BUCKETS, np.float32)
    counts[rows.k.to_numpy()] = rows.n.to_numpy()
    return SentenceModel(counts.reshape(len(FEATURES), BUCKETS))


def _quoted(line: str) -> list[tuple[int, int]]:
    """Outermost quotations of a line that are closed in it, as half-open spans."""
    spans, stack = [], []
    straight = -1
    for m in re.finditer("[«“„「『»”」』\"']", line):
        c, i = m.group(), m.start()
        if c == '"':
            if straight < 0:
                straight = i
            else:
                spans.append((straight, i + 1))
                straight = -1
        elif c == "'":
            before, after = line[i - 1 : i] or " ", line[i + 1 : i + 2] or " "
            if before.isspace() and not after.isspace():
                end = re.compile(r"[.!?,…]'(?=\s|$)").search(line, i + 1)
                if end:
                    spans.append((i, end.end()))
        elif stack and c == _MATCH[stack[-1][0]]:
            o, a = stack.pop()
            if not stack:
                spans.append((a, i + 1))
        elif c in _OPENERS:
            stack.append((c, i))
    if stack and not spans:
        return []
    return sorted(spans)


def _break_odds(line: str, at: int, end: int, model: SentenceModel) -> float | None:
    """Log odds that a sentence ends at ``end``, where a terminator that began at ``at`` and its closing
    marks end; None if no sentence can end there. Large values need no search."""
    nxt = end
    while nxt < len(line) and line[nxt].isspace():
        nxt += 1
    if nxt >= len(line):
        return 99.0
    c, mark = line[nxt], line[at]
    if mark in "。！？":
        return None if c in "，、；,;：—" else 20.0
    han = "㐀" <= c <= "鿿" or nxt == end and line[end - 1] in "”」』"
    if nxt == end and not han and c not in "“「『«":
        # text goes on without a space: a decimal, an address, or a space left out
        if not (mark in ".!?…" and at > 1 and end == at + 1 and line[at - 1].islower() and line[at - 2].islower() and c.isupper() and (line[nxt + 1 : nxt + 2].islower() or line[nxt + 1 : nxt + 2].isspace())):
            return None
        return 3.0
    if c in ",;:)]»”’…%" or c.islower():
        return None
    if mark == "…" or line.startswith("...", at):
        if han:
            return 6.0 if line[end - 1] in "”」』" else 1.5 * model.odds_open(line[nxt : nxt + 2]) + 0.5
        if nxt == end and c in "“「『«":
            return 2.0
        return 6.0
    if mark in "!?":
        return 20.0
    start = at
    while start > 0 and not line[start - 1].isspace() and line[start - 1] not in "«“„\"(「『":
        start -= 1
    word = line[start:at]
    if not word:
        return 4.0
    if len(word) == 1 and word.isupper():
        return -9.0
    m = _WORD_AFTER.match(line, end)
    follower = m.group(1) if m else ""
    plain = word.lower()
    short = len(word) <= 4 or "." in word or plain in BEFORE or plain in MAY_END
    if not short:
        b = model.odds_close(word)
        return 12.0 if b >= -1 else 4.0 + b
    if c.isdigit():
        if plain in BEFORE:
            return -9.0
        return 1.5 * model.odds_close(word) + (4.0 if _DATE.match(line, nxt) else 0.0 if plain in MAY_END else 0.5)
    if plain in BEFORE:
        return -9.0
    odds = 0.7 * model.odds_close(word)
    if plain in MAY_END:
        odds += 1.0
        if plain in ("г", "гг", "в", "вв"):
            odds += 3.0 if re.search(r"\d\s*$", line[:start]) else -6.0
    elif len(word) > 1:
        odds += 2.5
    if c in "—–«“„\"'":
        return odds + 2.0
    return odds + (model.odds_open(follower) if follower else 0.0)


#: What a clause that reports speech costs outside a span of speech, and the most that a span of speech can win at one place.
UNREPORTED, REWARD = 40.0, 26.0


def _next(places: list[int], after: int) -> int:
    i = bisect_right(places, after)
    return places[i] if i < len(places) else 1 << 30


def _quoted_between(quotes: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether a whole quotation lies between two places; the spans are sorted and apart."""
    i = bisect_left(quotes, (a, a))
    return i < len(quotes) and quotes[i][1] <= b


def _search(line: str, ends: list[int], odds: list[float], model: SentenceModel) -> list[int]:
    """The chosen ends: dynamic programming over spans between candidates.

    A span that has passed candidates with positive odds of ``passed`` in all is given up where cutting it at
    all of them is sure to score more: that gains twice the odds and no longer span, and loses at most ``UNREPORTED`` for each
    part with a reporting clause (those so far and one to come) and the three rewards that a span of speech can have.
    """
    quotes = _quoted(line)
    reports = [m.end() for m in _REPORT_DASH.finditer(line)]
    speeches = [m.end() for m in _SPEECH_DASH.finditer(line)]
    inside, closes_quote = [False] * len(ends), [False] * len(ends)
    opened = {b: a for a, b in quotes}
    for a, b in quotes:
        for i in range(bisect_right(ends, a), bisect_left(ends, b)):
            inside[i] = True
    for i, e in enumerate(ends):
        closes_quote[i] = e in opened
    # after quoted speech the clause that reports it belongs to it
    for i, e in enumerate(ends[:-1]):
        if not closes_quote[i]:
            continue
        a = opened[e]
        before = line[:a].rstrip()
        until = ends[i + 1]
        clause = line[e:until]
        if re.match(r"\s*[—–-]\s+", clause) and regex.match(r"\s*[—–-]\s+\p{Ll}", clause):
            odds[i] = -60.0
        elif before[-1:] in ("：", ":", ",") or any(q in clause for q in "“「『«："):
            continue
        elif REPORTS_HAN.search(clause) and len(clause) <= 40 or REPORTS_LATIN.search(clause) and len(clause) <= 160:
            odds[i] = -60.0
    n = len(ends)
    best = [-1e18] * (n + 1)
    back = [0] * (n + 1)
    best[0] = 0.0
    for i in range(n):
        if best[i] <= -1e17:
            continue
        a = ends[i - 1] if i else 0
        inner = passed = 0.0
        first = a
        while first < len(line) and line[first].isspace():
            first += 1
        dashed = first < len(line) and line[first] in "—–-" and line[first + 1 : first + 2].isspace()
        resumed = False
        for j in range(i, n):
            b = ends[j]
            own_reports = reports[bisect_right(reports, a) : bisect_right(reports, b)]
            score = best[i] + inner + (odds[j] if odds[j] < 90 else 20.0)
            if inside[j]:
                score -= 60.0
            if own_reports and not dashed and not _quoted_between(quotes, a, own_reports[0]) and not (line[first : first + 1] in "«“\"'"):
                score -= UNREPORTED
            # the whole span: a mild prior on its length
            score -= 0.002 * max(0, b - a - 220)
            if score > best[j + 1]:
                best[j + 1], back[j + 1] = score, i
            # going on past j
            cost = odds[j] if odds[j] < 90 else 20.0
            if inside[j] or odds[j] <= -50:
                cost = 0.0
            elif dashed:
                coming = _next(reports, b)
                start = _next(speeches, b)
                if not own_reports and coming < 1 << 30 and coming <= start and coming <= (ends[j + 2] if j + 2 < n else 1 << 30):
                    cost = -3.0 - max(cost, 0.0)
                elif own_reports and not resumed and (m := _SPEECH_DASH.match(line, b + 1 if line[b : b + 1] == " " else b)):
                    nxt = j + 1
                    while nxt + 1 < n and inside[nxt]:
                        nxt += 1
                    later = _next(speeches, m.end())
                    if not any(m.end() < r <= min(later, ends[min(nxt + 1, n - 1)] if nxt + 1 < n else ends[nxt]) for r in reports):
                        cost, resumed = -6.0 - max(cost, 0.0), True
            inner -= cost
            passed += max(cost, 0.0)
            if 2 * passed > UNREPORTED * (len(own_reports) + 1) + 3 * REWARD:
                break
    out, k = [], n
    while k > 0:
        out.append(ends[k - 1])
        k = back[k]
    return out[::-1]


def sentence_ends(text: str, model: SentenceModel) -> list[tuple[int, int]]:
    """Half-open spans of the sentences of a text, without the white space around them."""
    spans: list[tuple[int, int]] = []
    for piece in _LINES.finditer(text):
        line, offset = piece.group(), piece.start()
        ends, odds = [], []
        for m in _TERM.finditer(line):
            o = _break_odds(line, m.start(), m.end(), model)
            if o is None:
                continue
            ends.append(m.end())
            odds.append(o)
        stop = len(line.rstrip())
        if not stop:
            continue
        if not ends or ends[-1] < stop:
            ends.append(stop)
            odds.append(99.0)
        if len(ends) > 1:
            ends = _search(line, ends, odds, model)
        start = 0
        for e in ends:
            a = start
            while a < e and line[a].isspace():
                a += 1
            if a < e and _ALNUM.search(line, a, e):
                spans.append((offset + a, offset + e))
            elif a < e and spans and start > 0:
                spans[-1] = (spans[-1][0], offset + e)
            start = e
    return spans


def split_sentences(df: DataFrame, keys: list[str], text: str, model: SentenceModel, pairs: PairModel | None = None) -> DataFrame:
    """``(*keys, start_char, end_char)``: a row per sentence, in code points of the raw text.

    Null and empty texts and texts without a letter or digit have no sentence; repeated rows each give theirs.
    With ``pairs`` texts that were decoded with a wrong encoding are left out.
    """
    part = df.select(*keys, F.col(text).alias("_text")).filter(F.length("_text") > 0)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema if f.name in keys) + ", start_char int, end_char int"
    shared = df.sparkSession.sparkContext.broadcast((model, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pair_model = shared.value
        for batch in batches:
            rows, starts, ends = [], [], []
            texts = batch.column(len(keys)).to_pylist()
            wrong = set(wrong_rows(texts, pair_model)) if pair_model is not None else ()
            for i, t in enumerate(texts):
                if i in wrong:
                    continue
                for a, b in sentence_ends(t, own):
                    rows.append(i)
                    starts.append(a)
                    ends.append(b)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(len(keys))), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[*keys, "start_char", "end_char"])

    return part.mapInArrow(run, schema)
