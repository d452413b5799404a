"""Texts decoded with a wrong encoding: find them, restore them where possible.

Every pair of neighbouring characters is scored by corpus mutual information (``pairs``). The
maximum-scoring segments of improbability are the suspect runs of a text; only rows that have one go
further. Inside its runs, widened to whole words, and nowhere else, inverse mappings are tried: encode with the wrong
encoding, decode with the right one, again until nothing changes for text that was mangled repeatedly. A
mapping is accepted if the restored run scores clearly better, so that ends. Pairs with a character that stands for lost
bytes (U+FFFD, question marks in a row or inside a word) are improbable by themselves, so such places
are in segments, too; runs in which they make up words have lost bytes and are restored as far as it goes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.codepoints import GAP, batched, codes
from quire.llm.pairs import PairModel

#: Encodings that a text may wrongly have been read in, and those it may have been written in.
READ_AS = ("cp1252", "latin-1", "cp1251", "cp866", "koi8-r", "kz1048", "ptcp154", "mac_roman", "mac_cyrillic", "iso8859-5", "cp437", "cp850", "cp1254", "cp1250", "gb18030", "cp932", "big5", "euc_kr")
WRITTEN_IN = ("utf-8", "cp1251", "koi8-r", "cp866", "kz1048", "ptcp154", "gb18030", "big5", "iso8859-5", "mac_cyrillic", "cp1254")
#: Encodings in which a UTF-8 sequence doesn't look like a usual word; for the others only strong segments count.
SIGNED = ("cp1252", "latin-1", "cp1251", "cp866", "koi8-r", "mac_roman", "iso8859-5", "cp437", "cp850", "cp1254", "cp1250")
#: Double-byte encodings to read in: what was written in a single-byte one does not come out of them as text.
DOUBLE = ("gb18030", "cp932", "big5", "euc_kr")
MULTIBYTE = frozenset(("utf-8", "gb18030", "big5"))

#: A pair costs by how many bits it lies below the usual score less this slack.
SLACK = 5.0
#: Segments of this many bits are tried in rows that hold a possible UTF-8 sequence.
WEAK = 8.0
#: Single-byte encodings, which decode anything, are only tried on segments of this many bits.
STRONG = 28.0
#: Least gain in bits of an accepted mapping, as a sum and, for single-byte encodings, as a mean.
GAIN, MEAN_GAIN = 18.0, 4.0
#: Least number of characters beyond ASCII for a mapping between single-byte encodings.
LETTERS = 4
#: A run reads like text of a wrong single-byte encoding if its mean lies this far below the usual score.
STRANGE = -6.5
#: Mean distance below the usual score at which restored text counts as clean.
CLEAN = -3.0
#: Bits of a pair with a replacement character or with a question mark before a small letter, and of two question marks or one after a space.
HOLE, ASKED = 9.0, 4.0

_LOST = regex.compile(r"�|\?{5,}|(?:^|(?<=[\s«“\"(]))\?+[,.:;!]*(?: +[—–-]?\?+[,.:;!]*)+(?=$|[\s»”\")])")
_LOST_LETTER = regex.compile(r"\p{Ll}\?\p{Ll}")
_WORD = re.compile(r"\S+")


_HOLE = regex.compile(r"[\x80-\x9f�]")


def _encode(text: str, name: str) -> bytes | None:
    """Bytes of a text in an encoding; C1 controls stand for the bytes that single-byte encodings leave
    open, and up to a quarter of replacement characters for bytes that are lost."""
    try:
        return text.encode(name)
    except UnicodeEncodeError as e:
        if not _HOLE.match(text[e.start]):
            return None
    single = name not in DOUBLE
    out, lost = bytearray(), 0
    for part in regex.split(r"([\x80-\x9f�])", text):
        try:
            out += part.encode(name)
        except UnicodeEncodeError:
            if part == "�":
                lost += 1
                out += b"\xff" if single else b"?"
            elif len(part) == 1 and "\x80" <= part < "\xa0" and single:
                out.append(ord(part))
            else:
                return None
    return bytes(out) if lost * 4 <= len(text) else None


def _decode(data: bytes, name: str, lossy: bool) -> str | None:
    try:
        return data.decode(name)
    except UnicodeDecodeError:
        if not lossy:
            return None
    text = data.decode(name, "replace")
    return text if text.count("�") * 4 <= len(text) else None


def _odd(text: str) -> bool:
    return any(c < " " and c not in "\n\r\t" or "\x7f" <= c < "\xa0" or "\ue000" <= c < "\uf900" for c in text)


def _inverse(run: str, left: str, right: str, model: PairModel, strong: bool, word: bool = False) -> tuple[float, str] | None:
    """A mapping of a run that restores it, with its gain; ``left``/``right``: the characters beside it.

    Mappings are tried in their fixed order and the first whose result reads like usual text is taken,
    else the one with the largest gain.
    """
    strange = sum(c > "\x7f" for c in run)
    if strange < 2:
        return None

    def score(text: str) -> tuple[float, float]:
        pairs = model.of(left + text + right)
        pairs = np.minimum(pairs[bool(left) : len(pairs) - bool(right)] - model.usual, 0)
        total = float(pairs.sum())
        return total, total / max(1, len(pairs))

    if strong := strong and strange >= LETTERS:
        before, mean = score(run)
        strong = mean < STRANGE
    else:
        before = mean = None
    targets = WRITTEN_IN if strong else WRITTEN_IN[:1]
    lossy = "�" in run
    best: tuple[float, str] | None = None
    seen = {run}
    encoded = [(w, data) for w in READ_AS if (data := _encode(run, w)) is not None]
    for target in targets:
        if word and target in ("gb18030", "big5"):
            continue
        for wrong, data in encoded:
            if target == wrong or wrong in DOUBLE and target not in MULTIBYTE or (text := _decode(data, target, lossy)) is None or text in seen:
                continue
            forms = [text]
            if target == "utf-8" and not text.isascii() and (again := _encode(text, wrong)) and (twice := _decode(again, target, lossy)):
                forms.append(twice)
            for form in forms:
                seen.add(form)
                if target != "utf-8" and _odd(form):
                    continue
                if before is None:
                    before, mean = score(run)
                after, new_mean = score(form)
                gain = after - before
                if target == "utf-8" and len(form) < len(run):
                    enough = gain >= GAIN
                else:
                    enough = gain >= GAIN and new_mean - mean >= MEAN_GAIN and (target not in MULTIBYTE or len(run) - len(form) >= 2)
                if enough and (best is None or gain > best[0]):
                    best = gain, form
                    if new_mean >= CLEAN:
                        return best
    return best


def _weights(cp: np.ndarray, model: PairModel) -> np.ndarray:
    """Bits of improbability of each pair of neighbouring code points."""
    w = model.usual - SLACK - model.pairs(cp)
    a, b = cp[:-1], cp[1:]
    ask = b == 0x3F
    w[ask & ((a == 0x3F) | (a == 0x20))] = np.maximum(w[ask & ((a == 0x3F) | (a == 0x20))], ASKED)
    hole = ((a == 0xFFFD) | (b == 0xFFFD)) | (a == 0x3F) & _SMALL[b]
    w[hole] = np.maximum(w[hole], HOLE)
    return w


def _small_letters() -> np.ndarray:
    small = np.zeros(GAP + 1, bool)
    for cp in range(0x61, 0x600):
        small[cp] = chr(cp).islower()
    return small


_SMALL = _small_letters()


def _segments(weights: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (half-open, over pairs) with their bits, from left to right.

    Candidates are kept with the running total before and after them; a new one swallows those to its
    left as long as the stretch between raises the total.
    """
    kept: list[list[float]] = []  # begin, end, total before, total after
    totals = np.cumsum(weights)
    for i in np.flatnonzero(weights > 0).tolist():
        after = float(totals[i])
        item = [i, i + 1, after - float(weights[i]), after]
        while kept:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= item[2]:
                j -= 1
            if j < 0 or kept[j][3] >= item[3]:
                break
            item = [kept[j][0], item[1], kept[j][2], item[3]]
            del kept[j:]
        kept.append(item)
    return [(int(a), int(b), after - before) for a, b, before, after in kept if after - before >= WEAK]


_LEFT_EDGE = regex.compile(r"[\s。！？；”]")
_RIGHT_EDGE = regex.compile(r"[\s“]")
_HAN = regex.compile(r"[\p{Han}\u3000-\u303f\uff00-\uffef]")
_NO_HAN = regex.compile(r"[^\p{Han}\u3000-\u303f\uff00-\uffef]{4,}")


def _runs(text: str, model: PairModel) -> list[tuple[int, int, float, bool]]:
    """Suspect runs of characters with their bits, and whether they hold what may be a UTF-8 sequence;
    widened to whole words (to whole clauses in scripts without spaces), near ones of a line joined."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32)
    found = _segments(_weights(np.concatenate(([0x0A], cp, [0x0A])), model))
    if not found:
        return []
    more = _MORE[cp]
    signed = np.zeros(len(cp) + 1, bool)
    signed[: len(cp) - 1] = (_TWO[cp[:-1]] & more[1:]) != 0
    signed[: max(len(cp) - 2, 0)] |= (_THREE[cp[:-2]] & more[1:-1] & more[2:]) != 0
    signed[: len(cp)] |= cp == 0xFFFD
    spans: list[list] = []
    for a, b, bits in found:
        a, b = max(0, a - 1), min(len(text), b)
        while a > 0 and not _LEFT_EDGE.match(text[a - 1]):
            a -= 1
        while b < len(text) and not _RIGHT_EDGE.match(text[b]):
            b += 1
        if spans and a - spans[-1][1] <= 2 and "\n" not in text[spans[-1][1] : a]:
            spans[-1][1], spans[-1][2] = max(b, spans[-1][1]), spans[-1][2] + bits
        else:
            spans.append([a, b, bits])
    return [(a, b, bits, bool(signed[a:b].any())) for a, b, bits in spans if a < b and (not text[a:b].isascii() or "?" in text[a:b])]


def _worth(model: PairModel, run: str) -> bool:
    """Whether a run reads badly enough for a wrong single-byte encoding."""
    pairs = np.minimum(model.of(run) - model.usual, 0)
    return float(pairs.mean()) < STRANGE + 1.5


def repair(text: str, model: PairModel, only_find: bool = False) -> tuple[bool, bool, str]:
    """(was decoded wrongly, has lost bytes, restored text); with ``only_find`` it ends at the first finding."""
    found = lost = False
    while True:
        changed = False
        runs = _runs(text, model)
        if not lost:
            holes = sum(len(_LOST_LETTER.findall(text, a, b)) for a, b, *_ in runs)
            lost = holes >= 2 or any(_LOST.search(text, a, b) for a, b, *_ in runs)
            found |= lost
        if found and only_find:
            return found, lost, text
        runs = [r for r in runs if not text[r[0] : r[1]].isascii()]
        line_bits: dict[int, float] = {}
        for a, _, bits, _ in runs:
            line = text.rfind("\n", 0, a)
            line_bits[line] = line_bits.get(line, 0.0) + bits
        for a, b, bits, signed in reversed(runs):
            strong = line_bits.get(text.rfind("\n", 0, a), bits) >= STRONG
            words: list[tuple[int, int]] | None = None
            if not signed:
                # without such a sequence only a wrong single-byte or double-byte encoding can be meant
                if not strong:
                    continue
                if bits < STRONG or not _worth(model, text[a:b]):
                    words = [w.span() for w in _WORD.finditer(text, a, b) if sum(c > "\x7f" for c in w.group()) >= LETTERS and _worth(model, w.group())]
                    if not words:
                        continue
            spans = {(a, b)}
            if words is not None:
                spans = set(words)
            if _HAN.search(text, a, b):
                spans.update(m.span() for m in _NO_HAN.finditer(text, a, b))
            tries = [(m[0], m[1], p, q) for p, q in spans if (m := _inverse(text[p:q], text[max(0, p - 1) : p], text[q : q + 1], model, strong))]
            if tries:
                if only_find:
                    return True, lost, text
                _, new, p, q = max(tries)
                text, changed = text[:p] + new + text[q:], True
                if p < a:
                    break
                continue
            if not signed and words is None and bits < STRONG:
                continue
            # a mangled word inside a good run: try the words on their own
            for p, q in reversed(words if words is not None else [w.span() for w in _WORD.finditer(text, a, b)]):
                if not text[p:q].isascii() and (p, q) != (a, b) and (m := _inverse(text[p:q], text[max(0, p - 1) : p], text[q : q + 1], model, strong, True)):
                    if only_find:
                        return True, lost, text
                    text, changed = text[:p] + m[1] + text[q:], True
        found |= changed
        if not changed:
            break
    return found, lost or "�" in text, text


def _utf8_classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit sets over code points: in which single-byte encodings a character is a byte that opens a
    two-byte or a three-byte UTF-8 sequence, or that continues one."""
    two, three, more = (np.zeros(0x110001, np.uint32) for _ in range(3))
    for bit, name in enumerate(SIGNED):
        for byte in range(0x80, 0xF5):
            c = ord(bytes([byte]).decode(name, "replace"))
            c = byte if c == 0xFFFD else c
            mask = more if byte < 0xC0 else two if 0xC2 <= byte < 0xE0 else three if byte >= 0xE0 else None
            # where letters of usual words are such bytes a sequence tells nothing: small letters of the DOS code pages, ё of koi8-r
            if mask is not None and not (mask is three and name in ("cp866", "cp437", "cp850")) and not (name == "koi8-r" and c in (0x401, 0x451)):
                mask[c] |= 1 << bit
    return two, three, more


_TWO, _THREE, _MORE = _utf8_classes()


def suspects(texts: list[str | None], model: PairModel) -> np.ndarray:
    """Rows of a batch that need a look: with a segment of at least ``STRONG`` bits, or with one of at least
    ``WEAK`` bits and characters that are together a UTF-8 sequence in some encoding or may stand for lost bytes.
    """
    c = codes(texts)
    mark = np.zeros(len(c), bool)
    if not len(c):
        return mark
    weights = _weights(c.cp, model)
    # Kadane's recurrence for all rows at once: totals drop far at each row's start, so no minimum reaches across rows.
    first = c.start - 1
    total = np.concatenate(([0.0], np.cumsum(weights, dtype=np.float64)))
    total = total - total[first][c.row]
    drop = total - c.row * 1e9
    best = np.maximum.reduceat(drop - np.minimum.accumulate(drop), first)
    more = _MORE[c.cp]
    two = (_TWO[c.cp[:-1]] & more[1:]) != 0
    three = (_THREE[c.cp[:-2]] & more[1:-1] & more[2:]) != 0
    mark[c.row[:-1][two]] = True
    mark[c.row[:-2][three]] = True
    ask = c.cp == 0x3F
    mark[c.row[c.cp == 0xFFFD]] = True
    mark[c.row[:-1][ask[:-1] & (ask[1:] | _SMALL[c.cp[1:]])]] = True
    return (best >= STRONG) | (mark & (best >= WEAK))


def wrong_rows(texts: list[str | None], model: PairModel) -> list[int]:
    """Positions of the texts of a batch that were decoded wrongly; a text is as bad as its worst line."""
    out: list[int] = []
    for a, b in batched(texts):
        lines, owner = [], []
        for i in range(a, b):
            if text := texts[i]:
                own = text.split("\n") if "\n" in text else [text]
                lines += own
                owner += [i] * len(own)
        done = -1
        for k in np.flatnonzero(suspects(lines, model)).tolist():
            if owner[k] != done and repair(lines[k], model, only_find=True)[0]:
                done = owner[k]
                out.append(done)
    return out


def find_wrong(df: DataFrame, keys: list[str], text: str, model: PairModel) -> DataFrame:
    """``keys`` of the rows whose text was decoded with a wrong encoding; null and empty texts are none."""
    part = df.select(*keys, F.col(text).alias("_text")).filter(F.length("_text") > 0)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema if f.name in keys)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take = pa.array(wrong_rows(batch.column(len(keys)).to_pylist(), shared.value), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(i).take(take) for i in range(len(keys))], names=keys)

    return part.mapInArrow(run, schema)


def fix_encoding(df: DataFrame, keys: list[str], text: str, model: PairModel) -> DataFrame:
    """``(*keys, lost, restored)`` of the rows whose text was decoded with a wrong encoding.

    Null, empty and clean texts give no row; repeated rows each give theirs. ``lost`` tells that bytes
    are gone for good, so ``restored`` is only as near as the text allows.
    """
    part = df.select(*keys, F.col(text).alias("_text")).filter(F.length("_text") > 0)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema if f.name in keys) + ", lost boolean, restored string"
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keys)).to_pylist()
            rows, lost, restored = [], [], []
            for i in wrong_rows(column, shared.value):
                _, gone, new = repair(column[i], shared.value)
                rows.append(i)
                lost.append(gone)
                restored.append(new)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(len(keys))), pa.array(lost, pa.bool_()), pa.array(restored, pa.string())], names=[*keys, "lost", "restored"])

    return part.mapInArrow(run, schema)

