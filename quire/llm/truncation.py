"""Texts cut off by field limits or in transfer, and how often each source cuts.

A stack automaton reads every text from its first to its last character. Its stack holds the quotations,
brackets and tags that are open; its control state tells whether a sentence is open (something stands after the last
closing mark) and whether an entity, an escape, a tag or a multibyte character is broken off. The state at
the end is what all decisions are made from; a text whose automaton ends with nothing open is complete.

Each source has a baseline over all its documents: the length at which its texts pile up, in code points
or bytes; the marks it adds (endings that are frequent there and rare in other sources); how much of its prose stands in
paragraphs without a terminator; and how many of its closed texts leave a quotation or bracket open. What is usual
in a source is no sign of a cut there. An open sentence is a cut if the line is prose; in verse, a table of contents or a
signature, where lines end open, it is a cut only if the text stands at its source's limit, carries its mark, leaves more open
than the sentence, or its last word never ends a full line anywhere in the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.session import cut

#: A source's texts pile up at a length if at least this share (and ``PILE_MIN`` texts) have it.
PILE, PILE_MIN = 0.01, 3
#: Texts cut at a word's end pile up over a word's length; that takes a larger share. A pile is so many times as dense as
#: the lengths before it, and has so many times the texts beyond it.
WORD, WORD_PILE, DENSER, BEYOND = 16, 0.05, 4, 10
#: A bare ending is a source's mark if it is this many times as frequent there as in the middle one of all sources.
MARK_RATIO, MARK_SHARE = 3.0, 0.015
#: Where this share of a source's prose ends without a terminator, or of its closed texts with something open, that is its way.
USUAL_OPEN, USUAL_UNBALANCED = 0.5, 0.2

#: What opens and what closes a structure, tags that never close, and marks of an omission.
_PAIRS = {"«": "»", "“": "”", "„": "“", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "《": "》", "{": "}"}
_CLOSERS = {v: k for k, v in _PAIRS.items()}
_VOID = frozenset("br hr img input meta link wbr col area base source".split())
_BRACKETED = regex.compile(r"\s*(?:\[(?:\.{3}|…)\]|\((?:\.{3}|…)\)|<(?:\.{3}|…)>)\s*\Z")
_BARE = regex.compile(r"(?:\.{3}|…|—|–|-)\s*\Z")

#: What moves the automaton; everything else only keeps a sentence open.
_EVENT = regex.compile(
    r"(?P<para>\n\s*\n)|(?P<stop>[.!?…。！？]+|[’'])|(?P<open>[«“„「『(（\[《{])|(?P<close>[»”」』)）\]》}])|(?P<straight>\")"
    r"|(?P<tag></?([A-Za-z][\w-]*)(?:\s[^<>]*)?/?>)|(?P<broken>�\s*\Z|&\#?\w{0,8}\Z|\\u[0-9a-fA-F]{0,3}\Z|\\\Z|%[0-9A-F]?\Z|<[A-Za-z/][^<>]{0,200}\Z)"
)
_ENDS_CLOSED = regex.compile(r"[.!?…。！？»”’\"'」』]\s*\Z")
_BREAK = regex.compile(r"\s*(?:[*＊#~—–\-]\s*){2,}\Z")
_BROKEN_SPEECH = regex.compile(r"\s*[—–-]\s*(?:\S+\s+){0,3}\S+[—–]\Z")
_CAPITAL = r"\p{Lu}[\p{L}\p{M}ʻʼ’'.-]*"
_SIGNED = regex.compile(rf"\s*{_CAPITAL}(?: {_CAPITAL})*,?\Z")
_HAN_NAME = regex.compile(r"[一-鿿]{2,4}[，,]?(?:\n[一-鿿]{2,5})?\Z")
_ENTRY = regex.compile(r"\s*\d{1,4}[.)] ")
_HAN_TAIL = regex.compile(r"[一-鿿]{1,2}\Z")
_WORD_TAIL = regex.compile(r"([\p{L}\p{M}\p{N}ʻʼ’'-]+)[^\p{L}\p{N}]*\Z")
_WORDS = regex.compile(r"[\p{L}\p{M}ʻʼ]{4,}(?=[^\p{L}\p{M}ʻʼ])")
_HAN_OPENING = regex.compile(r"(?:\A|\n)([一-鿿]{2})[^\n]{7,}")


@dataclass
class State:
    """The automaton at the end of a text: ``stack`` of open structures, whether a sentence is open, whether something is
    broken off; and the characters of all paragraphs before the last, and of those among them that end open."""

    stack: list[str]
    sentence: bool
    broken: bool
    chars: int = 0
    chars_open: int = 0


def read(text: str) -> State:
    """Run the stack automaton over a text."""
    stack: list[str] = []
    closed = begin = 0  # where the last closing mark and the paragraph before it ended
    broken = False
    chars = chars_open = 0
    for m in _EVENT.finditer(text):
        kind, c = m.lastgroup, m.group()
        if kind == "stop":
            closed = m.end()
        elif kind == "open":
            if c == "“" and stack and stack[-1] == "„":
                stack.pop()
                closed = m.end()
            else:
                stack.append(c)
        elif kind == "close":
            opener = _CLOSERS.get(c, "")
            if opener in stack:
                while stack.pop() != opener:
                    pass
            if c in "»”」』":
                closed = m.end()
        elif kind == "straight":
            if c in stack:
                while stack.pop() != c:
                    pass
            else:
                stack.append(c)
            closed = m.end()
        elif kind == "para":
            chars += m.start() - begin
            chars_open += m.start() - begin if text[closed : m.start()].strip() else 0
            closed = begin = m.end()
        elif kind == "broken":
            broken = True
        elif not c.endswith("/>"):
            name = m.group(m.re.groupindex["tag"] + 1).lower()
            if c[1] != "/":
                stack += [name] if name not in _VOID else []
            elif name in stack:
                while stack.pop() != name:
                    pass
            closed = m.end()
    return State(stack, bool(text[closed:].strip()), broken, chars, chars_open)


def _tail(line: str) -> str:
    """What a line ends with: its last word, or its last two characters in a script without spaces."""
    line = line.rstrip(" ")
    m = _HAN_TAIL.search(line)
    if m:
        return m.group()
    m = _WORD_TAIL.search(line[-200:])
    return m.group(1).lower() if m else ""


def _last_line(left: str) -> dict:
    """What the last line is: ``kind`` prose, line (verse, a list), signature, name or break; its tail and more."""
    blocks = regex.split(r"\n\s*\n", left.rstrip(" "))
    block = blocks[-1]
    lines = block.split("\n")
    line = lines[-1]
    entry = bool(_ENTRY.match(line))
    unclosed = sum(not _ENDS_CLOSED.search(x) for x in lines[:-1])
    listed = len(lines) > 1 and unclosed * 2 > len(lines) - 1 or entry
    short = len(blocks) > 1 and len(lines) <= 2
    kind = "line" if listed else "prose"
    if _BREAK.match(line):
        kind = "break"
    elif short and all(_SIGNED.match(x) and len(x) <= 48 for x in lines) and (len(lines) == 2 or " " in line):
        kind = "signature"
    elif short and _HAN_NAME.match(block):
        kind = "name"
    return {"kind": kind, "tail": _tail(line), "opening": block[:2] if kind == "name" else None, "entry": entry, "entry_done": bool(regex.search(r"\.{3,}\s*\d+\Z", line)), "speech_breaks_off": bool(_BROKEN_SPEECH.match(line))}


_END = {
    "chars": pa.int32(), "bytes": pa.int32(), "bare": pa.int32(), "mark": pa.string(), "open": pa.int32(), "sentence": pa.bool_(), "broken": pa.bool_(), "loose": pa.bool_(), "para_chars": pa.int32(), "para_open": pa.int32(),
    "kind": pa.string(), "tail": pa.string(), "opening": pa.string(), "entry": pa.bool_(), "entry_done": pa.bool_(), "speech_breaks_off": pa.bool_(),
}


def end_of(text: str) -> dict:
    """How a text ends, with the mark of an omission taken off."""
    bare = text.rstrip(" ")
    last = bare[bare.rfind("\n") + 1 :]
    mark, left = "", text
    if m := _BRACKETED.search(text):
        mark, left = "bracket", text[: m.start()]
    elif bare.endswith("..."):
        mark = "dots"
    elif bare.endswith("…"):
        mark = "ellipsis" if not bare.endswith("……") else ""
    elif bare.endswith("—") and len(bare) > 1 and not bare[-2].isspace() and not _BROKEN_SPEECH.match(last) and not _BREAK.match(last):
        mark = "dash"
    if mark not in ("", "bracket") and (m := _BARE.search(text)):
        left = text[: m.start()]
    state = read(left)
    plain = _BRACKETED.sub("", text)
    m = _BARE.search(plain)
    return {
        "chars": len(text), "bytes": len(text.encode("utf-8", "surrogatepass")), "bare": len(plain[: m.start()].rstrip() if m else plain), "mark": mark,
        "open": len(state.stack), "sentence": state.sentence, "broken": state.broken, "loose": bool(left) and left[-1].isspace() and left[-1] != "\n" and not mark, "para_chars": state.chars, "para_open": state.chars_open,
        **(_last_line(left) if state.sentence else {"kind": "", "tail": "", "opening": None, "entry": False, "entry_done": False, "speech_breaks_off": False}),
    }


def read_ends(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, ...)``: how each text of (doc_id, text, source) ends. Null, empty and blank texts have null columns."""
    part = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.col("text").alias("_text"))
    kinds = {pa.int32(): "int", pa.bool_(): "boolean", pa.string(): "string"}
    schema = f"doc_id {part.schema['doc_id'].dataType.simpleString()}, source string, " + ", ".join(f"{k} {kinds[t]}" for k, t in _END.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [end_of(t) if t and t.strip() else {} for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r.get(k) for r in rows], t) for k, t in _END.items())], names=["doc_id", "source", *_END])

    return part.mapInArrow(run, schema)


def _pile(sizes: DataFrame, measure: str, width: int, share: float, name: str) -> DataFrame:
    """(source, ``name``): the length up to which, over ``width`` lengths, a source's texts pile up; sizes: (source, measure, size, texts)."""
    of = Window.partitionBy("source")
    by = of.orderBy("size")
    texts = lambda a, b: F.coalesce(F.sum("texts").over(by.rangeBetween(a, b)), F.lit(0))
    s = sizes.filter(F.col("measure") == measure).select("source", "size", F.sum("texts").over(of).alias("n"), texts(1 - width, 0).alias("inside"), texts(1 - width - WORD, -width).alias("before"), texts(1, Window.unboundedFollowing).alias("beyond"))
    s = s.filter((F.col("inside") >= PILE_MIN) & (F.col("inside") >= share * F.col("n")) & (F.col("inside") * WORD >= DENSER * width * F.col("before")) & (F.col("inside") >= BEYOND * F.col("beyond")))
    return s.groupBy("source").agg(F.max_by("size", F.struct("inside", -F.col("size"))).alias(name))


def source_baselines(ends: DataFrame) -> DataFrame:
    """A row per source of ``read_ends``: (source, n_docs, n_texts, char_limit, byte_limit, at_words, mark_dots, mark_ellipsis, mark_dash,
    open_prose, unbalanced). Sizes are counted per source and length before any window, so no source's texts meet in a task.

    ``at_words``: the source cuts at a word's end, and ``char_limit`` is the length without the mark it adds. ``open_prose``: the
    share of characters in paragraphs that end without a terminator. ``unbalanced``: the share of closed texts that leave
    a structure open.
    """
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    closed = ~F.col("sentence") & (F.col("mark") == "")
    counted = ends.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count("chars").alias("n_texts"),
        *[count(F.col("mark") == m).alias(m) for m in ("dots", "ellipsis", "dash")],
        F.coalesce(F.sum("para_open") / F.nullif(F.sum("para_chars"), F.lit(0)), F.lit(0.0)).alias("open_prose"),
        F.coalesce(count(closed & (F.col("open") > 0)) / F.nullif(count(closed), F.lit(0)), F.lit(0.0)).alias("unbalanced"),
    )
    sizes = cut(ends.filter("chars > 0").select("source", F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("size")) for m in ("chars", "bytes", "bare")]))).groupBy("source", "measure", "size").agg(F.count(F.lit(1)).alias("texts")))
    for pile in (_pile(sizes, "chars", 1, PILE, "exact"), _pile(sizes, "bare", WORD, WORD_PILE, "words"), _pile(sizes, "bytes", 4, PILE, "byte_limit")):
        counted = counted.join(pile, "source", "left")
    every = Window.partitionBy(F.lit(1))  # a row per source
    for mark in ("dots", "ellipsis", "dash"):
        share = F.coalesce(F.col(mark) / F.nullif(F.col("n_texts"), F.lit(0)), F.lit(0.0))
        counted = counted.withColumn(f"mark_{mark}", (share >= MARK_SHARE) & (share >= MARK_RATIO * F.median(F.when(F.col("n_texts") > 0, share)).over(every)))
    return counted.select(
        "source", "n_docs", "n_texts", F.coalesce("exact", "words").alias("char_limit"), "byte_limit", (F.col("exact").isNull() & F.col("words").isNotNull()).alias("at_words"), "mark_dots", "mark_ellipsis", "mark_dash", "open_prose", "unbalanced"
    )


def _seen(docs: DataFrame) -> DataFrame:
    """(key, seen_full, known, opens): the tails of full lines that end without a closing mark, whole words of four letters or more that
    something follows, and (with their number) the first two characters of paragraphs in scripts without spaces; each once per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            tails = {_tail(line) for t in texts if "\n" in t for line in t.split("\n")[:-1] if line.strip() and not _ENDS_CLOSED.search(line)} - {""}
            words = {w for t in texts for w in _WORDS.findall(t.lower())}
            opens: dict[str, int] = {}
            for t in texts:
                for o in _HAN_OPENING.findall(t):
                    opens[o] = opens.get(o, 0) + 1
            keys = list(tails | words | opens.keys())
            for a in range(0, len(keys), 50_000):
                some = keys[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([k in tails for k in some]), pa.array([k in words for k in some]), pa.array([opens.get(k, 0) for k in some], pa.int64())], names=["key", "seen_full", "known", "opens"])

    return docs.select("text").mapInArrow(run, "key string, seen_full boolean, known boolean, opens bigint")


def find_truncated(docs: DataFrame, ends: DataFrame | None = None, base: DataFrame | None = None) -> DataFrame:
    """``(doc_id, source, at_limit, reason)`` of the documents whose text was cut.

    ``docs``: (doc_id, text, source); ``ends`` and ``base`` if they are there already. Null, empty and blank texts are no
    cuts; a null source counts as one source of its own; repeated rows each give their row.
    """
    ends = cut(read_ends(docs)) if ends is None else ends
    base = source_baselines(ends) if base is None else base
    d = ends.filter("sentence AND kind <> 'break'").join(base, "source")
    size = F.when(F.col("at_words"), F.col("bare").between(F.col("char_limit") - WORD + 1, F.col("char_limit"))).otherwise(F.col("chars") == F.col("char_limit"))
    d = d.withColumn("at_limit", F.coalesce(size | F.col("bytes").between(F.col("byte_limit") - 3, F.col("byte_limit")), F.lit(False)))
    # dots close a text unless they are their source's mark
    marked = F.when(F.col("mark").isin("bracket", "dash"), True).when(F.col("mark") == "dots", F.col("mark_dots")).when(F.col("mark") == "ellipsis", F.col("mark_ellipsis") & F.col("at_limit")).otherwise(False)
    d = d.withColumn("marked", marked).filter("(mark = '' OR marked) AND (NOT speech_breaks_off OR marked)")
    d = cut(d.withColumn("unclosed", (F.col("open") > 0) & (F.col("unbalanced") < USUAL_UNBALANCED)))
    asked = d.filter("kind <> 'prose' OR open_prose >= %s" % USUAL_OPEN).select(F.explode(F.array("tail", "opening")).alias("key")).filter("key <> ''").distinct()
    seen = cut(_seen(docs).join(asked, "key", "left_semi").groupBy("key").agg(F.max("seen_full").alias("seen_full"), F.max("known").alias("known"), F.sum("opens").alias("opens")))
    d = d.join(seen.select(F.col("key").alias("tail"), "seen_full", "known"), "tail", "left").join(seen.filter("opens >= 3").select(F.col("key").alias("opening"), F.lit(True).alias("opens_prose")), "opening", "left")
    full = F.coalesce("seen_full", F.lit(False)) | F.col("entry_done") | (F.col("entry") & F.coalesce("known", F.lit(False)))
    unclosed = F.when(F.col("unclosed"), "open quotation or bracket")
    reason = (
        F.when(F.col("broken"), "broken character or markup")
        .when(F.col("marked"), "mark of a cut")
        .when(F.col("at_limit"), "length limit")
        .when(F.col("loose") & (F.col("kind") != "line"), "open end")
        .when(F.col("kind") == "prose", F.coalesce(unclosed, F.when((F.col("open_prose") < USUAL_OPEN) | ~full, "no closing mark")))
        .when(F.col("kind") == "line", F.when(~full, "unfinished line").otherwise(unclosed))
        .when(F.col("kind") == "signature", unclosed)
        .when(F.col("kind") == "name", F.when(F.coalesce("opens_prose", F.lit(False)), "no closing mark").otherwise(unclosed))
    )
    return d.withColumn("reason", reason).filter("reason IS NOT NULL").select("doc_id", "source", "at_limit", "reason")


def truncation_rates(docs: DataFrame) -> DataFrame:
    """``(source, n_docs, n_cut, cut_rate, char_limit, byte_limit, open_prose, unbalanced)`` of every source; empty documents count as documents."""
    ends = cut(read_ends(docs))
    base = cut(source_baselines(ends))
    found = find_truncated(docs, ends, base).groupBy("source").agg(F.count(F.lit(1)).alias("n_cut"))
    rows = base.join(found, "source", "left").fillna(0, ["n_cut"]).withColumn("cut_rate", F.col("n_cut") / F.col("n_docs"))
    return rows.select("source", "n_docs", "n_cut", "cut_rate", "char_limit", "byte_limit", "open_prose", "unbalanced")
