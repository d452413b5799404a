"""Encoding with a public byte-level BPE vocabulary, as recursive DuckDB queries per partition.

A text is cut into words by the vocabulary's own pattern, and a word into pieces wherever two
neighbouring bytes are never neighbours inside any vocabulary entry, since no merge can span such a
place. What remains to be merged are the distinct pieces. Each partition keeps a table of the pieces
met so far; new ones go to DuckDB, where token-position rows are joined to the merge table, the pair
of minimum rank of each piece is contracted wherever it stands, from the left, until no pair is left, and an
ordered aggregation returns the ids. (A merge makes only pairs of higher rank, so to contract all places of the
minimum pair at once is the same as one by one.) The recursion keeps the newest row of each position only, so its memory
is that of its input, and groups of pieces are held to ``LETTERS`` bytes. The table of pieces is emptied when it reaches
``KEPT_BYTES``, so the memory of a partition does not grow with its input.

A piece longer than ``BLOCK`` bytes is encoded in overlapping blocks. A sequence of tokens is the encoding of its bytes if
and only if every two neighbours are the encoding of theirs; so where two blocks have a token in common, the left one's
tokens up to it and the right one's after it are the exact ids. Pieces whose blocks share no token take
larger blocks, at last one for the whole piece.

The vocabulary is read from the path given; by default that of the installed ``public_tokenizers``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame

#: Bytes of words and pieces that a partition remembers, and bytes of pieces that DuckDB gets at once.
KEPT_BYTES, LETTERS = 6_000_000, 200_000
#: Bytes of a block of a long piece, a quarter of which it shares with the next. A multiple of three and of powers of two, so
#: blocks of a repeated character mostly fall in step.
BLOCK = 768
#: Words longer than this are not remembered.
LONG_WORD = 64

#: One contraction round per recursion step. ``w`` piece, ``p`` position, ``t`` token, -1 where it went into its left neighbour.
_MERGE = """
WITH RECURSIVE r(w, p, t) USING KEY (w, p) AS (
  SELECT w, p, t FROM start
  UNION ALL
  (WITH live AS (
     SELECT w, p, t FROM recurring.r WHERE t >= 0 AND w IN (SELECT w FROM r)
   ), n AS (
     SELECT w, p, t, lead(p) OVER x AS q, lead(t) OVER x AS u, row_number() OVER x AS i FROM live WINDOW x AS (PARTITION BY w ORDER BY p)
   ), c AS (
     SELECT n.w, n.p, n.q, n.i, m.t AS made, m.rank FROM n JOIN merges m ON m.a = n.t AND m.b = n.u
   ), b AS (
     SELECT w, p, q, i, made FROM c QUALIFY rank = min(rank) OVER (PARTITION BY w)
   ), g AS (
     SELECT w, p, q, i, made, i - row_number() OVER (PARTITION BY w ORDER BY i) AS run FROM b
   ), k AS (
     SELECT w, p, q, made FROM g QUALIFY row_number() OVER (PARTITION BY w, run ORDER BY i) % 2 = 1
   )
   SELECT w, p, made FROM k UNION ALL SELECT w, q, -1 FROM k)
)
SELECT w, list(t ORDER BY p) AS ids FROM r WHERE t >= 0 GROUP BY w ORDER BY w
"""


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a file of the public tokenizers lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def word_pattern() -> str:
    """The public pattern of the vocabulary."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file: printable bytes stand for
    themselves, the others take the code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Byte-level BPE by DuckDB; ``encode(texts)`` gives a list of ids per text."""

    def __init__(self, path: str, kept: int = KEPT_BYTES) -> None:
        letters = byte_letters()
        model = json.load(open(path, encoding="utf-8"))["model"]
        to_bytes = lambda token: bytes(letters[c] for c in token)
        vocab = {k: v for k, v in model["vocab"].items() if all(c in letters for c in k)}
        byte_id = np.zeros(256, np.int32)
        self.length = np.zeros(max(vocab.values()) + 1, np.int64)
        joined = np.zeros((256, 256), bool)
        for token, i in vocab.items():
            b = to_bytes(token)
            self.length[i] = len(b)
            if len(b) == 1:
                byte_id[b[0]] = i
            for x, y in zip(b, b[1:]):
                joined[x, y] = True
        self.byte_id = byte_id
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merges = pa.table({"a": pa.array([vocab[a] for a, _ in pairs], pa.int32()), "b": pa.array([vocab[b] for _, b in pairs], pa.int32()), "rank": pa.array(range(len(pairs)), pa.int32()), "t": pa.array([vocab[a + b] for a, b in pairs], pa.int32())})
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        self.db.register("merge_rows", merges)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merge_rows")
        self.db.unregister("merge_rows")
        # where a word may be cut: between x and y where no entry has them side by side
        self.joined = joined
        self.words = regex.compile(word_pattern())
        self.pieces: dict[bytes, list[int]] = {}
        self.word_ids: dict[str, list[int]] = {}
        self.kept, self.size = kept, 0

    def _split(self, word: bytes) -> list[bytes]:
        if len(word) < 2:
            return [word]
        x = np.frombuffer(word, np.uint8)
        cuts = np.flatnonzero(~self.joined[x[:-1], x[1:]]) + 1
        if not len(cuts):
            return [word]
        ends = [0, *cuts.tolist(), len(word)]
        return [word[a:b] for a, b in zip(ends, ends[1:])]

    def _contract(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece, by DuckDB in groups of bounded size."""
        out: list[list[int]] = []
        while len(out) < len(pieces):
            group, size = [], 0
            for piece in pieces[len(out) :]:
                if group and size + len(piece) > LETTERS:
                    break
                group.append(piece)
                size += len(piece)
            n = np.fromiter(map(len, group), np.int64, len(group))
            w = np.repeat(np.arange(len(group), dtype=np.int32), n)
            p = (np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            t = self.byte_id[np.frombuffer(b"".join(group), np.uint8)]
            self.db.register("start", pa.table({"w": w, "p": p, "t": t}))
            rows = self.db.execute(_MERGE).fetchall()
            self.db.unregister("start")
            out += [ids for _, ids in rows]
        return out

    def _stitch(self, blocks: list[tuple[int, list[int]]]) -> list[int] | None:
        """The ids of a piece of the (start, ids) of its blocks; None where two neighbours have no token in common."""
        start, ids = blocks[0]
        done: list[int] = []
        for nxt, new in blocks[1:]:
            begins = start + np.concatenate(([0], np.cumsum(self.length[ids])))
            begins_new = nxt + np.concatenate(([0], np.cumsum(self.length[new])))
            at = {x: i for i, x in enumerate(begins[:-1].tolist())}
            # a token is common to both if it begins and ends at the same bytes
            common = next(((at[x], j) for j, x in enumerate(begins_new[:-1].tolist()) if x in at and begins[at[x] + 1] == begins_new[j + 1]), None)
            if common is None:
                return None
            done += ids[: common[0]]
            start, ids = int(begins_new[common[1]]), new[common[1] :]
        return done + ids

    def _long(self, pieces: list[bytes]) -> dict[bytes, list[int]]:
        """The ids of pieces of more than ``BLOCK`` bytes."""
        done: dict[bytes, list[int]] = {}
        size = BLOCK
        while len(done) < len(pieces):
            step = size * 3 // 4
            blocks = {p: [(a, p[a : a + size]) for a in range(0, max(len(p) - size, 0) + step, step)] for p in pieces if p not in done}
            distinct = list({b for parts in blocks.values() for _, b in parts})
            ids = dict(zip(distinct, self._contract(distinct)))
            for p, parts in blocks.items():
                whole = self._stitch([(a, ids[b]) for a, b in parts])
                if whole is not None:
                    done[p] = whole
            size *= 4
        return done

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        found = [self.words.findall(t) if t else [] for t in texts]
        if self.size > self.kept:
            self.pieces, self.word_ids, self.size = {}, {}, 0
        known = self.word_ids
        parts = {w: self._split(w.encode("utf-8")) for w in {w for ws in found for w in ws}.difference(known)}
        new = {p for ps in parts.values() for p in ps}.difference(self.pieces)
        short = [p for p in new if len(p) <= BLOCK]
        self.pieces.update(zip(short, self._contract(short)))
        long = self._long([p for p in new if len(p) > BLOCK])
        self.size += sum(map(len, short))
        once: dict[str, list[int]] = {}
        for w, ps in parts.items():
            ids = [i for p in ps for i in (self.pieces[p] if len(p) <= BLOCK else long[p])]
            if len(w) <= LONG_WORD:
                known[w] = ids
                self.size += len(w)
            else:
                once[w] = ids
        return [[i for w in ws for i in (known[w] if w in known else once[w])] for ws in found]


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _slices(texts: list[str | None], limit: int) -> Iterator[tuple[int, int]]:
    from quire.functions.codepoints import batched

    yield from batched(texts, limit)


def encode_column(df: DataFrame, keys: list[str], text: Column, path: str | None = None, counts_only: bool = False) -> DataFrame:
    """``(*keys, ids)``: the ids of each text, or with ``counts_only`` ``(*keys, n_tokens)``.

    A null and an empty text give an empty list (0 tokens); a blank text is encoded as it is; special
    tokens are never added, and their strings in a text are ordinary text. Rows are kept one to one.
    """
    path = path or vocabulary_path()
    part = df.select(*keys, text.alias("_text"))
    made = "n_tokens int" if counts_only else "ids array<int>"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema if f.name in keys) + f", {made}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or _encoder(path)
            texts = batch.column("_text").to_pylist()
            kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "_text"]
            for a, b in _slices(texts, 1_000_000):
                ids = encoder.encode(texts[a:b])
                made = pa.array([len(x) for x in ids], pa.int32()) if counts_only else pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in kept), made], names=[*keys, "n_tokens" if counts_only else "ids"])

    return part.mapInArrow(run, schema)
