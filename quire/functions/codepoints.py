"""A batch of texts as one numpy vector of Unicode code points.

Operators that look at every character work on whole Arrow batches in this form, so the cost per
character is that of a few vector instructions and not of a Python loop.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

#: Stands between texts; it is no character, so no pair or run of a text crosses it.
GAP = 0x110000


@dataclass
class Codes:
    """``cp``: code points with one GAP before each text and one at the end.

    ``start``/``end``: where each text begins and ends in ``cp``; ``row``: the text of each position
    (a GAP counts to the text after it, the last one to the last text).
    """

    cp: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def text(self, a: int, b: int) -> str:
        return self.cp[a:b].astype("<u4").tobytes().decode("utf-32-le")


def codes(texts: Sequence[str | None]) -> Codes:
    """Encode texts; null counts as empty."""
    full = [t or "" for t in texts]
    n = np.fromiter(map(len, full), np.int64, len(full))
    flat = np.frombuffer("".join(full).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int32)
    start = np.cumsum(n + 1) - n
    end = start + n
    cp = np.full(int(n.sum()) + len(full) + 1, GAP, np.int32)
    inside = np.ones(len(cp), bool)
    inside[start - 1] = False
    inside[-1] = False
    cp[inside] = flat
    row = np.repeat(np.arange(len(full)), n + 1)
    row = np.append(row, len(full) - 1 if len(full) else 0)
    return Codes(cp, start, end, row)


def table_of(size: int, default: int, entries: dict[int, int] | None = None, dtype=np.int32) -> np.ndarray:
    """A lookup vector over code points (``size`` of at least GAP + 1 covers all)."""
    out = np.full(size, default, dtype)
    for k, v in (entries or {}).items():
        out[k] = v
    return out


def batched(values: Sequence[str | None], limit: int = 4_000_000) -> list[tuple[int, int]]:
    """Cut a batch into slices of at most ``limit`` characters (or one text), so memory stays bounded."""
    out, a, size = [], 0, 0
    for i, v in enumerate(values):
        size += len(v or "")
        if size > limit and i > a:
            out.append((a, i))
            a, size = i, len(v or "")
    if a < len(values) or not out:
        out.append((a, len(values)))
    return out
