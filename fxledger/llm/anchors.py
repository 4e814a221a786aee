"""Which windows of a corpus may occur twice: anchors by minimizers.

Two equal windows of ``length`` items choose the same anchor: the gram of ``k``
items in them with the smallest hash (the leftmost of equal ones).  The windows
of a document that share an anchor are consecutive, and form a segment.  So a
window that occurs elsewhere lies in a segment whose anchor occurs elsewhere,
and comparing the few segments of such anchors replaces comparing all windows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from fxledger.llm import textops as tx


@dataclass
class Segments:
    doc: np.ndarray      # index of the document in the slab
    first: np.ndarray    # first window start, counted in the slab
    last: np.ndarray     # last window start
    anchor: np.ndarray   # hash of the anchor, as a signed 64-bit number
    content: np.ndarray  # hash of the items [first, last + length)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of ``w`` values, in linear time."""
    n = len(x)
    if n < w:
        return x[:0]
    pad = -n % w
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - w + 1], ahead[w - 1:n])


def segments(items: np.ndarray, bounds: np.ndarray, length: int, k: int) -> Segments:
    """``items``: bytes or item hashes of a slab; ``bounds``: its documents."""
    n = len(items)
    if n < length:
        none = np.zeros(0, np.int64)
        return Segments(none, none, none, none, none)
    prefix = tx.Prefix(items)
    at = np.arange(n - k + 1)
    gram = prefix.of(at, at + k)
    bits = np.uint64(int(n).bit_length())
    chosen = sliding_min(((gram >> bits) << bits) | at.astype(np.uint64), length - k + 1)
    where = (chosen & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    ok = np.zeros(n - length + 1, dtype=bool)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= length:
            ok[a:b - length + 1] = True
    start = np.flatnonzero(ok)
    if not len(start):
        none = np.zeros(0, np.int64)
        return Segments(none, none, none, none, none)
    where = where[start]
    # anchors of different documents differ, so a change of anchor ends a segment
    head = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
    tail = np.concatenate([head[1:], [len(where)]]) - 1
    first, last = start[head], start[tail]
    return Segments(np.searchsorted(bounds, first, "right") - 1, first, last,
                    gram[where[head]].view(np.int64),
                    prefix.of(first, last + length).view(np.int64))
