"""Packing token ids into sequences by Karmarkar-Karp multiway differencing.

Each task packs the documents of its own partition, so nothing is shuffled.  A
document gives whole sequences of ``length`` ids, and a rest that is cut into
pieces of descending powers of two (and one short piece).  Pieces gather into
blocks of about ``block`` sequences.  In a block, differencing keeps partial
partitions of the pieces into k windows, and again and again merges the two
with the largest imbalance, fullest windows onto emptiest ones, until one
near-equal partition is left.  If its fullest window exceeds the capacity, the
window count rises and the block is packed again.

A sequence whose length is a power of two needs no padding, so the pieces that
make a block exceed a whole number of windows become sequences of their own.

Null text is an empty document: only its end id.  Repeated rows are documents
of their own.  An empty table gives no sequences.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from fxledger.llm import tokens
from fxledger.llm.memory import freed

LENGTH = 2048
BLOCK = 384
SMALLEST = 32
#: Sequence ids: the partition above this bit, a counter below.
PARTITION_BIT = 36

PIECE = ("doc_id long, start long, length long, doc_tokens long, sequence_id long, "
         "offset long, ids binary")


def difference(sizes: np.ndarray, k: int) -> list[list[int]]:
    """Partition the items into k windows of near-equal sums; item indices.

    A partial partition is the list of its (sum, node) that are not empty, in
    descending order; a node is an item, or joins two nodes.
    """
    if k <= 1 or not len(sizes):
        return [list(range(len(sizes)))] + [[] for _ in range(max(0, k - 1))]
    n = len(sizes)
    kids: list[tuple[int, int]] = []
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    count = n
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heap[0]
        apart = k - len(b)  # windows of a beyond these meet windows of b, fullest with emptiest
        if len(a) <= apart:
            merged = a + b
        else:
            merged = a[:apart] + b[:k - len(a)]
            for i in range(apart, len(a)):
                (s, x), (t, y) = a[i], b[k - 1 - i]
                merged.append((s + t, n + len(kids)))
                kids.append((x, y))
        merged.sort(reverse=True)
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heapreplace(heap, (-spread, count, merged))
        count += 1
    out = []
    for _, node in heap[0][2]:
        items, todo = [], [node]
        while todo:
            x = todo.pop()
            if x < n:
                items.append(x)
            else:
                todo += kids[x - n]
        out.append(sorted(items))
    return out + [[] for _ in range(k - len(out))]


def windows(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity``; the count rises while one exceeds it."""
    total = int(sizes.sum())
    if not total:
        return []
    alone: list[int] = []
    excess = total % capacity
    rest = np.ones(len(sizes), dtype=bool)
    if total > capacity and excess:
        excess += total // capacity // 16  # some slack, so that near-equal is enough
        for i in np.argsort(-sizes, kind="stable").tolist():
            s = int(sizes[i])
            if s & (s - 1) == 0 and s <= excess:
                alone.append(i)
                rest[i] = False
                excess -= s
    index = np.flatnonzero(rest)
    k = max(1, -(-int(sizes[index].sum()) // capacity))
    while True:
        found = difference(sizes[index], k)
        if max(int(sizes[index[w]].sum()) for w in found if w) <= capacity:
            break
        k += 1
    return [index[w].tolist() for w in found if w] + [[i] for i in alone]


def cuts(n: int, length: int = LENGTH, smallest: int = SMALLEST) -> list[int]:
    """Sizes of the pieces of a document of n ids: whole sequences first."""
    out = [length] * (n // length)
    n %= length
    size = 1 << max(0, length.bit_length() - 1)
    while size >= smallest:
        if n >= size:
            out.append(size)
            n -= size
        else:
            size >>= 1
    return out + [n] * (n > 0)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = LENGTH,
         block: int = BLOCK) -> DataFrame:
    """One row for each piece, with its ids (little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << PARTITION_BIT
        ready: list[tuple] = []
        waiting: list[tuple] = []
        held = 0

        def place() -> None:
            nonlocal number
            for window in windows(np.array([w[2] for w in waiting], dtype=np.int64), length):
                offset = 0
                for i in window:
                    doc, start, n, total, ids = waiting[i]
                    ready.append((doc, start, n, total, number, offset, ids))
                    offset += n
                number += 1
            waiting.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                encoded = tokens.encode_column(part.column("text"), tokenizer, end_id)
                for doc, ids in zip(part.column("doc_id").to_pylist(), encoded, strict=True):
                    total, start = len(ids) // 4, 0
                    for n in cuts(total, length):
                        piece = ids[4 * start:4 * (start + n)]
                        if n == length:
                            ready.append((doc, start, n, total, number, 0, piece))
                            number += 1
                        else:
                            waiting.append((doc, start, n, total, piece))
                            held += n
                        start += n
                    if held >= block * length:
                        place()
                        held = 0
                if len(ready) >= 1000:
                    yield _rows(ready)
                    ready = []
        place()
        if ready:
            yield _rows(ready)

    return docs.select("doc_id", "text").mapInArrow(freed(run), PIECE)


_SCHEMA = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens",
                                               "sequence_id", "offset")] + [("ids", pa.binary())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)],
        schema=_SCHEMA)
