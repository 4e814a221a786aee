"""Removal of repeated byte strings by induced sorting of suffixes.

A byte is covered if a string of ``WINDOW`` bytes over it also starts anywhere
else, in the same document or another; covered bytes go, in every copy.
Strings are judged on the input.

The segments that may repeat (see ``repeats``) are dealt to shards by anchor.
In a shard their suffixes are sorted by induction: suffixes smaller than their
left and right neighbours' (LMS) are ordered first, through the recursion on
their names, and from them all others, one first byte after another.  What a
bucket induces waits in queues by first byte, each in its final order, as
arrays of positions; queues beyond ``MEMORY`` bytes lie on the task's own disk,
in a nameless file that ends with the task.  Suffixes that share ``WINDOW``
bytes or more then stand side by side; their common prefix counts up to that
length only, which the hashes of the two strings tell.

Null text is empty.  See ``repeats`` for repeated and null ids.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fxledger.llm import repeats, textops as tx
from fxledger.llm.memory import freed

WINDOW = 400
ANCHOR = 32
SHARD_BYTES = 1 << 20
MEMORY = 256 << 20
SMALL = 4096
#: Contents of one anchor (about 600 bytes each) that a shard still takes whole.
HOT = 10_000
UNIT = repeats.Unit(False, WINDOW, ANCHOR)


class Queues:
    """Arrays that wait in buckets, first in first out; too many go to disk."""

    def __init__(self, buckets: int, memory: int = MEMORY):
        self.near: list[list[np.ndarray]] = [[] for _ in range(buckets)]
        self.far: list[list[tuple[int, int]]] = [[] for _ in range(buckets)]
        self.memory, self.held, self.file = memory, 0, None

    def push(self, bucket: int, x: np.ndarray) -> None:
        self.near[bucket].append(x)
        self.held += x.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        for bucket, parts in enumerate(self.near):
            if parts:
                raw = np.concatenate(parts).astype(np.int64).tobytes()
                self.file.write(raw)
                self.far[bucket].append((at, len(raw)))
                at += len(raw)
                parts.clear()
        self.held = 0

    def pop(self, bucket: int) -> np.ndarray:
        parts = []
        for at, n in self.far[bucket]:
            self.file.seek(at)
            parts.append(np.frombuffer(self.file.read(n), np.int64))
        self.far[bucket] = []
        parts += self.near[bucket]
        self.held -= sum(x.nbytes for x in self.near[bucket])
        self.near[bucket] = []
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def doubled(t: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffix array by prefix doubling, for the bottom of the recursion.  Only
    suffixes that still tie are sorted again.  With ``depth``, suffixes that
    share so many symbols may stand in any order."""
    n = len(t)
    order = np.argsort(t)
    start = np.concatenate([[True], t[order][1:] != t[order][:-1]])
    first = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = first  # the first place of the suffixes that tie
    k = 1
    while k < n and (depth is None or k < depth):
        alone = start & np.append(start[1:], True)
        place = np.flatnonzero(~alone)
        if not len(place):
            break
        at = order[place]
        second = np.where(at + k < n, rank[np.minimum(at + k, n - 1)] + 1, 0)
        by = np.argsort(rank[at] * (n + 1) + second)
        at, second = at[by], second[by]
        order[place] = at
        own = rank[at]
        start[place] = np.concatenate([[True], (own[1:] != own[:-1]) | (second[1:] != second[:-1])])
        first = np.maximum.accumulate(np.where(start[place], place, 0))
        rank[at] = first
        k *= 2
    return order


def _deal(queues: Queues, at: np.ndarray, first: np.ndarray) -> None:
    """Push positions to the buckets of their first symbols, in their order."""
    if not len(at):
        return
    order = np.argsort(first, kind="stable")
    at, first = at[order], first[order]
    cut = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])).tolist()
    for a, b in zip(cut, [*cut[1:], len(at)], strict=True):
        queues.push(int(first[a]), at[a:b])


def _induce(t: np.ndarray, small: np.ndarray, size: int, lms: list[np.ndarray],
            memory: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """From the LMS positions of each bucket, in order, all suffixes: (bucket, its
    larger-type ones, its smaller-type ones), from the last bucket to the first."""
    larger, kept = Queues(size, memory), Queues(size, memory)
    for c in range(size):
        batch = larger.pop(c)
        while len(batch):  # a run of one symbol induces into its own bucket
            kept.push(c, batch)
            left = batch[batch > 0] - 1
            left = left[~small[left]]
            first = t[left]
            _deal(larger, left[first != c], first[first != c])
            batch = left[first == c]
        if len(lms[c]):
            left = lms[c][lms[c] > 0] - 1
            left = left[~small[left]]
            _deal(larger, left, t[left])
    larger.close()
    smaller = Queues(size, memory)
    for c in range(size - 1, -1, -1):
        done = []
        batch = smaller.pop(c)
        if c == 0:
            batch = np.array([len(t) - 1])
        while len(batch):
            done.append(batch)
            left = batch[batch > 0] - 1
            left = left[small[left]]
            first = t[left]
            _deal(smaller, left[first != c], first[first != c])
            batch = left[first == c]
        big = kept.pop(c)
        left = big[::-1]
        left = left[left > 0] - 1
        left = left[small[left]]
        _deal(smaller, left, t[left])
        yield c, big, (np.concatenate(done)[::-1] if done else np.zeros(0, np.int64))
    smaller.close()
    kept.close()


def sorted_suffixes(t: np.ndarray, memory: int = MEMORY, depth: int | None = None) -> np.ndarray:
    """Suffix array of symbols 0..k, of which the last, and only it, is 0.
    Suffixes that share ``depth`` symbols may stand in any order."""
    n, size = len(t), int(t.max()) + 1
    if n <= SMALL or size > SMALL:
        return doubled(t, depth)
    step = np.sign(np.diff(t.astype(np.int64)))
    at = np.where(step != 0, np.arange(n - 1), n)
    at = np.minimum.accumulate(at[::-1])[::-1]  # the next place where the symbol changes
    small = np.append(step[np.minimum(at, n - 2)] > 0, True)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1

    def buckets(order: np.ndarray) -> list[np.ndarray]:
        first = t[order]
        by = np.argsort(first, kind="stable")
        return np.split(order[by], np.searchsorted(first[by], np.arange(1, size)))

    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    # 1. the order of the LMS substrings, and their names
    found = [s[is_lms[s]] for _, _, s in _induce(t, small, size, buckets(lms), memory)]
    order = np.concatenate(found[::-1])
    hashed = tx.Prefix(tx.mix(t.astype(np.uint64) + np.uint64(1)))
    end = np.append(lms[1:], n - 1)
    key = np.zeros(n, dtype=np.uint64)
    key[lms] = hashed.of(lms, end + 1)
    new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
    if new[-1] + 1 < len(lms):
        # 2. names repeat: the order of the LMS suffixes is that of the string of names
        name = np.zeros(n, dtype=np.int64)
        name[order] = new
        # (a name stands for two symbols or more)
        order = lms[sorted_suffixes(name[lms], memory, depth and depth // 2 + 1)]
    # 3. everything else follows from that order
    parts = [np.concatenate([big, s]) for _, big, s in _induce(t, small, size, buckets(order), memory)]
    return np.concatenate(parts[::-1])


def repeated_starts(texts: list[bytes], window: int = WINDOW, memory: int = MEMORY) -> list[np.ndarray]:
    """For each text: which windows also start elsewhere in these texts."""
    size = np.array([len(x) for x in texts])
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    raw = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
    t = raw.astype(np.uint16) + np.uint16(2)
    t[start + size] = 1
    whole = np.zeros(len(t), dtype=bool)
    for a, n in zip(start.tolist(), size.tolist(), strict=True):
        whole[a:a + max(0, n - window + 1)] = True
    order = sorted_suffixes(np.append(t, 0), memory, window)
    order = order[order < len(t)]
    order = order[whole[order]]
    key = tx.Prefix(raw).of(order, order + window)
    same = key[1:] == key[:-1]
    hit = np.zeros(len(t), dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return [hit[a:a + max(0, n - window + 1)] for a, n in zip(start.tolist(), size.tolist(), strict=True)]


def match(rows: Iterator[tuple[int, int, bytes]], window: int = WINDOW,
          shard_bytes: int = SHARD_BYTES) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(content, repeated window ranges) of the segments of each shard."""

    def shard(contents: list[int], texts: list[bytes]):
        for content, hit in zip(contents, repeated_starts(texts, window), strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
            if len(edge):
                yield content, list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))

    contents, texts, size, anchor = [], [], 0, None
    for h, content, text in rows:
        if h != anchor and size > shard_bytes:
            yield from shard(contents, texts)
            contents, texts, size = [], [], 0
        anchor = h
        contents.append(content)
        texts.append(text)
        size += len(text)
    if texts:
        yield from shard(contents, texts)


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, z, found: see ``repeats.spans``."""
    return repeats.spans(docs, UNIT, match, first_stays=False, hot=HOT)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes that stay)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                text = repeats.texts(b)
                gone = repeats.removed(text, b.column("found").to_pylist(), UNIT, False)
                rows = []
                for raw, (ranges, _) in zip(text.to_pylist(), gone, strict=True):
                    kept, end = hashlib.sha256(), 0
                    for p, q in ranges:
                        kept.update(raw[end:p])
                        end = q
                    kept.update(raw[end:])
                    rows.append((len(raw), sum(q - p for p, q in ranges), len(ranges),
                                 kept.hexdigest()))
                n, r, s, k = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), *[pa.array(x, pa.int64()) for x in (n, r, s)], pa.array(k)],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return found.mapInArrow(freed(run), "doc_id long, n_bytes long, n_removed long, n_spans long, "
                                 "kept_sha256 string")
