"""Benchmark passages in documents, found by an FM-index for each shard.

A shard is a slab of whole texts inside a task.  Its words become ids of the
benchmark's vocabulary; only runs of words whose neighbours also stand side by
side in the benchmark can hold an occurrence, so the index is built over those
runs alone.  Backward search runs for all phrases at once, on ranks from a
wavelet matrix over the Burrows-Wheeler transform; occurrences are located by
walking to the nearest sampled suffix position, and overlapping ones merge into
removal spans.

A phrase is a window of ``WINDOW`` consecutive words of an item, or the whole
item if it has fewer words, but some.  The benchmark is read in blocks of at
most ``BLOCK_WORDS`` words, each broadcast on its own (a proven bound) and freed
before the next, and a document passes through one step for each block, stored
in between, so nothing is shuffled however many items there are.

Null and empty texts have no words.  Items without words are ignored; repeated
items count once; an item with a null id is found but not named.  Words are
compared by 64-bit hashes, of which a phrase needs several in a row.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fxledger.llm import files, textops as tx
from fxledger.llm.memory import freed
from fxledger.session import scratch_path

WINDOW = 10
BLOCK_WORDS = 1_000_000
SAMPLE = 16
FOUND = ("struct<n_words:bigint,words:array<struct<a:bigint,b:bigint>>,"
         "bytes:array<struct<a:bigint,b:bigint>>,items:array<string>>")

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEEP = tx.table_of(bytes([*range(48, 58), *range(97, 123)]))
_KEEP[128:] = True
SEPARATOR = ~_KEEP


@dataclass
class Phrases:
    """The distinct phrases of a block of items."""

    vocabulary: np.ndarray       # sorted word hashes; the id of a word is its place + 1
    pairs: np.ndarray            # sorted id * (size + 1) + next id
    length: np.ndarray
    ids: np.ndarray              # phrases x WINDOW, right-aligned, 0 before the phrase
    items: list[list[str]]


def hashed_words(column: pa.Array):
    """(first row, end row, bytes, offsets, word starts, ends, documents, hashes)."""
    for a, b, buf, off in tx.slabs(column, 4 << 20):
        buf = _LOWER[buf]
        w0, w1, doc = tx.words(buf, off, SEPARATOR)
        yield a, b, off, w0, w1, doc, tx.Prefix(buf).of(w0, w1)


def phrases(item_ids: list, texts: pa.Array, window: int = WINDOW) -> Phrases | None:
    runs = []
    for a, _, _, _, _, doc, h in hashed_words(texts):
        for d in np.unique(doc):
            ids = item_ids[a + d]
            runs.append((ids if isinstance(ids, list) else [ids], h[doc == d]))
    if not runs:
        return None
    vocabulary = np.unique(np.concatenate([h for _, h in runs]))
    found: dict[tuple, set] = {}
    pairs = []
    for items, h in runs:
        ids = np.searchsorted(vocabulary, h) + 1
        pairs.append(ids[:-1] * (len(vocabulary) + 1) + ids[1:])
        for i in range(max(1, len(ids) - window + 1)):
            found.setdefault(tuple(ids[i:i + window].tolist()), set()).update(items)
    table = np.zeros((len(found), window), dtype=np.int64)
    for row, key in zip(table, found, strict=True):
        row[window - len(key):] = key
    return Phrases(vocabulary, np.unique(np.concatenate(pairs)),
                   np.array([len(k) for k in found], dtype=np.int64), table,
                   [sorted(x for x in v if x is not None) for v in found.values()])


def suffix_array(s: np.ndarray) -> np.ndarray:
    """By prefix doubling; a shorter suffix sorts before a longer one."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        second = np.zeros(n, dtype=np.int64)
        second[:n - k] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        new = np.empty(n, dtype=np.int64)
        new[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank, k = new, 2 * k
        if n == 0 or rank[order[-1]] == n - 1 or k >= n:
            return order


class Wavelet:
    """A wavelet matrix: ranks of many (symbol, place) pairs at once."""

    def __init__(self, s: np.ndarray, size: int):
        self.levels = []
        for bit in reversed(range(max(1, int(size - 1).bit_length()))):
            one = (s >> bit) & 1 == 1
            zeros = np.concatenate([[0], np.cumsum(~one)])
            self.levels.append((bit, zeros, int(zeros[-1])))
            s = np.concatenate([s[~one], s[one]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``c`` occurs before place ``i``."""
        lo, hi = np.zeros_like(i), i.copy()
        for bit, zeros, total in self.levels:
            one = (c >> bit) & 1 == 1
            zl, zh = zeros[lo], zeros[hi]
            lo, hi = np.where(one, total + lo - zl, zl), np.where(one, total + hi - zh, zh)
        return hi - lo


class Index:
    """An FM-index over integers from 0 (which parts the runs); one symbol of its
    own ends the text, so symbols are kept one higher."""

    def __init__(self, s: np.ndarray, size: int, sample: int = SAMPLE):
        s, size = np.append(s + 1, 0), size + 1
        order = suffix_array(s)
        self.n = len(s)
        self.last = s[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=size))])
        self.wavelet = Wavelet(self.last, size)
        # position 0 is among them, so no walk reaches the end symbol
        kept = order % sample == 0
        self.kept, self.rank = kept, np.concatenate([[0], np.cumsum(kept)])
        self.positions = order[kept]

    def search(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix range of each row of ``table`` (right-aligned, 0 is nothing)."""
        lo = np.zeros(len(table), dtype=np.int64)
        hi = np.full(len(table), self.n, dtype=np.int64)
        for column in table.T[::-1]:
            live = np.flatnonzero((column > 0) & (lo < hi))
            c = column[live] + 1
            lo[live] = self.before[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.before[c] + self.wavelet.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        while True:
            todo = np.flatnonzero(~self.kept[rows])
            if not len(todo):
                return self.positions[self.rank[rows]] + steps
            c = self.last[rows[todo]]
            rows[todo] = self.before[c] + self.wavelet.rank(c, rows[todo])
            steps[todo] += 1


def _runs(ids: np.ndarray, doc: np.ndarray, p: Phrases) -> np.ndarray:
    """Which words may lie in an occurrence."""
    shortest = int(p.length.min())
    if shortest == 1 or len(ids) < 2:
        return ids > 0 if shortest == 1 else np.zeros(len(ids), dtype=bool)
    key = ids[:-1] * (len(p.vocabulary) + 1) + ids[1:]
    at = np.minimum(np.searchsorted(p.pairs, key), len(p.pairs) - 1)
    joined = (p.pairs[at] == key) & (ids[:-1] > 0) & (ids[1:] > 0) & (doc[:-1] == doc[1:])
    edge = np.flatnonzero(np.diff(np.concatenate([[0], joined.astype(np.int8), [0]])))
    a, b = edge[::2], edge[1::2]
    long = b - a + 1 >= shortest
    d = np.zeros(len(ids) + 1, dtype=np.int64)
    d[a[long]] += 1
    d[b[long] + 1] -= 1
    return np.cumsum(d[:-1]) > 0


def occurrences(ids: np.ndarray, doc: np.ndarray, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, first word) of every occurrence in a shard's words."""
    keep = np.flatnonzero(_runs(ids, doc, p))
    if not len(keep):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # 0 wherever a run ends: the next kept word is not the neighbour, or another document's
    gap = np.flatnonzero((np.diff(keep) != 1) | (doc[keep[1:]] != doc[keep[:-1]])) + 1
    text = np.insert(ids[keep], gap, 0)
    place = np.insert(keep, gap, -1)
    local, text = np.unique(np.append(text, 0), return_inverse=True)  # a dense alphabet; 0 is first
    text = text[:-1]
    at = np.minimum(np.searchsorted(local, p.ids), len(local) - 1)
    present = (local[at] == p.ids).all(axis=1)
    which = np.flatnonzero(present)
    index = Index(text, len(local))
    lo, hi = index.search(np.where(p.ids[which] > 0, at[which], 0))
    n = np.maximum(0, hi - lo)
    rows = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
    return np.repeat(which, n), place[index.locate(rows)]


def _merge(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of [a, b) ranges, ascending; touching ones join."""
    if not len(a):
        return a, b
    o = np.argsort(a, kind="stable")
    a, b = a[o], np.maximum.accumulate(b[o])
    first = np.concatenate([[True], a[1:] > b[:-1]])
    return a[first], b[np.concatenate([np.flatnonzero(first)[1:] - 1, [len(a) - 1]])]


def _search(text: pa.Array, earlier: list[dict] | None, p: Phrases) -> list[pa.Array]:
    out = []
    for a, n, off, w0, w1, doc, h in hashed_words(text):
        at = np.minimum(np.searchsorted(p.vocabulary, h), len(p.vocabulary) - 1)
        ids = np.where(p.vocabulary[at] == h, at + 1, 0)
        phrase, first = occurrences(ids, doc, p)
        counts = np.bincount(doc, minlength=n - a)
        base = np.concatenate([[0], np.cumsum(counts)])
        at_doc = doc[first]
        order = np.argsort(at_doc, kind="stable")
        bounds = np.searchsorted(at_doc[order], np.arange(n - a + 1))
        for d in range(n - a):
            mine = order[bounds[d]:bounds[d + 1]]
            old = earlier[a + d] if earlier else None
            x, y = first[mine] - base[d], first[mine] - base[d] + p.length[phrase[mine]]
            items = {i for q in np.unique(phrase[mine]).tolist() for i in p.items[q]}
            if old:
                x = np.concatenate([x, [s["a"] for s in old["words"]]]).astype(np.int64)
                y = np.concatenate([y, [s["b"] for s in old["words"]]]).astype(np.int64)
                items |= set(old["items"])
            x, y = _merge(x, y)
            out.append({"n_words": int(counts[d]),
                        "words": [{"a": int(s), "b": int(e)} for s, e in zip(x, y, strict=True)],
                        "bytes": [{"a": int(w0[base[d] + s] - off[d]),
                                   "b": int(w1[base[d] + e - 1] - off[d])}
                                  for s, e in zip(x, y, strict=True)],
                        "items": sorted(items)})
    return out


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS, window: int = WINDOW):
    """The phrases of one block of items after another.  Items of one text come
    once, with their ids gathered; texts are dealt to blocks by a hash, and each block
    is fetched on its own."""
    b = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where(
        F.col("text").isNotNull()).groupBy("text").agg(F.collect_set("item").alias("item"))
    size = b.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0  # no more words than that
    n = int(size // block_words) + 1
    for k in range(n):
        part = b if n == 1 else b.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
        got = part.toArrow()
        p = phrases(got.column("item").to_pylist(), got.column("text").combine_chunks(), window)
        if p is not None:
            yield p


_ARROW = pa.struct([("n_words", pa.int64()),
                    *[(n, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))
                      for n in ("words", "bytes")], ("items", pa.list_(pa.string()))])


def find(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS,
         window: int = WINDOW) -> DataFrame:
    """``doc`` (the row) and ``out``: n_words, the hit word ranges, the byte ranges
    of the removal spans, and the ids of the items found, of every document.  The
    result of each block but the last is stored, so that only one block's phrases
    are held at a time."""
    spark = docs.sparkSession
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                       F.lit(None).cast(FOUND).alias("out"))
    schema = rows.schema
    empty = Phrases(np.array([1], np.uint64), np.array([0]), np.array([window]),
                    np.zeros((0, window), np.int64), [])
    shared, stored = None, None
    for p in chain(blocks(benchmark, block_words, window), [None]):
        if p is None and shared is not None:
            break
        if shared is not None:
            path = scratch_path(spark, "decontaminated")
            rows.write.parquet(path)
            rows = spark.read.schema(schema).parquet(path)
            shared.destroy()
            if stored:
                files.remove(stored)
            stored = path
        shared = spark.sparkContext.broadcast(p or empty)

        def run(batches, shared=shared):
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    part = batch.slice(at, 1000)
                    doc, old = part.column(0), part.column(1)
                    found = _search(doc.field("text"),
                                    old.to_pylist() if old.null_count < len(old) else None,
                                    shared.value)
                    yield pa.RecordBatch.from_arrays([doc, pa.array(found, _ARROW)], ["doc", "out"])

        rows = rows.mapInArrow(freed(run), schema)
    return rows


def digest(found: DataFrame) -> DataFrame:
    hit = F.aggregate("out.words", F.lit(0).cast("long"), lambda s, r: s + r["b"] - r["a"])
    return found.select(
        "doc.doc_id", "out.n_words", hit.alias("n_hit"),
        F.size("out.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("out.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("out.words") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without their removal spans, with their own columns; a text
    without an occurrence stays as it is, byte for byte.  ``n_chars``, if there,
    follows the text."""
    return tx.cut_spans(find(docs, benchmark), docs.columns)
