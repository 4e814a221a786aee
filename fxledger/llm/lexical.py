"""Ranked lexical search: exact inner products by sparse ball trees.

A document is a sparse vector over the terms of the queries, a query the vector of
its term weights, and the score their inner product, all integers.  Documents are cut
to the query terms in one scan, which also counts what the weights need; then each
task builds trees over ``SHARD`` documents at a time.  A node has a centre and radii in
two norms: a centroid with a Euclidean radius, in coordinates scaled by the roots of
the weights, and for every term the middle of its values with half their width (the
maximum norm with a radius for each term).  A query's product with any document below
is at most its product with the centre plus its own norm times the radius (summed
over its terms, in the second case); the smaller bound counts, and none exceeds that
of the node above.  Bounds are taken in floating point and raised by more than any
rounding, so no document is lost.  Subtrees are then opened best-first while they can
hold a score that reaches the tenth so far, which a task carries from tree to tree, and
their documents are scored exactly in 64-bit integers.

Queries are the distinct texts, in blocks of about ``BLOCK_CHARS`` characters, each
block a scan of its own; so what is broadcast is bounded, and repeated items cost
nothing.  Terms are compared by 64-bit hashes.

Defined results: repeated documents each count and may each be ranked; null ids come
after others at equal scores; null or empty texts hold no term and are never ranked,
and an item without terms has no rows; each row of the benchmark gets its ranking; empty
tables give an empty result; other columns are ignored; long texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from fxledger.llm.fm_index import hashed_words
from fxledger.llm.memory import freed
from fxledger.session import write_scratch

TOP = 10
BLOCK_CHARS = 4 << 20
SHARD = 4096
LEAF = 16
CELLS = 8 << 20  # of a dense matrix in a task: nodes, or queries, times terms


# -- queries ----------------------------------------------------------------------------

@dataclass
class Block:
    """The queries of one block: term numbers and how often each occurs."""

    vocabulary: np.ndarray          # sorted hashes; a term's number is its place
    keys: list[str]
    terms: list[np.ndarray]
    counts: list[np.ndarray]


def block_of(keys: list[str], texts: pa.Array) -> Block | None:
    runs: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(keys)
    for a, b, _, _, _, doc, h in hashed_words(texts):
        ends = np.searchsorted(doc, np.arange(b - a + 1))
        for i in range(b - a):
            runs[a + i] = h[ends[i]:ends[i + 1]]
    found = [i for i, h in enumerate(runs) if len(h)]
    if not found:
        return None
    vocabulary = np.unique(np.concatenate(runs))
    pairs = [np.unique(np.searchsorted(vocabulary, runs[i]), return_counts=True) for i in found]
    return Block(vocabulary, [keys[i] for i in found], [t for t, _ in pairs], [c for _, c in pairs])


def blocks(items: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[Block]:
    texts = items.where(F.col("text").isNotNull()).select("text").distinct()
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    n = int(size // block_chars) + 1
    for k in range(n):
        part = texts if n == 1 else texts.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
        got = part.select(_key().alias("key"), "text").toArrow()
        found = block_of(got.column("key").to_pylist(), got.column("text").combine_chunks())
        if found is not None:
            yield found


def _key():
    return F.sha2(F.col("text").cast("binary"), 256)


# -- documents --------------------------------------------------------------------------

def vectors(docs: DataFrame, shared) -> DataFrame:
    """doc_id, n (terms of the document), and the numbers of the query terms it holds
    (ascending) with their occurrences, packed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value.vocabulary
        size = len(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n, terms, tfs = [], [], []
                for a, b, _, _, _, doc, h in hashed_words(part.column(1)):
                    n.append(np.bincount(doc, minlength=b - a))
                    place = np.minimum(np.searchsorted(vocabulary, h), size - 1)
                    mine = vocabulary[place] == h
                    key, tf = np.unique(doc[mine] * size + place[mine], return_counts=True)
                    ends = np.searchsorted(key, np.arange(b - a + 1) * size)
                    t = (key % size).astype("<i4")
                    terms += [t[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)]
                    tfs += [tf[x:y].astype("<i8" if tf[x:y].max(initial=0) >> 31 else "<i4").tobytes()
                            for x, y in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.concatenate(n).astype(np.int64)),
                     pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())], ["doc_id", "n", "terms", "tfs"])

    return docs.select("doc_id", "text").mapInArrow(
        freed(run), "doc_id long, n long, terms binary, tfs binary")


def frequencies(found: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each query term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                total[np.frombuffer(t, "<i4")] += 1
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    rows = (found.select("terms").mapInArrow(freed(run), "id long, n long")
            .groupBy("id").agg(F.sum("n").alias("n")).toArrow())  # a row for each query term at most
    out = np.zeros(size, np.int64)
    out[rows.column("id").to_numpy()] = rows.column("n").to_numpy()
    return out


def weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def saturated(tf: np.ndarray, terms: int, n: int, total: int) -> np.ndarray:
    m = 100 - 75 + (75 * terms * n) // total  # Python's integers: never too small
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


# -- trees ------------------------------------------------------------------------------

def _sums(x: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, ptr[:-1])  # every row has an entry


def _flat(ptr: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of some rows, and where each row begins among them."""
    n = ptr[rows + 1] - ptr[rows]
    at = np.concatenate([[0], np.cumsum(n)])
    return np.repeat(ptr[rows] - at[:-1], n) + np.arange(at[-1]), at


class Tree:
    """A ball tree over rows of (term, value) entries."""

    def __init__(self, ptr: np.ndarray, terms: np.ndarray, values: np.ndarray, scale: np.ndarray):
        size, n = len(scale), len(ptr) - 1
        y = values * scale[terms]
        square = _sums(y * y, ptr)
        order = np.arange(n)
        nodes, open_ = [], [(0, n, -1)]
        while open_:
            a, b, above = open_.pop()
            nodes.append((a, b, above))
            rows = order[a:b]
            if b - a <= LEAF:
                continue
            flat, at = _flat(ptr, rows)
            t, v = terms[flat], y[flat]

            def far(centre: np.ndarray, t=t, v=v, at=at, rows=rows) -> np.ndarray:
                return square[rows] - 2 * _sums(centre[t] * v, at) + centre @ centre

            ends = []
            centre = np.bincount(t, v, size) / (b - a)
            for _ in range(2):  # the farthest from the centre, then the farthest from that
                x = int(np.argmax(far(centre)))
                centre = np.bincount(t[at[x]:at[x + 1]], v[at[x]:at[x + 1]], size)
                ends.append(far(centre))
            order[a:b] = rows[np.argsort(ends[0] - ends[1], kind="stable")]
            half = (a + b) // 2
            open_ += [(half, b, len(nodes) - 1), (a, half, len(nodes) - 1)]

        self.order = order
        flat, self.ptr = _flat(ptr, order)
        self.terms, self.values = terms[flat], values[flat]
        y = y[flat]
        self.above = np.array([x[2] for x in nodes])
        self.leaves = np.array([i for i, (a, b, _) in enumerate(nodes) if b - a <= LEAF])
        self.ranges = [(nodes[i][0], nodes[i][1]) for i in self.leaves]

        # centres and radii; a child's number is above its parent's
        self.middle = np.zeros((len(nodes), size), np.float32)   # of each term's values,
        self.width = np.zeros((len(nodes), size), np.float32)    # and half their width
        self.centroid = np.zeros((len(nodes), size), np.float32)
        self.radius = np.zeros(len(nodes))
        top = np.zeros((len(nodes), size), np.float32)
        least = np.zeros((len(nodes), size), np.float32)
        for i in range(len(nodes) - 1, -1, -1):
            a, b, above = nodes[i]
            x, z = self.ptr[a], self.ptr[b]
            t = self.terms[x:z]
            c = np.bincount(t, y[x:z], size) / (b - a)
            d = (_sums(y[x:z] ** 2, self.ptr[a:b + 1] - x) - 2 * _sums(c[t] * y[x:z], self.ptr[a:b + 1] - x)
                 + c @ c)
            slip = 1e-9 * (float(_sums(y[x:z] ** 2, self.ptr[a:b + 1] - x).max()) + c @ c)
            self.centroid[i], self.radius[i] = c, math.sqrt(max(0.0, float(d.max())) + slip)
            if b - a <= LEAF:
                np.maximum.at(top[i], t, self.values[x:z].astype(np.float32))
                full = np.bincount(t, minlength=size) == b - a  # held by every row: a least value
                low = np.full(size, np.inf, np.float32)
                np.minimum.at(low, t, self.values[x:z].astype(np.float32))
                least[i] = np.where(full, low, 0)
            if above >= 0:
                first = not top[above].any()
                np.maximum(top[above], top[i], out=top[above])
                least[above] = least[i] if first else np.minimum(least[above], least[i])
            self.middle[i] = (top[i] + least[i]) / 2
            self.width[i] = (top[i] - least[i]) / 2

    def bounds(self, queries: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """Upper bounds of the products of each query (column) with the rows of each node."""
        q = queries.astype(np.float32)
        box = self.middle @ q + self.width @ q
        scaled = queries / scale[:, None]
        ball = (self.centroid @ scaled.astype(np.float32)
                + self.radius[:, None] * np.sqrt((scaled * scaled).sum(0))[None])
        # all summands are at least 0, so the relative error of a sum of that many
        # terms in single precision is below this
        found = np.minimum(box, ball) * (1 + 8 * (len(scale) + 8) * 2.0 ** -24) + 1
        for i in range(1, len(found)):
            np.minimum(found[i], found[self.above[i]], out=found[i])
        return found[self.leaves]


class Best:
    """The highest scores of one query so far: score, whether the id is null, id."""

    def __init__(self, top: int):
        self.top = top
        self.rows = np.zeros((3, 0), np.int64)

    def needed(self) -> int:
        return int(self.rows[0, -1]) if self.rows.shape[1] == self.top else 1

    def add(self, score: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        keep = score >= self.needed()
        if keep.any():
            rows = np.concatenate([self.rows, np.stack([score[keep], null[keep], ids[keep]])], axis=1)
            self.rows = rows[:, np.lexsort((rows[2], rows[1], -rows[0]))[:self.top]]


def search_tree(tree: Tree, bound: np.ndarray, query: np.ndarray, best: Best, null: np.ndarray,
                ids: np.ndarray) -> int:
    """Open leaves best-first; the number of rows scored."""
    order = np.argsort(-bound, kind="stable")
    at, step, scored = 0, 4, 0
    while at < len(order) and bound[order[at]] >= best.needed():
        some = order[at:at + step]
        some = np.sort(some[bound[some] >= best.needed()])
        rows = np.concatenate([np.arange(*tree.ranges[i]) for i in some])
        flat, begin = _flat(tree.ptr, rows)
        score = _sums(query[tree.terms[flat]] * tree.values[flat], begin)
        best.add(score, null[tree.order[rows]], ids[tree.order[rows]])
        scored += len(rows)
        at, step = at + step, step * 2
    return scored


def _search(rows: list[tuple], block: Block, weight: np.ndarray, n: int, total: int, best: list[Best],
            stat: list[int]) -> None:
    terms = [np.frombuffer(r[2], "<i4") for r in rows]
    ptr = np.concatenate([[0], np.cumsum([len(t) for t in terms])])
    values = [saturated(np.frombuffer(r[3], f"<i{len(r[3]) // len(t)}").astype(np.int64), r[1], n, total)
              for r, t in zip(rows, terms, strict=True)]
    null = np.array([r[0] is None for r in rows], np.int64)
    ids = np.array([r[0] or 0 for r in rows], np.int64)
    scale = np.sqrt(np.maximum(weight, 1))
    tree = Tree(ptr, np.concatenate(terms), np.concatenate(values), scale)
    chunk = max(1, CELLS // 2 // len(weight))
    for a in range(0, len(best), chunk):
        some = range(a, min(a + chunk, len(best)))
        queries = np.zeros((len(weight), len(some)), np.int64)
        for k, i in enumerate(some):
            queries[block.terms[i], k] = block.counts[i] * weight[block.terms[i]]
        bound = tree.bounds(queries, scale)
        for k, i in enumerate(some):
            query = np.ascontiguousarray(queries[:, k])
            stat[0] += search_tree(tree, bound[:, k], query, best[i], null, ids)
            stat[1] += len(rows)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """item_id, rank, doc_id, score of each item's best documents, and ``scored``: the
    share of (query, document) pairs that the trees of the row's task scored."""
    spark = docs.sparkSession
    none = "key string, doc_id long, score long, scored double"
    out = None
    for block in blocks(items, block_chars):
        shared = spark.sparkContext.broadcast(block)
        found = write_scratch(vectors(docs, shared), "lexical-vectors")
        n, total = found.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        size = len(block.vocabulary)
        shard = max(LEAF, min(SHARD, CELLS // size * LEAF // 4))
        part = None
        if total:
            weight = spark.sparkContext.broadcast(weights(frequencies(found, size), n))

            def run(batches, shared=shared, weight=weight, n=n, total=total, shard=shard):
                block = shared.value
                best = [Best(top) for _ in block.keys]
                held, stat = [], [0, 0]
                for batch in batches:
                    for at in range(0, batch.num_rows, 1000):
                        held += zip(*[c.to_pylist() for c in batch.slice(at, 1000).columns], strict=True)
                        while len(held) >= shard:
                            _search(held[:shard], block, weight.value, n, total, best, stat)
                            held = held[shard:]
                if held:
                    _search(held, block, weight.value, n, total, best, stat)
                rows = [(key, None if null else doc, score, stat[0] / max(1, stat[1]))
                        for key, b in zip(block.keys, best, strict=True) for score, null, doc in b.rows.T.tolist()]
                for at in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(
                            zip(*rows[at:at + 10_000], strict=True),
                            (pa.string(), pa.int64(), pa.int64(), pa.float64()), strict=True)],
                        ["key", "doc_id", "score", "scored"])

            held = found.where(F.octet_length("terms") > 0)
            part = write_scratch(held.mapInArrow(freed(run), none), "lexical-top")
        if part is not None:
            out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], none)
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    wanted = items.select("item_id", _key().alias("item_key"))
    return (wanted.join(ranked, F.col("item_key") == F.col("key"))
            .select("item_id", "rank", "doc_id", "score", "scored"))
