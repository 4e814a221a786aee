"""Near duplicates by the Jaccard similarity of word shingles, exactly.

A document is the set of its distinct shingles of ``SHINGLE`` words (with fewer
words: one shingle of them all), A-Z lower-cased.  Two documents are linked if
the similarity of their sets is ``PERCENT`` / 100 or more.

1. Equal sets collapse to one node (its smallest doc_id stands for it).
2. Two linked sets share a shingle among the first n - ceil(0.8 n) + 1 of each
   in any common order.  The order used puts rare shingles first, then goes by
   hash; shingles are counted over all documents, in ``CELLS`` cells of their
   hashes, and pass for as frequent as their cell.  The order decides how
   fast the join is, never what it finds.  These few shingles are dealt to tasks
   by hash, as packed arrays.
3. For each shingle that several sets hold, the smallest set id leads a block
   of all of them, so any two linked sets meet in a block.  Texts move to blocks
   in three passes, each for what the last left open: first every set only to
   the block of the leader with which it shares most; then the blocks whose sets
   are not yet in one component; and for blocks larger than ``BLOCK``, which
   these passes search in parts, each with the leader, the sets outside the
   largest component with each other and with the parts of that component.
   Only sets that a bound from their count vectors (see 4) leaves a possible
   partner in the block move at all; the vectors are short.  A bitmap of their
   hashed ids keeps the other texts from moving.
4. In a block, each set is a point: the counts of its shingles in ``GROUPS``
   hash groups.  The points are indexed in an R-tree.  The sum over the groups
   of the smaller of two counts bounds the overlap of two sets, and with the
   upper corner of a box it bounds the overlap with any set of the box; boxes
   and points that cannot reach the similarity are skipped, and so are those
   already in the component of the query.  A large set fills ``GROUPS`` groups so
   evenly that the bound says nothing, so its vector has more groups, one for
   ``FILL`` shingles, which bound the pairs that the tree leaves.  Surviving pairs
   are verified on the sets.  A block gives at most one link fewer than it has sets.
5. Components of the links, by star contraction.

Null and empty texts have no shingles and are linked with nothing.  Rows that
repeat a doc_id are one document; null ids stand before all others and are
shown as null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from fxledger.llm import repeats, textops as tx
from fxledger.llm.components import components
from fxledger.llm.memory import freed
from fxledger.session import write_scratch

SHINGLE = 5
PERCENT = 80
GROUPS = 256
FILL = 8
LEAF = 16
AT_ONCE = 64
BLOCK = 2000
CELLS = 1 << 22
PART = 1 << 18
FULL = 255
BITS = 1 << 27
SHARE = 1e-3
HELD_PAIRS = 4 << 20
LEAST = repeats.LEAST
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    new = x[1:] != x[:-1]
    return x if new.all() else x[np.concatenate([[True], new])]


def slab_sets(text: pa.Array, k: int = SHINGLE) -> Iterator[list[np.ndarray]]:
    """The sorted distinct shingle hashes of each text, a list for each slab of texts."""
    for a, b, buf, off in tx.slabs(text):
        buf = _LOWER[buf]
        w0, w1, doc = tx.words(buf, off)
        h = tx.Prefix(buf).of(w0, w1)
        g = tx.grams(h, k)
        bounds = np.searchsorted(doc, np.arange(b - a + 1))
        out = []
        for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if y - x >= k:
                out.append(distinct(g[x:y - k + 1]))
            elif y > x:  # all words as one shingle, apart from any longer one
                out.append(tx.mix(tx.Prefix(h[x:y]).of(np.array([0]), np.array([y - x])) + np.uint64(y - x)))
            else:
                out.append(g[:0])
        yield out


def shingles(text: pa.Array, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for sets in slab_sets(text, k):
        yield from sets


def set_ids(sets: list[np.ndarray]) -> np.ndarray:
    ends = np.cumsum([len(x) for x in sets])
    return tx.Prefix(np.concatenate(sets)).of(np.concatenate([[0], ends[:-1]]), ends).view(np.int64)


def set_id(s: np.ndarray) -> int:
    return int(set_ids([s])[0])


def vector(s: np.ndarray) -> np.ndarray:
    """How many shingles of a set fall in each hash group: ``GROUPS`` groups, doubled
    until one holds ``FILL`` on the average at most."""
    groups = GROUPS
    while groups * FILL < len(s):
        groups *= 2
    return np.bincount((tx.mix(s) & np.uint64(groups - 1)).astype(np.int64), minlength=groups)


def fold(x: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """A count vector in fewer groups."""
    return x if len(x) == groups else x.reshape(-1, groups).sum(axis=0, dtype=np.int32)


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in the narrowest unsigned width that holds them."""
    top = int(counts.max())
    return counts.astype("<u1" if top < 256 else "<u2" if top < 65_536 else "<u4" if top < 1 << 32 else "<u8")


def pack(counts: np.ndarray) -> bytes:
    """A count vector: the width of a count, and the counts."""
    x = narrow(counts)
    return bytes([x.itemsize]) + x.tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int32)


def cells(x: np.ndarray) -> np.ndarray:
    """The cell of each shingle in the counts of ``_sets``."""
    return (tx.mix(x) >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def _sets(docs: DataFrame) -> DataFrame:
    """key, s (id of the set), n (its size), vec (its count vector) of every row; and
    part, z: how often shingles fall in each of ``CELLS`` cells, a part of the cells in
    a row, from each task.  The part -1 is the number of documents with shingles."""

    def run(batches):
        total, full = np.zeros(CELLS, np.uint32), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                s, n, vec = [], [], []
                for sets in slab_sets(part.column("text")):
                    s.append(set_ids(sets))
                    n += [len(x) for x in sets]
                    vec += [pack(vector(x)) for x in sets]
                    at_cells = np.sort(cells(np.concatenate(sets)))
                    if len(at_cells):
                        first = np.flatnonzero(np.concatenate([[True], at_cells[1:] != at_cells[:-1]]))
                        total[at_cells[first]] += np.diff(first, append=len(at_cells)).astype(np.uint32)
                full += len(n) - n.count(0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(np.concatenate(s)), pa.array(n, pa.int64()),
                     pa.array(vec, pa.binary()), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.binary())], _SETS)
        if full:
            squeeze = zstandard.ZstdCompressor(level=1)
            for part, x in enumerate([np.array([full]), *total.reshape(-1, PART)], -1):
                yield pa.RecordBatch.from_arrays(
                    [*[pa.nulls(1, pa.int64())] * 3, pa.nulls(1, pa.binary()), pa.array([part], pa.int64()),
                     pa.array([squeeze.compress(pack(x))], pa.binary())], _SETS)

    return (docs.select(repeats.key(docs).alias("key"), "text")
            .mapInArrow(freed(run), "key long, s long, n long, vec binary, part long, z binary"))


_SETS = ["key", "s", "n", "vec", "part", "z"]


def ranks(counted: DataFrame, share: float = SHARE) -> np.ndarray:
    """How frequent the shingles of each cell are by the counts (part, z) of all tasks:
    ``FULL`` for cells in which they fall more often than ``share`` times the number of
    documents and 8 times the mean of the cells, less for others.  The counts have a
    fixed size."""

    def add(batches):
        squeeze, expand = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        now, total = None, None

        def done():
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int64()), pa.array([squeeze.compress(pack(total))], pa.binary())],
                ["part", "z"])

        for batch in batches:
            for part, z in zip(*(batch.column(c).to_pylist() for c in ("part", "z")), strict=True):
                raw = expand.decompress(z)
                x = np.frombuffer(raw, f"<u{raw[0]}", offset=1)
                if part != now:
                    if now is not None:
                        yield done()
                    now, total = part, x.astype(np.uint64)
                else:
                    total += x
        if now is not None:
            yield done()

    got = (counted.select("part", "z").repartition("part").sortWithinPartitions("part")
           .mapInArrow(freed(add), "part long, z binary").orderBy("part").toArrow().column("z").to_pylist())
    out = np.zeros(CELLS, np.uint8)
    if not got:
        return out
    expand = zstandard.ZstdDecompressor()
    raw = (expand.decompress(z) for z in got)
    (n,), *total = (np.frombuffer(x, f"<u{x[0]}", offset=1) for x in raw)
    mean = sum(int(x.sum(dtype=np.uint64)) for x in total) / CELLS
    full, step = max(3, share * float(n), 8 * mean), max(1, mean / 32)
    for x, to in zip(total, out.reshape(-1, PART), strict=True):
        to[:] = np.where(x > full, FULL, np.minimum(x / step, FULL - 1))
    return out


def frequent(docs: DataFrame, share: float = SHARE) -> np.ndarray:
    """Whether each of ``CELLS`` cells is full.  All documents count."""
    return ranks(_sets(docs).where("part is not null"), share) == FULL


def _needed(n: np.ndarray | int, m: np.ndarray | int, percent: int = PERCENT):
    """The least overlap of sets of n and m shingles that are linked."""
    return -(-(percent * (n + m)) // (100 + percent))


def _heads(docs: DataFrame, buckets: int, ranked: np.ndarray | None = None) -> DataFrame:
    """bucket, and packed (shingle, set) pairs of the heads of the sets."""
    if ranked is None:
        ranked = ranks(_sets(docs).where("part is not null"))
    often = docs.sparkSession.sparkContext.broadcast(ranked)

    def run(batches):
        rank = often.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                seen, tokens, owners = set(), [], []
                for sets in slab_sets(batch.column("text").slice(at, 2000)):
                    for x, s in zip(sets, set_ids(sets).tolist(), strict=True):
                        n = len(x)
                        if not n or s in seen:
                            continue
                        seen.add(s)
                        size = n - (-(-PERCENT * n // 100)) + 1
                        if size < n:
                            order = rank[cells(x)].astype(np.uint64) << np.uint64(56) | x >> np.uint64(8)
                            x = x[order <= np.partition(order, size - 1)[size - 1]]  # and any that tie
                        tokens.append(x)
                        owners.append(np.full(len(x), s, dtype=np.int64))
                if not tokens:
                    continue
                t, o = np.concatenate(tokens), np.concatenate(owners)
                bucket = (tx.mix(t) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                t, o, bucket = t[order], o[order], bucket[order]
                cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                ends = np.concatenate([cut[1:], [len(t)]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[cut], pa.int64()),
                     pa.array([t[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()),
                     pa.array([o[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary())],
                    ["bucket", "t", "o"])

    return docs.select("text").mapInArrow(freed(run), "bucket long, t binary, o binary")


def _leaders(x: np.ndarray, s: np.ndarray) -> pa.RecordBatch | None:
    """Rows of ``_led`` for all pairs of some shingles."""
    again = np.sort(x)
    again = again[1:][again[1:] == again[:-1]]
    if not len(again):
        return None
    held = again[np.minimum(np.searchsorted(again, x), len(again) - 1)] == x  # more than once
    x, s = x[held], s[held]
    order = np.lexsort((s, x))
    x, s = x[order], s[order]
    new = np.concatenate([[True], x[1:] != x[:-1]])
    keep = new | np.concatenate([[True], s[1:] != s[:-1]])
    x, s, new = x[keep], s[keep], new[keep]
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate([first, [len(x)]]))
    leader, many = np.repeat(s[first], size), np.repeat(size > 1, size)
    leader, s = leader[many], s[many]
    if not len(s):
        return None
    order = np.lexsort((s, leader))
    leader, s = leader[order], s[order]
    new = np.flatnonzero(np.concatenate([[True], (leader[1:] != leader[:-1]) | (s[1:] != s[:-1])]))
    return _led_batch(leader[new], s[new], np.diff(new, append=len(s)), None)


def _led_batch(leader, s: np.ndarray, n: np.ndarray, shingle) -> pa.RecordBatch:
    none = pa.nulls(len(s), pa.int64())
    return pa.RecordBatch.from_arrays(
        [none if leader is None else pa.array(leader), pa.array(s), pa.array(n.astype(np.int64)),
         none if shingle is None else pa.array(shingle.view(np.int64))], ["leader", "s", "n", "shingle"])


def _led(heads: DataFrame, held_pairs: int = HELD_PAIRS) -> DataFrame:
    """leader, s, n: every set with the leaders of the n shingles it shares.

    A task holds the pairs of one bucket, ``held_pairs`` at most: when there are more,
    those of its shingles with over a sixteenth of them are let go as they are (now and
    later), and their leaders are found by aggregation and a join that Spark can split.
    """

    def run(batches):
        bucket, x, s, held, hot = None, [], [], 0, np.zeros(0, np.uint64)

        def loose(t: np.ndarray, o: np.ndarray, out: list) -> tuple[np.ndarray, np.ndarray]:
            mine = np.isin(t, hot)
            if mine.any():
                out.append(_led_batch(None, o[mine], np.ones(int(mine.sum())), t[mine]))
            return t[~mine], o[~mine]

        def close():
            done = _leaders(np.concatenate(x), np.concatenate(s)) if held else None
            return [] if done is None else [done]

        for batch in batches:
            for b, t, o in zip(*(batch.column(c).to_pylist() for c in ("bucket", "t", "o")), strict=True):
                out: list = []
                if b != bucket:
                    out += close()
                    bucket, x, s, held, hot = b, [], [], 0, hot[:0]
                t, o = np.frombuffer(t, np.uint64), np.frombuffer(o, np.int64)
                if len(hot):
                    t, o = loose(t, o, out)
                x.append(t)
                s.append(o)
                held += len(t)
                if held > held_pairs:
                    t, o = np.concatenate(x), np.concatenate(s)
                    of, n = np.unique(t, return_counts=True)
                    hot = np.union1d(hot, of[n > max(1, held_pairs // 16)])
                    t, o = loose(t, o, out)
                    x, s, held = [t], [o], len(t)
                yield from out
        yield from close()

    found = write_scratch(heads.repartition("bucket").sortWithinPartitions("bucket")
                          .mapInArrow(freed(run), "leader long, s long, n long, shingle long"), "led")
    hot = found.where(F.col("shingle").isNotNull()).select("s", "shingle")
    lead = (hot.groupBy(F.col("shingle").alias("of")).agg(F.min("s").alias("leader"), F.max("s").alias("other"))
            .where("leader <> other"))
    met = hot.join(lead, F.col("shingle") == F.col("of")).select("leader", "s", F.lit(1).cast("long").alias("n"))
    return (found.where(F.col("shingle").isNull()).select("leader", "s", "n").unionByName(met)
            .groupBy("leader", "s").agg(F.sum("n").alias("n")))


def _bounded(x: np.ndarray, n: int, others: list[np.ndarray], m: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Which of the sets of m shingles may be linked with one of n, by count vectors in
    as many groups as two of them share."""
    groups = np.array([min(len(x), len(y)) for y in others])
    out = np.ones(len(others), dtype=bool)
    for g in set(groups.tolist()):
        at = np.flatnonzero(groups == g)
        both = np.minimum(np.stack([fold(others[j], g) for j in at.tolist()]), fold(x, g)).sum(axis=1)
        out[at] = both >= _needed(n, m[at], percent)
    return out


class RTree:
    """Boxes over count vectors, level by level; the last level are the points."""

    def __init__(self, vectors: list[np.ndarray], sizes: np.ndarray, leaf: int = LEAF):
        points = np.stack([fold(x) for x in vectors]).astype(np.int32)
        # neighbours in size and in the fullest coordinates share a box
        order = np.lexsort((*points.T[np.argsort(points.var(axis=0))[-2:]], sizes))
        self.order, self.points, self.vectors = order, points, vectors
        self.levels = [(points[order], sizes[order], sizes[order], np.arange(len(order) + 1))]
        while len(self.levels[0][0]) > leaf:
            hi, small, large, _ = self.levels[0]
            cut = np.arange(0, len(hi), leaf)
            self.levels.insert(0, (np.maximum.reduceat(hi, cut), np.minimum.reduceat(small, cut),
                                   np.maximum.reduceat(large, cut), np.append(cut, len(hi))))

    def candidates(self, i: int, n: int, alike, percent: int = PERCENT) -> np.ndarray:
        """Points that may be linked with the i-th vector.  ``alike(level, boxes)`` tells
        which boxes hold nothing but the query's own component."""
        x = self.points[i]
        at = np.arange(len(self.levels[0][0]))
        for k, (hi, small, large, kids) in enumerate(self.levels):
            ok = (large[at] * 100 >= percent * n) & (small[at] * percent <= 100 * n)
            at = at[ok]
            at = at[~alike(k, at)]
            least = np.maximum(small[at], -(-percent * n // 100))
            at = at[np.minimum(hi[at], x).sum(axis=1) >= _needed(n, least, percent)]
            if k + 1 < len(self.levels) and len(at):
                at = np.concatenate([np.arange(kids[b], kids[b + 1]) for b in at])
        if len(at) and len(self.vectors[i]) > GROUPS:
            at = at[_bounded(self.vectors[i], n, [self.vectors[j] for j in self.order[at].tolist()],
                             self.levels[-1][1][at], percent)]
        return at


def links(sets: list[np.ndarray], labels: list, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links between the sets that join different components; each link is
    verified.  ``labels``: known components."""
    n = len(sets)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    named: dict = {}
    for i, label in enumerate(labels):
        if label is not None:
            parent[i] = named.setdefault(label, i)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    tree = RTree([vector(s) for s in sets], sizes)
    back = tree.order
    comp = np.array([root(i) for i in back])        # component of each point, by place in the tree
    out = []
    spread = [None] * len(tree.levels)

    def refresh() -> None:
        lo = hi = comp
        spread[-1] = (lo, hi)
        for k in range(len(tree.levels) - 2, -1, -1):
            cut = tree.levels[k][3][:-1]
            lo, hi = np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut)
            spread[k] = (lo, hi)

    refresh()
    for place in range(n):
        i = int(back[place])
        mine = comp[place]

        def alike(k: int, at: np.ndarray) -> np.ndarray:
            lo, hi = spread[k]
            return (lo[at] == mine) & (hi[at] == mine)

        changed = False
        for q in tree.candidates(i, int(sizes[i]), alike, percent).tolist():
            j = int(back[q])
            if j == i or root(i) == root(j):
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                out.append((i, j))
                ri, rj = root(i), root(j)
                parent[max(ri, rj)] = min(ri, rj)
                comp[(comp == ri) | (comp == rj)] = min(ri, rj)
                mine = min(ri, rj)
                changed = True
        if changed:
            refresh()
    return out


def _search(rows: DataFrame) -> DataFrame:
    """a, b: links in the blocks of ``rows`` (block, rep, s, label, z)."""

    def block(members: list[tuple]) -> list[tuple[int, int]]:
        rep, s, label, z = zip(*members, strict=True)
        unpack = zstandard.ZstdDecompressor()
        text = pa.array([unpack.decompress(x) for x in z], pa.large_binary())
        seen, keep, sets = set(), [], []
        for i, x in enumerate(shingles(text)):
            if rep[i] not in seen and set_id(x) == s[i]:  # else a row that repeats the id
                seen.add(rep[i])
                keep.append(i)
                sets.append(x)
        if len(sets) < 2:
            return []
        found = links(sets, [label[i] for i in keep])
        return [(rep[keep[i]], rep[keep[j]]) for i, j in found]

    def run(batches):
        now, members, out = None, [], []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("block", "rep", "s", "label", "z")]
            for name, *row in zip(*cols, strict=True):
                if name != now:
                    out += block(members) if len(members) > 1 else []
                    now, members = name, []
                members.append(tuple(row))
            if len(out) > 1000:
                yield _edges(out)
                out = []
        out += block(members) if len(members) > 1 else []
        if out:
            yield _edges(out)

    return (rows.select("block", "rep", "s", "label", "z").repartition("block")
            .sortWithinPartitions("block", "rep").mapInArrow(freed(run), "a long, b long"))


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _sift(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """The rows whose count vector leaves them a possible partner, of another
    component, in their block."""

    def keep(members: list[tuple]) -> list[tuple]:
        vectors = [unpack(m[-1]) for m in members]
        sizes = np.array([x.sum() for x in vectors], dtype=np.int64)
        names: dict = {}
        comp = np.array([names.setdefault(("c", m[2]) if m[2] is not None else ("s", m[1]), i)
                         for i, m in enumerate(members)])
        found = np.zeros(len(members), dtype=bool)
        if len(members) <= AT_ONCE:  # too few for a tree: all pairs
            a, b = np.triu_indices(len(members), 1)
            near = (comp[a] != comp[b]) & (100 * np.minimum(sizes[a], sizes[b])
                                           >= PERCENT * np.maximum(sizes[a], sizes[b]))
            a, b = a[near], b[near]
            if len(a):
                points = np.stack([fold(x) for x in vectors])
                near = np.minimum(points[a], points[b]).sum(axis=1) >= _needed(sizes[a], sizes[b])
                for i, j in zip(a[near].tolist(), b[near].tolist(), strict=True):
                    if not (found[i] and found[j]) and (
                            min(len(vectors[i]), len(vectors[j])) == GROUPS
                            or _bounded(vectors[i], sizes[i], [vectors[j]], sizes[j:j + 1])[0]):
                        found[i] = found[j] = True
            return [m[:-1] for m, f in zip(members, found.tolist(), strict=True) if f]
        tree = RTree(vectors, sizes)
        place = comp[tree.order]
        lo = hi = place
        spread = [(lo, hi)]
        for k in range(len(tree.levels) - 2, -1, -1):
            cut = tree.levels[k][3][:-1]
            lo, hi = np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut)
            spread.insert(0, (lo, hi))
        for at, i in enumerate(tree.order.tolist()):
            def alike(k: int, boxes: np.ndarray, mine=place[at]) -> np.ndarray:
                return (spread[k][0][boxes] == mine) & (spread[k][1][boxes] == mine)

            near = tree.candidates(i, int(sizes[i]), alike)
            if len(near):
                found[tree.order[near]] = found[i] = True
        return [m[:-1] for m, f in zip(members, found.tolist(), strict=True) if f]

    def run(batches):
        now, members, out = None, [], []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("block", "rep", "s", "label", "vec")]
            for name, *row in zip(*cols, strict=True):
                if name != now:
                    if len(members) > 1:
                        out += [(now, *m) for m in keep(members)]
                    now, members = name, []
                members.append(tuple(row))
            if len(out) > 10_000:
                yield _kept(out)
                out = []
        if len(members) > 1:
            out += [(now, *m) for m in keep(members)]
        if out:
            yield _kept(out)

    return (rows.select("block", "rep", "s", "label").join(vectors, F.col("s") == F.col("set")).drop("set")
            .repartition("block").sortWithinPartitions("block", "rep")
            .mapInArrow(freed(run), "block long, rep long, s long, label long"))


def _kept(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)],
                                      ["block", "rep", "s", "label"])


def _wanted(docs: DataFrame, rows: DataFrame, most: int = BITS) -> DataFrame:
    """The documents that are a ``rep`` of the rows, and a few others: those whose hashed
    id has its bit in a bitmap of ``most`` bits at most."""
    bits = 1 << 15
    n = 32 * rows.count()
    while bits < min(n, most):
        bits *= 2

    def bit(key):
        return F.pmod(F.xxhash64(key), F.lit(bits)) + 1

    got = (rows.select(bit(F.col("rep")).alias("bit"))
           .groupBy(F.bitmap_bucket_number("bit").alias("at"))
           .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map")).collect())
    held = np.zeros(bits // 8, np.uint8)
    for r in got:
        x = np.frombuffer(r["map"], np.uint8)
        held[(r["at"] - 1) * 4096:][:len(x)] = x
    there = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches):
        for batch in batches:
            b = batch.column("bit").to_numpy() - 1
            batch = batch.filter(pa.array((there.value[b >> 3] >> (b & 7).astype(np.uint8) & 1).astype(bool)))
            yield batch.select(["doc_id", "text"])

    rows = docs.select("doc_id", "text", bit(repeats.key(docs)).alias("bit"))
    return rows.mapInArrow(freed(run), rows.drop("bit").schema)


def _dealt(parts: str, salt: int) -> Column:
    return F.pmod(F.xxhash64("s", F.lit(salt)), F.col(parts))


def _upto(n: str) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.col(n) - 1)


def _parts(rows: DataFrame, block: int, salt: int = 0) -> DataFrame:
    """Blocks of (leader, s, rep) rows; a large one in parts, each with the leader.  Sets
    that are dealt to different parts by one salt may meet by another."""
    sizes = rows.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("parts"))
    rows = rows if "label" in rows.columns else rows.withColumn("label", F.lit(None).cast("long"))
    return (rows.join(sizes, "leader")
            .withColumn("part", F.explode(F.when(F.col("s") == F.col("leader"), _upto("parts"))
                                          .otherwise(F.array(_dealt("parts", salt)))))
            .withColumn("block", F.xxhash64("leader", "part")))


def _open(rows: DataFrame, label: DataFrame) -> DataFrame:
    """The rows, labelled, of the leaders whose sets are in several components."""
    rows = rows.join(label, F.col("rep") == F.col("node"), "left").withColumn(
        "label", F.coalesce("component", "rep")).drop("node", "component")
    mixed = (rows.groupBy("leader").agg(F.min("label").alias("x"), F.max("label").alias("y"))
             .where("x <> y").select("leader"))
    return rows.join(mixed, "leader", "left_semi")


def _across(rows: DataFrame, block: int) -> DataFrame:
    """Blocks in which any two sets of a leader that are in different components meet.
    Sets of the leader's largest component need not meet each other: they are dealt out,
    and met by all of the others."""
    sizes = rows.groupBy("leader", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = (sizes.groupBy("leader").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("all"))
               .select("leader", F.col("m.label").alias("base"),
                       F.ceil(F.col("m.n") / block).cast("long").alias("p"),
                       F.ceil((F.col("all") - F.col("m.n")) / block).cast("long").alias("q")))
    none = F.lit(-1).cast("long")
    dealt = rows.join(largest, "leader").withColumn("own", F.when(F.col("label") != F.col("base"), _dealt("q", 2)))
    base = F.transform(_upto("q"), lambda x: F.struct(_dealt("p", 3).alias("x"), x.alias("y"), none.alias("z")))
    other = F.transform(_upto("p"), lambda x: F.struct(x.alias("x"), F.col("own").alias("y"), none.alias("z")))
    pairs = F.transform(F.filter(_upto("q"), lambda x: x != F.col("own")), lambda x: F.struct(
        none.alias("x"), F.least(x, "own").alias("y"), F.greatest(x, "own").alias("z")))
    return (dealt.withColumn("at", F.explode(F.when(F.col("own").isNull(), base).otherwise(F.concat(other, pairs))))
            .withColumn("block", F.xxhash64("leader", "at")).drop("base", "p", "q", "own", "at"))


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    spark = docs.sparkSession
    told = write_scratch(_sets(docs), "sets")
    rows = told.where("part is null").select("key", "s", "n", "vec")
    pairs = rows.agg(F.sum(F.ceil(F.col("n") / 5) + 1)).first()[0] or 0  # of heads, at most
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), int(pairs // (HELD_PAIRS // 4)) + 1)
    nodes = rows.where("n > 0").groupBy("s").agg(F.min("key").alias("rep"))
    vectors = rows.select(F.col("s").alias("set"), "vec", "key").join(
        nodes.select(F.col("s").alias("of"), "rep"), (F.col("set") == F.col("of"))
        & (F.col("key") == F.col("rep"))).groupBy("set").agg(F.first("vec").alias("vec"))
    ranked = ranks(told.where("part is not null"))
    members = write_scratch(_led(_heads(docs, buckets, ranked)).join(nodes, "s"), "members")

    def linked(blocks: DataFrame) -> DataFrame:
        # a sort-merge join at every size: it may be split where a set is in very many blocks
        sifted = write_scratch(_sift(blocks, vectors), "sifted")
        text = repeats.squeezed(_wanted(docs, sifted))
        return write_scratch(_search(sifted.join(text.hint("merge"), F.col("rep") == F.col("key"))),
                             "links")

    # 1. each set with the leader it shares most shingles with
    best = (members.where("s <> leader").groupBy("s", "rep")
            .agg(F.max(F.struct("n", "leader")).alias("m")).select("m.leader", "s", "rep"))
    heads = best.select("leader").distinct().join(
        nodes.withColumnRenamed("s", "leader"), "leader").select("leader", F.col("leader").alias("s"), "rep")
    found = linked(_parts(best.union(heads), block))

    # 2. the blocks that hold several components
    rest = write_scratch(_parts(_open(members, components(found)), block, 1), "open")
    if not rest.isEmpty():
        found = found.union(linked(rest))

    # 3. the blocks in parts that hold several components still
    split = rest.where("parts > 1 and (s <> leader or part = 0)").select("leader", "s", "rep")
    if not split.isEmpty():
        found = found.union(linked(_across(_open(split, components(found)), block)))
    label = components(found)

    class_of = nodes.join(label, F.col("rep") == F.col("node"), "left").select(
        F.col("s").alias("set"), F.coalesce("component", "rep").alias("cid"))
    joined = rows.join(class_of, (F.col("s") == F.col("set")) & (F.col("n") > 0), "left")
    cid = F.coalesce("cid", "key")
    return joined.select(F.when(F.col("key") != LEAST, F.col("key")).alias("doc_id"),
                         F.col("n").alias("n_shingles"),
                         F.when(cid != LEAST, cid).alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """The documents, with their own columns, of which one of each component
    stays: the one with the smallest doc_id."""
    first = (near_duplicates(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
             .select(F.coalesce("doc_id", F.lit(LEAST)).alias("kept")).distinct())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                       repeats.key(docs).alias("key"))
    return rows.join(first, F.col("key") == F.col("kept"), "left_semi").select("doc.*")
