"""Repeated windows of a corpus: the tables that both repeat operators share.

1. Every document is cut into segments (see ``anchors``); a short row for each:
   document, anchor, content.
2. Anchors that occur once are dropped; nothing that repeats is lost by that.
3. Equal segments collapse to one (a hot passage costs no more than a rare one).
   An anchor with one content needs no comparison: its copies are equal whole.
4. The distinct segments of the other anchors are dealt to reference shards by
   anchor, and there a matcher compares them, shard by shard in bounded memory.
   An anchor with more than ``hot`` contents (the edge of a passage that very many
   documents hold) would be one task's work, so it is split into its windows:
   their hashes are aggregated, which no single task does for a key.
5. The verdicts go back to the documents that hold the segments, and one last
   pass over the texts removes what is covered.

Texts move through two joins on the document, compressed.  Joins on a hot
content or anchor are plain joins, which adaptive execution may split.

Rows that repeat a doc_id are one document; null ids are one document too,
before all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from fxledger.llm import anchors, textops as tx
from fxledger.llm.memory import freed
from fxledger.session import write_scratch

LEAST = -(1 << 63)
HOT = 1000


@dataclass(frozen=True)
class Unit:
    """What a window counts: bytes, or words between ASCII white space."""

    by_word: bool
    length: int
    k: int

    def items(self, buf: np.ndarray, off: np.ndarray):
        """Items, document bounds, and the byte range of each item."""
        if not self.by_word:
            at = np.arange(len(buf))
            return buf, off, at, at + 1
        a, b, doc = tx.words(buf, off)
        return (tx.Prefix(buf).of(a, b), np.searchsorted(doc, np.arange(len(off))), a, b)

    def segments(self, buf: np.ndarray, off: np.ndarray):
        items, bounds, a, b = self.items(buf, off)
        return anchors.segments(items, bounds, self.length, self.k), bounds, a, b


def key(docs: DataFrame) -> Column:
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(LEAST))


def squeezed(docs: DataFrame) -> DataFrame:
    """key and compressed text (null: empty), to be shuffled."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for b in batches:
            z = [pack.compress(t or b"") for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(z, pa.binary())], ["key", "z"])

    return docs.select(key(docs).alias("key"), "text").mapInArrow(freed(run), "key long, z binary")


def texts(batch: pa.RecordBatch) -> pa.Array:
    unpack = zstandard.ZstdDecompressor()
    return pa.array([unpack.decompress(z) for z in batch.column("z").to_pylist()], pa.large_binary())


def segment_rows(docs: DataFrame, unit: Unit) -> DataFrame:
    """key, anchor, content, n: the distinct segments of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for a, _, buf, off in tx.slabs(batch.column("text")):
                s, _, _, _ = unit.segments(buf, off)
                _, at, n = np.unique(s.content.view(np.uint64) ^ tx.salt(s.doc),
                                     return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[a + s.doc[at]]), pa.array(s.anchor[at]), pa.array(s.content[at]),
                     pa.array(n.astype(np.int32))], ["key", "h", "c", "n"])

    return (docs.select(key(docs).alias("key"), "text")
            .mapInArrow(freed(run), "key long, h long, c long, n int"))


Matcher = Callable[[Iterator[tuple[int, int, bytes]]], Iterator[tuple[int, list[tuple[int, int]]]]]


def verdicts(docs: DataFrame, unit: Unit, matcher: Matcher, first_stays: bool,
             hot: int = HOT) -> DataFrame:
    """key and ``found``: for each segment content of the document with covered
    windows, their ranges [a, b) in the segment; null ranges: all of them.

    ``matcher`` gets the (anchor, content, text) of a shard's segments, by
    anchor and by place of their first copy, and gives (content, ranges).
    """
    rows = segment_rows(docs, unit)
    again = rows.groupBy("h").agg(F.sum("n").alias("t")).where("t > 1").select("h")
    kept = write_scratch(rows.join(again, "h", "left_semi"), "segments")
    content = write_scratch(kept.groupBy("c", "h").agg(F.min("key").alias("owner"),
                                                       F.sum("n").alias("t")), "contents")
    several = (content.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
               .select("h", (F.col("k") > hot).alias("hot")))
    wanted = (content.join(several, "h").groupBy("owner")
              .agg(F.collect_list(F.struct("c", "hot")).alias("cs")))

    def cut(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                yield from _cut(batch.slice(at, 500), unit)

    cuts = write_scratch(
        squeezed(docs).join(wanted, F.col("key") == F.col("owner")).select("owner", "cs", "z")
        .mapInArrow(freed(cut), "h long, c long, owner long, place long, i long, text binary"), "cuts")
    shards = cuts.where("i < 0").repartition("h").sortWithinPartitions("h", "owner", "place")
    single = cuts.where("i >= 0").select("h", "c", "owner", "place", "i").dropDuplicates(["h", "c", "place"])
    one = F.struct("owner", "place")
    shared = single.groupBy("h").agg(F.min(one).alias("m"), F.count(F.lit(1)).alias("copies")).where(
        "copies > 1").withColumnRenamed("h", "w")
    split = (single.join(shared, F.col("h") == F.col("w"))
             .where(one != F.col("m") if first_stays else F.lit(True))
             .groupBy("c").agg(F.array_sort(F.collect_list(
                 F.struct(F.col("i").alias("a"), (F.col("i") + 1).alias("b")))).alias("ranges")))

    def match(batches):
        def one_by_one():
            anchor, seen = None, set()  # rows that repeat a doc_id may repeat a content
            for batch in batches:
                for h, c, text in zip(*(batch.column(x).to_pylist() for x in ("h", "c", "text")),
                                      strict=True):
                    if h != anchor:
                        anchor, seen = h, set()
                    if c not in seen:
                        seen.add(c)
                        yield h, c, text

        out = []
        for c, ranges in matcher(one_by_one()):
            out.append((c, [{"a": a, "b": b} for a, b in ranges]))
            if len(out) >= 5000:
                yield _matched(out)
                out = []
        if out:
            yield _matched(out)

    matched = shards.select("h", "c", "text").mapInArrow(freed(match), "c long, ranges " + RANGES).union(split)
    judged = content.select("c", "owner", "t").join(
        matched.withColumnRenamed("c", "mc"), F.col("c") == F.col("mc"), "left").drop("mc")
    if first_stays:
        whole = F.col("key") != F.col("owner")
    else:
        whole, judged = F.col("t") > 1, judged.where("t > 1 or size(ranges) > 0")
    some = "whole or size(ranges) > 0" + (" or n > 1" if first_stays else "")
    ranges = F.coalesce(F.col("ranges"), F.array().cast(RANGES))
    found = (kept.select("key", F.col("c").alias("kc"), "n").join(judged, F.col("kc") == F.col("c"))
             .select("key", "c", "n", whole.alias("whole"), "ranges").where(some))
    return (found.groupBy("key").agg(F.collect_list(F.struct(
        "c", F.when(~F.col("whole"), ranges).alias("ranges"))).alias("found")))


RANGES = "array<struct<a:bigint,b:bigint>>"
_RANGES = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _matched(rows: list) -> pa.RecordBatch:
    c, r = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(r, _RANGES)], ["c", "ranges"])


def _cut(batch: pa.RecordBatch, unit: Unit) -> Iterator[pa.RecordBatch]:
    """The wanted segments of some documents (i = -1), or for hot anchors their
    windows (i counts them in the segment, and h is the window's own hash)."""
    owner = batch.column("owner").to_numpy()
    asked = [{x["c"]: x["hot"] for x in cs} for cs in batch.column("cs").to_pylist()]
    for a, _, buf, off in tx.slabs(texts(batch)):
        items, bounds, w0, w1 = unit.items(buf, off)
        s = anchors.segments(items, bounds, unit.length, unit.k)
        whole, parts, hashed = [], [], None
        for j, (d, c) in enumerate(zip(s.doc.tolist(), s.content.tolist(), strict=True)):
            split = asked[a + d].pop(c, None)  # only the first copy in a document
            if split is not None:
                (parts if split else whole).append(j)
        if whole:
            j = np.array(whole)
            ends = w1[s.last[j] + unit.length - 1]
            yield _arrays(s.anchor[j], s.content[j], owner[a + s.doc[j]], s.first[j],
                          np.full(len(j), -1),
                          [buf[x:y].tobytes() for x, y in zip(w0[s.first[j]], ends, strict=True)])
        if parts:
            hashed = tx.Prefix(items) if hashed is None else hashed
            j = np.array(parts)
            n = s.last[j] - s.first[j] + 1
            i = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            j = np.repeat(j, n)
            at = s.first[j] + i
            yield _arrays(hashed.of(at, at + unit.length).view(np.int64), s.content[j],
                          owner[a + s.doc[j]], at, i, [None] * len(at))


def _arrays(*cols) -> pa.RecordBatch:
    *numbers, text = cols
    return pa.RecordBatch.from_arrays(
        [*[pa.array(c, pa.int64()) for c in numbers], pa.array(text, pa.binary())],
        ["h", "c", "owner", "place", "i", "text"])


def removed(text: pa.Array, found: list, unit: Unit, first_stays: bool) -> list[list[tuple[int, int]]]:
    """The covered item ranges [a, b) of each text, ascending and merged, and
    their byte ranges, as pairs of lists."""
    out: list = [([], []) for _ in found]
    some = [i for i, f in enumerate(found) if f]
    if not some:
        return out
    text = text.take(pa.array(some, pa.int64()))
    found = [found[i] for i in some]
    for a, _, buf, off in tx.slabs(text):
        n = len(off) - 1
        s, bounds, w0, w1 = unit.segments(buf, off)
        spans: list[list] = [[] for _ in range(n)]
        asked = [{f["c"]: f["ranges"] for f in found[a + d]} for d in range(n)]
        seen: list[set] = [set() for _ in range(n)]
        for d, x, y, c in zip(*(v.tolist() for v in (s.doc, s.first, s.last, s.content)), strict=True):
            if first_stays and c in seen[d]:
                spans[d].append((x, y + unit.length))
                continue
            seen[d].add(c)
            if c in asked[d]:
                r = asked[d][c]
                spans[d] += [(x, y + unit.length)] if r is None else [
                    (x + p["a"], x + p["b"] - 1 + unit.length) for p in r]
        for d in range(n):
            merged: list[list[int]] = []
            for p, q in sorted(spans[d]):
                if merged and p <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], q)
                else:
                    merged.append([p, q])
            out[some[a + d]] = (
                [(p - int(bounds[d]), q - int(bounds[d])) for p, q in merged],
                [(int(w0[p]) - int(off[d]), int(w1[q - 1]) - int(off[d])) for p, q in merged])
    return out


def spans(docs: DataFrame, unit: Unit, matcher: Matcher, first_stays: bool,
          hot: int = HOT) -> DataFrame:
    """doc_id, z (compressed text), found.  Null where nothing is covered."""
    v = verdicts(docs, unit, matcher, first_stays, hot).withColumnRenamed("key", "vkey")
    return (squeezed(docs).join(v, F.col("key") == F.col("vkey"), "left")
            .select(F.when(F.col("key") != LEAST, F.col("key")).alias("doc_id"), "z", "found"))
