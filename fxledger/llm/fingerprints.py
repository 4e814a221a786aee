"""Document fingerprints: threshold-scaled sketches of byte shingles.

A text's shingles are its windows of ``WIDTH`` bytes (a shorter text is one shingle).
Each has a hash of 48 bits, and the sketch keeps every hash below 1 / ``SCALE`` of
their range.  So sketches of very unequal documents sample the same hashes: their
overlap estimates how much of the smaller text lies in the larger, and the sketch of
two texts taken together is the union of theirs (``merge``).  Short texts would keep
too few, so the ``LEAST`` smallest hashes always stay; this too can be merged, and a
sketch of fewer hashes than that holds all there are.

A fingerprint is text: the hashes in ascending order, twelve hexadecimal digits each.
Equal texts have equal fingerprints.

``next_text`` deals rows by range of doc_id and reads each range in order, one row
ahead; only the first and the last row of each range meet by a join.  Rows of one
doc_id are ordered by a hash of their text, and equal rows by their place in the
input, so that a third of all rows may share an id and a text and still be dealt
apart.  Null ids come first; a null text is empty; an empty text has an empty
fingerprint, alike (1.0) only to another empty one; a single row follows itself; an
empty table gives an empty result; other columns are ignored; long texts are taken
whole (a task holds a few of them).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from fxledger.llm import textops as tx
from fxledger.llm.memory import freed
from fxledger.session import write_scratch

WIDTH = 12
SCALE = 32
LEAST = 16
BITS = 48
LIMIT = (1 << BITS) // SCALE
_HELD = 1 << 20


# -- sketches ---------------------------------------------------------------------------

def sketches(texts: list[bytes]) -> list[np.ndarray]:
    """Ascending hashes of the sketch of each text."""
    out: list[np.ndarray] = []
    for a, b, buf, off in tx.slabs(pa.array(texts, pa.large_binary())):
        prefix = tx.Prefix(buf)
        starts = np.arange(max(0, len(buf) - WIDTH + 1))
        h = prefix.of(starts, starts + WIDTH) >> tx.U64(64 - BITS)
        low = np.flatnonzero(h < LIMIT)
        doc = np.searchsorted(off, low, "right") - 1
        inside = low + WIDTH <= off[doc + 1]
        low, doc = low[inside], doc[inside]
        ends = np.searchsorted(doc, np.arange(b - a + 1))
        for i in range(b - a):
            x, y = int(off[i]), int(off[i + 1])
            mine = np.unique(h[low[ends[i]:ends[i + 1]]])
            if len(mine) < LEAST and y > x:
                whole = h[x:y - WIDTH + 1] if y - x >= WIDTH else (
                    prefix.of(np.array([x]), np.array([y])) >> tx.U64(64 - BITS))
                mine = np.unique(whole)[:LEAST]
            out.append(mine)
    return out


def to_bytes(sketch: np.ndarray) -> bytes:
    return sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BITS // 8:].tobytes()


def to_text(sketch: np.ndarray) -> str:
    return to_bytes(sketch).hex()


def from_text(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, BITS // 8)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 8 - BITS // 8:] = raw
    return wide.view(">u8").ravel().astype(np.uint64)


def _known(sketch: np.ndarray) -> int:
    """All shingle hashes up to this one are in the sketch."""
    if len(sketch) < LEAST:
        return (1 << BITS) - 1
    return max(LIMIT - 1, int(sketch[LEAST - 1]))


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of both texts' shingles together."""
    both = np.union1d(a, b)
    return both[:max(LEAST, int(np.searchsorted(both, LIMIT)))]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the smaller text's shingles that the larger one holds."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    top = min(_known(a), _known(b))
    a, b = a[:np.searchsorted(a, top, "right")], b[:np.searchsorted(b, top, "right")]
    if not len(a) or not len(b):
        return 0.0
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def fingerprint(docs: DataFrame) -> DataFrame:
    """``doc`` (the row) and ``out.fingerprint``."""
    def run(text: pa.Array) -> list:
        raw = text.fill_null("").cast(pa.binary()).to_pylist()
        return [pa.array([to_text(s) for s in sketches(raw)], pa.string())]

    return tx.rowwise(docs, run, "fingerprint string")


# -- each text beside the next one ------------------------------------------------------

def edited(text: str, after: str) -> str:
    """The text with its last half replaced by as much of the start of the next."""
    half = len(text) // 2
    return text[:len(text) - half] + after[:half]


_OUT = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
        ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()),
        ("near_next", pa.float64())]
_KIND = ("doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, "
         "near_edited double, near_next double")
_COLUMNS = [n for n, _ in _OUT]
_TEXTS = ("fingerprint", "edited_fingerprint")


def _rows(pairs: list[tuple[int | None, str, str]]) -> list[tuple]:
    """Result rows of (doc_id, text, next text); a text that follows is sketched once."""
    new = [edited(t, n) for _, t, n in pairs]
    chain = [i > 0 and pairs[i - 1][2] is pairs[i][1] for i in range(len(pairs))]
    own = sketches([t.encode() for _, t, _ in pairs])
    rest = iter(sketches([pairs[i][2].encode() for i in range(len(pairs))
                          if i + 1 == len(pairs) or not chain[i + 1]]))
    after = [own[i + 1] if i + 1 < len(pairs) and chain[i + 1] else next(rest) for i in range(len(pairs))]
    changed = sketches([t.encode() for t in new])
    return [(d, len(t), hashlib.sha256(e.encode()).hexdigest(), to_bytes(a), to_bytes(c), likeness(a, c),
             likeness(a, n))
            for (d, t, _), e, a, c, n in zip(pairs, new, own, changed, after, strict=True)]


def _batch(rows: list[tuple], fields: list) -> pa.RecordBatch:
    schema = pa.schema(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            b = batch.slice(at, 500)
            packed = [pack.compress(t) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(packed, pa.binary())],
                                             ["doc_id", "h", "i", "z"])


def next_text(docs: DataFrame, rows: Callable = _rows) -> DataFrame:
    """Per document: its length, its edited text's digest, both fingerprints and
    their likeness, and its likeness to the next document.  Texts move compressed, and
    fingerprints are stored as bytes, to keep the disk of the shuffle small."""
    text = F.coalesce("text", F.lit(""))
    ordered = (docs.select("doc_id", F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("i"),
                           text.alias("text"))
               .mapInArrow(freed(_small), "doc_id long, h long, i long, z binary")
               .repartitionByRange("doc_id", "h", "i").sortWithinPartitions("doc_id", "h", "i")
               .select("doc_id", "z"))
    fields = [*_OUT, ("part", pa.int64()), ("head", pa.bool_()), ("text", pa.string())]
    none = (None,) * (len(_OUT) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        unpack = zstandard.ZstdDecompressor()
        last, first, pairs, size = None, True, [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                for d, z in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    t = unpack.decompress(z).decode()
                    if first:
                        yield _batch([(None, *none, part, True, t)], fields)
                        first = False
                    else:
                        pairs.append((*last, t))
                        size += len(t)
                    last = (d, t)
                    if size >= _HELD:
                        yield _batch([(*r, None, None, None) for r in rows(pairs)], fields)
                        pairs, size = [], 0
        if pairs:
            yield _batch([(*r, None, None, None) for r in rows(pairs)], fields)
        if last is not None:
            yield _batch([(last[0], *none, part, False, last[1])], fields)

    found = write_scratch(ordered.mapInArrow(freed(run), _KIND + ", part long, head boolean, text string"),
                          "fingerprints")
    heads = found.where("head").select(F.col("part").alias("p"), F.col("text").alias("after"))
    # one short row for each range: the next range that has rows, after the last the first
    order = Window.orderBy("p")
    follows = heads.select(F.col("p").alias("q"), F.coalesce(
        F.lead("p").over(order), F.first("p").over(order.rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing))).alias("to"))
    tails = found.where(~F.col("head"))
    met = (tails.join(follows, tails["part"] == follows["q"]).join(heads, F.col("to") == F.col("p"))
           .select("doc_id", "text", "after"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                yield _batch(rows([r]), _OUT)

    every = found.where(F.col("part").isNull()).select(*_COLUMNS).unionByName(
        met.mapInArrow(freed(finish), _KIND))
    return every.select(*[F.lower(F.hex(c)).alias(c) if c in _TEXTS else F.col(c) for c in _COLUMNS])
