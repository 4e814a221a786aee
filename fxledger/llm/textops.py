"""Vectorised byte and word kernels shared by the operators.

The kernels work on slabs of a few megabytes of concatenated UTF-8 texts, so
the memory of a task is bounded by its largest single text, and there is no
Python loop over words.  Equality of words, lines and windows is decided on
64-bit hashes of their bytes; operators that need more verify afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from fxledger.llm.memory import freed

SLAB_BYTES = 1 << 20
U64 = np.uint64
#: Bytes 0x09-0x0D and 0x20 separate words.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_MULT = np.random.default_rng(20240301).integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)


def table_of(chars: bytes) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(chars)] = True
    return t


IS_SPACE = table_of(SPACES)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), so that sums of hashes stay well spread."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            m = max(n, SLAB_BYTES + (1 << 16))
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
                x = np.full(m, base, dtype=np.uint64)
                x[0] = 1
                with np.errstate(over="ignore"):
                    setattr(cls, name, np.multiply.accumulate(x))
        return cls.up, cls.down


class Prefix:
    """Prefix sums over bytes, or over 64-bit hashes of longer items; ``of(a, b)``
    hashes the ranges [a, b)."""

    def __init__(self, items: np.ndarray):
        n = len(items)
        up, self.down = _Powers.of(n + 1)
        self.sum = np.zeros(n + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((_BYTE[items] if items.dtype == np.uint8 else items) * up[:n],
                      out=self.sum[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sum[b] - self.sum[a]) * self.down[a]
                       + (b - a).astype(np.uint64) * U64(_BASE))


def slabs(column: pa.Array, limit: int = SLAB_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a text column into (first row, end row, bytes, offsets) of about
    ``limit`` bytes; one longer text makes a slab of its own.  Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, b, data[off[a]:off[b]], off[a:b + 1] - off[a]
        a = b


def words(buf: np.ndarray, off: np.ndarray, sep: np.ndarray = IS_SPACE):
    """Starts, ends (byte positions) and document index of every word."""
    inside = ~sep[buf]
    first, last = inside.copy(), inside.copy()
    if len(buf):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        full = off[1:] > off[:-1]
        heads, tails = off[:-1][full], off[1:][full] - 1
        first[heads] = inside[heads]
        last[tails] = inside[tails]
    a = np.flatnonzero(first)
    return a, np.flatnonzero(last) + 1, np.searchsorted(off, a, "right") - 1


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the windows of ``k`` consecutive items (all, across documents)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out += h[j:n + j] * _MULT[j]
    return mix(out)


def within(doc: np.ndarray, k: int) -> np.ndarray:
    """Which windows of ``k`` items lie in one document."""
    n = len(doc) - k + 1
    return doc[:n] == doc[k - 1:] if n > 0 else np.zeros(0, dtype=bool)


def cover(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of ``n`` items lie in a window [s, s + k)."""
    d = np.zeros(n + 1, dtype=np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + k, n), -1)
    return np.cumsum(d[:n]) > 0


def per_doc(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the ranges that ``off`` bounds."""
    s = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=s[1:])
    return s[off[1:]] - s[off[:-1]]


def salt(doc: np.ndarray) -> np.ndarray:
    """A hash of the document index, to keep the documents of a slab apart."""
    return mix(doc.astype(np.uint64) * U64(_BASE) + U64(1))


def rowwise(docs: DataFrame, fn: Callable[[pa.Array], list], fields: str,
            column: str = "text") -> DataFrame:
    """``docs`` as a struct column ``doc`` beside a struct column ``out`` that
    ``fn`` computes from the text column, batch by batch.  Keeping the input in
    a struct means extra columns can never clash with the computed ones.  All columns
    of ``docs`` cross to Python: a caller that needs few selects them first."""
    out = T._parse_datatype_string(fields) if isinstance(fields, str) else fields
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    schema = T.StructType([source.schema["doc"], T.StructField("out", out)])
    names = out.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.StructArray.from_arrays(
                        [pa.array(x) if isinstance(x, np.ndarray) else x
                         for x in fn(part.column(0).field(column))], names)], ["doc", "out"])

    return source.mapInArrow(freed(run), schema)


def cut_spans(found: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``doc`` with ``out.bytes`` (ascending byte ranges) cut from the
    text.  A cut between two words leaves the white space of one side."""
    schema = found.select("doc.*").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, out = batch.column(0), batch.column(1)
            cols = dict(zip([f.name for f in doc.type], doc.flatten(), strict=True))
            spans = out.field("bytes").to_pylist()
            text = cols["text"].to_pylist()
            for i, ranges in enumerate(spans):
                if ranges and text[i] is not None:
                    text[i] = without(text[i].encode(), [(r["a"], r["b"]) for r in ranges]).decode()
            cols["text"] = pa.array(text, pa.string())
            if "n_chars" in cols:
                cols["n_chars"] = pa.array(
                    [len(t) if r and t is not None else n for t, r, n in
                     zip(text, spans, cols["n_chars"].to_pylist(), strict=True)], cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays([cols[c] for c in columns], columns)

    return found.mapInArrow(freed(run), schema)


def without(raw: bytes, ranges: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in ranges:
        out.append(raw[at:a])
        at = b
        while at < len(raw) and raw[at:at + 1] in (b" ", b"\n", b"\t") and (not a or out[-1][-1:].isspace()):
            at += 1
    return b"".join([*out, raw[at:]])
