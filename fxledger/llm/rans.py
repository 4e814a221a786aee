"""Token-id files by a static range asymmetric numeral system (rANS).

One table of frequencies, counted over all ids, serves every file.  A file is a
row of blocks of whole documents, neighbours in ascending order of the document
key; each block is coded on its own by up to ``LANES`` interleaved 64-bit states, so one
numpy operation steps all lanes, and any block can be decoded alone.  The index
at the end of a file holds a checkpoint for each block (its place, and the ids
before it in the file), and blocks, index and table carry checksums.

``write`` makes the files, ``read`` deals their blocks to tasks.

Null text is an empty document: only its end id.  Repeated rows stay separate
documents, next to one another.  Null ids come first.  An empty table gives no
files and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from fxledger.llm import files, tokens
from fxledger.llm.memory import freed
from fxledger.session import write_scratch

LANES = 1024
BLOCK_IDS = 1 << 18
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
MAGIC, TAIL = b"IDRANS01", b"IDRANSIX"
HEAD = "<8sII"            # magic, scale, table checksum
BLOCK = "<IIIII"          # ids, documents, words, lanes, checksum of the ids
ENTRY = "<QQQ"            # place, length, ids before it in the file
FOOT = "<QII8s"           # place of the index, entries, its checksum, magic

MANIFEST = "file string, bytes long, first_pos long, documents long, ids long"


@dataclass
class Table:
    """Frequencies that sum to 2**scale; ``slot`` gives the id of each slot."""

    scale: int
    freq: np.ndarray
    start: np.ndarray
    slot: np.ndarray
    checksum: int

    @classmethod
    def of(cls, counts: np.ndarray) -> "Table":
        """Scale counts so that every id that occurs keeps a frequency of one or more."""
        seen = np.flatnonzero(counts)
        scale = max(12, min(24, int(len(seen) * 16).bit_length()))
        size = 1 << scale
        freq = np.zeros(len(counts), dtype=np.int64)
        if len(seen):
            share = counts[seen].astype(np.float64) / counts[seen].sum()
            freq[seen] = 1 + np.floor(share * (size - len(seen))).astype(np.int64)
            freq[seen[np.argmax(counts[seen])]] += size - int(freq.sum())
        return cls.from_freq(scale, freq)

    @classmethod
    def from_freq(cls, scale: int, freq: np.ndarray) -> "Table":
        start = np.concatenate([[0], np.cumsum(freq)[:-1]])
        return cls(scale, freq.astype(np.uint64), start.astype(np.uint64),
                   np.repeat(np.arange(len(freq), dtype=np.uint32), freq),
                   zlib.crc32(freq.astype("<u4").tobytes()))

    def to_bytes(self) -> bytes:
        body = zlib.compress(self.freq.astype("<u4").tobytes())
        return struct.pack("<III", self.scale, len(self.freq), self.checksum) + body

    @classmethod
    def from_bytes(cls, raw: bytes) -> "Table":
        scale, n, checksum = struct.unpack_from("<III", raw)
        freq = np.frombuffer(zlib.decompress(raw[12:]), "<u4")
        if len(freq) != n or zlib.crc32(freq.tobytes()) != checksum:
            raise ValueError("damaged frequency table")
        return cls.from_freq(scale, freq.astype(np.int64))


def encode_block(ids: np.ndarray, table: Table, lanes: int = LANES) -> tuple[bytes, int, int]:
    """States and words of a block, the number of words and of lanes."""
    n = len(ids)
    lanes = min(lanes, n)
    freq, start = table.freq[ids], table.start[ids]
    shift = np.uint64(table.scale)
    limit = freq << np.uint64(63 - table.scale)
    state = np.full(lanes, LOW, dtype=np.uint64)
    out = []
    for at in range((n - 1) // lanes * lanes, -1, -lanes) if n else ():
        m = min(lanes, n - at)
        x, f = state[:m], freq[at:at + m]
        full = x >= limit[at:at + m]
        out.append(x[full].astype(np.uint32))
        x = np.where(full, x >> WORD, x)
        q = x // f
        state[:m] = (q << shift) + (x - q * f) + start[at:at + m]
    words = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
    return state.astype("<u8").tobytes() + words.astype("<u4").tobytes(), len(words), lanes


def decode_block(raw: bytes, n: int, lanes: int, table: Table) -> np.ndarray:
    state = np.frombuffer(raw, "<u8", lanes).copy()
    words = np.frombuffer(raw, "<u4", offset=8 * lanes).astype(np.uint64)
    ids = np.empty(n, dtype=np.uint32)
    mask, shift, pos = np.uint64((1 << table.scale) - 1), np.uint64(table.scale), 0
    for at in range(0, n, lanes) if n else ():
        m = min(lanes, n - at)
        x = state[:m]
        slot = x & mask
        sym = table.slot[slot]
        ids[at:at + m] = sym
        x = table.freq[sym] * (x >> shift) + slot - table.start[sym]
        low = np.flatnonzero(x < LOW)
        x[low] = (x[low] << WORD) | words[pos:pos + len(low)]
        pos += len(low)
        state[:m] = x
    if pos != len(words) or (state != LOW).any():
        raise ValueError("damaged block")
    return ids


COUNTS = 0  # the width of a row that holds counts


def _tokenise(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int) -> DataFrame:
    """doc_id, width (bytes of an id) and the ids of every document as a stored table,
    made where the texts are read.  Each task adds a row of width ``COUNTS``: how often
    it met each id."""

    def encoded(batches):
        total = np.zeros(vocabulary, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                ids = tokens.encode_column(b.column("text"), tokenizer, end_id)
                flat = np.frombuffer(b"".join(ids), "<u4")
                total += np.bincount(flat, minlength=vocabulary)
                width = 2 if flat.max(initial=0) < 65536 else 4
                size = np.array([len(x) // 4 for x in ids])
                ends = np.concatenate([[0], np.cumsum(size)]) * width
                raw = flat.astype(f"<u{width}").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(np.full(len(ids), width, np.int32)),
                     pa.array([raw[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.binary())],
                    ["doc_id", "width", "ids"])
        if total.any():
            packed = zstandard.ZstdCompressor(level=3).compress(total.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([None], pa.int64()), pa.array([COUNTS], pa.int32()), pa.array([packed], pa.binary())],
                ["doc_id", "width", "ids"])

    return write_scratch(docs.select("doc_id", "text").mapInArrow(
        freed(encoded), "doc_id long, width int, ids binary"), "token-ids")


def count(ids: DataFrame, vocabulary: int) -> np.ndarray:
    """Exact count of every id, from the rows that each task of ``_tokenise`` left."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        total = np.zeros(vocabulary, dtype=np.int64)
        for batch in batches:
            for z in batch.column("ids").to_pylist():
                total += np.frombuffer(unpack.decompress(z), "<i8")
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    rows = (ids.where(F.col("width") == COUNTS).select("ids").mapInArrow(freed(run), "id long, n long")
            .groupBy("id").agg(F.sum("n").alias("n")).toArrow())
    counts = np.zeros(vocabulary, dtype=np.int64)
    counts[rows.column("id").to_numpy()] = rows.column("n").to_numpy()
    return counts


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write ``table.freq`` and the files below ``path``; the stored manifest."""
    spark = docs.sparkSession
    vocabulary = max(tokens.encoder(tokenizer).vocabulary, end_id + 1)
    ids = _tokenise(docs, tokenizer, end_id, vocabulary)
    table = Table.of(count(ids, vocabulary))
    with files.create(f"{path}/table.freq") as f:
        f.write(table.to_bytes())
    shared = spark.sparkContext.broadcast(table)  # a fixed size: the vocabulary and 2**scale slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a file of blocks ends where the next document is not the neighbour
        table, out, size, index, name, last = shared.value, None, 0, [], "", None
        docs_, parts, held, total, n_docs, first = [], [], 0, 0, 0, None

        def flush() -> None:
            nonlocal size, held, total, n_docs
            x = np.concatenate(parts)
            body, words, lanes = encode_block(x, table)
            keys = zlib.compress(b"".join(struct.pack("<?qq", d is None, d or 0, n) for d, n in docs_))
            raw = (struct.pack(BLOCK, len(x), len(docs_), words, lanes, zlib.crc32(x.astype("<u4").tobytes()))
                   + struct.pack("<I", len(keys)) + keys + body)
            out.write(raw)
            index.append((size, len(raw), total))
            size, total, n_docs = size + len(raw), total + len(x), n_docs + len(docs_)
            docs_.clear()
            parts.clear()
            held = 0

        def finish() -> pa.RecordBatch:
            if parts:
                flush()
            raw = b"".join(struct.pack(ENTRY, *e) for e in index)
            out.write(raw + struct.pack(FOOT, size, len(index), zlib.crc32(raw), TAIL))
            out.close()
            return pa.RecordBatch.from_pydict({
                "file": [name], "bytes": [size + len(raw) + struct.calcsize(FOOT)], "first_pos": [first],
                "documents": [n_docs], "ids": [total]})

        for batch in batches:
            for pos, d, width, ids in zip(*(batch.column(c).to_pylist() for c in ("pos", "doc_id", "width", "ids")),
                                          strict=True):
                x = np.frombuffer(ids, f"<u{width}")
                if out is not None and pos != last + 1:
                    yield finish()
                    out = None
                if out is None:
                    name = f"{path}/{files.attempt_name('ids', '.rans')}"
                    first, total, n_docs, index, out = pos, 0, 0, [], files.create(name)
                    out.write(struct.pack(HEAD, MAGIC, table.scale, table.checksum))
                    size = struct.calcsize(HEAD)
                last = pos
                docs_.append((d, len(x)))
                parts.append(x)
                held += len(x)
                if held >= BLOCK_IDS:
                    flush()
        if out is not None:
            yield finish()

    # packed ids move once, to their range of keys, and are coded where they are sorted
    placed = (ids.where(F.col("width") != COUNTS).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
              .select(F.monotonically_increasing_id().alias("pos"), "doc_id", "width", "ids"))
    return write_scratch(placed.mapInArrow(freed(run), MANIFEST),
                         "rans-manifest")


def checkpoints(f, size: int) -> list[tuple[int, int, int]]:
    """(place, length, ids before) of each block of an open file."""
    at, n, checksum, magic = struct.unpack(FOOT, f.read_at(struct.calcsize(FOOT), size - struct.calcsize(FOOT)))
    raw = f.read_at(struct.calcsize(ENTRY) * n, at)
    if magic != TAIL or zlib.crc32(raw) != checksum:
        raise ValueError("damaged index")
    return [struct.unpack_from(ENTRY, raw, i * struct.calcsize(ENTRY)) for i in range(n)]


def read(manifest: DataFrame, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids."""
    spark = manifest.sparkSession
    with files.open_random(f"{path}/table.freq") as f:
        shared = spark.sparkContext.broadcast(Table.from_bytes(f.read()))
    # one short row for each file: the ids before it, in the order of the documents
    before = Window.orderBy("first_pos").rowsBetween(Window.unboundedPreceding, -1)
    listed = manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0).cast("long")))

    def blocks(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with files.open_random(row["file"]) as f:
                    found = checkpoints(f, row["bytes"])
                yield pa.RecordBatch.from_pydict({
                    "file": [row["file"]] * len(found), "place": [e[0] for e in found],
                    "length": [e[1] for e in found], "base": [row["base"] + e[2] for e in found]})

    def run(batches):
        table = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                with files.open_random(row["file"]) as f:
                    _, scale, checksum = struct.unpack(HEAD, f.read_at(struct.calcsize(HEAD), 0))
                    if (scale, checksum) != (table.scale, table.checksum):
                        raise ValueError("the file was written with another table")
                    raw = f.read_at(row["length"], row["place"])
                n, docs_, words, lanes, checksum = struct.unpack_from(BLOCK, raw)
                keys_at = struct.calcsize(BLOCK) + 4
                keys_n, = struct.unpack_from("<I", raw, struct.calcsize(BLOCK))
                keys = list(struct.iter_unpack("<?qq", zlib.decompress(raw[keys_at:keys_at + keys_n])))
                ids = decode_block(raw[keys_at + keys_n:], n, lanes, table).astype("<u4")
                if len(keys) != docs_ or zlib.crc32(ids.tobytes()) != checksum:
                    raise ValueError("damaged block")
                ends = np.cumsum([k[2] for k in keys])
                starts = ends - [k[2] for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None if k[0] else k[1] for k in keys], pa.int64()),
                     pa.array(row["base"] + starts, pa.int64()),
                     pa.array([k[2] for k in keys], pa.int64()),
                     pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)],
                              pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    tasks = max(spark.sparkContext.defaultParallelism,
                int(spark.conf.get("spark.sql.shuffle.partitions")))
    return (listed.select("file", "bytes", "base").repartition(tasks)
            .mapInArrow(freed(blocks), "file string, place long, length long, base long")
            .repartition(tasks)
            .mapInArrow(freed(run), "doc_id long, start long, n_tokens long, ids binary"))
