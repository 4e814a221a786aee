"""WARC archives: a writer with revisit records and a splittable reader.

Every record is one gzip member.  Of pages with equal payloads of at least
``MIN_DUPLICATE`` bytes the one with the smallest page_id becomes a
``response`` record, the others ``revisit`` records without the payload.

The reader deals byte ranges of the archives to tasks.  A task looks for the
gzip magic in its range and validates each candidate: the member must inflate
to a WARC header block, and pass the member's checksum, and end where the next
member or the end of the file is.  A record belongs to the task in whose range
it starts, and that task reads past the end of the range to finish it, so a
range may begin anywhere.  The manifest keeps where the records start, and a
task that finds another number of records in its range fails.

Null html is an empty payload.  A null url becomes ``urn:x-page:none``.  Pages
repeated with the same page_id and payload are all responses, if that page_id
is the smallest of the payload.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from fxledger.llm import files
from fxledger.llm.memory import freed
from fxledger.session import write_scratch

MIN_DUPLICATE = 100
FILE_BYTES = 1 << 30   # a longer archive is closed, and the task goes on in a new one
SPLIT_BYTES = 4 << 20
READ_BYTES = 1 << 20
MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "file string, bytes long, records long, starts array<long>"
RECORD = ("page_id long, url string, record_type string, payload_bytes long, "
          "payload_digest string, refers_to long, payload binary")


def classify(pages: DataFrame, min_duplicate: int = MIN_DUPLICATE) -> DataFrame:
    """page_id, url, payload, digest and ``refers_to`` (null for responses).

    Only short rows are aggregated; the payloads move once, in a join on the
    digest that adaptive execution may split where a digest is frequent.
    """
    body = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    p = pages.select("page_id", "url", body.alias("payload"), F.sha2(body, 256).alias("digest"))
    first = (p.where(F.length("payload") >= min_duplicate)
             .groupBy("digest").agg(F.min("page_id").alias("first_id"),
                                    F.count(F.lit(1)).alias("copies"))
             .where("copies > 1").drop("copies").withColumnRenamed("digest", "first_digest"))
    return (p.join(first, (F.col("digest") == F.col("first_digest")), "left")
            .withColumn("refers_to", F.when(F.col("page_id") != F.col("first_id"), F.col("first_id")))
            .drop("first_id", "first_digest"))


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str,
           refers_to: int | None) -> bytes:
    """One record, not compressed."""
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + (payload if refers_to is None else b"")
    target = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else "urn:x-page:none"
    head = [f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {_urn(page_id)}\r\n"
            f"WARC-Date: {DATE}\r\nWARC-Target-URI: {target}\r\n"
            f"WARC-Payload-Digest: sha256:{digest}\r\nX-Payload-Length: {len(payload)}\r\n"
            "Content-Type: application/http; msgtype=response\r\n"]
    if refers_to is not None:
        head.append(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: {_urn(refers_to)}\r\n")
    head.append(f"Content-Length: {len(block)}\r\n\r\n")
    return "".join(head).encode() + block + b"\r\n\r\n"


def _member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write(pages: DataFrame, path: str, level: int = 6,
          min_duplicate: int = MIN_DUPLICATE) -> DataFrame:
    """Write the archives below ``path`` and return the manifest table.  A task
    writes one file, record by record.  The manifest is stored, so that no
    later step can make the archives be written again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, starts, name = None, 0, array("q"), ""

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({
                "file": [name], "bytes": [size], "records": [len(starts)],
                "starts": pa.array([starts], pa.list_(pa.int64()))})

        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")]
            for i in range(batch.num_rows):
                if out is None:
                    name = f"{path}/{files.attempt_name('pages', '.warc.gz')}"
                    out, size, starts = files.create(name), 0, array("q")
                data = _member(record(*[c[i].as_py() for c in cols]), level)
                out.write(data)
                starts.append(size)
                size += len(data)
                if size >= FILE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    rows = classify(pages, min_duplicate).select("page_id", "url", "payload", "digest", "refers_to")
    return write_scratch(rows.mapInArrow(freed(run), MANIFEST), "warc-manifest")


def _window(f, size: int, at: int, n: int) -> bytes:
    return f.read_at(min(n, max(0, size - at)), at) if at < size else b""


def _inflate(f, size: int, at: int, limit: int | None = None) -> tuple[bytes, int] | None:
    """The content of the member at ``at`` and its end; with ``limit``, only the
    first bytes.  None if it is no sound member."""
    z, parts, got, pos = zlib.decompressobj(31), [], 0, at
    try:
        while not z.eof:
            chunk = _window(f, size, pos, READ_BYTES if limit is None else limit)
            if not chunk:
                return None
            pos += len(chunk)
            part = z.decompress(chunk) if limit is None else z.decompress(chunk, limit - got)
            parts.append(part)
            got += len(part)
            if limit is not None and got >= limit:
                break
    except zlib.error:
        return None
    return b"".join(parts), pos - len(z.unused_data)


def _valid(f, size: int, at: int) -> tuple[bytes, int] | None:
    """The whole record if a member with a WARC header starts at ``at``."""
    head = _inflate(f, size, at, 64)
    if head is None or not head[0].startswith(b"WARC/1."):
        return None
    whole = _inflate(f, size, at)
    if whole is None or b"\r\n\r\n" not in whole[0]:
        return None
    end = whole[1]
    return whole if end == size or _window(f, size, end, 3) == MAGIC else None


def records_in(path: str, size: int, start: int, end: int) -> Iterator[bytes]:
    """The records of ``path`` that start in [start, end)."""
    f = files.open_random(path)
    try:
        at = start
        while at < end:
            chunk = _window(f, size, at, min(READ_BYTES, end - at) + len(MAGIC) - 1)
            k = chunk.find(MAGIC)
            if k < 0:
                at += max(1, len(chunk) - len(MAGIC) + 1)
                continue
            found = _valid(f, size, at + k)
            if found is None:
                at += k + 1
                continue
            yield found[0]
            at = found[1]
    finally:
        f.close()


_FIELD = re.compile(rb"^([A-Za-z-]+): (.*?)\r?$", re.M)


def parse(raw: bytes) -> tuple:
    """(page_id, url, type, payload bytes, digest, refers_to, payload)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    h = {k.lower().decode(): v.decode() for k, v in _FIELD.findall(head)}
    block = rest[:int(h["content-length"])]
    payload = block.partition(b"\r\n\r\n")[2]

    def page(urn: str | None) -> int | None:
        x = (urn or "").strip("<>").rpartition(":")[2]
        return int(x) if x.lstrip("-").isdigit() else None

    if h["warc-type"] == "response":
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        if f"sha256:{digest}" != h["warc-payload-digest"]:
            raise ValueError(f"payload of {h['warc-record-id']} does not match its digest")
    else:
        size, digest, payload = int(h["x-payload-length"]), h["warc-payload-digest"][7:], None
    return (page(h["warc-record-id"]), h["warc-target-uri"], h["warc-type"], size, digest,
            page(h.get("warc-refers-to")), payload)


def read(manifest: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """The records of the archives that the manifest of ``write`` lists; fails if
    their number is not the manifest's."""
    sound = F.when(F.size("starts") == F.col("records"), F.col("starts")).otherwise(
        F.raise_error(F.concat(F.lit("the manifest does not hold a start for each record of "), "file")))
    # how many records start in each range, without the list of starts beside every range
    counts = (manifest.select(F.col("file").alias("of"), F.explode(sound).alias("at"))
              .groupBy("of", F.floor(F.col("at") / split_bytes).alias("number"))
              .agg(F.count(F.lit(1)).alias("records")))
    ranges = _ranges(manifest, split_bytes)
    known = ranges.join(counts, (F.col("file") == F.col("of"))
                        & (F.floor(F.col("start") / split_bytes) == F.col("number")), "left")
    return _read(known.select("file", "bytes", "start", F.coalesce("records", F.lit(0)).alias("records")),
                 split_bytes, payloads)


def read_archives(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES,
                  payloads: bool = True) -> DataFrame:
    """The records of gzip archives below a path that this module wrote, without their
    manifest (so without a check of their number)."""
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
              .option("pathGlobFilter", "*.warc.gz").load(path)
              .select(F.regexp_replace("path", "^file:/*", "/").alias("file"), F.col("length").alias("bytes")))
    return _read(_ranges(listed, split_bytes).withColumn("records", F.lit(None).cast("long")), split_bytes,
                 payloads)


def _ranges(files_: DataFrame, split_bytes: int) -> DataFrame:
    return files_.select("file", "bytes", F.explode(F.sequence(
        F.lit(0).cast("long"), F.greatest("bytes", F.lit(1)) - 1, F.lit(split_bytes).cast("long")))
        .alias("start"))


def _read(ranges: DataFrame, split_bytes: int, payloads: bool) -> DataFrame:
    # one short row for each range; dealt evenly, as ranges cost alike
    spark = ranges.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism,
                int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows, held, found = [], 0, 0
                for raw in records_in(row["file"], row["bytes"], row["start"],
                                      min(row["start"] + split_bytes, row["bytes"])):
                    rec = parse(raw)
                    found += 1
                    rows.append(rec if payloads else rec[:6] + (None,))
                    held += len(raw) if payloads else 200
                    if held > READ_BYTES:
                        yield _batch(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, schema)
                if row["records"] is not None and found != row["records"]:
                    raise ValueError(f"{found} records instead of {row['records']} start in "
                                     f"{row['file']} from {row['start']} on")

    return ranges.repartition(tasks).mapInArrow(freed(run), RECORD)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)],
        schema=schema)
