"""Binary files written by tasks into the shared folder, and read back by byte range.

Each task attempt writes under a name of its own and reports it as a row; only
the rows of the attempts that Spark commits form the manifest, so a retried or
speculative attempt leaves at most an unlisted file, never a wrong result.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

from fxledger.session import scratch_path


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder (created by the writers)."""
    return scratch_path(spark, name)


def attempt_name(prefix: str, suffix: str) -> str:
    return f"{prefix}-{uuid.uuid4().hex}{suffix}"


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (file, hdfs, s3, gs) or of a plain local path."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def create(path: str):
    where, p = locate(path)
    where.create_dir(p.rpartition("/")[0], recursive=True)
    return where.open_output_stream(p, compression=None)


def open_random(path: str):
    where, p = locate(path)
    return where.open_input_file(p)


def remove(path: str) -> None:
    """Delete a folder and what is in it."""
    where, p = locate(path)
    where.delete_dir(p)
