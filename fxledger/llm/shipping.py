"""Give the executors this package, wherever the driver was started."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import fxledger

#: Rows of a batch that crosses to Python: texts are long, and an executor holds a
#: batch of every task on both sides.  Only Spark's default is replaced.
BATCH_ROWS = "2000"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's modules with the application, once for each, and set the
    size of its batches."""
    sc = spark.sparkContext
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, BATCH_ROWS)
    if sc.applicationId not in _sent:
        root = os.path.dirname(os.path.abspath(fxledger.__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="fxledger-"), "fxledger.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        sc.addPyFile(path)
        _sent.add(sc.applicationId)
    return spark
