"""Spark jobs for document corpora: see README.md."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Shuffle files go when the statement that wrote them ends, not when the driver happens to collect its garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Python workers get batches of 16 MB at most, however many rows that is.
BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors' Python workers, once per application. Sessions that don't say otherwise drop
    shuffle files early, so a loop or a row of steps holds those of one statement."""
    if CLEAN not in spark.conf.getAll:
        spark.conf.set(CLEAN, "true")
    if BYTES not in spark.conf.getAll:
        spark.conf.set(BYTES, str(2**24))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).parent
    name = Path(tempfile.mkdtemp(prefix="spark-")) / "quarry_jobs.zip"
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    context.addPyFile(str(name))
    _shipped.add(context.applicationId)
