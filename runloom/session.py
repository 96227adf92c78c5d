"""What a session needs besides Spark's defaults."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


#: Rows that Python tasks get at once where the session has Spark's default: rows here can be long texts
BATCH_ROWS = "2000"
BATCH, DEFAULT_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
#: Their bytes, which long texts reach first
BATCH_BYTES = str(8 << 20)
BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Python workers reuse freed memory of their arrays up to so many bytes, where each would else come anew from the system
MEMORY = {"MALLOC_MMAP_THRESHOLD_": str(8 << 20), "MALLOC_TRIM_THRESHOLD_": str(32 << 20)}


def packed() -> str:
    """A zip of this package, for executors elsewhere."""
    folder = Path(ROOT) / "runloom"
    path = Path(tempfile.mkdtemp(prefix="runloom-")) / "runloom.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for f in sorted(folder.rglob("*.py")):
            out.write(f, f.relative_to(ROOT))
    return str(path)


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package where it isn't installed, and keeps their batches small.

    Workers of this machine find the folder that it lies in; to others Spark ships a zip, once a session.
    """
    if spark.conf.get(BATCH) == DEFAULT_BATCH:
        spark.conf.set(BATCH, BATCH_ROWS)
        spark.conf.set(BYTES, BATCH_BYTES)
    environment = spark.sparkContext.environment
    for name, value in MEMORY.items():
        environment.setdefault(name, value)
    have = environment.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (have, ROOT) if x)
        if not spark.sparkContext.master.startswith("local"):
            spark.sparkContext.addPyFile(packed())
    return spark


def shared(spark: SparkSession, kind: str) -> str:
    """A new place in the shared folder that spark.checkpoint.dir names.

    Only where that isn't set, as in tests on one machine, a temporary folder is taken.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-"))
    return f"{context.getCheckpointDir()}/{kind}-{uuid.uuid4().hex}"


#: Spark's setting under which the shuffle files of a query go when it has run, not when the driver happens to collect garbage
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """What is planned and run within leaves no shuffle files behind."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a checkpoint in the shared folder."""
    shared(df.sparkSession, "none")
    with freeing(df.sparkSession):
        return df.select("*").checkpoint()  # planned anew, within


def stash(df: DataFrame) -> DataFrame:
    """Cuts lineage as cut() does, with a Parquet table in the same folder: smaller for long rows of few distinct values."""
    path = shared(df.sparkSession, "table")
    with freeing(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


def discard(table: DataFrame) -> None:
    """Deletes the table of a stash() that nothing reads any more."""
    context = table.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(table.stashed_at)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
