"""Materialising intermediate results in the folder that all machines share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local folder in local mode, as in tests; an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_tidying, _lock = [], threading.Lock()


@contextmanager
def tidy(spark: SparkSession):
    """What runs inside drops its shuffle files as it ends; a stream started inside does so after each batch. For writes, whose shuffles nothing reads again."""
    with _lock:
        if not _tidying:
            tidy.before = spark.conf.get(_CLEANUP, None)
            spark.conf.set(_CLEANUP, "true")
        _tidying.append(spark)
    try:
        yield
    finally:
        with _lock:
            _tidying.pop()
            if not _tidying:
                spark.conf.unset(_CLEANUP) if tidy.before is None else spark.conf.set(_CLEANUP, tidy.before)


def write(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write `df` as dense Parquet."""
    with tidy(df.sparkSession):
        df.write.mode(mode).option("compression", "zstd").parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate rows that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def place(spark: SparkSession, what: str) -> str:
    """A new folder's name in the shared folder."""
    return f"{shared_dir(spark)}/tidewheel-{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back, which cuts its lineage."""
    path = place(df.sparkSession, what)
    write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, order: list[Column | str], first: int = 1) -> DataFrame:
    """Add `name`, the dense number of each row in a total order, without sorting in one task.

    Ranges are sorted apart; only one count per range reaches the driver.
    """
    mark = "__mark"
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(mark, F.monotonically_increasing_id())
    ranged = materialize(ranged, "numbered")
    part = F.shiftright(mark, 33)
    counts = {r.p: r.n for r in ranged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    offset, rows = first, []
    for p in sorted(counts):
        rows.append((p, offset))
        offset += counts[p]
    offsets = df.sparkSession.createDataFrame(rows, "p long, o long")
    local = F.col(mark).bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(F.broadcast(offsets), part == F.col("p"), "left").withColumn(name, F.col("o") + local).drop("p", "o", mark)
