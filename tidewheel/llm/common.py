"""Helpers the operators share: session settings, shared folder, Arrow batch loops."""

from __future__ import annotations

import ctypes
import ctypes.util
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of one Arrow batch; texts can be long, so both are bounded.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches of this session, since one text may be megabytes long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share. Where none is set, a local one in local mode, as in tests; an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, what: str, codec: str = "snappy") -> DataFrame:
    """Cut the lineage: write `df` as Parquet into the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/tidewheel-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, what: str, *keys: str) -> DataFrame:
    """As `stored`, in buckets by `keys`, so that later joins on them don't shuffle it again. The table's name stays in the session's catalog."""
    spark = df.sparkSession
    name = f"tidewheel_{what}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    return spark.table(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")


def with_fields(schema: T.StructType, *added: T.StructField) -> T.StructType:
    """`schema` without columns that clash (ignoring case) with the added ones, then those."""
    names = {f.name.lower() for f in added}
    return T.StructType([*(f for f in schema.fields if f.name.lower() not in names), *added])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name, with underscores before it until no column of `df` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def groups(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of at most BATCH_ROWS texts of about `most` characters in all; a longer text stands alone, whole."""
    start = size = 0
    for i, x in enumerate(texts):
        n = len(x) if x else 0
        if size and size + n > most or i - start == BATCH_ROWS:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def release() -> None:
    """Give memory that a Python worker no longer uses back to its machine; workers outlive their tasks."""
    gc.collect()
    if libc := ctypes.util.find_library("c"):
        trim = getattr(ctypes.CDLL(libc), "malloc_trim", None)
        if trim:
            trim(0)


def tidy(run: Callable) -> Callable:
    """`run` over the batches of a task, which gives its memory back at the end."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return tidied


def map_texts(df: DataFrame, text: str, added: list[T.StructField], columns: Callable[[list], list], keep: list[str] | None = None, finish: Callable[[], None] | None = None) -> DataFrame:
    """Add columns made from the texts: `columns(texts)` gives one list or array per added field.

    Keeps the other columns (or those in `keep`), except those an added one replaces.
    `finish` is called at the end of a task, to give memory back.
    """
    base = df if keep is None else df.select(*{c: None for c in [*keep, text]})
    schema = with_fields(base.schema if keep is None else base.select(*keep).schema, *added)
    kept = [f.name for f in schema.fields[: len(schema.fields) - len(added)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        types = [out.field(f.name).type for f in added]
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for a, b in groups(texts):
                made = columns(texts[a:b])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(c).cast(out.field(c).type) for c in kept), *(x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(made, types, strict=True))], schema=out)
        if finish:
            finish()

    return base.mapInArrow(tidy(run), schema)


def ascii_lower(column):
    """Lower-case A-Z alone, as the contracts ask; other letters stay."""
    return F.translate(column, UPPER, UPPER.lower())
