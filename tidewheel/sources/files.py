"""Files as sources and sinks: strict JSON lines, ordered logs, checksums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.plans.storage import write


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """SRC6: rows of JSON lines with nothing but the schema's fields; blank lines are passed over, a bad line fails the read."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    names = F.array(*(F.lit(n) for n in schema.names))
    keys = F.json_object_keys("value")
    listed = F.from_json(F.concat(F.lit("["), F.col("value"), F.lit("]")), T.ArrayType(schema), {"mode": "FAILFAST"})  # two values on a line aren't a list of one
    good = raw.withColumn("rows", listed).withColumn("row", F.element_at("rows", 1)).withColumn("extra", F.array_except(keys, names))
    checked = good.withColumn("row", F.when(keys.isNull() | (F.size("rows") != 1) | (F.size("extra") > 0), F.raise_error(F.concat(F.lit("unexpected line: "), F.substring("value", 1, 200))).cast(schema)).otherwise(F.col("row")))
    return checked.select("row.*")


def write_log(lines: DataFrame, path: str) -> None:
    """SRC8, SNK1: lines (sequence, line) as text files whose names and contents follow the sequence: ranges are sorted apart."""
    lines.repartitionByRange("sequence").sortWithinPartitions("sequence").select("line").write.mode("overwrite").text(path)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """SNK2, SNK3: (path, sha256) of every file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def mismatches(found: DataFrame, expected: DataFrame) -> DataFrame:
    """SNK2: (path, message) where files and their recorded checksums differ; paths that leave the folder are refused."""
    both = found.withColumn("f", F.lit(True)).join(expected.withColumnRenamed("sha256", "want").withColumn("e", F.lit(True)), "path", "full_outer")
    escapes = F.col("path").rlike(r"(^|/)\.\.(/|$)")
    message = F.when(escapes, "path escapes").when(F.col("f").isNull(), "missing").when(F.col("e").isNull(), "unlisted").when(F.col("sha256") != F.col("want"), "differs")
    return both.select("path", message.alias("message")).where(F.col("message").isNotNull())


def save_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """SRC2, SRC3: an immutable version of several tables, one folder each."""
    for name, df in tables.items():
        write(df, f"{path}/{name}")


def load_snapshot(spark: SparkSession, path: str, names: list[str], columns: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """SRC2-SRC5: the tables of a version, narrowed to the named columns where given."""
    out = {}
    for n in names:
        df = spark.read.parquet(f"{path}/{n}")
        out[n] = df.select(*columns[n]) if columns and n in columns else df
    return out
