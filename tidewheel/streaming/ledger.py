"""Structured Streaming over ledger events: fold, tail, idempotent ingest, sliding service levels, leases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLD = "job_id string, state string, state_version long, last_seq long"


def fold(events: DataFrame) -> DataFrame:
    """STR4 as a stream: state and version of each job after its last event so far (complete or update mode)."""
    return events.groupBy("job_id").agg(F.max_by("state", "event_seq").alias("state"), F.max_by("state_version", "event_seq").alias("state_version"), F.max("event_seq").alias("last_seq"))


def tail(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **options):
    """STR5, TK6: every event once to `sink(batch, id)`; the checkpoint is the cursor."""
    return events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).options(**options).start()


def ingest(deliveries: DataFrame, path: str, checkpoint: str):
    """STR1, STR10, SRC9: deliveries (trigger, stream, message_id, digest, and offset, their order) into `path`, each key once, as first delivered, whatever is delivered again.

    A batch writes its own folder, so a batch that is run again replaces what it wrote.
    Another digest under a known key goes to `path`/conflicts.
    """
    keys = ["trigger", "stream", "message_id"]

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        earliest = F.min_by("digest", "offset") if "offset" in batch.columns else F.min("digest")
        first = batch.groupBy(*keys).agg(earliest.alias("digest"), F.count_distinct("digest").alias("digests"))
        schema = batch.select(*keys, "digest").schema
        try:
            old = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/accepted").where(F.input_file_name().rlike(f"batch={number}/") == F.lit(False))
        except Exception as e:  # nothing was accepted before
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = spark.createDataFrame([], schema)
        known = old.withColumnRenamed("digest", "old")
        both = first.join(known, keys, "left").persist()
        both.where("old is null").select(*keys, "digest").write.mode("overwrite").parquet(f"{path}/accepted/batch={number}")
        both.where("digests > 1 or old <> digest").select(*keys, "digest").write.mode("overwrite").parquet(f"{path}/conflicts/batch={number}")
        both.unpersist()

    return deliveries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sliding(observations: DataFrame, limit_s: float = 5.0, minutes: int = 30, late: str = "10 minutes") -> DataFrame:
    """STR9: good, n and ratio per stage over sliding windows of `minutes`, by event time (`at`, a timestamp); rows later than `late` are dropped by the watermark, so route them aside before if they matter."""
    w = F.window("at", f"{minutes} minutes", "1 minute")
    out = observations.withWatermark("at", late).groupBy("stage", w).agg(F.count_if(F.col("ns") <= int(limit_s * 1e9)).alias("good"), F.count("*").alias("n"))
    return out.select("stage", F.col("window.end").alias("until"), "good", "n", F.try_divide("good", "n").alias("ratio"))


def leases(events: DataFrame, ttl_ms: int = 2500) -> DataFrame:
    """STR6: one row per lease that ran out: (job_id, expired_ms). `events` has job_id, kind (lease, heartbeat, complete), at (a timestamp, with a watermark in a stream).

    A lease is a session: each event extends it to its own time and the lease's, and it is
    over when the watermark passes its end. Sessions whose last event completed the job
    didn't run out.
    """
    session = F.session_window("at", f"{ttl_ms} milliseconds")
    own = events.groupBy("job_id", session).agg(F.max_by("kind", "at").alias("last"))
    return own.where(F.col("last") != "complete").select("job_id", F.unix_millis("session_window.end").alias("expired_ms"))


def backlog(query) -> dict[str, int]:
    """SRC11: rows that a finished or running stream has read, and batches, from its own progress."""
    progress = query.recentProgress
    return {"consumed": sum(p["numInputRows"] for p in progress), "batches": len([p for p in progress if p["numInputRows"]])}


def first_response(requests: DataFrame) -> DataFrame:
    """STR2 as a stream: per (tenant_id, submission_key) the first digest and whether another came (update mode)."""
    return requests.groupBy("tenant_id", "submission_key").agg(F.min_by("digest", "seq").alias("digest"), (F.min("digest") != F.max("digest")).alias("conflict"))
