"""Streams agree with batches, ingest is idempotent, files are strict."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.operators import checks
from tidewheel.sources import files
from tidewheel.streaming import ledger as streams

EVENTS = "event_seq long, job_id string, event_type string, state string, state_version long, occurred_at long"


def rows(n):
    return [(i, f"j{i % 7}", "x", f"s{i % 5}", i // 7 + 1, i) for i in range(1, n + 1)]


def test_fold_stream_equals_batch(spark, tmp_path):
    for part in range(3):
        spark.createDataFrame(rows(60)[part * 20 : part * 20 + 20], EVENTS).write.parquet(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    q = streams.fold(stream).writeStream.format("memory").queryName("folded").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = checks.fold_events(spark.createDataFrame(rows(60), EVENTS))
    assert sorted(map(tuple, spark.table("folded").collect())) == sorted(map(tuple, batch.collect()))


def test_ingest_takes_each_key_once(spark, tmp_path):
    schema = "trigger string, stream string, message_id string, digest string"
    path, inbox, cp = str(tmp_path / "out"), str(tmp_path / "in"), str(tmp_path / "cp")
    for part in ([("t", "s", "1", "a"), ("t", "s", "2", "b")], [("t", "s", "1", "a"), ("t", "s", "2", "other"), ("t", "s", "3", "c")]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(inbox, mode="append")
        streams.ingest(spark.readStream.schema(schema).parquet(inbox), path, cp).awaitTermination(120)
    got = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/accepted")
    assert sorted(r.message_id + r.digest for r in got.collect()) == ["1a", "2b", "3c"]
    bad = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/conflicts")
    assert [r.message_id for r in bad.collect()] == ["2"]


def test_tail_sees_every_event_once(spark, tmp_path):
    seen = []
    spark.createDataFrame(rows(10), EVENTS).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
    sink = lambda batch, _: seen.extend(r.event_seq for r in batch.collect())
    streams.tail(read(), sink, str(tmp_path / "c")).awaitTermination(120)
    spark.createDataFrame(rows(13)[10:], EVENTS).write.parquet(str(tmp_path / "in"), mode="append")
    streams.tail(read(), sink, str(tmp_path / "c")).awaitTermination(120)
    assert sorted(seen) == list(range(1, 14))


def test_leases_expire_by_event_time(spark, tmp_path):
    schema = "job_id string, kind string, at timestamp"
    parts = [[("a", "lease", 0), ("b", "lease", 0)], [("a", "heartbeat", 1), ("b", "complete", 1)], [("z", "lease", 60)], [("z", "heartbeat", 61)]]
    q_in = str(tmp_path / "in")
    for i, p in enumerate(parts):
        spark.createDataFrame(p, "job_id string, kind string, s long").select("job_id", "kind", F.timestamp_seconds("s").alias("at")).coalesce(1).write.parquet(q_in, mode="append")
        stream = spark.readStream.schema(schema).parquet(q_in).withWatermark("at", "0 seconds")
        q = streams.leases(stream).writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = spark.read.schema("job_id string, expired_ms long").parquet(str(tmp_path / "out"))
    assert [tuple(r) for r in got.collect()] == [("a", 3500)]


def test_sliding_windows(spark, tmp_path):
    spark.createDataFrame([("s", 60 * i, 10**9 if i else 9 * 10**9) for i in range(3)], "stage string, t long, ns long").select("stage", F.timestamp_seconds("t").alias("at"), "ns").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("stage string, at timestamp, ns long").parquet(str(tmp_path / "in"))
    q = streams.sliding(stream).writeStream.format("memory").queryName("slid").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    best = spark.table("slid").orderBy(F.desc("n"), "until").first()
    assert (best.good, best.n) == (2, 3)


def test_strict_json_lines(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    (tmp_path / "good").write_text('{"a":1,"b":"x"}\n\n{"a":2}\n')
    assert [tuple(r) for r in files.read_jsonl(spark, str(tmp_path / "good"), schema).collect()] == [(1, "x"), (2, None)]
    for bad in ('{"a":1,"c":2}', "{", '{"a":1} {"a":2}'):
        (tmp_path / "bad").write_text(bad + "\n")
        with pytest.raises(Exception):
            files.read_jsonl(spark, str(tmp_path / "bad"), schema).collect()


def test_checksums(spark, tmp_path):
    d = tmp_path / "d"
    d.mkdir()
    (d / "a").write_text("x")
    found = files.checksums(spark, str(d))
    row = found.first()
    assert row.sha256 == "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"
    want = spark.createDataFrame([(row.path, "0"), ("d/../e", "1")], "path string, sha256 string")
    assert {r.message for r in files.mismatches(found, want).collect()} == {"differs", "path escapes"}


def test_log_and_snapshot(spark, tmp_path):
    lines = spark.range(1, 101).select(F.col("id").alias("sequence"), F.format_string('{"n":%d}', "id").alias("line"))
    files.write_log(lines, str(tmp_path / "log"))
    parts = sorted((tmp_path / "log").glob("part-*"))
    assert [json.loads(x)["n"] for p in parts for x in p.read_text().splitlines()] == list(range(1, 101))
    files.save_snapshot({"t": lines}, str(tmp_path / "v1"))
    assert files.load_snapshot(spark, str(tmp_path / "v1"), ["t"], {"t": ["sequence"]})["t"].columns == ["sequence"]
