"""Commands that insert rows, and evidence about whole runs."""

from pyspark.sql import functions as F

from tidewheel.functions import ledger as fn
from tidewheel.operators import evidence, transitions

S = 1_000_000_000


def test_leases_commit_together_or_not_at_all(spark):
    jobs = spark.createDataFrame([("a", "t", "q", 2, 0, 0, 1, "PENDING"), ("b", "t", "q", 2, 1, 1, 4, "PENDING")], "id string, tenant_id string, queue_name string, slot_cost long, attempt_no long, lease_generation long, state_version long, state string")
    grants = spark.createDataFrame([("a",), ("b",)], "job_id string")
    for cap, good in ((4, True), (3, False), (0, True)):
        tenants = spark.createDataFrame([("t", cap, 0)], "tenant_id string, max_slots long, active_slots long")
        rows = {r.job_id: r for r in transitions.acquire(grants, jobs, tenants, "w", "secret", 5, 100).collect()}
        assert {r.committed for r in rows.values()} == {good}
        assert (rows["b"].attempt_no, rows["b"].lease_generation, rows["b"].state_version, rows["b"].expires_at) == (2, 2, 5, 105)
        assert len({r.token_hash for r in rows.values()}) == 2


def test_actions_and_triggers_are_idempotent(spark):
    schema = "tenant_id string, action string, idempotency_key string, actor string, target_type string, target_id string, digest string"
    actions = spark.createDataFrame([("t", "cancel", "k1", "me", "job", "j", "d"), ("t", "cancel", "k2", "me", "job", "j", "d"), ("t", "cancel", "k3", "me", "job", "j", "x")], schema)
    known = spark.createDataFrame([("t", "cancel", "k2", "d"), ("t", "cancel", "k3", "d")], "tenant_id string, action string, idempotency_key string, digest string")
    rows = transitions.record_actions(actions, known, 5).collect()
    assert sorted(r.outcome for r in rows) == ["conflict", "recorded", "replayed"] and all(len(r.id) == 30 for r in rows)
    old = spark.createDataFrame([("a", "@daily"), ("b", "@daily")], "id string, schedule string")
    new = spark.createDataFrame([("a", "@daily", 1), ("b", "@hourly", 1), ("c", "@hourly", 1)], "id string, schedule string, next_fire_at long")
    assert {r.id: r.outcome for r in transitions.create_triggers(new, old).collect()} == {"a": "same", "b": "conflict", "c": "created"}


def test_workflows_are_taken_whole(spark):
    jobs = spark.createDataFrame([], "id string, tenant_id string, state string")
    tenants = spark.createDataFrame([("t", 3)], "tenant_id string, max_depth long")
    known = spark.createDataFrame([], "tenant_id string, submission_key string, request_digest string, job_id string")
    nodes = [(1, n) for n in "ab"] + [(2, n) for n in "cd"] + [(3, n) for n in "xy"] + [(4, "z")]
    edges = [(1, "b", "a"), (3, "x", "y"), (3, "y", "x")]
    df = spark.createDataFrame([(r, "t", f"k{r}", "d", n, f"j{n}", 0) for r, n in nodes], "request int, tenant_id string, submission_key string, digest string, node string, job_id string, available_at long")
    got = {(r.request, r.node): (r.outcome, r.ready_seq) for r in transitions.submit_workflows(df, spark.createDataFrame(edges, "request int, node string, parent string"), known, jobs, tenants, 4, 10).collect()}
    assert got[1, "a"] == ("accepted", 5) and got[1, "b"] == ("accepted", 0)
    assert got[2, "c"] == got[2, "d"] == ("rejected", 0)
    assert got[3, "x"] == got[3, "y"] == ("invalid", 0)


def test_saved_dag(spark):
    jobs = spark.createDataFrame([("a", "t"), ("b", "t"), ("o", "u")], "id string, tenant_id string")
    nodes = spark.createDataFrame([("a", "n1"), ("b", "n2"), ("o", "n3"), ("a", "n2")], "job_id string, node_key string")
    rows = transitions.save_dag(nodes, jobs, "t", "key").collect()
    assert len({r.dag_id for r in rows}) == 1 and rows[0].dag_id.startswith("dag-") and len(rows[0].dag_id) == 28
    assert {(r.job_id, r.node_key): r.message for r in rows} == {("a", "n1"): None, ("b", "n2"): "duplicate node", ("o", "n3"): "missing job", ("a", "n2"): "duplicate node"}


def test_submissions_of_a_run(spark):
    base = spark.createDataFrame([(i, f"j{i}") for i in range(5)], "index long, job_id string").withColumn("run_id", F.lit("r")).withColumn("seed", F.lit(7))
    key = fn.stable_key("bench", "b-", F.col("run_id"), F.col("seed"), F.col("index"))
    sent = base.withColumn("idempotency_key", key).withColumn("error", F.lit(None).cast("string")).withColumn("duplicate", F.lit(False)).withColumn("ambiguous_retry", F.lit(False)).withColumn("attempt_count", F.lit(1))
    drained = base.select("run_id", "job_id", F.lit("SUCCEEDED").alias("state"), F.lit(5).alias("terminal_at"))
    assert evidence.submissions(sent, drained, "r", "bench", "b-", 5).count() == 0
    bent = sent.withColumn("seed", F.when(F.col("index") == 2, 8).otherwise(F.col("seed"))).withColumn("attempt_count", F.when(F.col("index") == 3, 0).otherwise(1))
    rules = {r.rule for r in evidence.submissions(bent, drained.where("job_id <> 'j1'"), "r", "bench", "b-", 6).collect()}
    assert rules == {"unstable key", "no attempts", "submitted job not drained", "unexpected count"}


def test_environment_and_accounting(spark):
    runs = spark.createDataFrame([("r1", 5000, "wal"), ("r2", 4999, None)], "run string, jobs long, journal string")
    assert sorted((r.run, r.column) for r in evidence.environment(runs, "run", {"jobs": 5000, "journal": "wal"}).collect()) == [("r2", "jobs"), ("r2", "journal")]
    report = spark.createDataFrame([("a", 2), ("b", 0)], "check string, violations long")
    states = spark.createDataFrame([("SUCCEEDED", 5)], "state string, n long")
    assert tuple(evidence.report_accounting(report, ["b", "a"], 2, 2, False, states, 5).first()) == (True, True, True, True)
    assert tuple(evidence.report_accounting(report, ["a"], 3, 2, False, states, 4).first()) == (False, False, False, False)
    assert [r.side for r in evidence.differences(report, report.where("check = 'a'")).collect()] == ["stored"]


def test_a_rejected_request_takes_no_room(spark):
    jobs = spark.createDataFrame([("o", "t", "RUNNING")], "id string, tenant_id string, state string")
    tenants = spark.createDataFrame([("t", 4), ("free", 0)], "tenant_id string, max_depth long")
    known = spark.createDataFrame([], "tenant_id string, submission_key string, request_digest string, job_id string")
    rows = [(1, "t", 2), (2, "t", 9), (3, "t", 1), (4, "t", 1), (5, "free", 99)]
    requests = spark.createDataFrame([(i, t, f"k{i}", "d", f"n{i}", None, n) for i, t, n in rows], "request int, tenant_id string, submission_key string, digest string, job_id string, parent string, nodes int")
    got = {r.request: r.outcome for r in transitions.submit(requests, known, jobs, tenants, 0, 0).collect()}
    assert got == {1: "accepted", 2: "rejected", 3: "accepted", 4: "rejected", 5: "accepted"}
