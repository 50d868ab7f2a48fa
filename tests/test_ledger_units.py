"""Golden values and small cases of the ledger's operators."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidewheel.functions import ledger as fn
from tidewheel.operators import checks, evidence, graph, reads, scheduling, slo, timing, transitions
from tidewheel.plans.storage import numbered
from tidewheel.streaming import cron

S = 1_000_000_000
JOB = "0123456789abcdef0123456789abcdef"
DIGEST = "a" * 64


def queue(name, weight, *jobs, deficit=0):
    return {"tenant_id": "t", "name": name, "weight": weight, "deficit": deficit, "candidates": [dict(zip(("job_id", "priority", "ready_seq", "slot_cost", "recovery"), j, strict=True), tenant_id="t", queue=name) for j in jobs]}


def snapshot(slots, batch, *queues, cursor=0):
    return {"sequence": 1, "worker_slots": slots, "batch_limit": batch, "cursor": cursor, "queues": list(queues), "algorithm": "drr-v1"}


def granted(d):
    return [g["job_id"] for g in d["grants"]]


def test_order_within_queue():
    d = scheduling.decide(snapshot(3, 3, queue("q", 3, ("later", 1, 2, 1, False), ("high", 2, 3, 1, False), ("first", 1, 1, 1, False))))
    assert granted(d) == ["high", "first", "later"]


def test_queues_take_turns():
    d = scheduling.decide(snapshot(2, 2, queue("a", 1, ("a1", 0, 1, 1, False), ("a2", 0, 2, 1, False)), queue("b", 1, ("b1", 0, 1, 1, False), ("b2", 0, 2, 1, False))))
    assert granted(d) == ["a1", "b1"]


def test_deficit_carries_over():
    first = scheduling.decide(snapshot(4, 1, queue("q", 1, ("head", 0, 1, 2, False))))
    assert granted(first) == []
    again = scheduling.decide(snapshot(4, 1, queue("q", 1, ("head", 0, 1, 2, False), deficit=first["queues"][0]["deficit"])))
    assert granted(again) == ["head"]


def test_recovered_before_priority():
    d = scheduling.decide(snapshot(1, 1, queue("q", 1, ("normal", 100, 1, 1, False), ("recovered", -100, 2, 1, True))))
    assert granted(d) == ["recovered"]


def test_empty_decision_resets_cursor():
    assert scheduling.decide(snapshot(0, 1, queue("q", 1), cursor=5))["next_cursor"] == 0


@pytest.mark.parametrize("bad", [snapshot(-1, 1), snapshot(1, -1), {**snapshot(1, 1), "algorithm": "other"}])
def test_invalid_snapshot(bad):
    with pytest.raises(ValueError):
        scheduling.decide(bad)


def test_replay_digest(spark):
    lines = scheduling.decisions(scheduling.synthetic(spark, 50_000))
    assert scheduling.digest(lines) == "06ea0a236743ed4a9782879f9fff78242fd6e29da24ed78cc9c90e46a6376bdf"


def test_divergence_is_found(spark):
    log = scheduling.synthetic(spark, 20).join(scheduling.decisions(scheduling.synthetic(spark, 20)).select("sequence", "line"), "sequence")
    bent = log.withColumn("line", F.when(F.col("sequence").isin(7, 9), F.lit("{}")).otherwise(F.col("line")))
    assert scheduling.divergences(log).count() == 0
    assert [r.sequence for r in scheduling.divergences(bent).collect()] == [7]


def test_canonical_json_escapes():
    assert scheduling.canonical({"a": "<b> & é "}) == '{"a":"\\u003cb\\u003e \\u0026 é\\u2028"}'


def test_chain(spark):
    import hashlib

    rows, previous = [], ""
    for i in range(1, 6):
        material = f'{{"n":{i},"p":"{previous}"}}'
        own = hashlib.sha256(material.encode()).hexdigest()
        rows.append((1, i, previous, own, material))
        previous = own
    schema = "schema_version int, sequence long, previous_hash string, hash string, material string"
    good = spark.createDataFrame(rows, schema)
    assert scheduling.chain_faults(good).count() == 0
    bent = good.withColumn("material", F.when(F.col("sequence") == 3, "x").otherwise(F.col("material")))
    assert [(r.sequence, r.message) for r in scheduling.chain_faults(bent).collect()] == [(3, "hash differs")]
    assert ("sequence not contiguous",) in [(r.message,) for r in scheduling.chain_faults(good.where("sequence <> 2")).collect()]


def test_record_append():
    d = scheduling.decide(snapshot(1, 1, queue("q", 1, ("j", 0, 1, 1, False))))
    full = {**snapshot(1, 1, queue("q", 1, ("j", 0, 1, 1, False))), "logical_time_ns": 5, "config_hash": ""}
    r = scheduling.append("", full, d)
    assert r["hash"] == scheduling.record_hash("", 1, full, d) and len(r["hash"]) == 64
    assert scheduling.append(r["hash"], full, d)["hash"] != r["hash"]


def test_retry_delay(spark):
    rows = spark.range(1, 6).select(fn.retry_delay_ns(F.lit("job-123"), F.col("id")).alias("d")).collect()
    assert [r.d for r in rows] == [1906600000, 3672800000, 6839200000, 12979200000, 15635200000]


def test_keys(spark):
    r = spark.range(1).select(fn.cron_key(F.lit("trigger"), fn.rfc3339_nano(F.lit(1767362400 * S))).alias("c"), fn.rfc3339_nano(F.lit(1767362400 * S + 120_000_000)).alias("t")).first()
    assert r.c == "cron:5d9a4cd28e2a4be805cb8c68e5c4c36506681f20a2c3febb770155d708a28542"
    assert r.t == "2026-01-02T14:00:00.12Z"


def test_cron():
    at = lambda *x: datetime(*x, tzinfo=timezone.utc)
    assert cron.next_time("CRON_TZ=America/New_York 0 9 * * *", at(2026, 1, 2, 13)) == at(2026, 1, 2, 14)
    assert cron.next_time("*/15 * * * *", at(2026, 1, 1, 0, 15)) == at(2026, 1, 1, 0, 30)
    assert cron.next_time("@monthly", at(2026, 1, 31)) == at(2026, 2, 1)
    assert cron.next_time("0 0 13 * fri", at(2026, 1, 1)) == at(2026, 1, 2)  # either day field
    with pytest.raises(ValueError):
        cron.next_time("61 * * * *", at(2026, 1, 1))


def test_due_triggers_fire_once(spark):
    t = spark.createDataFrame([("a", "@hourly", 0), ("b", "@hourly", 10**18)], "id string, schedule string, next_fire_at long")
    rows = cron.due(t, 3 * 3600 * S + 5, 10).collect()
    assert [(r.id, r.nominal_at, r.next) for r in rows] == [("a", 0, 4 * 3600 * S)]


def test_percentiles(spark):
    df = spark.range(1, 101).select(F.col("id").alias("ms"))
    r = timing.nearest_rank(df, "ms", [50, 95, 99, 100]).first()
    assert (r.p50, r.p95, r.p99, r.p100) == (50, 95, 99, 100)
    assert timing.nearest_rank(df.where("false"), "ms", [50]).first().p50 is None


@pytest.mark.parametrize("values,want", [([30, 10, 20], 20), ([4, 1, 3, 2], 2.5), ([1.0, float("nan")], None)])
def test_median(spark, values, want):
    assert timing.median(spark.createDataFrame([(float(v),) for v in values], "v double"), "v").first().median == want


def test_rate(spark):
    df = spark.range(500).select((F.col("id") * 30 * S / 499).cast("long").alias("t"))
    assert round(timing.rate_per_minute(df, "t").first().per_minute) == 1000
    assert timing.rate_per_minute(df.limit(1), "t").first().per_minute is None


def test_lexical_order_and_cycles(spark):
    nodes = spark.createDataFrame([("d", n) for n in ("deploy", "test", "build", "docs")] + [("c", "x"), ("c", "y"), ("c", "z")], "dag_id string, id string")
    edges = spark.createDataFrame([("d", "deploy", "build"), ("d", "deploy", "test"), ("d", "test", "build"), ("c", "x", "y"), ("c", "y", "x")], "dag_id string, id string, parent string")
    rows = graph.lexical_order(nodes, edges).orderBy("position").collect()
    assert [r.id for r in rows if r.dag_id == "d"] == ["build", "docs", "test", "deploy"]
    assert not [r for r in rows if r.dag_id == "c"]
    level = {(r.dag_id, r.id): r.level for r in graph.levels(nodes, edges).collect()}
    assert level["d", "deploy"] == 2 and level["c", "x"] is None and level["c", "z"] == 0


def test_descendants_of_a_diamond(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "d")], "job_id string, depends_on_id string")
    start = spark.createDataFrame([("a",)], "id string")
    assert sorted(r.id for r in graph.descendants(edges, start).collect()) == ["b", "c", "d", "e"]
    assert sorted(r.id for r in graph.descendants(edges, start, spark.createDataFrame([("b",), ("e",)], "id string")).collect()) == ["b"]
    assert graph.descendants(edges, start.where("false")).count() == 0


def test_chains_beyond_a_thousand(spark):
    n = 1500
    nodes = spark.range(n).select(F.lit("d").alias("dag_id"), F.format_string("n%05d", "id").alias("id"))
    edges = spark.range(1, n).select(F.lit("d").alias("dag_id"), F.format_string("n%05d", "id").alias("id"), F.format_string("n%05d", F.col("id") - 1).alias("parent"))
    want = [(f"n{i:05}", i) for i in range(n)]
    assert [(r.id, r.level) for r in graph.levels(nodes, edges).orderBy("id").collect()] == want
    assert [(r.id, r.position - 1) for r in graph.lexical_order(nodes, edges).orderBy("id").collect()] == want
    below = graph.descendants(edges.select(F.col("id").alias("job_id"), F.col("parent").alias("depends_on_id")), spark.createDataFrame([("n00002",), ("n00900",)], "id string"))
    assert sorted(r.id for r in below.collect()) == [i for i, _ in want[3:]]


@pytest.mark.parametrize("seed", range(3))
def test_levels_and_descendants_against_brute_force(spark, seed):
    import random

    r = random.Random(seed)
    parents = {(d, i): {j for j in range(14) if r.random() < (0.08 if d else 0.05) and (d or j < i)} | ({i - 1} if i % 7 and r.random() < 0.8 else set()) for d in range(4) for i in range(14)}
    parents |= {(9, 0): {2}, (9, 1): {0}, (9, 2): {1}, (9, 3): set(), (9, 4): {4}}
    nodes = spark.createDataFrame([(str(d), f"{i:02}") for d, i in parents], "dag_id string, id string")
    edges = spark.createDataFrame([(str(d), f"{i:02}", f"{j:02}") for (d, i), ps in parents.items() for j in ps] + [("0", "00", "unknown")], "dag_id string, id string, parent string")
    level, moved = {}, True
    while moved:
        ready = {(d, i): 1 + max((level[d, j] for j in ps), default=-1) for (d, i), ps in parents.items() if (d, i) not in level and all((d, j) in level for j in ps)}
        level, moved = level | ready, bool(ready)
    assert {(int(x.dag_id), int(x.id)): x.level for x in graph.levels(nodes, edges).collect()} == {k: level.get(k) for k in parents}
    start = {(d, i) for d, i in parents if i % 6 == 0}
    for open_ in (set(parents), {k for k in parents if r.random() < 0.8}):
        below, todo = set(), list(start)
        while todo:
            d, j = todo.pop()
            new = {(d, i) for (e, i), ps in parents.items() if e == d and j in ps and (e, i) in open_} - below
            below, todo = below | new, todo + list(new)
        name = F.concat_ws("/", "dag_id", "id")
        ids = lambda keys: spark.createDataFrame([(f"{d}/{i:02}",) for d, i in keys], "id string")
        got = graph.descendants(edges.select(name.alias("job_id"), F.concat_ws("/", "dag_id", "parent").alias("depends_on_id")), ids(start), ids(open_))
        assert sorted(x.id for x in got.collect()) == sorted(f"{d}/{i:02}" for d, i in below)


def test_open_jobs_below_a_terminal_one_are_found(spark):
    jobs = spark.createDataFrame([("a", "DEAD_LETTER"), ("b", "FAILED"), ("c", "PENDING"), ("d", "SUCCEEDED")], "id string, state string")
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c")], "job_id string, depends_on_id string")
    assert [r.id for r in graph.open_descendants(jobs.where("id = 'a'").select("id"), jobs, edges).collect()] == ["c"]
    full = jobs.select("id", F.lit("t").alias("tenant_id"), "state", F.lit(0).alias("ready_seq"))
    assert ("dag", "open below a failed job") in found(checks.dependencies(edges, full, ledger(spark)[3]))


@pytest.mark.parametrize(
    "old,new,kind,good",
    [("RETRYING", "SCHEDULED", "x", True), ("RETRYING", "FAILED", "x", False), ("PENDING", "PENDING", "x", False), ("PENDING", "PENDING", "job_promoted", True), ("SUCCEEDED", "PENDING", "x", False), ("RUNNING", "RUNNING", "x", False), ("SCHEDULED", "RUNNING", "x", True)],
)
def test_moves_of_events(spark, old, new, kind, good):
    assert spark.range(1).select(checks.allowed(F.lit(old), F.lit(new), F.lit(kind)).alias("x")).first().x == good


def test_events_need_a_job(spark):
    jobs, _, _, events, _, _ = ledger(spark)
    assert ("event_log", "events without job") in found(checks.event_log(events, jobs.where("false")))


def test_counters(spark):
    jobs = spark.createDataFrame([("a", 3), ("b", 3), ("c", 0)], "id string, ready_seq long")
    of = lambda rows: {m for _, m in found(checks.counters(jobs, spark.createDataFrame(rows, "name string, value long")))}
    assert of([("ready_seq", 3)]) == {"ready sequence repeated"}
    assert of([]) == {"ready sequence repeated", "counter missing"}
    assert of([("ready_seq", 2), ("ready_seq", 1)]) == {"ready sequence repeated", "duplicate counter", "counter behind ready sequence"}


def test_lease_that_ends_in_the_uncertain_boundary_fails(spark):
    df = spark.createDataFrame([("FAILED", 0)], "state string, completed_at long")
    with pytest.raises(Exception, match="uncertain"):
        evidence.decided(df, -5, 5).collect()
    assert evidence.decided(df, 5, 9).first().affected is False


def test_grants_by_windows_equal_the_rounds(spark):
    """Where slots suffice, the windows give what turn by turn rounds do."""
    import random

    for seed in range(6):
        r = random.Random(seed)
        queues = [("t", f"q{i}", r.randint(1, 3)) for i in range(4)]
        rows = [(f"{q}-{k:02}", t, q, k + 1, r.randint(1, 4), w, 0) for t, q, w in queues for k in range(r.randint(0, 6))]
        df = spark.createDataFrame(rows, "id string, tenant_id string, queue_name string, rank long, slot_cost long, weight long, deficit long")
        own = [{"tenant_id": t, "name": q, "weight": w, "deficit": 0, "candidates": [{"job_id": i, "tenant_id": t, "queue": q, "priority": 0, "ready_seq": k, "slot_cost": c, "recovery": False} for i, _, n, k, c, *_ in rows if n == q]} for t, q, w in queues]
        own = [q for q in own if q["candidates"]]
        cursor = seed % max(1, len(own))
        want = scheduling.decide({"sequence": 1, "worker_slots": 1000, "batch_limit": 15, "cursor": cursor, "queues": own})["grants"]
        got = scheduling.grant_order(df, cursor, 15, 1000).orderBy("used").collect()
        assert [g.id for g in got] == [g["job_id"] for g in want]


@pytest.mark.parametrize("by", [None, ["g"]])
def test_ranks_of_groups_beyond_one_task(spark, monkeypatch, by):
    import random

    r = random.Random(3)
    rows = [(i % 2, int(r.paretovariate(0.7) * 10)) for i in range(4000)] + [(2, 5)] * 7
    df = spark.createDataFrame(rows, "g int, v long")
    want = sorted(map(tuple, timing.distribution(df, "v", by).collect()))
    monkeypatch.setattr(timing, "RANKED", 20)
    monkeypatch.setattr(timing, "PARTS", 8)
    assert sorted(map(tuple, timing.distribution(df, "v", by).collect())) == want


def test_json_fields_and_strings(spark):
    df = spark.createDataFrame([('{"a":1,"b":"x,y"}',), ("{}",)], "j string")
    assert [r[0] for r in df.select(fn.json_set(F.col("j"), "b", F.lit('"$z"'))).collect()] == ['{"a":1,"b":"$z"}', '{"b":"$z"}']
    assert df.limit(1).select(fn.json_text(F.lit('a"<\\\u2028'))).first()[0] == '"a\\"\\u003c\\\\\\u2028"'


def test_durations_of_schedules():
    assert [cron.duration(x) for x in ("1h30m", "90s", "1.5h", "10ms")] == [5400, 90, 5400, 1]
    with pytest.raises(ValueError):
        cron.duration("5 minutes")


def test_workflow_validation(spark):
    nodes = spark.createDataFrame([("w", "a"), ("w", "a"), ("w", " ")], "dag_id string, id string")
    edges = spark.createDataFrame([("w", "a", "q"), ("w", "a", "a"), ("w", "a", "q")], "dag_id string, id string, parent string")
    assert {r.message for r in graph.validate(nodes, edges).collect()} == {"blank key", "duplicate key", "unknown parent", "duplicate parent", "own parent"}


def test_parents_of_requests(spark):
    jobs = spark.createDataFrame([("p", "t1"), ("o", "t2")], "id string, tenant_id string")
    requests = spark.createDataFrame([(1, "t1", "p"), (2, "t1", "o"), (3, "t1", "gone"), (4, "t1", "p"), (4, "t1", "p")], "request int, tenant_id string, depends_on_id string")
    assert {(r.request, r.message) for r in graph.check_parents(requests, jobs).collect()} == {(2, "parent of another tenant"), (3, "missing parent"), (4, "duplicate parent")}


def test_affected_leases(spark):
    ms = 1_000_000
    rows = [("EXPIRED", 6 * ms), ("SUCCEEDED", -6 * ms), ("RUNNING", None), ("SUCCEEDED", 6 * ms), ("FAILED", 6 * ms), ("FAILED", 0)]
    df = spark.createDataFrame(rows, "state string, completed_at long")
    assert [r.affected for r in evidence.affected(df, -5 * ms, 5 * ms).collect()] == [True, False, True, False, True, None]


def test_recovery_sample(spark):
    kills = spark.createDataFrame([(1, "j", 1, 10 * S), (2, "k", 1, 0)], "kill_sequence long, job_id string, killed_generation long, killed_at long")
    attempts = spark.createDataFrame([("j", 1, 1, 5 * S), ("j", 2, 2, 12 * S), ("j", 3, 3, 50 * S)], "job_id string, attempt_no long, lease_generation long, leased_at long")
    got = {r.job_id: r.recovery_ms for r in evidence.recoveries(kills, attempts).collect()}
    assert got == {"j": 2000, "k": None}


def test_slo_alert_fires_and_clears(spark):
    rows = [("s", m, 98, 100) if m == 1 else ("s", m, 0, 0) for m in range(0, 40)]
    per_minute = spark.createDataFrame(rows, "stage string, minute long, good long, n long")
    grid = slo.sliding_ratio(per_minute).withColumnRenamed("stage", "series")
    firing = {r.minute: r.firing for r in slo.alerts(grid, (F.col("ratio") < 0.99) & (F.col("n") >= 20), 5).collect()}
    assert not firing[5] and firing[6] and not firing[32]


def test_depth_alert(spark):
    grid = spark.createDataFrame([("d", m, 10 if 1 <= m <= 21 else 0) for m in range(40)], "series string, minute long, depth int")
    firing = {r.minute: r.firing for r in slo.alerts(grid, F.col("depth") >= 10, 10).collect()}
    assert not firing[10] and firing[11] and not firing[32]


def test_counter_reset(spark):
    df = spark.createDataFrame([("c", 0, 5), ("c", 1, 8), ("c", 2, 2)], "series string, minute long, value long")
    assert [r.increase for r in slo.increase(df).orderBy("minute").collect()] == [0, 3, 5]


def test_histogram_quantile(spark):
    df = spark.createDataFrame([("s", 1.0, 50), ("s", 2.0, 100), ("s", float("inf"), 100)], "stage string, le double, n long")
    assert slo.histogram_quantile(df, 0.75).first().value == 1.5


def ledger(spark, done=True):
    jobs = spark.createDataFrame([(JOB, "chaos", "noop", 1, '{"type":"noop"}', '{"max_attempts":5}', "SUCCEEDED", 1, 4, 1, 0, 0, 1, 5, 5)], "id string, tenant_id string, queue_name string, slot_cost long, payload_json string, retry_json string, state string, attempt_no long, state_version long, lease_generation long, available_at long, ready_seq long, created_at long, updated_at long, terminal_at long")
    attempts = spark.createDataFrame([(JOB, 1, "w", 1, DIGEST, "SUCCEEDED", 2, 3, 6, 3, 5)], "job_id string, attempt_no long, worker_id string, lease_generation long, token_hash string, state string, leased_at long, heartbeat_at long, expires_at long, started_at long, completed_at long")
    completions = spark.createDataFrame([(JOB, "SUCCEEDED", 4, 1, DIGEST, 5)] if done else [], "job_id string, state string, state_version long, attempt_no long, output_digest string, committed_at long")
    events = spark.createDataFrame([(1, JOB, "job_admitted", "PENDING", 1, 1, "{}"), (2, JOB, "lease_acquired", "SCHEDULED", 2, 2, '{"attempt_no":1}'), (3, JOB, "attempt_started", "RUNNING", 3, 3, '{"attempt_no":1}'), (4, JOB, "job_completed", "SUCCEEDED", 4, 5, '{"attempt_no":1}')], "event_seq long, job_id string, event_type string, state string, state_version long, occurred_at long, payload_json string")
    accepted = spark.createDataFrame([(1, "submit-1", JOB, "chaos", 1)], "sequence long, submission_key string, job_id string, tenant_id string, accepted_at long")
    requests = spark.createDataFrame([("chaos", "submit-1", "job", DIGEST, JOB)], "tenant_id string, submission_key string, request_kind string, request_digest string, job_id string")
    return jobs, attempts, completions, events, accepted, requests


def found(df):
    return {(r.check, r.message) for r in df.collect()}


def test_clean_ledger_passes(spark):
    jobs, attempts, done, events, accepted, requests = ledger(spark)
    parts = [checks.manifest(accepted, 1), checks.ledger_jobs(accepted, jobs), checks.materialized(jobs), checks.completions(accepted, jobs, done), checks.idempotency(accepted, requests), checks.attempt_rows(attempts, jobs), checks.attempt_chain(attempts, jobs), checks.event_log(events, jobs)]
    assert found(checks.union(parts)) == set()
    assert checks.report(checks.union(parts)).where("not passed").count() == 0


def test_check_that_did_not_run_is_no_pass(spark):
    accepted = ledger(spark)[4]
    report = checks.report(checks.manifest(accepted, 1), ["manifest"])
    assert {r.check: (r.violations, r.passed) for r in report.collect()} == {c: (0, True) if c == "manifest" else (None, None) for c in checks.CHECKS}
    verdict = evidence.passes(report).first()
    assert not verdict.passed and verdict.reasons == ",".join(sorted(set(checks.CHECKS) - {"manifest"}))
    assert evidence.passes(checks.report(checks.manifest(accepted, 1), checks.CHECKS)).first().passed


def test_cycle_of_dependencies_is_found(spark):
    jobs = spark.createDataFrame([(i, "t", "SUCCEEDED", 0) for i in "abc"], "id string, tenant_id string, state string, ready_seq long")
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "job_id string, depends_on_id string")
    got = checks.dependencies(edges, jobs, ledger(spark)[3])
    assert sorted((r.job_id, r.message) for r in got.collect()) == [("a", "on or below a cycle"), ("b", "on or below a cycle")]


def test_lost_completion_is_found(spark):
    jobs, _, done, _, accepted, _ = ledger(spark, done=False)
    assert found(checks.completions(accepted, jobs, done)) == {("canonical_ledger", "no canonical completion"), ("canonical_ledger", "terminal job without completion")}


@pytest.mark.parametrize(
    "column,value,message",
    [("id", "'x'", "invalid id"), ("terminal_at", "cast(null as long)", "terminal time disagrees with state"), ("ready_seq", "1", "ready sequence outside PENDING"), ("slot_cost", "0", "invalid slot cost"), ("payload_json", "'{'", "invalid payload"), ("retry_json", "'{}'", "invalid retry policy"), ("updated_at", "0", "updated before created"), ("state_version", "0", "invalid counters")],
)
def test_job_rules(spark, column, value, message):
    assert ("materialized_jobs", message) in found(checks.materialized(ledger(spark)[0].withColumn(column, F.expr(value))))


@pytest.mark.parametrize("column,value,message", [("state_version", "9", "version not contiguous"), ("event_type", "'x'", "admission not first and once"), ("state", "'SUCCEEDED'", "move not allowed"), ("event_seq", "event_seq + 1", "sequence not contiguous"), ("payload_json", "'{'", "invalid payload or time")])
def test_event_rules(spark, column, value, message):
    jobs, _, _, events, _, _ = ledger(spark)
    assert ("event_log", message) in found(checks.event_log(events.withColumn(column, F.expr(value)), jobs))


@pytest.mark.parametrize("column,value,message", [("token_hash", "'x'", "invalid worker or token"), ("heartbeat_at", "9", "times out of order"), ("started_at", "1", "started before lease"), ("completed_at", "cast(null as long)", "completion time disagrees with state"), ("job_id", "'other'", "attempt without job")])
def test_attempt_rules(spark, column, value, message):
    jobs, attempts, *_ = ledger(spark)
    assert ("attempts_and_leases", message) in found(checks.attempt_rows(attempts.withColumn(column, F.expr(value)), jobs))


def test_schema_versions(spark):
    good = spark.createDataFrame([(1, DIGEST), (2, DIGEST)], "version long, checksum string")
    assert found(checks.schema_versions(good)) == set()
    assert ("schema_migrations", "no migrations") in found(checks.schema_versions(good.where("false")))
    assert ("schema_migrations", "versions not contiguous") in found(checks.schema_versions(good.where("version = 2")))


def test_timing_of_a_recovery(spark):
    jobs = spark.createDataFrame([("j", 0)], "id string, created_at long")
    attempts = spark.createDataFrame([("j", 1, "EXPIRED", 1 * S, 3 * S), ("j", 2, "LEASED", 5 * S, None)], "job_id string, attempt_no long, state string, leased_at long, completed_at long")
    events = spark.createDataFrame([(1, "j", "job_admitted", "PENDING", 0, "{}"), (2, "j", "lease_acquired", "SCHEDULED", S, '{"attempt_no":1}'), (3, "j", "lease_reaped", "PENDING", 3 * S, '{"attempt_no":1}'), (4, "j", "lease_acquired", "SCHEDULED", 5 * S, '{"attempt_no":2}')], "event_seq long, job_id string, event_type string, state string, occurred_at long, payload_json string")
    done = spark.createDataFrame([], "job_id string, committed_at long")
    r = timing.timing_events(events, jobs, attempts, done, after=3).first()
    assert r.lease_recovery == 2 * S and r.ready_to_lease == 2 * S


def test_submit_outcomes(spark):
    jobs = spark.createDataFrame([("ok", "t", "SUCCEEDED"), ("bad", "t", "FAILED"), ("open", "t", "RUNNING"), ("far", "u", "SUCCEEDED")], "id string, tenant_id string, state string")
    tenants = spark.createDataFrame([("t", 4)], "tenant_id string, max_depth long")
    known = spark.createDataFrame([("t", "k0", "d0", "old")], "tenant_id string, submission_key string, request_digest string, job_id string")
    rows = [(1, "k0", "d0", None), (2, "k0", "dX", None), (3, "k1", "d1", "ok"), (4, "k2", "d2", "bad"), (5, "k3", "d3", "far"), (6, "k1", "d1", "ok"), (7, "k4", "d4", "open"), (8, "k5", "d5", None)]
    requests = spark.createDataFrame([(i, "t", k, d, f"n{i}", p, 1) for i, k, d, p in rows], "request int, tenant_id string, submission_key string, digest string, job_id string, parent string, nodes int")
    got = {r.request: (r.outcome, r.state, r.ready_seq) for r in transitions.submit(requests, known, jobs, tenants, 10, 0).collect()}
    assert got == {1: ("replayed", None, 0), 2: ("conflict", None, 0), 3: ("accepted", "PENDING", 11), 4: ("accepted", "DEAD_LETTER", 0), 5: ("invalid", None, 0), 6: ("replayed", None, 0), 7: ("accepted", "PENDING", 0), 8: ("rejected", None, 0)}


def test_activation_waits_for_all_parents(spark):
    jobs = spark.createDataFrame([("p1", "SUCCEEDED", 0), ("p2", "RUNNING", 0), ("c1", "PENDING", 0), ("c2", "PENDING", 0)], "id string, state string, ready_seq long")
    edges = spark.createDataFrame([("c1", "p1"), ("c2", "p1"), ("c2", "p2")], "job_id string, depends_on_id string")
    rows = transitions.activate(spark.createDataFrame([("p1",)], "id string"), jobs, edges, 7).collect()
    assert [(r.id, r.ready_seq) for r in rows] == [("c1", 8)]


def test_clock_mapping(spark):
    r = spark.range(1).select(*fn.mapped_clock(F.lit(1000), F.lit(900), F.lit(911))).first()
    assert tuple(r) == (95, 6)


def test_numbered_is_dense(spark):
    df = spark.range(1000).select(F.xxhash64("id").alias("h"))
    rows = numbered(df, "n", ["h"]).orderBy("h").collect()
    assert [r.n for r in rows] == list(range(1, 1001))


def test_history_pages(spark):
    events = ledger(spark)[3]
    first = reads.history(events, JOB, 0, 3).collect()
    assert [r.event_seq for r in first] == [4, 3, 2] and {r.next_before for r in first} == {2}
    last = reads.history(events, JOB, 2, 3).collect()
    assert [r.event_seq for r in last] == [1] and last[0].next_before == 0


def test_suite_and_verdict(spark):
    runs = spark.createDataFrame([(0, True, 1.0, "c"), (1, False, 5.0, "c"), (2, False, 9.0, "c"), (3, False, 7.0, "c")], "run int, warmup boolean, per_minute double, config string")
    r = evidence.suite(runs).first()
    assert r.valid and r.median == 7.0
    assert not evidence.suite(runs.where("run <> 3")).first().valid
    parts = spark.createDataFrame([("a", True, True), ("b", True, False)], "part string, valid boolean, met boolean")
    assert evidence.verdict(parts).first().verdict == "miss"


def test_action_log_and_samples(spark):
    log = spark.createDataFrame([(1, 10, 5, 15, "kill", 1), (3, 10, 5, 16, "kill", 1)], "sequence long, observed_ns long, offset_ns long, calibrated_ns long, kind string, kill_sequence long")
    assert {r.message for r in evidence.action_log(log).collect()} == {"sequence not contiguous", "clock differs", "kill repeated"}
    s = spark.createDataFrame([(1, "a", 1, 2, 5, 9, 4), (2, "b", 2, 2, 5, 9, 4), (9, "z", 1, 2, 5, 9, 4)], "kill_sequence long, job_id string, killed_generation long, generation long, killed_at long, leased_at long, recovery_ms long")
    e = spark.createDataFrame([(1, "a", 4), (2, "b", 4), (3, "c", 4)], "kill_sequence long, job_id string, recovery_ms long")
    assert {(r.kill_sequence, r.message) for r in evidence.sample_rows(s, e).collect()} == {(2, "successor not later"), (3, "missing sample"), (9, "unexpected sample")}
