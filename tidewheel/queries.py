"""Registered queries over the derived ledger, each with DuckDB SQL over the same derivation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions import ledger as fn
from tidewheel.operators import checks, evidence, graph, reads, scheduling, slo, timing, transitions
from tidewheel.registry import NOW, QUERIES, SQL, TENANT, key, now_of, query
from tidewheel.sources.derive import Ledger, duckdb_ctes
from tidewheel.streaming import ledger as streams

# --- reads

query("SRC1_job", "SELECT id, tenant_id, state, attempt_no, slot_cost, max_attempts FROM jobs WHERE id = md5('job:7')")(lambda x: reads.job(x.jobs, key(x.jobs, 7)).select("id", "tenant_id", "state", "attempt_no", "slot_cost", F.get_json_object("retry_json", "$.max_attempts").cast("long").alias("max_attempts")))
query(
    "AG1_state_snapshot",
    """SELECT (SELECT coalesce(max(event_seq), 0) FROM ledger_events) AS sequence, count(*) FILTER (WHERE state = 'PENDING') AS pending, count(*) FILTER (WHERE state = 'SCHEDULED') AS scheduled,
    count(*) FILTER (WHERE state = 'RUNNING') AS running, count(*) FILTER (WHERE state = 'RETRYING') AS retrying, (SELECT count(*) FROM dead_letters WHERE redriven_job_id IS NULL) AS dlq FROM jobs""",
)(lambda x: reads.state_snapshot(x.jobs, x.ledger_events, x.dead_letters))
DEPTH_SQL = f"""SELECT q.tenant_id, q.queue_name, CAST(sum(CASE WHEN state = 'PENDING' THEN 1 ELSE 0 END) AS BIGINT) AS pending, CAST(sum(CASE WHEN state = 'SCHEDULED' THEN 1 ELSE 0 END) AS BIGINT) AS scheduled,
    CAST(sum(CASE WHEN state = 'RUNNING' THEN 1 ELSE 0 END) AS BIGINT) AS running, CAST(sum(CASE WHEN state = 'RETRYING' THEN 1 ELSE 0 END) AS BIGINT) AS retrying,
    CAST(sum(CASE WHEN state NOT IN ('SUCCEEDED', 'FAILED', 'DEAD_LETTER') THEN 1 ELSE 0 END) AS BIGINT) AS active, t.max_depth, q.active_slots, t.max_slots,
    greatest(0, {NOW} - min(CASE WHEN state = 'PENDING' AND ready_seq > 0 THEN updated_at END)) // 1000000 AS raw_age
    FROM queue_state q JOIN tenant_limits t ON t.tenant_id = q.tenant_id LEFT JOIN jobs j ON j.tenant_id = q.tenant_id AND j.queue_name = q.queue_name
    GROUP BY q.tenant_id, q.queue_name, t.max_depth, q.active_slots, t.max_slots"""
# greatest passes over nulls, so an empty queue's age is set apart
DEPTH_SQL = f"SELECT d.* EXCLUDE (raw_age), CASE WHEN (SELECT count(*) FROM jobs j WHERE j.tenant_id = d.tenant_id AND j.queue_name = d.queue_name AND j.state = 'PENDING' AND j.ready_seq > 0) > 0 THEN raw_age END AS oldest_ready_age_ms FROM ({DEPTH_SQL}) d"
query("AG2_queue_depth", f"{DEPTH_SQL} WHERE tenant_id = '{TENANT}'")(lambda x: reads.queue_depth(x.queue_state, x.tenant_limits, x.jobs, TENANT, now_of(x)))
query("JN2_all_queue_depths", DEPTH_SQL)(lambda x: reads.queue_depth(x.queue_state, x.tenant_limits, x.jobs, None, now_of(x)))
HEALTH_SQL = f"""SELECT w.worker_id, w.capacity_slots, ({NOW} - last_heartbeat_at) // 1000000 AS heartbeat_age_ms,
    CASE WHEN {NOW} - last_heartbeat_at < 30001000000 THEN 'healthy' WHEN {NOW} - last_heartbeat_at < 120001000000 THEN 'stale' ELSE 'offline' END AS status,
    count(j.id) AS active_leases, CAST(coalesce(sum(j.slot_cost), 0) AS BIGINT) AS active_slots, CASE WHEN count(j.id) > 0 THEN greatest(0, {NOW} - min(leased_at)) // 1000000 END AS oldest_lease_age_ms,
    CASE WHEN count(j.id) > 0 THEN greatest(0, min(expires_at) - {NOW}) // 1000000 END AS next_expiry_ms
    FROM workers w LEFT JOIN (SELECT a.worker_id AS wid, a.leased_at, a.expires_at, j.id, j.slot_cost FROM attempts a JOIN jobs j ON j.id = a.job_id AND j.attempt_no = a.attempt_no AND j.lease_generation = a.lease_generation
      WHERE a.state IN ('LEASED', 'RUNNING') AND j.state IN ('SCHEDULED', 'RUNNING')) j ON j.wid = w.worker_id GROUP BY w.worker_id, w.capacity_slots, w.last_heartbeat_at"""
query("AG3_worker_health", HEALTH_SQL)(lambda x: reads.worker_health(x.workers, x.attempts, x.jobs, now_of(x)))
query("AG4_open_depth", "SELECT tenant_id, queue_name, state, count(*) AS n FROM jobs WHERE state NOT IN ('SUCCEEDED', 'FAILED', 'DEAD_LETTER') GROUP BY ALL")(lambda x: reads.open_depth(x.jobs))
query(
    "AG5_admission",
    """SELECT t.tenant_id, max_depth, count(j.id) AS active, max_depth = 0 OR count(j.id) + 1 <= max_depth AS accepted FROM tenant_limits t
    LEFT JOIN jobs j ON j.tenant_id = t.tenant_id AND j.state NOT IN ('SUCCEEDED', 'FAILED', 'DEAD_LETTER') GROUP BY t.tenant_id, max_depth""",
)(lambda x: reads.admission(x.jobs, x.tenant_limits))
query("AG6_progress", "SELECT count(*) FILTER (WHERE state = 'SUCCEEDED') AS succeeded, count(*) FILTER (WHERE state IN ('SCHEDULED', 'RUNNING')) AS active, count(*) FILTER (WHERE state IN ('FAILED', 'DEAD_LETTER')) AS failed, count(*) FILTER (WHERE attempt_no > 1) AS repeated FROM jobs")(lambda x: reads.progress(x.jobs))
query("AG7_state_histogram", "SELECT state, count(*) AS n FROM jobs GROUP BY state")(lambda x: reads.state_histogram(x.jobs))
query("AG8_active_workers", "SELECT DISTINCT worker_id FROM attempts WHERE state IN ('LEASED', 'RUNNING')")(lambda x: reads.active_workers(x.attempts))
query("AG9_logical_clock", "SELECT greatest((SELECT max(greatest(created_at, updated_at)) FROM jobs), (SELECT max(greatest(leased_at, heartbeat_at, expires_at, coalesce(completed_at, 0))) FROM attempts), (SELECT max(occurred_at) FROM ledger_events), (SELECT max(committed_at) FROM job_completions)) AS clock_ns")(
    lambda x: reads.logical_clock(jobs=(x.jobs, ["created_at", "updated_at"]), attempts=(x.attempts, ["leased_at", "heartbeat_at", "expires_at", "completed_at"]), events=(x.ledger_events, ["occurred_at"]), done=(x.job_completions, ["committed_at"]))
)
query("AG10_slot_accounting", "SELECT q.tenant_id, q.queue_name, q.active_slots, CAST(coalesce(sum(slot_cost), 0) AS BIGINT) AS expected FROM queue_state q LEFT JOIN jobs j ON j.tenant_id = q.tenant_id AND j.queue_name = q.queue_name AND j.state IN ('SCHEDULED', 'RUNNING') GROUP BY ALL")(lambda x: reads.slot_accounting(x.jobs, x.queue_state))
query("AG11_attempt_repeats", "SELECT CAST(sum(n - 1) AS BIGINT) AS repeats FROM (SELECT count(*) AS n FROM attempts GROUP BY job_id)")(lambda x: reads.attempt_repeats(x.attempts))
query("AG14_first_lease", f"SELECT t.tenant_id, coalesce((SELECT min(leased_at) FROM attempts a JOIN jobs j ON j.id = a.job_id WHERE j.tenant_id = t.tenant_id AND leased_at > {NOW} - 86400000000000 * 30), 0) AS first_lease FROM tenant_limits t")(lambda x: reads.first_lease_after(x.attempts, x.jobs, now_of(x) - 86_400_000_000_000 * 30))
query("AG24_dashboard", f"SELECT CAST(sum(active) AS BIGINT) AS depth, CAST(sum(running) AS BIGINT) AS running, (SELECT count(*) FROM ({HEALTH_SQL}) WHERE status = 'healthy') AS healthy, (SELECT count(*) FROM workers) AS workers FROM ({DEPTH_SQL})")(
    lambda x: reads.dashboard_totals(reads.queue_depth(x.queue_state, x.tenant_limits, x.jobs, None, now_of(x)), reads.worker_health(x.workers, x.attempts, x.jobs, now_of(x)))
)
READY_SQL = f"""SELECT j.id, j.tenant_id, j.queue_name, priority, slot_cost, ready_seq, recovery_pending, weight, deficit,
    row_number() OVER (PARTITION BY j.tenant_id, j.queue_name ORDER BY recovery_pending DESC, priority DESC, ready_seq, id) AS rank
    FROM jobs j JOIN tenant_limits t ON t.tenant_id = j.tenant_id JOIN queue_state q ON q.tenant_id = j.tenant_id AND q.queue_name = j.queue_name
    WHERE state = 'PENDING' AND ready_seq > 0 AND available_at <= {NOW} AND (t.max_slots = 0 OR t.active_slots + slot_cost <= t.max_slots)"""
query("WN1_ready_candidates", f"SELECT * FROM ({READY_SQL}) WHERE rank <= 2")(lambda x: reads.ready_candidates(x.jobs, x.tenant_limits, x.queue_state, now_of(x), 2))
query(
    "TK1_history",
    """WITH p AS (SELECT * FROM ledger_events WHERE job_id = md5('job:6') ORDER BY event_seq DESC LIMIT 6), r AS (SELECT *, row_number() OVER (ORDER BY event_seq DESC) AS r, count(*) OVER () AS n FROM p)
    SELECT event_seq, event_type, state, state_version, 'system' AS actor, CASE WHEN n > 5 THEN min(event_seq) OVER () ELSE 0 END AS next_before FROM r WHERE r <= 5""",
)(lambda x: reads.history(x.ledger_events, key(x.jobs, 6), 0, 5))
query("TK2_dead_letters", "SELECT * FROM dead_letters WHERE redriven_job_id IS NULL ORDER BY created_at, job_id LIMIT 100")(lambda x: reads.open_dead_letters(x.dead_letters, 100))
DUE_SQL = f"""SELECT id, available_at, state FROM jobs j WHERE available_at <= {NOW} AND (state = 'RETRYING' OR state = 'PENDING' AND ready_seq = 0)
    AND NOT EXISTS (SELECT 1 FROM job_dependencies d JOIN jobs p ON p.id = d.depends_on_id WHERE d.job_id = j.id AND p.state <> 'SUCCEEDED') ORDER BY available_at, id LIMIT 50"""
query("TK3_due_jobs", DUE_SQL)(lambda x: reads.due_jobs(x.jobs, x.job_dependencies, now_of(x), 50))
EXPIRED_SQL = f"""SELECT a.job_id, a.attempt_no, a.lease_generation, a.expires_at, j.tenant_id, j.max_attempts FROM attempts a JOIN jobs j ON j.id = a.job_id AND j.attempt_no = a.attempt_no AND j.lease_generation = a.lease_generation
    WHERE a.state IN ('LEASED', 'RUNNING') AND j.state IN ('SCHEDULED', 'RUNNING') AND a.expires_at <= {NOW} ORDER BY a.expires_at, a.job_id LIMIT 100"""
query("TK4_expired_leases", EXPIRED_SQL)(lambda x: reads.expired_leases(x.attempts, x.jobs, now_of(x), 100))
query(
    "TK8_recent",
    """SELECT * FROM (SELECT CASE WHEN state = 'RUNNING' THEN 'running' ELSE 'failed' END AS kind, row_number() OVER (PARTITION BY state = 'RUNNING' ORDER BY updated_at DESC, id) AS r, id, state, updated_at, coalesce(dag_id, '') AS dag
    FROM jobs LEFT JOIN dag_jobs ON job_id = id WHERE state IN ('RUNNING', 'FAILED', 'DEAD_LETTER')) WHERE r <= 20""",
)(lambda x: reads.recent(x.jobs, x.dag_jobs, 20))
query("TK9_audit", f"SELECT * FROM audit_events WHERE actor = 'actor-1' AND occurred_at <= {NOW}")(lambda x: reads.audit(x.audit_events, 0, now_of(x), "actor-1"))
EDGES_SQL = "SELECT c.dag_id, c.node_key AS node, p.node_key AS parent FROM job_dependencies d JOIN dag_jobs c ON c.job_id = d.job_id JOIN dag_jobs p ON p.job_id = d.depends_on_id AND p.dag_id = c.dag_id"
query("JN5_dag_edges", EDGES_SQL)(lambda x: reads.dag_edges(x.job_dependencies, x.dag_jobs))
query("GR7_run_view", f"SELECT g.dag_id, g.node_key, g.job_id, j.state, coalesce((SELECT string_agg(parent, ',' ORDER BY parent) FROM ({EDGES_SQL}) e WHERE e.dag_id = g.dag_id AND e.node = g.node_key), '') AS depends_on FROM dag_jobs g JOIN jobs j ON j.id = g.job_id")(lambda x: reads.run_view(x.jobs, x.dag_jobs, x.job_dependencies))
query("JN21_owned_audit", "SELECT a.id, a.action, coalesce(j.tenant_id, 'default') AS tenant_id FROM audit_events a LEFT JOIN jobs j ON j.id = a.target")(lambda x: reads.owned_audit(x.keyed("audit_events", "target"), x.keyed("jobs", "id")))
query("AG22_audit_actions", "SELECT action, count(*) AS n FROM audit_events GROUP BY action")(lambda x: x.audit_events.groupBy("action").agg(F.count("*").alias("n")))

# --- timing and statistics

TIMING_SQL = """SELECT e.event_seq, e.event_type, e.state,
    CASE WHEN e.event_type = 'lease_acquired' AND a.leased_at >= r.ready_at THEN a.leased_at - r.ready_at END AS ready_to_lease,
    CASE WHEN e.event_type = 'lease_acquired' AND l.job_id IS NOT NULL AND a.leased_at >= p.completed_at THEN a.leased_at - p.completed_at END AS lease_recovery,
    CASE WHEN e.event_type IN ('job_completed', 'retry_scheduled') AND a.completed_at >= a.leased_at THEN a.completed_at - a.leased_at END AS lease_to_completion,
    CASE WHEN e.state IN ('SUCCEEDED', 'FAILED', 'DEAD_LETTER') AND c.committed_at >= j.created_at THEN c.committed_at - j.created_at END AS end_to_end
    FROM (SELECT * EXCLUDE (no), CAST(json_extract(payload_json, '$.attempt_no') AS BIGINT) AS no FROM ledger_events) e JOIN jobs j ON j.id = e.job_id LEFT JOIN attempts a ON a.job_id = e.job_id AND a.attempt_no = e.no
    LEFT JOIN attempts p ON p.job_id = e.job_id AND p.attempt_no = a.attempt_no - 1 AND p.state = 'EXPIRED'
    LEFT JOIN (SELECT DISTINCT job_id, occurred_at, CAST(json_extract(payload_json, '$.attempt_no') AS BIGINT) AS no FROM ledger_events WHERE event_type = 'lease_reaped' AND state = 'PENDING') l ON l.job_id = e.job_id AND l.no = p.attempt_no AND l.occurred_at = p.completed_at
    LEFT JOIN job_completions c ON c.job_id = e.job_id AND c.committed_at = e.occurred_at
    LEFT JOIN (SELECT e1.event_seq, max(e2.occurred_at) AS ready_at FROM ledger_events e1 JOIN ledger_events e2 ON e2.job_id = e1.job_id AND e2.event_seq < e1.event_seq
      AND e2.event_type IN ('job_admitted', 'job_promoted', 'dependency_released', 'lease_reaped', 'operator_release') GROUP BY e1.event_seq) r ON r.event_seq = e.event_seq"""


def timing_of(x: Ledger) -> DataFrame:
    return timing.timing_events(x.ledger_events, x.jobs, x.attempts, x.job_completions)


LONG_SQL = " UNION ALL ".join(f"SELECT '{s}' AS stage, {s} AS ns FROM t WHERE {s} IS NOT NULL" for s in ("ready_to_lease", "lease_recovery", "lease_to_completion", "end_to_end"))
query("TS12_timing_events", TIMING_SQL)(timing_of)
query("TK6_timing_page", f"SELECT * FROM ({TIMING_SQL}) WHERE event_seq > 1000 ORDER BY event_seq LIMIT 1000")(lambda x: timing.timing_events(x.ledger_events, x.jobs, x.attempts, x.job_completions, 1000, 1000))
query("AG17_latency_distribution", f"WITH t AS ({TIMING_SQL}), l AS ({LONG_SQL}) SELECT stage, count(*) AS n, min(ns) AS min, max(ns) AS max, quantile_disc(ns, 0.5) AS p50, quantile_disc(ns, 0.95) AS p95, quantile_disc(ns, 0.99) AS p99 FROM l GROUP BY stage")(lambda x: timing.distribution(timing.long_latencies(timing_of(x)), "ns", ["stage"]))
query("AG16_price_percentiles", "SELECT l_returnflag, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.95) AS p95, quantile_disc(l_extendedprice, 0.99) AS p99 FROM lineitem GROUP BY l_returnflag")(lambda x: timing.nearest_rank(x.spark.read.parquet(f"{x.sf_dir}/lineitem.parquet"), "l_extendedprice", [50, 95, 99], ["l_returnflag"]))
query("AG18_median", "SELECT round(median(o_totalprice), 6) AS median FROM orders")(lambda x: timing.median(x.spark.read.parquet(f"{x.sf_dir}/orders.parquet"), "o_totalprice").select(F.round("median", 6).alias("median")))
query("AG19_rates", "SELECT worker_id, CASE WHEN count(*) >= 2 AND max(leased_at) > min(leased_at) THEN round(count(*) * 60e9 / (max(leased_at) - min(leased_at)), 9) END AS per_minute FROM attempts GROUP BY worker_id")(lambda x: timing.rate_per_minute(x.attempts, "leased_at", ["worker_id"]).select("worker_id", F.round("per_minute", 9).alias("per_minute")))

# --- evidence

SAMPLES_SQL = """SELECT m.job_id, j.created_at AS admitted, min(a.leased_at) AS first_lease, max(a.leased_at) AS final_lease, c.committed_at AS completed,
    coalesce(j.created_at <= min(a.leased_at) AND max(a.leased_at) <= c.committed_at, false) AS complete
    FROM manifest m LEFT JOIN jobs j ON j.id = m.job_id LEFT JOIN attempts a ON a.job_id = m.job_id LEFT JOIN job_completions c ON c.job_id = m.job_id GROUP BY m.job_id, j.created_at, c.committed_at"""


def samples_of(x: Ledger) -> DataFrame:
    """Samples of all accepted jobs, joined by the orders' keys; only rows of keys with a succeeded job are shuffled."""
    return x.identified(evidence.benchmark_samples(x.accepted_keys(), x.keyed("jobs", "id", True), x.keyed("attempts", accepted=True), x.keyed("job_completions", accepted=True)), "job_id")


query("EV1_samples", SAMPLES_SQL)(samples_of)
_spans = " UNION ALL ".join(f"SELECT '{k}' AS measure, {a} - {b} AS ns FROM s" for k, a, b in (("admission_to_lease", "first_lease", "admitted"), ("lease_to_completion", "completed", "final_lease"), ("end_to_end", "completed", "admitted")))
_times = " UNION ALL ".join(f"SELECT '{k}' AS measure, {c} AS t FROM s" for k, c in (("admissions", "admitted"), ("leases", "first_lease"), ("completions", "completed")))
query("EV2_run_summary", f"WITH s AS (SELECT * FROM ({SAMPLES_SQL}) WHERE complete), l AS ({_spans}), t AS ({_times}) SELECT measure, count(*) AS n, quantile_disc(ns, 0.5) AS p50, quantile_disc(ns, 0.95) AS p95, quantile_disc(ns, 0.99) AS p99, max(ns) AS max, CAST(NULL AS DOUBLE) AS per_minute FROM l GROUP BY measure UNION ALL SELECT measure, count(*), NULL, NULL, NULL, NULL, round(count(*) * 60e9 / (max(t) - min(t)), 6) FROM t GROUP BY measure")(
    lambda x: evidence.run_summary(samples_of(x))
)
query("SO2_residual", "SELECT 'tenant/' || tenant_id AS label, active_slots FROM tenant_limits WHERE active_slots <> 0 UNION ALL SELECT 'queue/' || tenant_id || '/' || queue_name, active_slots FROM queue_state WHERE active_slots <> 0")(lambda x: evidence.residual(x.tenant_limits, x.queue_state))
KILLS = "SELECT attempt_no * 1000000 + k AS kill_sequence, job_id, lease_generation AS killed_generation, completed_at AS killed_at FROM {0} WHERE state = 'EXPIRED' AND attempt_no = 1"
RECOVERY_SQL = f"SELECT k.*, a.lease_generation AS generation, a.leased_at, (a.leased_at - k.killed_at) // 1000000 AS recovery_ms FROM ({KILLS.format('attempts')}) k LEFT JOIN attempts a ON a.job_id = k.job_id AND a.lease_generation = 2"


def recovered(x: Ledger) -> DataFrame:
    return evidence.recoveries(x.spark.sql(KILLS.format("{attempts}"), attempts=x.attempts), x.attempts)


query("EV7_recoveries", RECOVERY_SQL)(recovered)
query("EV8_recovery_p99", f"SELECT quantile_disc(recovery_ms, 0.99) AS p99, quantile_disc(recovery_ms, 0.99) < 5000 AS passed FROM ({RECOVERY_SQL})")(lambda x: evidence.campaign(recovered(x), 5000))

# --- graph

#: All that lies below a dead letter, whatever stands between; then the open ones of it.
CLOSURE = "WITH RECURSIVE c AS (SELECT d.job_id AS id FROM job_dependencies d JOIN jobs p ON p.id = d.depends_on_id WHERE p.state = 'DEAD_LETTER' UNION SELECT d.job_id FROM c JOIN job_dependencies d ON d.depends_on_id = c.id) SELECT id FROM jobs WHERE id IN (SELECT id FROM c) AND state NOT IN ('SUCCEEDED', 'FAILED', 'DEAD_LETTER')"
query("GR1_failed_descendants", CLOSURE)(lambda x: x.identified(transitions.fail_descendants(x.numbers().where("state = 'DEAD_LETTER'").select("id"), x.numbers(), x.numbered_edges())))


def dag_parts(x: Ledger) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the customers' DAGs as numbers, for which `dag_named` has the keys."""
    nodes = x.job0.select(F.col("cust").alias("dag_id"), F.col("k").alias("id"))
    return nodes, x.links().select(F.col("cust").alias("dag_id"), F.col("k").alias("id"), F.col("previous").alias("parent"))


def dag_named(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.concat(F.lit("dag-" if c == "dag_id" else "node-"), F.col(c).cast("string")) for c in ("dag_id", "id", "parent") if c in df.columns})


query("GR3_levels", "SELECT concat('dag-', CAST(cust AS STRING)) AS dag_id, concat('node-', CAST(k AS STRING)) AS id, row_number() OVER (PARTITION BY cust ORDER BY created_at, job0.id) - 1 AS level FROM job0")(lambda x: dag_named(graph.levels(*dag_parts(x))))
query("GR2_lexical_order", "SELECT concat('dag-', CAST(cust AS STRING)) AS dag_id, concat('node-', CAST(k AS STRING)) AS id, row_number() OVER (PARTITION BY cust ORDER BY created_at, job0.id) AS position FROM job0")(lambda x: graph.lexical_order(*dag_parts(x), dag_named))

# --- scheduling

query("SCH2_unit_cost_order", f"WITH r AS (SELECT * FROM ({READY_SQL}) WHERE rank <= 100), q AS (SELECT tenant_id, queue_name, row_number() OVER (ORDER BY tenant_id, queue_name) - 1 AS qi, count(*) OVER () AS nq FROM (SELECT DISTINCT tenant_id, queue_name FROM r)) SELECT id, r.tenant_id, r.queue_name, CAST(ceil(rank / weight) AS BIGINT) AS round, ((qi - 1) % nq + nq) % nq AS turn, rank FROM r JOIN q ON q.tenant_id = r.tenant_id AND q.queue_name = r.queue_name ORDER BY round, turn, rank LIMIT 40")(
    lambda x: scheduling.unit_cost_order(reads.ready_candidates(x.jobs, x.tenant_limits, x.queue_state, now_of(x), 100), 1, 40)
)


def decided(x: Ledger) -> DataFrame:
    """The same through the scheduler itself, with costs of 1."""
    c = reads.ready_candidates(x.jobs, x.tenant_limits, x.queue_state, now_of(x), 100).withColumn("slot_cost", F.lit(1))
    d = scheduling.decisions(scheduling.snapshots(c, x.queue_state, now_of(x), 40, 40, 1, 1))
    return d.select(F.posexplode("decision.grants").alias("i", "g")).select(F.col("g.job_id").alias("id"))


query("SCH2_decision", f"WITH r AS (SELECT * FROM ({READY_SQL}) WHERE rank <= 100), q AS (SELECT tenant_id, queue_name, row_number() OVER (ORDER BY tenant_id, queue_name) - 1 AS qi, count(*) OVER () AS nq FROM (SELECT DISTINCT tenant_id, queue_name FROM r)) SELECT id FROM (SELECT id FROM r JOIN q ON q.tenant_id = r.tenant_id AND q.queue_name = r.queue_name ORDER BY ceil(rank / weight), ((qi - 1) % nq + nq) % nq, rank LIMIT 40)")(decided)
query("SCH4_reserve", "SELECT s AS slots, CASE WHEN s <= 1 THEN 0 ELSE (s + 3) // 4 END AS reserve FROM range(0, 65) t(s)")(lambda x: x.spark.range(65).select(F.col("id").alias("slots"), scheduling.recovery_reserve(F.col("id")).alias("reserve")))
query("RPL4_replay", "SELECT n AS sequence, '{\"sequence\":' || n || ',\"grants\":[{\"job_id\":\"' || lpad(to_hex(n), 32, '0') || '\",\"tenant_id\":\"qualification\",\"queue\":\"replay\",\"slot_cost\":1}],\"queues\":[{\"tenant_id\":\"qualification\",\"queue\":\"replay\",\"deficit\":0}],\"next_cursor\":0}' AS line FROM (SELECT lower(to_hex(0)) AS z, n FROM range(1, 5001) t(n))")(lambda x: scheduling.decisions(scheduling.synthetic(x.spark, 5000)).select("sequence", "line"))
SQL["RPL4_replay"] = SQL["RPL4_replay"].replace("lpad(to_hex(n)", "lpad(lower(to_hex(n))")

# --- service levels over the stream's events

OBSERVED = "SELECT event_type AS stage, occurred_at AS at_ns, CAST(floor(value * 100000000) AS BIGINT) AS ns FROM {0}"


def observed(x: Ledger) -> DataFrame:
    return x.spark.sql(OBSERVED.format("{e}"), e=x.stream_events)


_o = f"o AS ({OBSERVED.format('stream_events')})"
_bounds = ", ".join(f"({b})" for b in slo.JOB_LATENCY) + ", ('inf')"
query("TS1_buckets", f"WITH {_o}, b(le) AS (SELECT CAST(le AS DOUBLE) FROM (VALUES {', '.join(f'({chr(39)}{b}{chr(39)})' for b in (*slo.JOB_LATENCY, 'inf'))}) v(le)) SELECT stage, le, count(*) FILTER (WHERE ns / 1e9 <= le) AS n FROM o, b GROUP BY stage, le")(lambda x: slo.buckets(observed(x)))
_m = f"{_o}, m AS (SELECT stage, at_ns // {slo.MINUTE} AS minute, count(*) FILTER (WHERE ns <= 5000000000) AS good, count(*) AS n FROM o GROUP BY ALL)"
_s = f"{_m}, s AS (SELECT stage, minute, CAST(sum(good) OVER w AS BIGINT) AS good, CAST(sum(n) OVER w AS BIGINT) AS n FROM m WINDOW w AS (PARTITION BY stage ORDER BY minute RANGE BETWEEN 29 PRECEDING AND CURRENT ROW))"
query("TS4_sliding_ratio", f"WITH {_s} SELECT stage, minute, good, n, good / n AS ratio FROM s")(lambda x: slo.sliding_ratio(slo.minute_counts(observed(x), 5.0)))
query("TS5_slo_alert", f"WITH {_s}, c AS (SELECT stage AS series, minute, coalesce(good / n < 0.99 AND n >= 20, false) AS c FROM s), g AS (SELECT *, max(CASE WHEN NOT c THEN minute END) OVER (PARTITION BY series ORDER BY minute) AS off FROM c) SELECT series, minute, c AND minute - min(CASE WHEN c THEN minute END) OVER (PARTITION BY series, off ORDER BY minute ROWS UNBOUNDED PRECEDING) >= 5 AS firing FROM g")(
    lambda x: slo.alerts(slo.sliding_ratio(slo.minute_counts(observed(x), 5.0)).withColumnRenamed("stage", "series"), (F.col("ratio") < slo.RATIO) & (F.col("n") >= slo.OBSERVATIONS), slo.RATIO_MINUTES)
)
query("TS7_rates", "SELECT series, at_ns, round(step * 60e9 / gap, 6) AS per_minute FROM (SELECT event_type AS series, at_ns, CASE WHEN v < lag(v) OVER w THEN v ELSE v - lag(v) OVER w END AS step, at_ns - lag(at_ns) OVER w AS gap FROM (SELECT event_type, occurred_at AS at_ns, event_seq % 97 AS v FROM stream_events QUALIFY row_number() OVER (PARTITION BY event_type, occurred_at ORDER BY event_seq) = 1) WINDOW w AS (PARTITION BY event_type ORDER BY at_ns)) WHERE gap > 0")(
    lambda x: slo.rates(x.stream_events.groupBy(F.col("event_type").alias("series"), F.col("occurred_at").alias("at_ns")).agg((F.min("event_seq") % 97).alias("value"))).select("series", "at_ns", F.round("per_minute", 6).alias("per_minute"))
)
query("TS9_gauges", "SELECT event_type, CAST(sum(v) AS BIGINT) AS value FROM (SELECT event_type, job_id, arg_max(event_seq % 97, event_seq) AS v FROM stream_events GROUP BY ALL) GROUP BY event_type")(
    lambda x: slo.gauges(x.stream_events.select(F.concat_ws("/", "event_type", "job_id").alias("series"), "event_type", F.col("event_seq").alias("at_ns"), (F.col("event_seq") % 97).alias("value")), ["event_type"])
)
query("TS11_zero_filled", "SELECT p.o_orderpriority AS label, count(e.event_seq) AS n FROM (SELECT DISTINCT o_orderpriority FROM orders) p LEFT JOIN stream_events e ON e.event_type = p.o_orderpriority GROUP BY ALL")(
    lambda x: slo.zero_filled(x.stream_events.groupBy(F.col("event_type").alias("label")).agg(F.count("*").alias("n")), x.spark.read.parquet(f"{x.sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("label")).distinct(), "label")
)
query("JN11_ready_before", "SELECT event_seq, job_id, max(CASE WHEN event_type IN ('job_admitted', 'job_promoted') THEN occurred_at END) OVER (PARTITION BY job_id ORDER BY event_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ready_at FROM stream_events")(
    lambda x: x.spark.sql("SELECT event_seq, job_id, max(CASE WHEN event_type IN ('job_admitted', 'job_promoted') THEN occurred_at END) OVER (PARTITION BY job_id ORDER BY event_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ready_at FROM {e}", e=x.stream_events)
)
query("STR4_fold", "SELECT job_id, arg_max(state, event_seq) AS state, max(state_version) AS state_version, max(event_seq) AS last_seq FROM ledger_events GROUP BY job_id")(lambda x: checks.fold_events(x.ledger_events))

# --- transitions and functions

DELAY_SQL = "(CASE least(n, 4) WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 8 ELSE 16 END) * CAST(1000000000 AS BIGINT) * (8000 + CAST('0x' || substr(sha256(CAST(encode(id) || unhex('00' || lpad(to_hex(n), 16, '0')) AS BLOB)), 1, 4) AS BIGINT) % 2001) // 10000"
query("SC12_retry_delay", f"SELECT id, n, {DELAY_SQL} AS delay_ns FROM (SELECT id, greatest(attempt_no, 1) AS n FROM jobs)")(lambda x: x.jobs.select("id", F.greatest("attempt_no", F.lit(1)).cast("long").alias("n")).withColumn("delay_ns", fn.retry_delay_ns(F.col("id"), F.col("n"))))
query("SC7_keys", "SELECT id, 'dag-' || substr(sha256(CAST(encode(tenant_id) || unhex('00') || encode(queue_name) AS BLOB)), 1, 24) AS dag_id, 'redis:' || tenant_id || ':' || queue_name || ':' || id AS delivery, regexp_full_match(id, '[0-9a-f]{32}') AS valid FROM jobs")(
    lambda x: x.jobs.select("id", fn.dag_id(F.col("tenant_id"), F.col("queue_name")).alias("dag_id"), fn.delivery_key(F.col("tenant_id"), F.col("queue_name"), F.col("id")).alias("delivery"), fn.is_id(F.col("id")).alias("valid"))
)
COMMANDS = "SELECT id AS job_id, attempt_no, k % 3 = 0 AS success, k % 3 = 1 AS failure_retryable FROM {0} WHERE state IN ('SCHEDULED', 'RUNNING')"
query("DM7_complete", f"SELECT job_id, attempt_no, CASE WHEN success THEN 'SUCCEEDED' WHEN failure_retryable AND attempt_no < max_attempts THEN 'RETRYING' WHEN failure_retryable THEN 'DEAD_LETTER' ELSE 'FAILED' END AS state, state_version + 1 AS state_version, CASE WHEN NOT success AND failure_retryable AND attempt_no < max_attempts THEN {NOW} + {DELAY_SQL} END AS available_at FROM (SELECT c.*, j.id, j.attempt_no AS n, j.max_attempts, j.state_version FROM ({COMMANDS.format('jobs')}) c JOIN jobs j ON j.id = c.job_id)")(
    lambda x: transitions.complete(x.spark.sql(COMMANDS.format("{jobs}"), jobs=x.jobs), x.jobs, now_of(x))
)
query("DM9_promote", f"SELECT id, 1000 + row_number() OVER (ORDER BY available_at, id) AS ready_seq FROM ({DUE_SQL})")(lambda x: transitions.promote(x.jobs, x.job_dependencies, 1000, now_of(x), 50))
query("DM10_reap", f"WITH e AS ({EXPIRED_SQL}), s AS (SELECT job_id, expires_at, CASE WHEN attempt_no < max_attempts THEN 'PENDING' ELSE 'DEAD_LETTER' END AS state FROM e) SELECT job_id, state, CASE WHEN state = 'PENDING' THEN 1000 + row_number() OVER (PARTITION BY state ORDER BY expires_at, job_id) ELSE 0 END AS ready_seq FROM s")(lambda x: transitions.reap(x.attempts, x.jobs, 1000, now_of(x), 100))
ACTIONS = "SELECT id AS job_id, CASE k % 4 WHEN 0 THEN 'release' WHEN 1 THEN 'cancel' WHEN 2 THEN 'dead_letter' ELSE 'explode' END AS action FROM {0}"
query("DM13_force", f"SELECT a.job_id, action, CASE WHEN state IN ('SUCCEEDED', 'FAILED', 'DEAD_LETTER') OR action = 'explode' THEN 'error' WHEN action = 'release' THEN 'PENDING' WHEN action = 'cancel' THEN 'FAILED' ELSE 'DEAD_LETTER' END AS state, state IN ('SCHEDULED', 'RUNNING') AND action <> 'explode' AS fenced, state IN ('SCHEDULED', 'RUNNING') AND action = 'release' AS recovery_pending FROM ({ACTIONS.format('jobs')}) a JOIN jobs j ON j.id = a.job_id")(
    lambda x: transitions.force(x.spark.sql(ACTIONS.format("{jobs}"), jobs=x.jobs), x.jobs)
)
query("DM14_redrive", "SELECT d.job_id, CASE WHEN redriven_job_id IS NULL THEN 'cloned' ELSE 'already' END AS outcome, coalesce(redriven_job_id, substr(sha256('redrive' || d.job_id || '1'), 1, 32)) AS clone_id, tenant_id, queue_name, priority, slot_cost FROM dead_letters d JOIN jobs j ON j.id = d.job_id")(
    lambda x: transitions.redrive(x.dead_letters.select("job_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("request")), x.dead_letters, x.jobs)
)
BEATS = "SELECT worker_id, 8 + CAST(substr(worker_id, 8) AS BIGINT) % 9 + CASE WHEN worker_id = 'worker-5' THEN 1 ELSE 0 END AS capacity_slots, max(heartbeat_at) AS at FROM {0} GROUP BY worker_id"
query("DM17_register", f"SELECT coalesce(w.worker_id, b.worker_id) AS worker_id, coalesce(w.capacity_slots, b.capacity_slots) AS capacity_slots, greatest(w.last_heartbeat_at, b.at) AS last_heartbeat_at, coalesce(w.capacity_slots <> b.capacity_slots, false) AS conflict FROM workers w FULL JOIN ({BEATS.format('attempts')}) b ON b.worker_id = w.worker_id")(
    lambda x: transitions.register(x.spark.sql(BEATS.format("{attempts}"), attempts=x.attempts), x.workers)
)
query("DM5_start", f"SELECT job_id, attempt_no, CASE WHEN expires_at <= {NOW} - 5000000000 OR state NOT IN ('LEASED', 'RUNNING') THEN 'stale' WHEN state = 'LEASED' THEN 'started' ELSE 'running' END AS outcome FROM attempts")(lambda x: transitions.start(x.attempts.select("job_id", "attempt_no", "token_hash"), x.attempts, now_of(x) - 5_000_000_000))
query("DM6_heartbeat", f"SELECT job_id, attempt_no, state IN ('LEASED', 'RUNNING') AND expires_at > {NOW} - 5000000000 AS accepted, CASE WHEN state IN ('LEASED', 'RUNNING') AND expires_at > {NOW} - 5000000000 THEN greatest(expires_at, {NOW} - 5000000000 + 9000000000) ELSE expires_at END AS expires_at FROM attempts")(
    lambda x: transitions.heartbeat(x.attempts.select("job_id", "attempt_no", "token_hash"), x.attempts, 9_000_000_000, now_of(x) - 5_000_000_000)
)


query("TS8_quantiles", f"WITH {_o}, b(le) AS (SELECT CAST(le AS DOUBLE) FROM (VALUES {', '.join(f'({chr(39)}{b}{chr(39)})' for b in (*slo.JOB_LATENCY, 'inf'))}) v(le)), c AS (SELECT stage, le, count(*) FILTER (WHERE ns / 1e9 <= le) AS n FROM o, b GROUP BY stage, le), w AS (SELECT *, max(n) OVER (PARTITION BY stage) AS total, coalesce(lag(le) OVER (PARTITION BY stage ORDER BY le), 0) AS low, coalesce(lag(n) OVER (PARTITION BY stage ORDER BY le), 0) AS before FROM c) SELECT stage, round(CASE WHEN le = 'inf' THEN low ELSE low + (le - low) * (0.95 * total - before) / (n - before) END, 6) AS value FROM w WHERE n >= 0.95 * total AND before < 0.95 * total")(
    lambda x: slo.histogram_quantile(slo.buckets(observed(x)), 0.95).select("stage", F.round("value", 6).alias("value"))
)
query("TS6_depth_alert", "WITH d AS (SELECT event_type AS series, occurred_at // 60000000000 AS minute, count(*) AS n FROM stream_events GROUP BY ALL), g AS (SELECT *, max(CASE WHEN n < 10 THEN minute END) OVER (PARTITION BY series ORDER BY minute) AS off FROM d) SELECT series, minute, n >= 10 AND minute - min(CASE WHEN n >= 10 THEN minute END) OVER (PARTITION BY series, off ORDER BY minute ROWS UNBOUNDED PRECEDING) >= 10 AS firing FROM g")(
    lambda x: slo.alerts(x.stream_events.groupBy(F.col("event_type").alias("series"), fn.whole(F.col("occurred_at"), slo.MINUTE).alias("minute")).agg(F.count("*").alias("n")), F.col("n") >= slo.DEPTH, slo.DEPTH_MINUTES)
)
query("JN18_affected", f"SELECT job_id, attempt_no, CASE WHEN completed_at IS NULL THEN true WHEN completed_at < {NOW} - 20000000000000 THEN false WHEN completed_at > {NOW} - 10000000000000 THEN state <> 'SUCCEEDED' END AS affected FROM attempts")(
    lambda x: evidence.affected(x.attempts, now_of(x) - 20_000_000_000_000, now_of(x) - 10_000_000_000_000).select("job_id", "attempt_no", "affected")
)
query("SO6_known_workers", "SELECT worker_id FROM attempts WHERE state IN ('LEASED', 'RUNNING') INTERSECT SELECT worker_id FROM workers WHERE capacity_slots > 10")(lambda x: reads.active_workers(x.attempts).intersect(x.workers.where("capacity_slots > 10").select("worker_id")))
query("SC18_bounded_labels", "SELECT CASE WHEN queue_name IN ('1-URGENT', '2-HIGH') THEN queue_name ELSE 'other' END AS label, count(*) AS n FROM jobs GROUP BY ALL")(lambda x: x.jobs.groupBy(fn.bounded(F.col("queue_name"), ("1-URGENT", "2-HIGH")).alias("label")).agg(F.count("*").alias("n")))
query("FLT10_labels", "SELECT text IS NOT NULL AND strlen(text) BETWEEN 1 AND 128 AND regexp_full_match(text, '[!-~]([ -~]*[!-~])?') AS valid, count(*) AS n FROM benchmark GROUP BY ALL")(lambda x: x.spark.read.parquet(f"{x.sf_dir}/benchmark.parquet").groupBy(fn.is_label(F.col("text")).alias("valid")).agg(F.count("*").alias("n")))
query("GR6_parents", "WITH r AS (SELECT d.job_id AS request, j.tenant_id, CASE WHEN j.k % 10 = 0 THEN 'gone' ELSE d.depends_on_id END AS p FROM job_dependencies d JOIN jobs j ON j.id = d.job_id) SELECT request, CASE WHEN o.id IS NULL THEN 'missing parent' ELSE 'parent of another tenant' END AS message FROM r LEFT JOIN jobs o ON o.id = r.p WHERE o.id IS NULL OR o.tenant_id <> r.tenant_id")(
    lambda x: graph.check_parents(x.job_dependencies.join(x.jobs.select(F.col("id").alias("job_id"), "tenant_id", "k"), "job_id").select(F.col("job_id").alias("request"), "tenant_id", F.when(F.col("k") % 10 == 0, "gone").otherwise(F.col("depends_on_id")).alias("depends_on_id")), x.jobs)
)
query("DM4_acquire", f"SELECT id AS job_id, 1 AS attempt_no, 1 AS lease_generation, state_version + 1 AS state_version, 'SCHEDULED' AS state, (SELECT count(*) FROM (SELECT t.tenant_id FROM ({READY_SQL}) r JOIN tenant_limits t ON t.tenant_id = r.tenant_id WHERE rank <= 2 GROUP BY t.tenant_id, max_slots, active_slots HAVING max_slots > 0 AND active_slots + sum(slot_cost) > max_slots)) = 0 AS committed FROM jobs WHERE id IN (SELECT id FROM ({READY_SQL}) WHERE rank <= 2)")(
    lambda x: transitions.acquire(reads.ready_candidates(x.jobs, x.tenant_limits, x.queue_state, now_of(x), 2).select(F.col("id").alias("job_id")), x.jobs, x.tenant_limits, "w", "secret", 1, now_of(x)).select("job_id", F.col("attempt_no").cast("int").alias("attempt_no"), F.col("lease_generation").cast("int").alias("lease_generation"), "state_version", "state", "committed")
)
query("DM11_activate", "SELECT id, 500 + row_number() OVER (ORDER BY id) AS ready_seq FROM (SELECT j.id FROM jobs j WHERE j.state = 'PENDING' AND EXISTS (SELECT 1 FROM job_dependencies d JOIN jobs p ON p.id = d.depends_on_id WHERE d.job_id = j.id AND p.state = 'SUCCEEDED') AND NOT EXISTS (SELECT 1 FROM job_dependencies d JOIN jobs p ON p.id = d.depends_on_id WHERE d.job_id = j.id AND p.state <> 'SUCCEEDED'))")(
    lambda x: transitions.activate(x.jobs.where("state = 'SUCCEEDED'").select("id"), x.jobs.withColumn("ready_seq", F.lit(0)), x.job_dependencies, 500)
)
query("JN16_outcomes", "SELECT a.job_id, a.attempt_no, coalesce(c.state, 'open') AS outcome FROM attempts a LEFT JOIN job_completions c ON c.job_id = a.job_id AND c.attempt_no = a.attempt_no")(lambda x: x.attempts.select("job_id", "attempt_no").join(x.job_completions.select("job_id", "attempt_no", "state"), ["job_id", "attempt_no"], "left").select("job_id", "attempt_no", F.coalesce("state", F.lit("open")).alias("outcome")))
query("AG21_pooled_latency", f"WITH s AS (SELECT * FROM ({SAMPLES_SQL}) WHERE complete), u AS (SELECT completed - admitted AS ns FROM s UNION ALL SELECT completed - final_lease FROM s) SELECT count(*) AS n, min(ns) AS min, max(ns) AS max, quantile_disc(ns, 0.5) AS p50, quantile_disc(ns, 0.95) AS p95, quantile_disc(ns, 0.99) AS p99 FROM u")(
    lambda x: (lambda s: timing.distribution(s.select((F.col("completed") - F.col("admitted")).alias("ns")).unionByName(s.select((F.col("completed") - F.col("final_lease")).alias("ns"))), "ns"))(samples_of(x).where("complete"))
)
query("STR2_first_response", "SELECT tenant_id, queue_name AS submission_key, arg_min(execution_key, k) AS digest, min(execution_key) <> max(execution_key) AS conflict FROM jobs GROUP BY ALL")(
    lambda x: streams.first_response(x.jobs.select("tenant_id", F.col("queue_name").alias("submission_key"), F.col("execution_key").alias("digest"), F.col("k").alias("seq")))
)


def _all() -> None:
    """The other modules of queries, which build on this one."""
    from tidewheel import queries_checks, queries_more  # noqa: F401


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _all()
    return {name: (lambda spark, sf_dir, f=f: f(Ledger.of(spark, sf_dir))) for name, f in QUERIES.items()}


def oracles() -> dict[str, str]:
    _all()
    ctes = duckdb_ctes()
    out = {}
    for name, sql in SQL.items():
        head, _, rest = sql.partition(" ") if sql.startswith("WITH ") else ("", "", "")
        if sql.startswith("WITH RECURSIVE "):
            out[name] = f"WITH RECURSIVE {ctes}, {sql[len('WITH RECURSIVE '):]}"
        elif head == "WITH":
            out[name] = f"WITH {ctes}, {rest}"
        else:
            out[name] = f"WITH {ctes} {sql}"
    return out
