"""More of the inventory as registered queries: predicates, joins, windows, functions, evidence, commands, files and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.functions import ledger as fn
from tidewheel.functions.ledger import ACTIVE, TERMINAL
from tidewheel.operators import checks, evidence, graph, reads, scheduling, slo, timing, transitions
from tidewheel.plans.storage import discard, materialize, shared_dir, tidy, write
from tidewheel.queries import ACTIONS, BEATS, DUE_SQL, KILLS, OBSERVED, READY_SQL, SAMPLES_SQL, TIMING_SQL, observed, samples_of, timing_of
from tidewheel.queries_checks import _ctes, drained
from tidewheel.registry import NOW, TENANT, key, now_of, query
from tidewheel.sources import files
from tidewheel.sources.derive import EVENT_TYPE, JOB_ID, Ledger
from tidewheel.streaming import cron
from tidewheel.streaming import ledger as streams

LIVE = ("LEASED", "RUNNING")
OPEN = "('SUCCEEDED', 'FAILED', 'DEAD_LETTER')"
FENCED = "attempts a JOIN jobs j ON j.id = a.job_id AND j.attempt_no = a.attempt_no AND j.lease_generation = a.lease_generation WHERE a.state IN ('LEASED', 'RUNNING') AND j.state IN ('SCHEDULED', 'RUNNING')"


def folder(x: Ledger, what: str) -> str:
    return f"{shared_dir(x.spark)}/tidewheel-{what}-{uuid.uuid4().hex}"


def table(x: Ledger, name: str) -> DataFrame:
    return x.spark.read.parquet(f"{x.sf_dir}/{name}.parquet")


def blob(*parts: str) -> str:
    """DuckDB: SHA-256 of texts with a zero byte between them."""
    return f"sha256(CAST({' || unhex(chr(48) || chr(48)) || '.join(f'encode({p})' for p in parts)} AS BLOB))"


# --- sources and sinks

_KEYS = {"jobs": "id", "attempts": "job_id", "ledger_events": "job_id", "job_completions": "job_id", "idempotency_requests": "submission_key", "job_dependencies": "job_id", "queue_state": "queue_name", "tenant_limits": "tenant_id", "counters": "name", "schema_migrations": "checksum"}


def versions(x: Ledger) -> dict[str, DataFrame]:
    """The ten tables as one immutable version, written once and read back; ids, digests and texts that follow from a row's other columns are computed as it is read."""

    def make() -> dict[str, DataFrame]:
        path = folder(x, "version")
        files.save_snapshot({n: x.stored(n) for n in _KEYS}, path)
        return {n: x.restored(n, df) for n, df in files.load_snapshot(x.spark, path, list(_KEYS)).items()}

    return x.kept("version", make)


query("SRC2_tables", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n, min({k}) AS first, max({k}) AS last FROM {n}" for n, k in _KEYS.items()))(
    lambda x: checks.union([versions(x)[n].agg(F.count("*").alias("n"), F.min(k).alias("first"), F.max(k).alias("last")).select(F.lit(n).alias("name"), "n", "first", "last") for n, k in _KEYS.items()])
)
query("SRC3_snapshot", f"SELECT id, state, state_version FROM jobs WHERE state NOT IN {OPEN}")(lambda x: versions(x)["jobs"].where(~F.col("state").isin(*TERMINAL)).select("id", "state", "state_version"))


def narrow(x: Ledger) -> DataFrame:
    path = folder(x, "narrow")
    files.save_snapshot({"attempts": x.attempts}, path)
    return files.load_snapshot(x.spark, path, ["attempts"], {"attempts": ["job_id", "attempt_no", "lease_generation", "state"]})["attempts"]


query("SRC4_narrow", "SELECT job_id, attempt_no, lease_generation, state FROM attempts")(narrow)
query("SRC5_contract_text", "SELECT event_seq, job_id, CAST(NULL AS VARCHAR) AS from_state, state AS to_state, state_version FROM ledger_events")(lambda x: reads.from_text(x.spark, "SELECT event_seq, job_id, CAST(NULL AS STRING) AS from_state, state AS to_state, state_version FROM {events}", events=x.ledger_events))


def json_lines(x: Ledger) -> DataFrame:
    path = folder(x, "jsonl")
    own = x.manifest.select("sequence", "job_id", "tenant_id", "submission_key", "accepted_at", "duplicate")
    own.write.json(path)
    return files.read_jsonl(x.spark, path, own.schema)


query("SRC6_jsonl", "SELECT sequence, job_id, tenant_id, submission_key, accepted_at, duplicate FROM manifest")(json_lines)

#: One chain of decision records per DAG, in order of its jobs; `LOG` in SQL, link by link.
LOG = """WITH RECURSIVE o AS (SELECT cust, row_number() OVER (PARTITION BY cust ORDER BY created_at, id) AS sequence, '"decision":{"job_id":"' || id || '"}' AS body FROM job0),
    l AS (SELECT cust, sequence, '' AS previous_hash, '{"schema_version":1,"sequence":1,"previous_hash":"",' || body || '}' AS material FROM o WHERE sequence = 1
      UNION ALL SELECT o.cust, o.sequence, sha256(l.material), '{"schema_version":1,"sequence":' || o.sequence || ',"previous_hash":"' || sha256(l.material) || '",' || o.body || '}' FROM l JOIN o ON o.cust = l.cust AND o.sequence = l.sequence + 1),
    r AS (SELECT cust, sequence, previous_hash, material, sha256(material) AS hash FROM l)"""


def log_of(x: Ledger) -> DataFrame:
    """The log; what is written are hashes and ids as bytes, from which its texts are made as they are read."""
    decision = lambda job: F.concat(F.lit('"decision":{"job_id":"'), job, F.lit('"}'))
    text = lambda name: F.lower(F.hex(name))

    def make() -> DataFrame:
        from pyspark.sql import Window

        w = Window.partitionBy("cust").orderBy("created_at", "id")
        rows = x.jobs.select("cust", F.row_number().over(w).cast("long").alias("sequence"), decision(F.col("id")).alias("body"))
        job = F.substring("material", -35, 32)  # before the closing quote and braces
        return materialize(scheduling.chained(rows, ["cust"]).select("cust", "sequence", F.unhex(job).alias("job"), *(F.unhex(h).alias(h) for h in ("previous_hash", "hash"))), "log")

    own = x.kept("log", make).select("cust", "sequence", text("job").alias("job"), text("previous_hash").alias("previous_hash"), text("hash").alias("hash"))
    material = scheduling.record_text(F.col("sequence"), F.col("previous_hash"), decision(F.col("job")))
    return own.select("cust", "sequence", "previous_hash", material.alias("material"), "hash", F.lit(1).alias("schema_version"))


def bent_log(x: Ledger) -> DataFrame:
    """The log with a record taken out, hashes changed and a version that isn't known."""
    c = F.col
    own = log_of(x).where("NOT (cust % 17 = 1 AND sequence = 2)")
    own = own.withColumn("hash", F.when((c("cust") % 17 == 2) & (c("sequence") == 1), F.sha2(c("hash").cast("binary"), 256)).otherwise(c("hash")))
    own = own.withColumn("previous_hash", F.when((c("cust") % 17 == 3) & (c("sequence") == 2), "x").otherwise(c("previous_hash")))
    return own.withColumn("schema_version", F.when(c("cust") % 17 == 4, 2).otherwise(1))


BENT_LOG = f"""{LOG}, b AS (SELECT cust, sequence, CASE WHEN cust % 17 = 3 AND sequence = 2 THEN 'x' ELSE previous_hash END AS previous_hash, material, CASE WHEN cust % 17 = 2 AND sequence = 1 THEN sha256(hash) ELSE hash END AS hash, CASE WHEN cust % 17 = 4 THEN 2 ELSE 1 END AS schema_version FROM r WHERE NOT (cust % 17 = 1 AND sequence = 2)),
    w AS (SELECT b.*, lag(hash) OVER o AS wanted, lag(sequence) OVER o AS before FROM b WINDOW o AS (PARTITION BY cust ORDER BY sequence)),
    v AS (SELECT 'unsupported schema' AS message FROM w WHERE schema_version <> 1 UNION ALL SELECT 'sequence not contiguous' FROM w WHERE sequence <> 1 AND coalesce(before, 0) <> sequence - 1
    UNION ALL SELECT 'previous hash differs' FROM w WHERE sequence = 1 AND previous_hash <> '' OR sequence > 1 AND before = sequence - 1 AND previous_hash <> wanted UNION ALL SELECT 'hash differs' FROM w WHERE sha256(material) <> hash)"""
query("SCH5_chained_records", f"{LOG} SELECT cust, sequence, previous_hash, hash FROM r")(lambda x: log_of(x).select("cust", "sequence", "previous_hash", "hash"))
query("RPL5_appended_material", f"{LOG} SELECT cust, sequence, material FROM r")(lambda x: log_of(x).select("cust", "sequence", "material"))
query("TK7_chain_heads", f"{LOG} SELECT cust, max(sequence) AS sequence, arg_max(hash, sequence) AS hash FROM r GROUP BY cust")(lambda x: reads.heads(log_of(x), ["cust"]))
query("RPL2_chain_faults", f"{BENT_LOG} SELECT message, count(*) AS n FROM v GROUP BY message")(lambda x: scheduling.chain_faults(bent_log(x), by=["cust"]).groupBy("message").agg(F.count("*").alias("n")))
query("WN7_chain_breaks", f"{BENT_LOG} SELECT cust, count(*) AS n FROM w WHERE before = sequence - 1 AND previous_hash <> wanted GROUP BY cust")(lambda x: scheduling.chain_faults(bent_log(x), by=["cust"]).where("message = 'previous hash differs'").groupBy("cust").agg(F.count("*").alias("n")))


def read_log(x: Ledger) -> DataFrame:
    """The records through a file of strict JSON lines, and its chains checked."""
    path = folder(x, "records")
    own = log_of(x).select("cust", "schema_version", "sequence", "previous_hash", "hash", "material")
    own.write.json(path)
    back = materialize(files.read_jsonl(x.spark, path, own.schema), "records")
    bad = scheduling.chain_faults(back, by=["cust"]).groupBy("cust").agg(F.count("*").alias("faults"))
    return back.groupBy("cust").agg(F.count("*").alias("n")).join(bad, "cust", "left").select("cust", "n", F.coalesce("faults", F.lit(0)).alias("faults"))


query("SRC7_log_read", f"{LOG} SELECT cust, count(*) AS n, CAST(0 AS BIGINT) AS faults FROM r GROUP BY cust")(read_log)
_LINE = "'{\"sequence\":' || event_seq || ',\"job_id\":\"' || job_id || '\"}'"


def event_lines(x: Ledger) -> DataFrame:
    return x.ledger_events.select(F.col("event_seq").alias("sequence"), F.concat(F.lit('{"sequence":'), F.col("event_seq").cast("string"), F.lit(',"job_id":"'), F.col("job_id"), F.lit('"}')).alias("line"))


def exported(x: Ledger) -> DataFrame:
    path = folder(x, "export")
    files.write_log(event_lines(x), path)
    return x.spark.read.text(path).select(F.col("value").alias("line"))


query("SRC8_log_export", f"SELECT {_LINE} AS line FROM ledger_events")(exported)
query("SNK1_range_digests", f"SELECT (event_seq - 1) // 1000 * 1000 + 1 AS first, count(*) AS n, sha256(string_agg({_LINE} || chr(10), '' ORDER BY event_seq)) AS sha256 FROM ledger_events GROUP BY ALL")(lambda x: scheduling.range_digests(event_lines(x)))
_PATH = "'part/' || p_partkey || '.bin'"
query(
    "SNK2_mismatches",
    f"""SELECT CASE WHEN p_partkey % 11 = 4 THEN 'part/../' || p_partkey ELSE {_PATH} END AS path, CASE p_partkey % 11 WHEN 1 THEN 'differs' WHEN 2 THEN 'missing' WHEN 3 THEN 'unlisted' ELSE 'path escapes' END AS message FROM part WHERE p_partkey % 11 BETWEEN 1 AND 4""",
)(
    lambda x: (lambda p: files.mismatches(p.where("p_partkey % 11 <> 2").select("path", "sha256"), p.where("p_partkey % 11 <> 3").select("path", F.when(F.col("p_partkey") % 11 == 1, "0").otherwise(F.col("sha256")).alias("sha256"))))(
        table(x, "part").select("p_partkey", F.when(F.col("p_partkey") % 11 == 4, F.concat(F.lit("part/../"), F.col("p_partkey").cast("string"))).otherwise(F.concat(F.lit("part/"), F.col("p_partkey").cast("string"), F.lit(".bin"))).alias("path"), F.sha2(F.col("p_partkey").cast("string").cast("binary"), 256).alias("sha256"))
    )
)


def digests(x: Ledger) -> DataFrame:
    """SHA-256 of three files, one per table."""
    root = folder(x, "files")
    for n in ("jobs", "attempts", "ledger_events"):
        x.table(n).agg(F.count("*").cast("string").alias("value")).coalesce(1).write.text(f"{root}/{n}")
    return files.checksums(x.spark, root).where("path LIKE '%.txt'").select(F.element_at(F.split("path", "/"), -2).alias("name"), "sha256")


query("SNK3_file_digests", " UNION ALL ".join(f"SELECT '{n}' AS name, sha256(CAST(count(*) AS VARCHAR) || chr(10)) AS sha256 FROM {n}" for n in ("jobs", "attempts", "ledger_events")))(digests)
query("SNK4_exposition", "SELECT 'jobs' AS metric, 'jobs{queue=\"' || queue_name || '\",state=\"' || state || '\"} ' || count(*) AS line FROM jobs GROUP BY queue_name, state")(
    lambda x: slo.exposition(x.jobs.groupBy("queue_name", "state").agg(F.count("*").alias("value")).select(F.lit("jobs").alias("metric"), F.create_map(F.lit("state"), F.col("state"), F.lit("queue"), F.col("queue_name")).alias("labels"), "value"))
)

# --- predicates

query("FLT1_ready", f"SELECT id FROM ({READY_SQL})")(lambda x: reads.ready_candidates(x.jobs, x.tenant_limits, x.queue_state, now_of(x), reads.BIG).select("id"))
query("FLT2_open", f"SELECT id, state FROM jobs WHERE state NOT IN {OPEN}")(lambda x: x.jobs.where(~F.col("state").isin(*TERMINAL)).select("id", "state"))
query("FLT3_expired", f"SELECT job_id, attempt_no FROM attempts WHERE state IN ('LEASED', 'RUNNING') AND expires_at <= {NOW}")(lambda x: x.attempts.where(F.col("state").isin(*LIVE) & (F.col("expires_at") <= now_of(x))).select("job_id", "attempt_no"))
query("FLT4_fenced", f"SELECT a.job_id, a.attempt_no, a.lease_generation, slot_cost FROM {FENCED}")(lambda x: reads.fenced_leases(x.attempts, x.jobs).select("job_id", "attempt_no", "lease_generation", "slot_cost"))
query("FLT5_audit_range", f"SELECT id, actor FROM audit_events WHERE occurred_at BETWEEN {NOW} - 86400000000000 * 900 AND {NOW}")(lambda x: reads.audit(x.audit_events, now_of(x) - 86_400_000_000_000 * 900, now_of(x)).select("id", "actor"))
query("FLT6_open_dead_letters", "SELECT job_id FROM dead_letters WHERE redriven_job_id IS NULL")(lambda x: x.dead_letters.where(F.col("redriven_job_id").isNull()).select("job_id"))
_FENCES = "SELECT job_id, attempt_no, lease_generation + CASE WHEN k % 200 = 0 THEN 100 ELSE 0 END AS lease_generation FROM {0}"
_LEASED = f"SELECT f.job_id, f.attempt_no, f.lease_generation, a.state, CASE WHEN a.job_id IS NOT NULL THEN coalesce(a.completed_at, 0) END AS completed_at FROM ({_FENCES.format('attempts')}) f LEFT JOIN attempts a ON a.job_id = f.job_id AND a.attempt_no = f.attempt_no AND a.lease_generation = f.lease_generation"


def fences(x: Ledger) -> DataFrame:
    return reads.lease_states(x.attempts, x.spark.sql(_FENCES.format("{attempts}"), attempts=x.attempts))


query("JN17_fence_lookup", _LEASED)(fences)
query("FLT7_lease_fences", f"SELECT * FROM ({_LEASED}) WHERE state IS NOT NULL")(lambda x: fences(x).where(F.col("state").isNotNull()))
query("FLT8_jobs_in_list", "SELECT a.job_id, a.attempt_no, a.lease_generation, a.leased_at, coalesce(c.committed_at, 0) AS committed_at FROM attempts a LEFT JOIN job_completions c ON c.job_id = a.job_id WHERE a.job_id IN (SELECT job_id FROM dead_letters)")(lambda x: reads.attempts_of(x.attempts, x.job_completions, x.dead_letters))
query(
    "FLT9_constraints",
    f"""WITH {_ctes(True)}, v AS (SELECT 'terminal_at is null' AS rule FROM f_jobs WHERE terminal_at IS NULL UNION ALL SELECT 'slot_cost >= 1' FROM f_jobs WHERE NOT slot_cost >= 1 UNION ALL SELECT 'state known' FROM f_jobs WHERE state NOT IN ('SUCCEEDED')
    UNION ALL SELECT 'id repeated' FROM (SELECT id FROM f_jobs GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'tenant_id unknown' FROM f_jobs WHERE tenant_id NOT IN (SELECT tenant_id FROM f_tenants)) SELECT rule, count(*) AS n FROM v GROUP BY rule""",
)(lambda x: checks.constraints(drained(x, True)["jobs"], ["terminal_at"], {"slot_cost >= 1": F.col("slot_cost") >= 1, "state known": F.col("state") == "SUCCEEDED"}, [["id"]], {"tenant_id": drained(x, True)["tenants"]}))

# --- joins

query("JN1_ready_join", f"SELECT id, tenant_id, queue_name, weight, deficit FROM ({READY_SQL})")(lambda x: reads.ready_candidates(x.jobs, x.tenant_limits, x.queue_state, now_of(x), reads.BIG).select("id", "tenant_id", "queue_name", "weight", "deficit"))
query("JN3_worker_leases", f"SELECT w.worker_id, l.job_id FROM workers w LEFT JOIN (SELECT a.worker_id, a.job_id FROM {FENCED}) l ON l.worker_id = w.worker_id")(lambda x: x.workers.select("worker_id").join(reads.fenced_leases(x.attempts, x.jobs).select("worker_id", "job_id"), "worker_id", "left"))
query("JN4_expired_fences", f"SELECT a.job_id, a.attempt_no, a.lease_generation, a.expires_at FROM {FENCED} AND a.expires_at <= {NOW}")(lambda x: reads.fenced_leases(x.attempts, x.jobs).where(F.col("expires_at") <= now_of(x)).select("job_id", "attempt_no", "lease_generation", "expires_at"))
query("JN6_dag_nodes", "SELECT g.dag_id, g.node_key, j.id, j.state FROM dag_jobs g JOIN jobs j ON j.id = g.job_id")(lambda x: reads.run_view(x.jobs, x.dag_jobs, x.job_dependencies).select("dag_id", "node_key", F.col("job_id").alias("id"), "state"))
query("JN7_dag_of_job", "SELECT j.id, coalesce(g.dag_id, '') AS dag FROM jobs j LEFT JOIN dag_jobs g ON g.job_id = j.id")(lambda x: x.jobs.select("id").join(x.dag_jobs.select(F.col("job_id").alias("id"), "dag_id"), "id", "left").select("id", F.coalesce("dag_id", F.lit("")).alias("dag")))
query("JN8_no_open_parent", "SELECT id FROM jobs j WHERE NOT EXISTS (SELECT 1 FROM job_dependencies d JOIN jobs p ON p.id = d.depends_on_id WHERE d.job_id = j.id AND p.state <> 'SUCCEEDED')")(lambda x: reads.without_open_parent(x.jobs, x.job_dependencies, x.jobs).select("id"))
query("JN9_accepted_heartbeats", f"SELECT job_id, attempt_no FROM attempts a WHERE a.state IN ('LEASED', 'RUNNING') AND expires_at > {NOW} - 86400000000000 * 900 AND EXISTS (SELECT 1 FROM jobs j WHERE j.id = a.job_id AND j.attempt_no = a.attempt_no AND j.lease_generation = a.lease_generation)")(
    lambda x: transitions.heartbeat(x.attempts.select("job_id", "attempt_no", "token_hash"), x.attempts, 1, now_of(x) - 86_400_000_000_000 * 900).where("accepted").join(x.jobs.select(F.col("id").alias("job_id"), "attempt_no"), ["job_id", "attempt_no"], "left_semi").select("job_id", "attempt_no")
)
query("JN10_lost_leases", f"SELECT event_seq, lease_recovery FROM ({TIMING_SQL}) WHERE lease_recovery IS NOT NULL")(lambda x: timing_of(x).where(F.col("lease_recovery").isNotNull()).select("event_seq", "lease_recovery"))
query("JN12_event_attempts", "SELECT e.event_seq, a.leased_at FROM ledger_events e LEFT JOIN attempts a ON a.job_id = e.job_id AND a.attempt_no = CAST(json_extract(e.payload_json, '$.attempt_no') AS BIGINT)")(
    lambda x: x.ledger_events.select("event_seq", "job_id", fn.attempt_of(F.col("payload_json")).alias("attempt_no")).join(x.attempts.select("job_id", "attempt_no", "leased_at"), ["job_id", "attempt_no"], "left").select("event_seq", "leased_at")
)


def previous(x: Ledger) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("job_id").orderBy("attempt_no")
    own = x.attempts.select("job_id", "attempt_no", F.when((F.lag("state").over(w) == "EXPIRED") & (F.lag("attempt_no").over(w) == F.col("attempt_no") - 1), F.lag("completed_at").over(w)).alias("lost_at"))
    return own.where(F.col("lost_at").isNotNull())


query("JN13_previous_expired", "SELECT a.job_id, a.attempt_no, p.completed_at AS lost_at FROM attempts a JOIN attempts p ON p.job_id = a.job_id AND p.attempt_no = a.attempt_no - 1 AND p.state = 'EXPIRED'")(previous)
query("JN14_event_completions", "SELECT e.event_seq, c.state FROM ledger_events e JOIN job_completions c ON c.job_id = e.job_id AND c.committed_at = e.occurred_at")(lambda x: x.ledger_events.select("event_seq", "job_id", F.col("occurred_at").alias("committed_at")).join(x.job_completions.select("job_id", "committed_at", "state"), ["job_id", "committed_at"]).select("event_seq", "state"))
query("JN15_successors", "SELECT a.job_id, a.lease_generation AS killed, min(b.lease_generation) AS successor, arg_min(b.leased_at, b.lease_generation) AS leased_at FROM attempts a LEFT JOIN attempts b ON b.job_id = a.job_id AND b.lease_generation > a.lease_generation WHERE a.state = 'EXPIRED' GROUP BY a.job_id, a.lease_generation")(
    lambda x: evidence.recoveries(x.attempts.where("state = 'EXPIRED'").select(F.col("lease_generation").alias("kill_sequence"), "job_id", F.col("lease_generation").alias("killed_generation"), F.col("completed_at").alias("killed_at")), x.attempts).select("job_id", F.col("killed_generation").alias("killed"), F.col("generation").alias("successor"), "leased_at")
)
query("JN20_children", "SELECT d.job_id AS id, count(*) FILTER (WHERE p.state <> 'SUCCEEDED') AS open_parents FROM job_dependencies d JOIN jobs p ON p.id = d.depends_on_id WHERE d.job_id IN (SELECT d.job_id FROM job_dependencies d JOIN jobs p ON p.id = d.depends_on_id WHERE p.state = 'SUCCEEDED') GROUP BY d.job_id")(lambda x: reads.children(x.jobs.where("state = 'SUCCEEDED'").select("id"), x.job_dependencies, x.jobs))
query("JN22_after_restart", f"SELECT j.tenant_id, count(*) AS n, min(a.leased_at) AS first FROM attempts a JOIN jobs j ON j.id = a.job_id WHERE a.leased_at > {NOW} - 86400000000000 * 400 GROUP BY j.tenant_id")(
    lambda x: x.attempts.where(F.col("leased_at") > now_of(x) - 86_400_000_000_000 * 400).join(x.jobs.select(F.col("id").alias("job_id"), "tenant_id"), "job_id").groupBy("tenant_id").agg(F.count("*").alias("n"), F.min("leased_at").alias("first"))
)

# --- aggregates and windows

_RUNS = "SELECT k % 4 AS run, k % 4 = 0 AS warmup, count(*) * 60e9 / (max(leased_at) - min(leased_at)) AS per_minute, 'c' AS config FROM {0} GROUP BY k % 4"


def runs_of(x: Ledger) -> DataFrame:
    return x.spark.sql(_RUNS.format("{attempts}"), attempts=x.attempts)


query("AG20_median_rate", f"SELECT round(median(per_minute), 6) AS median FROM ({_RUNS.format('attempts')}) WHERE NOT warmup")(lambda x: evidence.suite(runs_of(x)).select(F.round("median", 6).alias("median")))
query("EV6_suite", f"SELECT count(*) FILTER (WHERE warmup) = 1 AND count(*) FILTER (WHERE NOT warmup) = 3 AND count(DISTINCT config) = 1 AS valid, round(median(per_minute) FILTER (WHERE NOT warmup), 6) AS median FROM ({_RUNS.format('attempts')})")(lambda x: evidence.suite(runs_of(x)).select("valid", F.round("median", 6).alias("median")))

SENT = """SELECT CASE WHEN k % 89 = 1 THEN 'r2' ELSE 'r1' END AS run_id, 7 AS seed, CASE WHEN k % 89 = 2 THEN 1 ELSE sequence END AS index, job_id, CASE WHEN k % 89 = 3 THEN 'refused' ELSE '' END AS error, k % 89 = 4 AS duplicate, k % 178 = 4 AS ambiguous_retry, CASE WHEN k % 89 = 5 THEN 0 ELSE 1 END AS attempt_count, k FROM {0}"""
DRAINED = """SELECT CASE WHEN k % 89 = 6 THEN 'r2' ELSE 'r1' END AS run_id, CASE WHEN k % 89 = 7 THEN md5(job_id) ELSE job_id END AS job_id, CASE WHEN k % 89 = 8 THEN 'RUNNING' ELSE 'SUCCEEDED' END AS state, CASE WHEN k % 89 = 9 THEN NULL ELSE accepted_at END AS terminal_at FROM {0} WHERE k % 89 <> 10 UNION ALL SELECT 'r1', job_id, 'SUCCEEDED', accepted_at FROM {0} WHERE k % 89 = 11"""
_STABLE = "'key-' || substr(" + blob("'domain'", "run_id", "'7'", "CAST(index AS VARCHAR)") + ", 1, 48)"
SUBMISSIONS = f"""WITH s0 AS ({SENT.format('manifest')}), s AS (SELECT *, CASE WHEN k % 89 = 12 THEN 'key-' || k ELSE {_STABLE} END AS key, {_STABLE} AS wanted FROM s0), d AS ({DRAINED.format('manifest')}), v AS (
    SELECT 'submission of another run' AS rule FROM s WHERE run_id <> 'r1' UNION ALL SELECT 'submission failed' FROM s WHERE error <> '' UNION ALL SELECT 'reused an admission' FROM s WHERE duplicate AND NOT ambiguous_retry UNION ALL SELECT 'no attempts' FROM s WHERE attempt_count < 1
    UNION ALL SELECT 'unstable key' FROM s WHERE key <> wanted UNION ALL SELECT 'duplicate index' FROM (SELECT index FROM s GROUP BY index HAVING count(*) > 1) UNION ALL SELECT 'duplicate key' FROM (SELECT key FROM s GROUP BY key HAVING count(*) > 1)
    UNION ALL SELECT 'duplicate drain sample' FROM (SELECT job_id FROM d GROUP BY job_id HAVING count(*) > 1) UNION ALL SELECT 'drain sample not terminal' FROM d WHERE state <> 'SUCCEEDED' OR terminal_at IS NULL UNION ALL SELECT 'drain sample of another run' FROM d WHERE run_id <> 'r1'
    UNION ALL SELECT 'drained job never submitted' FROM (SELECT DISTINCT job_id FROM d) WHERE job_id NOT IN (SELECT job_id FROM s) UNION ALL SELECT 'submitted job not drained' FROM (SELECT DISTINCT job_id FROM s) WHERE job_id NOT IN (SELECT job_id FROM d)
    UNION ALL SELECT 'unexpected count' FROM (SELECT count(*) AS n FROM s) WHERE n <> 5000)"""


def submitted(x: Ledger) -> DataFrame:
    sent = x.spark.sql(SENT.format("{manifest}"), manifest=x.manifest)
    stable = fn.stable_key("domain", "key-", F.col("run_id"), F.col("seed"), F.col("index"))
    sent = sent.withColumn("idempotency_key", F.when(F.col("k") % 89 == 12, F.concat(F.lit("key-"), F.col("k").cast("string"))).otherwise(stable))
    return evidence.submissions(sent, x.spark.sql(DRAINED.format("{manifest}"), manifest=x.manifest), "r1", "domain", "key-", 5000)


query("EV3_submissions", f"{SUBMISSIONS} SELECT rule, count(*) AS n FROM v GROUP BY rule")(lambda x: submitted(x).groupBy("rule").agg(F.count("*").alias("n")))
query("AG23_stable_keys", f"{SUBMISSIONS} SELECT rule, count(*) AS n FROM v WHERE rule IN ('unstable key', 'duplicate index', 'duplicate key') GROUP BY rule")(lambda x: submitted(x).where("rule IN ('unstable key', 'duplicate index', 'duplicate key')").groupBy("rule").agg(F.count("*").alias("n")))
query("WN8_first_and_last", f"SELECT job_id, first_lease, final_lease FROM ({SAMPLES_SQL}) WHERE first_lease IS NOT NULL")(lambda x: samples_of(x).where("first_lease is not null").select("job_id", "first_lease", "final_lease"))
query("SO1_union_of_scalars", "SELECT greatest((SELECT max(created_at) FROM jobs), (SELECT max(created_at) FROM dead_letters), (SELECT max(last_heartbeat_at) FROM workers)) AS clock_ns")(lambda x: reads.logical_clock(jobs=(x.jobs, ["created_at"]), dead=(x.dead_letters, ["created_at"]), workers=(x.workers, ["last_heartbeat_at"])))
query("SO3_reachable", "WITH RECURSIVE c AS (SELECT d.job_id AS id FROM job_dependencies d JOIN jobs p ON p.id = d.depends_on_id WHERE p.state IN ('FAILED', 'DEAD_LETTER') UNION SELECT d.job_id FROM c JOIN job_dependencies d ON d.depends_on_id = c.id) SELECT id FROM c")(lambda x: x.identified(graph.descendants(x.numbered_edges(), x.numbers().where("state IN ('FAILED', 'DEAD_LETTER')").select("id"))))
query("TK5_due_cron", f"SELECT tenant_id || '/' || queue_name AS id, {NOW} + (weight - 2) * 3600000000000 AS nominal_at FROM queue_state WHERE weight <= 2 ORDER BY nominal_at, id LIMIT 20")(lambda x: cron.due(triggers_of(x), now_of(x), 20).select("id", "nominal_at"))


def triggers_of(x: Ledger) -> DataFrame:
    """Triggers of every queue, some of them due."""
    schedule = F.when(F.col("weight") > 1, "@hourly").otherwise("*/5 * * * *")
    return x.queue_state.select(F.concat_ws("/", "tenant_id", "queue_name").alias("id"), schedule.alias("schedule"), (F.lit(now_of(x)) + (F.col("weight") - 2) * 3_600_000_000_000).alias("next_fire_at"))


_HOUR, _FIVE = "3600000000000", "300000000000"
_DUE = f"SELECT tenant_id || '/' || queue_name AS id, {NOW} + (weight - 2) * {_HOUR} AS nominal_at, CASE WHEN weight > 1 THEN ({NOW} // {_HOUR} + 1) * {_HOUR} ELSE ({NOW} // {_FIVE} + 1) * {_FIVE} END AS next FROM queue_state WHERE weight <= 2 ORDER BY nominal_at, id LIMIT 1000"
query("STR3_due_triggers", _DUE)(lambda x: cron.due(triggers_of(x), now_of(x), 1000))
_ISO = "strftime(make_timestamp(nominal_at // 1000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN nominal_at % 1000000000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(nominal_at % 1000000000 AS VARCHAR), 9, '0'), '0') END || 'Z'"
query("SRC10_occurrences", f"SELECT id, 'cron:' || {blob('id', _ISO)} AS submission_key FROM ({_DUE})")(lambda x: cron.due(triggers_of(x), now_of(x), 1000).select("id", fn.cron_key(F.col("id"), fn.rfc3339_nano(F.col("nominal_at"))).alias("submission_key")))

# --- scalar functions

query("SC1_scalars", "SELECT id, coalesce(terminal_at, 0) AS ended, greatest(created_at, updated_at) AS latest, CASE WHEN attempt_no > 1 THEN 'again' ELSE 'once' END AS how FROM jobs")(lambda x: x.jobs.select("id", F.coalesce("terminal_at", F.lit(0)).alias("ended"), F.greatest("created_at", "updated_at").alias("latest"), F.when(F.col("attempt_no") > 1, "again").otherwise("once").alias("how")))
query("SC2_json", "SELECT id, json_valid(retry_json) AS valid, CAST(json_extract(retry_json, '$.max_attempts') AS BIGINT) AS most, replace(retry_json, '\"max_attempts\":' || max_attempts, '\"max_attempts\":9') AS changed, substr(retry_json, 1, length(retry_json) - 1) || ',\"x\":' || k || chr(125) AS more FROM jobs")(
    lambda x: x.jobs.select("id", F.try_parse_json("retry_json").isNotNull().alias("valid"), F.get_json_object("retry_json", "$.max_attempts").cast("long").alias("most"), fn.json_set(F.col("retry_json"), "max_attempts", F.lit("9")).alias("changed"), fn.json_set(F.col("retry_json"), "x", F.col("k").cast("string")).alias("more"))
)
query("SC3_casts", "SELECT worker_id, CAST(substr(worker_id, 8) AS BIGINT) AS number, octet_length(encode(worker_id)) AS bytes, lower(typeof(CAST(capacity_slots AS BIGINT))) AS kind FROM workers")(lambda x: x.workers.select("worker_id", F.substring("worker_id", 8, 30).cast("long").alias("number"), F.octet_length(F.col("worker_id").cast("binary")).alias("bytes"), F.typeof(F.col("capacity_slots").cast("long")).alias("kind")))
query("SC4_concatenation", "SELECT 'queue/' || tenant_id || '/' || queue_name AS label FROM queue_state")(lambda x: x.queue_state.select(F.concat(F.lit("queue/"), F.col("tenant_id"), F.lit("/"), F.col("queue_name")).alias("label")))
query("SC5_token_hash", "SELECT job_id, attempt_no, sha256('token-' || job_id) AS hash FROM attempts")(lambda x: x.attempts.select("job_id", "attempt_no", fn.sha_hex(F.concat(F.lit("token-"), F.col("job_id"))).alias("hash")))
_ODD = "tenant_id || ' <&> \"' || queue_name || '\" \\ ' || chr(9) || chr(10) || chr(8232) || 'é'"
_ESCAPED = f"""'"' || replace(replace(replace(replace(replace(replace(replace(replace({_ODD}, '\\', '\\\\'), '"', '\\"'), chr(9), '\\t'), chr(10), '\\n'), '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026'), chr(8232), '\\u2028') || '"'"""


def odd_text() -> F.Column:
    return F.concat(F.col("tenant_id"), F.lit(' <&> "'), F.col("queue_name"), F.lit('" \\ \t\n é'))


query("SC15_canonical_json", f"SELECT tenant_id, queue_name, {_ESCAPED} AS text FROM queue_state")(lambda x: x.queue_state.select("tenant_id", "queue_name", fn.json_text(odd_text()).alias("text")))
query("SC6_request_digest", f"SELECT tenant_id, queue_name, sha256('{{\"tenant_id\":' || {_ESCAPED} || ',\"weight\":' || weight || ',\"queues\":[]}}') AS digest FROM queue_state")(
    lambda x: x.queue_state.select("tenant_id", "queue_name", fn.request_digest(tenant_id=fn.json_text(odd_text()), weight=F.col("weight").cast("string"), queues=F.lit("[]")).alias("digest"))
)
query("SC8_audit_keys", f"SELECT id, {blob('actor', 'action', 'target')} AS scope, 'audit-' || substr({blob('actor', 'action', 'target')}, 1, 24) AS audit_id FROM audit_events")(lambda x: x.audit_events.select("id", fn.scoped_key(F.col("actor"), F.col("action"), F.col("target")).alias("scope"), fn.audit_id(F.col("actor"), F.col("action"), F.col("target")).alias("audit_id")))
_JOB_ISO = _ISO.replace("nominal_at", "created_at")
query("SC9_cron_keys", f"SELECT id, 'cron:' || {blob('tenant_id', _JOB_ISO)} AS key FROM jobs")(lambda x: x.jobs.select("id", fn.cron_key(F.col("tenant_id"), fn.rfc3339_nano(F.col("created_at"))).alias("key")))
query("SC10_delivery_keys", "SELECT id, 'redis:' || tenant_id || ':' || queue_name || ':' || k AS key FROM jobs")(lambda x: x.jobs.select("id", fn.delivery_key(F.col("tenant_id"), F.col("queue_name"), F.col("k").cast("string")).alias("key")))
query("SC11_benchmark_keys", "SELECT k, 'bench-' || substr(" + blob("'domain'", "'run'", "CAST(cust AS VARCHAR)", "CAST(k AS VARCHAR)") + ", 1, 48) AS key FROM jobs")(lambda x: x.jobs.select("k", fn.stable_key("domain", "bench-", F.lit("run"), F.col("cust"), F.col("k")).alias("key")))
query("SC13_ages", f"SELECT id, greatest(0, {NOW} - created_at) // 1000000 AS age, greatest(0, created_at - {NOW}) // 1000000 AS ahead FROM jobs")(lambda x: x.jobs.select("id", fn.age_ms(now_of(x), F.col("created_at")).alias("age"), F.call_function("div", F.greatest(F.lit(0), F.col("created_at") - now_of(x)), F.lit(1_000_000)).alias("ahead")))
query("SC14_health", "SELECT ms, CASE WHEN ms <= 30000 THEN 'healthy' WHEN ms <= 120000 THEN 'stale' ELSE 'offline' END AS status FROM (SELECT s * 500 AS ms FROM range(0, 300) t(s))")(lambda x: x.spark.range(300).select((F.col("id") * 500).alias("ms")).select("ms", fn.health(F.col("ms")).alias("status")))
query("SC16_durations", "SELECT job_id, attempt_no, CASE WHEN completed_at >= started_at THEN completed_at - started_at END AS ran, CASE WHEN leased_at >= heartbeat_at THEN leased_at - heartbeat_at END AS back FROM attempts")(lambda x: x.attempts.select("job_id", "attempt_no", fn.duration_between(F.col("started_at"), F.col("completed_at")).alias("ran"), fn.duration_between(F.col("heartbeat_at"), F.col("leased_at")).alias("back")))
query("SC19_validity", "SELECT id, regexp_full_match(CASE WHEN k % 3 = 0 THEN upper(id) ELSE id END, '[0-9a-f]{32}') AS good_id, regexp_full_match(CASE WHEN k % 5 = 0 THEN id ELSE execution_key END, '[0-9a-f]{64}') AS good_digest FROM jobs")(
    lambda x: x.jobs.select("id", fn.is_id(F.when(F.col("k") % 3 == 0, F.upper("id")).otherwise(F.col("id"))).alias("good_id"), fn.is_digest(F.when(F.col("k") % 5 == 0, F.col("id")).otherwise(F.col("execution_key"))).alias("good_digest"))
)
query("SC20_clock_mapping", "SELECT job_id, attempt_no, heartbeat_at - (leased_at + (expires_at - leased_at) // 2) AS shift, (expires_at - leased_at + 1) // 2 AS uncertainty FROM attempts")(
    lambda x: (lambda m: x.attempts.select("job_id", "attempt_no", m[0].alias("shift"), m[1].alias("uncertainty")))(fn.mapped_clock(F.col("heartbeat_at"), F.col("leased_at"), F.col("expires_at")))
)

# --- graph

_BENT = """n AS (SELECT dag_id, CASE WHEN node_key LIKE '%77' THEN ' ' ELSE node_key END AS id FROM dag_jobs UNION ALL SELECT dag_id, node_key FROM dag_jobs WHERE node_key LIKE '%13'),
    e0 AS (SELECT c.dag_id, c.node_key AS id, p.node_key AS parent FROM job_dependencies d JOIN dag_jobs c ON c.job_id = d.job_id JOIN dag_jobs p ON p.job_id = d.depends_on_id AND p.dag_id = c.dag_id),
    e AS (SELECT dag_id, id, CASE WHEN id LIKE '%31' THEN 'gone' WHEN id LIKE '%41' THEN id ELSE parent END AS parent FROM e0 UNION ALL SELECT dag_id, id, parent FROM e0 WHERE id LIKE '%51')"""


def workflow(x: Ledger) -> DataFrame:
    c = F.col
    nodes = x.dag_jobs.select("dag_id", F.when(c("node_key").endswith("77"), " ").otherwise(c("node_key")).alias("id")).unionByName(x.dag_jobs.where("node_key LIKE '%13'").select("dag_id", c("node_key").alias("id")))
    own = reads.dag_edges(x.job_dependencies, x.dag_jobs).withColumnRenamed("node", "id")
    bent = own.withColumn("parent", F.when(c("id").endswith("31"), "gone").when(c("id").endswith("41"), c("id")).otherwise(c("parent")))
    return graph.validate(nodes, bent.unionByName(own.where("id LIKE '%51'")))


query("GR4_workflow_faults", f"WITH {_BENT}, v AS (SELECT dag_id, 'blank key' AS message FROM n WHERE trim(id) = '' UNION ALL SELECT dag_id, 'duplicate key' FROM (SELECT dag_id, id FROM n GROUP BY dag_id, id HAVING count(*) > 1) UNION ALL SELECT dag_id, 'unknown parent' FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.dag_id = e.dag_id AND n.id = e.parent) UNION ALL SELECT dag_id, 'duplicate parent' FROM (SELECT dag_id, id, parent FROM e GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT dag_id, 'own parent' FROM e WHERE id = parent) SELECT dag_id, message, count(*) AS n FROM v GROUP BY ALL")(
    lambda x: workflow(x).groupBy("dag_id", "message").agg(F.count("*").alias("n"))
)

#: DAGs that branch: node i of a DAG hangs on i div 2 and, where i is a multiple of 3, on i - 1; one DAG in seven has a cycle of its first two nodes.
_TREE = """t AS (SELECT cust, row_number() OVER (PARTITION BY cust ORDER BY created_at, id) AS i FROM job0), n AS (SELECT cust AS d, i FROM t),
    e AS (SELECT d, i, i // 2 AS p FROM n WHERE i > 1 UNION SELECT d, i, i - 1 FROM n WHERE i % 3 = 0 AND i > 1 UNION SELECT d, 1, 2 FROM n WHERE i = 2 AND d % 7 = 0)"""


def trees(x: Ledger) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("cust").orderBy("created_at", "id")).cast("long")
    n = materialize(x.jobs.select(F.col("cust").alias("d"), i.alias("i")), "trees")
    e = n.where("i > 1").selectExpr("d", "i", "i div 2 AS p").union(n.where("i % 3 = 0 AND i > 1").selectExpr("d", "i", "i - 1")).union(n.where("i = 2 AND d % 7 = 0").selectExpr("d", "1L", "2L")).distinct()
    name = lambda c: F.format_string("n%03d", F.pmod(F.col(c) * 37, F.lit(1000)))
    nodes = n.select(F.col("d").cast("string").alias("dag_id"), name("i").alias("id"))
    return nodes, e.select(F.col("d").cast("string").alias("dag_id"), name("i").alias("id"), name("p").alias("parent"))


_NODE = "'n' || lpad(CAST({0} * 37 % 1000 AS VARCHAR), 3, '0')"
query(
    "GR3_branching_levels",
    f"""WITH RECURSIVE {_TREE}, up AS (SELECT d, i, p FROM e UNION SELECT up.d, up.i, e.p FROM up JOIN e ON e.d = up.d AND e.i = up.p), bent AS (SELECT DISTINCT d, i FROM up WHERE i = p),
    off AS (SELECT d, i FROM bent UNION SELECT up.d, up.i FROM up JOIN bent ON bent.d = up.d AND bent.i = up.p),
    walk AS (SELECT d, i, 0 AS l FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.d = n.d AND e.i = n.i) UNION SELECT e.d, e.i, l + 1 FROM walk JOIN e ON e.d = walk.d AND e.p = walk.i WHERE NOT EXISTS (SELECT 1 FROM off WHERE off.d = e.d AND off.i = e.i))
    SELECT CAST(n.d AS VARCHAR) AS dag_id, {_NODE.format('n.i')} AS id, max(l) AS level FROM n LEFT JOIN walk ON walk.d = n.d AND walk.i = n.i GROUP BY n.d, n.i""",
)(lambda x: graph.levels(*trees(x)))
#: Each step of the recursion takes the least ready node of every DAG; a DAG with a cycle has no rows.
query(
    "GR2_branching_order",
    f"""WITH RECURSIVE {_TREE}, up AS (SELECT d, i, p FROM e UNION SELECT up.d, up.i, e.p FROM up JOIN e ON e.d = up.d AND e.i = up.p),
    g AS (SELECT n.d, list({_NODE.format('n.i')} ORDER BY {_NODE.format('n.i')}) AS ids, count(*) AS size FROM n WHERE NOT EXISTS (SELECT 1 FROM up WHERE up.d = n.d AND up.i = up.p) GROUP BY n.d),
    w AS (SELECT e.d, list({{'id': {_NODE.format('e.i')}, 'p': {_NODE.format('e.p')}}}) AS edges FROM e GROUP BY e.d),
    s AS (SELECT g.d, 0 AS k, CAST([] AS VARCHAR[]) AS done, g.ids, g.size, coalesce(w.edges, []) AS edges FROM g LEFT JOIN w ON w.d = g.d
      UNION ALL SELECT d, k + 1, list_append(done, list_filter(ids, lambda x: NOT list_contains(done, x) AND len(list_filter(edges, lambda y: y.id = x AND NOT list_contains(done, y.p))) = 0)[1]), ids, size, edges FROM s WHERE k < size)
    SELECT CAST(d AS VARCHAR) AS dag_id, done[k] AS id, k AS position FROM s WHERE k > 0""",
)(lambda x: graph.lexical_order(*trees(x)))

# --- service levels

_o = f"o AS ({OBSERVED.format('stream_events')})"
_grid = f"{_o}, m AS (SELECT stage, at_ns // {slo.MINUTE} AS minute, count(*) FILTER (WHERE ns <= 5000000000) AS good, count(*) AS n FROM o GROUP BY ALL), c AS (SELECT DISTINCT minute FROM m), g AS (SELECT stage, minute FROM (SELECT DISTINCT stage FROM m), c)"


def on_grid(x: Ledger) -> DataFrame:
    """Sums of the last 30 minutes at every minute in which any stage has a sample."""
    per_minute = materialize(slo.minute_counts(observed(x), 5.0), "minutes")
    return slo.sliding_ratio(slo.or_zero(per_minute, per_minute, ["good", "n"]))


for _name, _column in (("TS2_good_increase", "good"), ("TS3_count_increase", "n")):
    query(_name, f"WITH {_grid} SELECT g.stage, g.minute, CAST(sum(coalesce(m.{_column}, 0)) OVER (PARTITION BY g.stage ORDER BY g.minute RANGE BETWEEN 29 PRECEDING AND CURRENT ROW) AS BIGINT) AS increase FROM g LEFT JOIN m ON m.stage = g.stage AND m.minute = g.minute")(lambda x, c=_column: on_grid(x).select("stage", "minute", F.col(c).alias("increase")))
_recovery = ", ".join(f"('{b}')" for b in (*slo.LEASE_RECOVERY, "inf"))
query("TS1_recovery_buckets", f"WITH o AS (SELECT 'lease_recovery' AS stage, lease_recovery AS ns FROM ({TIMING_SQL}) WHERE lease_recovery IS NOT NULL), b(le) AS (SELECT CAST(le AS DOUBLE) FROM (VALUES {_recovery}) v(le)) SELECT stage, le, count(*) FILTER (WHERE ns / 1e9 <= le) AS n FROM o, b GROUP BY stage, le")(
    lambda x: slo.buckets(timing_of(x).where(F.col("lease_recovery").isNotNull()).select(F.lit("lease_recovery").alias("stage"), F.col("lease_recovery").alias("ns")), slo.LEASE_RECOVERY)
)
query("TS10_outcomes", "SELECT l.label, count(c.job_id) AS n FROM (VALUES ('SUCCEEDED'), ('FAILED'), ('DEAD_LETTER'), ('RETRYING')) l(label) LEFT JOIN job_completions c ON c.state = l.label GROUP BY l.label")(
    lambda x: slo.zero_filled(x.job_completions.groupBy(F.col("state").alias("label")).agg(F.count("*").alias("n")), x.spark.createDataFrame([("SUCCEEDED",), ("FAILED",), ("DEAD_LETTER",), ("RETRYING",)], "label string"), "label")
)

# --- evidence

_ENV = "SELECT worker_id AS run, capacity_slots AS worker_slots, CASE WHEN capacity_slots > 12 THEN 8 ELSE 7 END AS worker_count, CASE WHEN capacity_slots % 2 = 0 THEN 'wal' END AS journal FROM {0}"
query("EV4_environment", f"WITH r AS ({_ENV.format('workers')}) SELECT run, 'worker_slots' AS \"column\", CAST(worker_slots AS VARCHAR) AS found FROM r WHERE worker_slots <> 16 UNION ALL SELECT run, 'worker_count', CAST(worker_count AS VARCHAR) FROM r WHERE worker_count <> 8 UNION ALL SELECT run, 'journal', journal FROM r WHERE journal IS DISTINCT FROM 'wal'")(
    lambda x: evidence.environment(x.spark.sql(_ENV.format("{workers}"), workers=x.workers), "run", {"worker_slots": 16, "worker_count": 8, "journal": "wal"})
)
query("EV9_qualification", "SELECT CASE WHEN count(*) FILTER (WHERE NOT valid) > 0 THEN 'invalid' WHEN count(*) FILTER (WHERE NOT met) > 0 THEN 'miss' ELSE 'qualified' END AS verdict FROM (SELECT count(*) > 0 AS valid, max(state_version) < 3 AS met FROM jobs UNION ALL SELECT true, true)")(
    lambda x: evidence.verdict(x.jobs.agg((F.count("*") > 0).alias("valid"), (F.max("state_version") < 3).alias("met")).withColumn("part", F.lit("a")).unionByName(x.spark.createDataFrame([("b", True, True)], "part string, valid boolean, met boolean"), allowMissingColumns=True))
)
_RUN = """SELECT CAST(CASE WHEN k % 71 = 14 THEN k - 1 ELSE k END AS STRING) AS run, CASE WHEN k % 71 = 1 THEN 'other' ELSE CAST(CASE WHEN k % 71 = 14 THEN k - 1 ELSE k END AS STRING) END AS summary_run, CASE WHEN k % 4 = 0 THEN 'warmup' WHEN k % 71 = 2 THEN 'x' ELSE 'measured' END AS phase, CASE WHEN k % 4 = 0 THEN 'warmup' WHEN k % 71 = 2 THEN 'x' ELSE 'measured' END AS summary_phase,
    CASE WHEN k % 71 = 3 THEN k % 4 = 0 ELSE k % 4 <> 0 END AS scored, CASE WHEN k % 71 = 4 THEN 'invalid' ELSE 'valid' END AS status, k % 71 <> 5 AS valid, k % 71 <> 6 AS qualification, CASE WHEN k % 71 = 7 THEN 4999 ELSE 5000 END AS job_count, 8 AS worker_count, CASE WHEN k % 71 = 8 THEN 255 ELSE 256 END AS worker_slots,
    CASE WHEN k % 71 = 9 THEN 1 ELSE 5000 END AS canonical_jobs, 5000 AS lease_grants, CASE WHEN k % 71 = 10 THEN 1 ELSE 0 END AS repeats, execution_key AS digest, CASE WHEN k % 71 = 11 THEN 'x' WHEN k % 71 = 12 THEN upper(execution_key) WHEN k % 71 = 13 THEN md5(id) ELSE execution_key END AS recorded_digest FROM {0}"""
query(
    "EV10a_benchmark_runs",
    f"""WITH r AS ({_RUN.format('jobs').replace('STRING', 'VARCHAR')}), v AS (SELECT 'digest of the summary differs' AS message FROM r WHERE NOT regexp_full_match(recorded_digest, '[0-9a-fA-F]{{64}}') OR lower(recorded_digest) <> digest UNION ALL SELECT 'invalid status or phase' FROM r WHERE status <> 'valid' OR phase NOT IN ('warmup', 'measured')
    UNION ALL SELECT 'scored disagrees with the phase' FROM r WHERE scored <> (phase = 'measured') UNION ALL SELECT 'not the qualifying workload' FROM r WHERE NOT qualification OR job_count <> 5000 OR worker_count <> 8 OR worker_slots <> 256
    UNION ALL SELECT 'summary of another run or invalid' FROM r WHERE summary_run <> run OR NOT valid OR summary_phase <> phase UNION ALL SELECT 'counts differ from the workload' FROM r WHERE canonical_jobs <> 5000 OR lease_grants <> 5000 OR repeats <> 0
    UNION ALL SELECT 'run id repeated' FROM (SELECT run FROM r GROUP BY run HAVING count(*) > 1)) SELECT message, count(*) AS n FROM v GROUP BY message""",
)(lambda x: evidence.benchmark_run(x.spark.sql(_RUN.format("{jobs}"), jobs=x.jobs), 5000, 8, 256).groupBy("message").agg(F.count("*").alias("n")))


def sample_faults(x: Ledger) -> DataFrame:
    own = materialize(evidence.recoveries(x.spark.sql(KILLS.format("{attempts}"), attempts=x.attempts), x.attempts), "samples")
    bent = own.where("kill_sequence % 13 <> 1").withColumn("recovery_ms", F.when(F.col("kill_sequence") % 13 == 2, F.col("recovery_ms") + 1).otherwise(F.col("recovery_ms"))).withColumn("generation", F.when(F.col("kill_sequence") % 13 == 3, F.col("killed_generation")).otherwise(F.col("generation")))
    return evidence.sample_rows(bent, own.where("kill_sequence % 13 <> 4").select("kill_sequence", "job_id", "recovery_ms"))


_SAMPLES = f"(SELECT k.kill_sequence, k.job_id, k.killed_at, a.leased_at, a.lease_generation AS generation FROM ({KILLS.format('attempts')}) k LEFT JOIN attempts a ON a.job_id = k.job_id AND a.lease_generation = 2)"
query("EV10b_sample_sets", f"SELECT message, count(*) AS n FROM (SELECT CASE kill_sequence % 13 WHEN 1 THEN 'missing sample' WHEN 4 THEN 'unexpected sample' END AS message FROM {_SAMPLES}) WHERE message IS NOT NULL GROUP BY message")(lambda x: sample_faults(x).where("message IN ('missing sample', 'unexpected sample')").groupBy("message").agg(F.count("*").alias("n")))
query("EV12_sample_rows", f"SELECT kill_sequence, job_id, CASE kill_sequence % 13 WHEN 2 THEN 'recovery differs' ELSE 'successor not later' END AS message FROM {_SAMPLES} WHERE generation IS NOT NULL AND kill_sequence % 13 IN (2, 3)")(lambda x: sample_faults(x).where("message IN ('recovery differs', 'successor not later')"))
query("EV13_campaign", f"SELECT quantile_disc((leased_at - killed_at) // 1000000, 0.99) AS p99, quantile_disc((leased_at - killed_at) // 1000000, 0.99) < 9000 AS passed FROM {_SAMPLES} WHERE leased_at IS NOT NULL")(lambda x: evidence.campaign(evidence.recoveries(x.spark.sql(KILLS.format("{attempts}"), attempts=x.attempts), x.attempts), 9000))

_REPORT = """SELECT tenant_id AS report, count(*) AS n, count_if(state = 'SUCCEEDED') AS good, count_if(state NOT IN ('SUCCEEDED', 'FAILED', 'DEAD_LETTER')) AS open, length(tenant_id) % 2 = 0 AS even FROM {0} GROUP BY tenant_id"""


def reports(x: Ledger) -> DataFrame:
    """A report per tenant, each of which contradicts itself in some way."""
    c = F.col
    own = x.spark.sql(_REPORT.format("{jobs}"), jobs=x.jobs)
    check = lambda name, n: F.struct(F.lit(name).alias("name"), n.alias("violations"), (n == 0).alias("passed"))
    own = own.withColumn("checks", F.when(c("even"), F.array(check("a", c("open")), check("b", F.lit(0).cast("long")))).otherwise(F.array(check("a", c("open")), check("a", F.lit(1).cast("long")))))
    own = own.withColumn("states", F.array(F.struct(F.lit("SUCCEEDED").alias("state"), c("good").alias("n")), F.struct(F.lit("OPEN").alias("state"), c("open").alias("n"))))
    zero = F.lit(0).cast("long")
    return own.select("report", F.lit(5000).alias("expected"), "checks", c("open").alias("total"), zero.alias("details"), (c("open") > 0).alias("truncated"), (c("open") == 0).alias("passed"), "states", c("n").alias("job_count"), c("n").alias("accepted"), c("good").alias("completions"), zero.alias("active_jobs"), zero.alias("active_attempts"), zero.alias("reservations"))


query(
    "EV10c_report_accounting",
    f"""WITH r AS ({_REPORT.format('jobs')}) SELECT report, 'check repeated' AS message FROM r WHERE NOT even UNION ALL SELECT report, 'checks missing or unknown' FROM r WHERE NOT even UNION ALL SELECT report, 'status disagrees with the checks' FROM r WHERE NOT even
    UNION ALL SELECT report, 'states disagree with the jobs' FROM r WHERE good + open <> n UNION ALL SELECT report, 'passed with loss or residue' FROM r WHERE open = 0""",
)(lambda x: evidence.report_faults(reports(x), ["a", "b"], 5000))
_REPLAY = "SELECT queue_name AS kind, k % 3 AS process, CASE WHEN queue_name LIKE '1%' AND k % 50 = 0 THEN 49999 ELSE 50000 END AS decisions, CASE WHEN queue_name LIKE '2%' AND k % 50 = 1 THEN 49999 WHEN queue_name LIKE '1%' AND k % 50 = 0 THEN 49999 ELSE 50000 END AS matched, CASE WHEN queue_name LIKE '3%' AND k % 50 = 2 THEN execution_key ELSE {sha} END AS digest FROM {0} WHERE NOT (queue_name LIKE '4%' AND k % 3 = 2)"
query("EV10d_replay_runs", f"WITH r AS ({_REPLAY.replace('{0}', 'jobs').replace('{sha}', chr(39) + 'a' * 64 + chr(39))}), g AS (SELECT kind, count(DISTINCT process) AS n, count(*) FILTER (WHERE decisions <> 50000) AS short, count(*) FILTER (WHERE matched <> decisions) AS off, count(DISTINCT digest) AS d FROM r GROUP BY kind) SELECT kind, 'other number of processes' AS message FROM g WHERE n <> 3 UNION ALL SELECT kind, 'other number of decisions' FROM g WHERE short > 0 UNION ALL SELECT kind, 'decisions that don''t match' FROM g WHERE off > 0 UNION ALL SELECT kind, 'digests differ or are invalid' FROM g WHERE d <> 1")(
    lambda x: evidence.replay_faults(x.spark.sql(_REPLAY.replace("{0}", "{jobs}").replace("{sha}", f"'{'a' * 64}'"), jobs=x.jobs), 50000, 3)
)


def killed(x: Ledger) -> DataFrame:
    """A kill per worker: the leases it had, and those that the kill hit."""
    c = F.col
    own = x.attempts.groupBy("worker_id").agg(F.sort_array(F.collect_list(F.concat_ws("/", "job_id", c("attempt_no").cast("string")))).alias("before"))  # leases of one worker
    n = F.substring("worker_id", 8, 30).cast("long")
    own = own.withColumn("n", n).withColumn("affected", F.when(c("n") % 5 == 1, F.array(F.lit("gone"))).when(c("n") % 5 == 2, F.concat(F.slice("before", 1, 1), F.slice("before", 1, 1))).otherwise(F.slice("before", 1, 2)))
    own = own.withColumn("before", F.when(c("n") % 5 == 3, F.concat("before", F.slice("before", 1, 1))).otherwise(c("before")))
    return own.select(c("n").alias("sequence"), F.when(c("n") % 5 == 4, 4).otherwise(c("n")).alias("kill_sequence"), c("n").alias("observed_ns"), F.lit(3).alias("offset_ns"), F.when(c("n") % 5 == 0, c("n")).otherwise(c("n") + 3).alias("calibrated_ns"), "before", "affected")


query(
    "EV11_kill_log",
    """WITH w AS (SELECT DISTINCT CAST(substr(worker_id, 8) AS BIGINT) AS n FROM attempts), s AS (SELECT n, CASE WHEN n % 5 = 4 THEN 4 ELSE n END AS k FROM w), v AS (SELECT 'clock differs' AS message, count(*) AS n FROM w WHERE n % 5 = 0 UNION ALL SELECT 'kill repeated', count(*) FROM (SELECT k FROM s GROUP BY k HAVING count(*) > 1)
    UNION ALL SELECT 'kill missing', count(*) FROM (SELECT count(DISTINCT k) AS d, max(k) AS m FROM s) WHERE d <> m UNION ALL SELECT 'lease repeated before the kill', count(*) FROM w WHERE n % 5 = 3 UNION ALL SELECT 'hit lease wasn''t there before', count(*) FROM w WHERE n % 5 = 1 UNION ALL SELECT 'hit lease repeated', count(*) FROM w WHERE n % 5 = 2) SELECT message, n FROM v WHERE n > 0""",
)(lambda x: evidence.kill_faults(killed(x)))

# --- commands

_ASK = "SELECT k AS request, tenant_id, concat('new-', CAST(CASE WHEN k % 10 = 1 THEN k - 1 ELSE k END AS STRING)) AS submission_key, CASE WHEN k % 20 = 1 THEN 'other' ELSE 'digest' END AS digest, md5(concat('new', id)) AS job_id, CASE WHEN k % 6 = 0 THEN id WHEN k % 31 = 0 THEN 'gone' END AS parent, 1 AS nodes FROM {0}"
SUBMIT_SQL = f"""WITH a0 AS ({_ASK.format('jobs').replace('STRING', 'VARCHAR')}), a1 AS (SELECT *, row_number() OVER w AS r, first_value(digest) OVER w AS first FROM a0 WINDOW w AS (PARTITION BY tenant_id, submission_key ORDER BY request)),
    a2 AS (SELECT a1.*, p.state AS ps, p.id AS pid, CASE WHEN r > 1 THEN CASE WHEN first = digest THEN 'replayed' ELSE 'conflict' END WHEN parent IS NOT NULL AND (p.id IS NULL OR p.tenant_id <> a1.tenant_id) THEN 'invalid' ELSE 'new' END AS kind FROM a1 LEFT JOIN jobs p ON p.id = a1.parent),
    a3 AS (SELECT a2.*, t.max_depth, (SELECT count(*) FROM jobs j WHERE j.tenant_id = a2.tenant_id AND j.state NOT IN {OPEN}) AS active, row_number() OVER (PARTITION BY a2.tenant_id, kind ORDER BY request) AS taken FROM a2 LEFT JOIN tenant_limits t ON t.tenant_id = a2.tenant_id),
    a4 AS (SELECT *, CASE WHEN kind = 'new' AND coalesce(max_depth, 0) > 0 AND taken > max_depth - active THEN 'rejected' WHEN kind = 'new' THEN 'accepted' ELSE kind END AS outcome FROM a3),
    a5 AS (SELECT *, CASE WHEN outcome = 'accepted' THEN CASE WHEN ps IN ('FAILED', 'DEAD_LETTER') THEN 'DEAD_LETTER' ELSE 'PENDING' END END AS state FROM a4)"""


def asked(x: Ledger) -> DataFrame:
    none = x.spark.createDataFrame([], "tenant_id string, submission_key string, request_digest string, job_id string")
    return transitions.submit(x.spark.sql(_ASK.format("{jobs}"), jobs=x.jobs), none, x.jobs, x.tenant_limits, 500, 1)


query("DM1_submit", f"{SUBMIT_SQL}, z AS (SELECT *, outcome = 'accepted' AND state = 'PENDING' AND (parent IS NULL OR ps = 'SUCCEEDED') AS ready FROM a5) SELECT request, outcome, state, CASE WHEN ready THEN 500 + row_number() OVER (PARTITION BY ready ORDER BY request) ELSE 0 END AS ready_seq FROM z")(lambda x: asked(x).select("request", "outcome", "state", "ready_seq"))
query("STR8_worker_liveness", f"SELECT worker_id, max(t) AS last_heartbeat_at FROM (SELECT worker_id, last_heartbeat_at AS t FROM workers UNION ALL SELECT worker_id, max(heartbeat_at) FROM attempts GROUP BY worker_id) GROUP BY worker_id")(lambda x: transitions.register(x.spark.sql(BEATS.format("{attempts}"), attempts=x.attempts), x.workers).select("worker_id", "last_heartbeat_at"))
_FLOW = """w AS (SELECT cust, id, tenant_id, created_at, row_number() OVER (PARTITION BY cust ORDER BY created_at, id) AS i, count(*) OVER (PARTITION BY cust) AS size FROM job0)"""


def workflows(x: Ledger) -> DataFrame:
    """A workflow per customer: each job hangs on the one before; one customer in five has a cycle."""
    return x.kept("workflows", lambda: _workflows(x))


def _workflows(x: Ledger) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("cust").orderBy("created_at", "id")
    own = materialize(x.jobs.select("cust", "id", "tenant_id", "created_at", F.row_number().over(w).alias("i")), "flows")
    name = lambda c: F.format_string("n%03d", c)
    nodes = own.select(F.col("cust").alias("request"), "tenant_id", F.concat(F.lit("flow-"), F.col("cust").cast("string")).alias("submission_key"), F.lit("d").alias("digest"), name(F.col("i")).alias("node"), F.col("id").alias("job_id"), F.when(F.col("cust") % 3 == 0, 2).otherwise(0).cast("long").alias("available_at"))
    edges = own.where("i > 1").select(F.col("cust").alias("request"), name(F.col("i")).alias("node"), name(F.col("i") - 1).alias("parent"))
    edges = edges.unionByName(own.where("i = 2 AND cust % 5 = 0").select(F.col("cust").alias("request"), F.lit("n001").alias("node"), F.lit("n002").alias("parent")))
    free = x.tenant_limits.withColumn("max_depth", F.lit(0))
    none = x.spark.createDataFrame([], "tenant_id string, submission_key string, request_digest string, job_id string")
    return materialize(transitions.submit_workflows(nodes, edges, none, x.jobs, free, 100, 1), "flows")


FLOW_SQL = f"WITH {_FLOW}, f AS (SELECT cust AS request, 'n' || lpad(CAST(i AS VARCHAR), 3, '0') AS node, CASE WHEN cust % 5 = 0 AND size > 1 THEN 'invalid' ELSE 'accepted' END AS outcome, i = 1 AND cust % 3 <> 0 AND NOT (cust % 5 = 0 AND size > 1) AS ready FROM w)"
query("DM2_workflows", f"{FLOW_SQL} SELECT request, node, outcome, CASE WHEN ready THEN 100 + row_number() OVER (PARTITION BY ready ORDER BY request, node) ELSE 0 END AS ready_seq FROM f")(workflows)
query("DM3_workflow_records", f"{FLOW_SQL} SELECT outcome, count(DISTINCT request) AS workflows, count(*) AS nodes FROM f GROUP BY outcome")(lambda x: workflows(x).groupBy("outcome").agg(F.countDistinct("request").alias("workflows"), F.count("*").alias("nodes")))
query("DM8_slots", f"SELECT t.tenant_id, max_slots, active_slots, CAST(coalesce(sum(slot_cost), 0) AS BIGINT) AS asked, max_slots = 0 OR active_slots + coalesce(sum(slot_cost), 0) <= max_slots AS fits FROM tenant_limits t LEFT JOIN (SELECT tenant_id, slot_cost FROM ({READY_SQL}) WHERE rank <= 2) r ON r.tenant_id = t.tenant_id GROUP BY t.tenant_id, max_slots, active_slots")(
    lambda x: transitions.reserved(reads.ready_candidates(x.jobs, x.tenant_limits, x.queue_state, now_of(x), 2), x.tenant_limits)
)
query("DM12_fail_descendants", "WITH RECURSIVE c AS (SELECT d.job_id AS id FROM job_dependencies d JOIN jobs p ON p.id = d.depends_on_id WHERE p.state = 'RUNNING' UNION SELECT d.job_id FROM c JOIN job_dependencies d ON d.depends_on_id = c.id) SELECT j.id FROM jobs j JOIN c ON c.id = j.id WHERE j.state NOT IN ('SUCCEEDED', 'FAILED', 'DEAD_LETTER')")(lambda x: x.identified(transitions.fail_descendants(x.numbers().where("state = 'RUNNING'").select("id"), x.numbers(), x.numbered_edges())))
query("DM15_retry_clones", "SELECT job_id, 'not dead' AS outcome, queue_name, slot_cost FROM (SELECT id AS job_id, queue_name, slot_cost FROM jobs WHERE state = 'SUCCEEDED') UNION ALL SELECT d.job_id, CASE WHEN redriven_job_id IS NULL THEN 'cloned' ELSE 'already' END, queue_name, slot_cost FROM dead_letters d JOIN jobs j ON j.id = d.job_id")(
    lambda x: transitions.redrive(x.jobs.where("state IN ('DEAD_LETTER', 'SUCCEEDED')").select(F.col("id").alias("job_id"), F.lit(1).alias("request")), x.dead_letters, x.jobs).select("job_id", "outcome", "queue_name", "slot_cost")
)
_ACT = "SELECT tenant_id, 'cancel' AS action, concat('key-', CAST(k AS STRING)) AS idempotency_key, 'me' AS actor, 'job' AS target_type, id AS target_id, execution_key AS digest FROM {0}"
query("DM16_record_actions", f"SELECT 'audit-' || substr({blob('tenant_id', 'action', 'idempotency_key')}, 1, 24) AS id, target_id, CASE k % 3 WHEN 0 THEN 'recorded' WHEN 1 THEN 'replayed' ELSE 'conflict' END AS outcome FROM (SELECT tenant_id, 'cancel' AS action, 'key-' || k AS idempotency_key, id AS target_id, k FROM jobs)")(
    lambda x: transitions.record_actions(x.spark.sql(_ACT.format("{jobs}"), jobs=x.jobs), x.jobs.where("k % 3 <> 0").select("tenant_id", F.lit("cancel").alias("action"), F.concat(F.lit("key-"), F.col("k").cast("string")).alias("idempotency_key"), F.when(F.col("k") % 3 == 1, F.col("execution_key")).otherwise("x").alias("digest")), 1).select("id", "target_id", "outcome")
)
query("DM18_create_triggers", "SELECT tenant_id || '/' || queue_name AS id, CASE weight WHEN 1 THEN 'created' WHEN 2 THEN 'same' ELSE 'conflict' END AS outcome FROM queue_state")(
    lambda x: transitions.create_triggers(triggers_of(x), x.queue_state.where("weight > 1").select(F.concat_ws("/", "tenant_id", "queue_name").alias("id"), F.when(F.col("weight") == 2, "@hourly").otherwise("@daily").alias("schedule"))).select("id", "outcome")
)
query("DM19_save_dag", "SELECT id AS job_id, CASE WHEN tenant_id <> 'nation-7' THEN 'missing job' END AS message FROM jobs")(lambda x: transitions.save_dag(x.jobs.select(F.col("id").alias("job_id"), F.concat(F.lit("node-"), F.col("k").cast("string")).alias("node_key")), x.jobs, TENANT, "run").select("job_id", "message"))
query("DM20_next_counter", "SELECT greatest(max(ready_seq), 17) AS value FROM jobs")(lambda x: transitions.next_counter(x.jobs, "ready_seq", 17))
query("STR7_promotion", f"SELECT id, 1000 + row_number() OVER (ORDER BY available_at, id) AS ready_seq FROM ({DUE_SQL.replace('LIMIT 50', 'LIMIT 500')})")(lambda x: transitions.promote(x.jobs, x.job_dependencies, 1000, now_of(x), 500))

# --- scheduling and replay

query("SCH3_canonical_order", f"SELECT id, rank FROM ({READY_SQL})")(lambda x: reads.ready_candidates(x.jobs, x.tenant_limits, x.queue_state, now_of(x), reads.BIG).select("id", "rank"))
query("SCH1_snapshot", f"WITH r AS (SELECT * FROM ({READY_SQL}) WHERE rank <= 3) SELECT tenant_id, queue_name, any_value(weight) AS weight, count(*) AS candidates, string_agg(id, ',' ORDER BY rank) AS ids, 64 - CASE WHEN (SELECT bool_or(recovery_pending) FROM r) THEN 0 ELSE 16 END AS slots FROM r GROUP BY tenant_id, queue_name")(
    lambda x: scheduling.queue_snapshots(reads.ready_candidates(x.jobs, x.tenant_limits, x.queue_state, now_of(x), 3), 64)
)
_GRANTS = f"""WITH r AS (SELECT * FROM ({READY_SQL}) WHERE rank <= 100), q AS (SELECT tenant_id, queue_name, row_number() OVER (ORDER BY tenant_id, queue_name) - 1 AS qi, count(*) OVER () AS nq FROM (SELECT DISTINCT tenant_id, queue_name FROM r)),
    c AS (SELECT r.*, qi, nq, sum(slot_cost) OVER (PARTITION BY r.tenant_id, r.queue_name ORDER BY rank) AS reach FROM r JOIN q ON q.tenant_id = r.tenant_id AND q.queue_name = r.queue_name),
    g AS (SELECT id, tenant_id, queue_name, slot_cost, rank, nq, CAST(ceil(reach / weight) AS BIGINT) AS round, ((qi - 1) % nq + nq) % nq AS turn FROM c ORDER BY round, turn, rank LIMIT 60),
    h AS (SELECT *, (round - 1) * nq + turn - coalesce(lag((round - 1) * nq + turn) OVER o, -1) AS gap, sum(slot_cost) OVER o AS used FROM g WINDOW o AS (ORDER BY round, turn, rank)), k AS (SELECT *, max(CASE WHEN gap > nq THEN 1 ELSE 0 END) OVER (ORDER BY round, turn, rank) AS ended FROM h)
    SELECT id, tenant_id, queue_name, round, turn, CAST(used AS BIGINT) AS used FROM k WHERE ended = 0 AND used <= 90"""
query("SCH4_worker_reserves", "SELECT worker_id, CASE WHEN capacity_slots <= 1 THEN 0 ELSE (capacity_slots + 3) // 4 END AS reserve FROM workers")(lambda x: x.workers.select("worker_id", scheduling.recovery_reserve(F.col("capacity_slots")).alias("reserve")))
query("SCH2_grant_order", _GRANTS)(lambda x: scheduling.grant_order(reads.ready_candidates(x.jobs, x.tenant_limits, x.queue_state, now_of(x), 100), 1, 60, 90))
query("RPL1_replayed_log", f"{LOG} SELECT cust, sequence FROM r WHERE cust % 17 = 2 AND sequence = 1")(lambda x: bent_log(x).where(F.sha2(F.col("material").cast("binary"), 256) != F.col("hash")).select("cust", "sequence"))
query("RPL3_canonical_lines", "SELECT tenant_id, queue_name, '{\"tenant_id\":\"' || tenant_id || '\",\"queue\":\"' || queue_name || '\",\"deficit\":' || deficit || '}' || chr(10) AS line FROM queue_state")(
    lambda x: x.queue_state.select("tenant_id", "queue_name", F.concat(fn.json_object(tenant_id=fn.json_text(F.col("tenant_id")), queue=fn.json_text(F.col("queue_name")), deficit=F.col("deficit").cast("string")), F.lit("\n")).alias("line"))
)

# --- streams, run until their source is read


def as_files(x: Ledger, df: DataFrame, parts: int = 3) -> DataFrame:
    """`df` as a stream of a few files."""
    path = folder(x, "inbox")
    df.repartition(parts).write.parquet(path)
    return x.spark.readStream.schema(df.schema).parquet(path)


_MAIL = "SELECT queue_name AS trigger, tenant_id AS stream, CAST(k % 40 AS STRING) AS message_id, CASE WHEN k % 7 = 0 THEN 'other' ELSE 'digest' END AS digest, k AS offset FROM {0}"


def received(x: Ledger) -> str:
    def make() -> str:
        out = folder(x, "mail")
        streams.ingest(as_files(x, x.spark.sql(_MAIL.format("{jobs}"), jobs=x.jobs).select("trigger", "stream", "message_id", "digest", F.col("offset").cast("long").alias("offset"))), out, folder(x, "cursor")).awaitTermination()
        return out

    return x.kept("mail", make)


def box(x: Ledger, name: str) -> DataFrame:
    return x.spark.read.schema("trigger string, stream string, message_id string, digest string").option("recursiveFileLookup", "true").parquet(f"{received(x)}/{name}")


_FIRST = f"SELECT trigger, stream, message_id, arg_min(digest, \"offset\") AS digest, count(DISTINCT digest) AS digests FROM ({_MAIL.format('jobs').replace('STRING', 'VARCHAR').replace('AS offset', 'AS %soffset%s' % (chr(34), chr(34)))}) GROUP BY ALL"
query("STR1_ingest", f"SELECT trigger, stream, message_id, digest FROM ({_FIRST})")(lambda x: box(x, "accepted"))
query("SRC9_stream_source", f"SELECT stream, count(*) AS n FROM ({_FIRST}) GROUP BY stream")(lambda x: box(x, "accepted").groupBy("stream").agg(F.count("*").alias("n")))
query("STR10_redelivery", f"SELECT trigger, stream, message_id, digest FROM ({_FIRST}) WHERE digests > 1")(lambda x: box(x, "conflicts"))


def tailed(x: Ledger) -> tuple[DataFrame, dict[str, int]]:
    """The events through a stream into a table, and what the stream says of its progress; keys and codes stand for texts on the way."""

    def make() -> tuple[DataFrame, dict[str, int]]:
        out, path = folder(x, "tailed"), folder(x, "inbox")
        own = x.coded().select("event_seq", "k", "code")
        write(own, path)
        with tidy(x.spark):
            q = streams.tail(x.spark.readStream.schema(own.schema).parquet(path), lambda batch, n: write(batch, f"{out}/batch={n}", "overwrite"), folder(x, "cursor"))
        q.awaitTermination()
        discard(x.spark, path)
        rows = x.spark.read.schema(own.schema).option("recursiveFileLookup", "true").parquet(out)
        return rows.select("event_seq", F.expr(JOB_ID).alias("job_id"), F.expr(EVENT_TYPE).alias("event_type")), streams.backlog(q)

    return x.kept("tailed", make)


query("STR5_tail", "SELECT event_seq, job_id, event_type FROM ledger_events")(lambda x: tailed(x)[0])
query("SRC11_backlog", "SELECT count(*) AS consumed, CAST(0 AS BIGINT) AS pending FROM ledger_events")(lambda x: x.spark.createDataFrame([(tailed(x)[1]["consumed"],)], "consumed long").join(x.ledger_events.agg(F.count("*").alias("n")), F.lit(True)).select("consumed", (F.col("n") - F.col("consumed")).alias("pending")))


def streamed(x: Ledger, df: DataFrame, what: str, mode: str = "append") -> DataFrame:
    """What a streaming DataFrame gives until its source is read, as a table."""
    out = folder(x, what)
    df.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", folder(x, "cursor")).trigger(availableNow=True).start().awaitTermination()
    return x.spark.read.schema(df.schema).parquet(out)


#: Leases, heartbeats and completions by an event's code; keys stand for ids, and no event needs its number.
_BEAT = "SELECT k AS job_id, CASE code WHEN 1 THEN 'lease' WHEN 2 THEN 'heartbeat' ELSE 'complete' END AS kind, timestamp_millis(occurred_at div 1000000) AS at, false AS last FROM {e} WHERE code IN (1, 2, 4, 5)"
#: Fixed value: events whose sessions a stream may hold as its state at once.
BEATS_AT_ONCE = 1 << 23


def ran_out(x: Ledger) -> DataFrame:
    """Leases that ran out, by one stream after the other over a share of the jobs each, so that no stream's state grows with the ledger."""
    path, out = folder(x, "inbox"), folder(x, "leases")
    write(x.spark.sql(_BEAT, e=x.coded(numbers=False)), f"{path}/beats")
    inbox = lambda what: x.spark.read.parquet(f"{path}/{what}")
    # moves the watermark past all others
    write(inbox("beats").agg(F.max("at").alias("at")).select(F.lit(None).cast("long").alias("job_id"), F.lit("complete").alias("kind"), (F.col("at") + F.expr("INTERVAL 1 DAY")).alias("at"), F.lit(True).alias("last")), f"{path}/last")
    schema, shares = inbox("beats").schema, -(-inbox("beats").count() // BEATS_AT_ONCE)
    for i in range(max(1, shares)):
        own = x.spark.readStream.schema(schema).parquet(f"{path}/*").where(F.col("last") | (F.pmod(F.xxhash64("job_id"), F.lit(max(1, shares))) == i))
        cursor = folder(x, "cursor")
        with tidy(x.spark):
            q = streams.tail(streams.leases(own.withWatermark("at", "0 seconds")), lambda batch, n, i=i: write(batch, f"{out}/share={i}/batch={n}", "overwrite"), cursor)
        q.awaitTermination()
        discard(x.spark, cursor)
    discard(x.spark, path)
    rows = x.spark.read.schema("job_id long, expired_ms long").option("recursiveFileLookup", "true").parquet(out)
    return x.identified(rows, "job_id")


query(
    "STR6_expired_leases",
    """WITH b AS (SELECT job_id, event_type = 'job_completed' AS done, occurred_at // 1000000 AS ms FROM ledger_events WHERE event_type IN ('lease_acquired', 'attempt_started', 'job_completed')),
    s AS (SELECT *, sum(f) OVER (PARTITION BY job_id ORDER BY ms) AS i FROM (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY job_id ORDER BY ms) < 2500 THEN 0 ELSE 1 END AS f FROM b))
    SELECT job_id, max(ms) + 2500 AS expired_ms FROM s GROUP BY job_id, i HAVING NOT arg_max(done, ms)""",
)(ran_out)


def slid(x: Ledger) -> DataFrame:
    own = observed(x).select("stage", F.timestamp_millis(F.call_function("div", F.col("at_ns"), F.lit(1_000_000))).alias("at"), "ns")
    last = own.agg(F.max("at").alias("m")).select(F.lit("end").alias("stage"), (F.col("m") + F.expr("INTERVAL 2 DAYS")).alias("at"), F.lit(0).cast("long").alias("ns"))  # moves the watermark past all others
    done = streamed(x, streams.sliding(as_files(x, own.unionByName(last), 1)), "slid")
    return done.where("stage <> 'end'").select("stage", F.unix_millis("until").alias("until_ms"), "good", "n")


query("STR9_sliding_stream", f"WITH {_o}, w AS (SELECT stage, (at_ns // {slo.MINUTE} + i) * 60000 AS until_ms, ns FROM o, range(1, 31) t(i)) SELECT stage, until_ms, count(*) FILTER (WHERE ns <= 5000000000) AS good, count(*) AS n FROM w GROUP BY stage, until_ms")(slid)
