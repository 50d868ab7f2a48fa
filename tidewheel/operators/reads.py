"""Read queries over the ledger. Each takes DataFrames and parameters and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.ledger import ACTIVE, TERMINAL, age_ms, health

BIG = (1 << 63) - 1


def total(condition: Column, value: Column | int = 1) -> Column:
    return F.coalesce(F.sum(F.when(condition, value).otherwise(0)), F.lit(0)).cast("long")


def one_row(*parts: DataFrame) -> DataFrame:
    """Columns of several one-row results in one row."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.agg(*(F.max(c).alias(c) for c in out.columns))


def job(jobs: DataFrame, job_id: str) -> DataFrame:
    """SRC1."""
    return jobs.where(F.col("id") == job_id)


def state_snapshot(jobs: DataFrame, events: DataFrame, dead_letters: DataFrame) -> DataFrame:
    """AG1: last sequence, counts by open state, open dead letters; zeros of an empty ledger."""
    last = events.agg(F.coalesce(F.max("event_seq"), F.lit(0)).alias("sequence"))
    dlq = dead_letters.where(F.col("redriven_job_id").isNull()).agg(F.count("*").alias("dlq"))
    counts = jobs.agg(*(total(F.col("state") == s).alias(s.lower()) for s in ("PENDING", "SCHEDULED", "RUNNING", "RETRYING")))
    return one_row(last, counts, dlq)


def queue_depth(queues: DataFrame, tenants: DataFrame, jobs: DataFrame, tenant: str | None, now_ns: int) -> DataFrame:
    """AG2: depth of every queue, empty ones too; of one tenant, or of all."""
    if tenant is not None:
        queues, jobs = queues.where(F.col("tenant_id") == tenant), jobs.where(F.col("tenant_id") == tenant)
    state = F.col("state")
    depth = jobs.groupBy("tenant_id", "queue_name").agg(
        *(total(state == s).alias(s.lower()) for s in ("PENDING", "SCHEDULED", "RUNNING", "RETRYING")),
        total(~state.isin(*TERMINAL)).alias("active"),
        F.min(F.when((state == "PENDING") & (F.col("ready_seq") > 0), F.col("updated_at"))).alias("oldest"),
    )
    limits = tenants.select("tenant_id", "max_depth", "max_slots")
    counts = ("pending", "scheduled", "running", "retrying", "active")
    joined = queues.select("tenant_id", "queue_name", "active_slots").join(limits, "tenant_id").join(depth, ["tenant_id", "queue_name"], "left")
    return joined.select("tenant_id", "queue_name", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts), "max_depth", "active_slots", "max_slots", age_ms(now_ns, F.col("oldest")).alias("oldest_ready_age_ms"))


def fenced() -> Column:
    """FLT4: the attempt is the one that its job holds a lease for."""
    return F.col("attempt_state").isin("LEASED", "RUNNING") & F.col("job_state").isin(*ACTIVE) & (F.col("job_attempt") == F.col("attempt_no")) & (F.col("job_generation") == F.col("lease_generation"))


def worker_health(workers: DataFrame, attempts: DataFrame, jobs: DataFrame, now_ns: int) -> DataFrame:
    """AG3, JN3: leases and age of heartbeat of every worker, idle ones too. Settled attempts and jobs don't reach the joins."""
    live = attempts.where(F.col("state").isin("LEASED", "RUNNING")).select("worker_id", "job_id", "attempt_no", "lease_generation", "leased_at", "expires_at", F.col("state").alias("attempt_state"))
    held = jobs.where(F.col("state").isin(*ACTIVE)).select(F.col("id").alias("job_id"), F.col("state").alias("job_state"), F.col("attempt_no").alias("job_attempt"), F.col("lease_generation").alias("job_generation"), "slot_cost")
    leases = live.join(held, "job_id").where(fenced()).groupBy("worker_id").agg(F.count("*").alias("n"), F.sum("slot_cost").cast("long").alias("s"), F.min("leased_at").alias("l"), F.min("expires_at").alias("e"))
    age = age_ms(now_ns, F.col("last_heartbeat_at"))
    expiry = F.col("e") - now_ns
    return workers.join(leases, "worker_id", "left").select(
        "worker_id", "capacity_slots", age.alias("heartbeat_age_ms"), health(age).alias("status"), F.coalesce("n", F.lit(0)).alias("active_leases"), F.coalesce("s", F.lit(0)).alias("active_slots"),
        age_ms(now_ns, F.col("l")).alias("oldest_lease_age_ms"), F.when(expiry > 0, F.call_function("div", expiry, F.lit(1_000_000))).otherwise(F.when(expiry <= 0, 0)).alias("next_expiry_ms"),
    )


def fenced_leases(attempts: DataFrame, jobs: DataFrame) -> DataFrame:
    """FLT4, JN4: live attempts that their jobs hold a lease for."""
    live = attempts.where(F.col("state").isin("LEASED", "RUNNING")).select("job_id", "attempt_no", "lease_generation", "worker_id", "leased_at", "expires_at")
    held = jobs.where(F.col("state").isin(*ACTIVE)).select(F.col("id").alias("job_id"), "attempt_no", "lease_generation", "tenant_id", "slot_cost")
    return live.join(held, ["job_id", "attempt_no", "lease_generation"])


def lease_states(attempts: DataFrame, leases: DataFrame) -> DataFrame:
    """JN17, FLT7: state and end (0 if open) of the attempts of a list of fences (job_id, attempt_no, lease_generation); one that is gone has a null state."""
    fence = ["job_id", "attempt_no", "lease_generation"]
    return leases.select(*fence).distinct().join(attempts.select(*fence, "state", F.coalesce("completed_at", F.lit(0)).alias("completed_at")), fence, "left")


def attempts_of(attempts: DataFrame, done: DataFrame, ids: DataFrame) -> DataFrame:
    """FLT8: attempts of a list of jobs (job_id) with the job's commit time, 0 without."""
    own = attempts.join(ids.select("job_id").distinct(), "job_id", "left_semi")
    return own.join(done.select("job_id", "committed_at"), "job_id", "left").select("job_id", "attempt_no", "lease_generation", "leased_at", F.coalesce("committed_at", F.lit(0)).alias("committed_at"))


def open_depth(jobs: DataFrame) -> DataFrame:
    """AG4."""
    return jobs.where(~F.col("state").isin(*TERMINAL)).groupBy("tenant_id", "queue_name", "state").agg(F.count("*").alias("n"))


def admission(jobs: DataFrame, tenants: DataFrame, incoming: int = 1) -> DataFrame:
    """AG5: open jobs against the tenant's cap; 0 is no cap, and active + incoming may reach it."""
    active = jobs.where(~F.col("state").isin(*TERMINAL)).groupBy("tenant_id").agg(F.count("*").alias("active"))
    n = F.coalesce("active", F.lit(0))
    return tenants.join(active, "tenant_id", "left").select("tenant_id", "max_depth", n.alias("active"), ((F.col("max_depth") == 0) | (n + incoming <= F.col("max_depth"))).alias("accepted"))


def state_histogram(jobs: DataFrame) -> DataFrame:
    """AG7."""
    return jobs.groupBy("state").agg(F.count("*").alias("n"))


def progress(jobs: DataFrame) -> DataFrame:
    """AG6."""
    return jobs.agg(total(F.col("state") == "SUCCEEDED").alias("succeeded"), total(F.col("state").isin(*ACTIVE)).alias("active"), total(F.col("state").isin("FAILED", "DEAD_LETTER")).alias("failed"), total(F.col("attempt_no") > 1).alias("repeated"))


def active_workers(attempts: DataFrame) -> DataFrame:
    """AG8."""
    return attempts.where(F.col("state").isin("LEASED", "RUNNING")).select("worker_id").distinct()


def logical_clock(**times: tuple[DataFrame, list[str]]) -> DataFrame:
    """AG9, SO1: the largest of all time columns; one partial maximum per table."""
    parts = [df.select(F.greatest(*(F.max(c) for c in cols), F.lit(0)).alias("t")) for df, cols in times.values()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.agg(F.max("t").alias("clock_ns"))


def slot_accounting(jobs: DataFrame, queues: DataFrame) -> DataFrame:
    """AG10: slots that the active jobs of each queue hold, against the queue's own figure."""
    held = jobs.where(F.col("state").isin(*ACTIVE)).groupBy("tenant_id", "queue_name").agg(F.sum("slot_cost").cast("long").alias("expected"))
    return queues.join(held, ["tenant_id", "queue_name"], "left").select("tenant_id", "queue_name", "active_slots", F.coalesce("expected", F.lit(0)).alias("expected"))


def attempt_repeats(attempts: DataFrame) -> DataFrame:
    """AG11."""
    return attempts.groupBy("job_id").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("repeats"))


def first_lease_after(attempts: DataFrame, jobs: DataFrame, after_ns: int) -> DataFrame:
    """AG14, JN22: per tenant, the first lease after a time; 0 where there is none."""
    leased = attempts.where(F.col("leased_at") > after_ns).join(jobs.select(F.col("id").alias("job_id"), "tenant_id"), "job_id").groupBy("tenant_id").agg(F.min("leased_at").alias("t"))
    return jobs.select("tenant_id").distinct().join(leased, "tenant_id", "left").select("tenant_id", F.coalesce("t", F.lit(0)).alias("first_lease"))


def ready_candidates(jobs: DataFrame, tenants: DataFrame, queues: DataFrame, now_ns: int, limit: int) -> DataFrame:
    """FLT1, JN1, WN1: the first `limit` jobs of each queue that may run now, in scheduling order. The tenant's cap is tested per job."""
    order = [F.desc("recovery_pending"), F.desc("priority"), F.asc("ready_seq"), F.asc("id")]
    own = jobs.where((F.col("state") == "PENDING") & (F.col("ready_seq") > 0) & (F.col("available_at") <= now_ns)).select("id", "tenant_id", "queue_name", "priority", "slot_cost", "ready_seq", "recovery_pending")
    limits = tenants.select("tenant_id", "max_slots", F.col("active_slots").alias("used"))
    fits = (F.col("max_slots") == 0) | (F.col("used") + F.col("slot_cost") <= F.col("max_slots"))
    joined = own.join(limits, "tenant_id").where(fits).join(queues.select("tenant_id", "queue_name", "weight", "deficit"), ["tenant_id", "queue_name"]).drop("max_slots", "used")
    return joined.withColumn("rank", F.row_number().over(Window.partitionBy("tenant_id", "queue_name").orderBy(*order)).cast("long")).where(F.col("rank") <= limit)


def history(events: DataFrame, job_id: str, before: int, limit: int) -> DataFrame:
    """TK1: a page of a job's events, latest first, with the cursor of the next page, 0 on the last. before 0: from the end."""
    page = events.where((F.col("job_id") == job_id) & (F.col("event_seq") < (before or BIG))).orderBy(F.desc("event_seq")).limit(limit + 1)
    actor = F.coalesce(F.get_json_object("payload_json", "$.actor"), F.lit("system"))
    ranked = page.withColumn("r", F.row_number().over(Window.orderBy(F.desc("event_seq"))))  # of at most limit + 1 rows
    full = Window.partitionBy()
    ranked = ranked.withColumn("n", F.count("*").over(full)).withColumn("low", F.min(F.when(F.col("r") <= limit, F.col("event_seq"))).over(full))
    return ranked.where(F.col("r") <= limit).select("event_seq", "event_type", "state", "state_version", actor.alias("actor"), F.when(F.col("n") > limit, F.col("low")).otherwise(0).alias("next_before"))


def open_dead_letters(dead_letters: DataFrame, limit: int) -> DataFrame:
    """TK2, FLT6."""
    return dead_letters.where(F.col("redriven_job_id").isNull()).orderBy("created_at", "job_id").limit(limit)


def without_open_parent(jobs: DataFrame, dependencies: DataFrame, states: DataFrame) -> DataFrame:
    """JN8: jobs all of whose parents succeeded."""
    parent = states.select(F.col("id").alias("depends_on_id"), F.col("state").alias("parent_state"))
    blocked = dependencies.join(parent, "depends_on_id").where(F.col("parent_state") != "SUCCEEDED").select(F.col("job_id").alias("id"))
    return jobs.join(blocked, "id", "left_anti")


def due_jobs(jobs: DataFrame, dependencies: DataFrame, now_ns: int, limit: int) -> DataFrame:
    """TK3: retrying or delayed jobs whose time has come, oldest first."""
    due = jobs.where((F.col("available_at") <= now_ns) & ((F.col("state") == "RETRYING") | (F.col("state") == "PENDING") & (F.col("ready_seq") == 0)))
    return without_open_parent(due, dependencies, jobs).orderBy("available_at", "id").limit(limit).select("id", "available_at", "state")


def expired_leases(attempts: DataFrame, jobs: DataFrame, now_ns: int, limit: int) -> DataFrame:
    """TK4, FLT3, JN4: leases that ran out (the last instant included), joined on the whole fence."""
    live = attempts.where(F.col("state").isin("LEASED", "RUNNING") & (F.col("expires_at") <= now_ns))
    held = jobs.where(F.col("state").isin(*ACTIVE)).select(F.col("id").alias("job_id"), "attempt_no", "lease_generation", "max_attempts", "tenant_id")
    return live.drop("max_attempts").join(held, ["job_id", "attempt_no", "lease_generation"]).orderBy("expires_at", "job_id").limit(limit).select("job_id", "attempt_no", "lease_generation", "expires_at", "tenant_id", "max_attempts")


def recent(jobs: DataFrame, dags: DataFrame, limit: int) -> DataFrame:
    """TK8, JN7: latest running and latest failed jobs, `limit` of either, with their DAG if any."""
    kind = F.when(F.col("state") == "RUNNING", "running").when(F.col("state").isin("FAILED", "DEAD_LETTER"), "failed")
    own = jobs.withColumn("kind", kind).where(F.col("kind").isNotNull())
    first = own.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("updated_at"), "id")).cast("long")).where(F.col("r") <= limit)
    return first.join(dags.select(F.col("job_id").alias("id"), "dag_id"), "id", "left").select("kind", "r", "id", "state", "updated_at", F.coalesce("dag_id", F.lit("")).alias("dag"))


def audit(events: DataFrame, since: int, until: int, actor: str | None = None) -> DataFrame:
    """TK9, FLT5: audit events of a time range, both ends included, of one actor or of all."""
    own = events.where(F.col("occurred_at").between(since, until))
    return own.where(F.col("actor") == actor) if actor else own


def dag_edges(dependencies: DataFrame, dags: DataFrame) -> DataFrame:
    """JN5: edges within DAGs by node key."""
    child = dags.select("dag_id", "job_id", F.col("node_key").alias("node"))
    parent = dags.select("dag_id", F.col("job_id").alias("depends_on_id"), F.col("node_key").alias("parent"))
    return dependencies.join(child, "job_id").join(parent, ["dag_id", "depends_on_id"]).select("dag_id", "node", "parent")


def run_view(jobs: DataFrame, dags: DataFrame, dependencies: DataFrame) -> DataFrame:
    """GR7, JN6: nodes of all runs with state and sorted parents, by one query."""
    parents = dag_edges(dependencies, dags).groupBy("dag_id", F.col("node").alias("node_key")).agg(F.array_join(F.array_sort(F.collect_list("parent")), ",").alias("depends_on"))
    state = jobs.select(F.col("id").alias("job_id"), "state")
    return dags.join(state, "job_id").join(parents, ["dag_id", "node_key"], "left").select("dag_id", "node_key", "job_id", "state", F.coalesce("depends_on", F.lit("")).alias("depends_on"))


def owned_audit(audit_events: DataFrame, jobs: DataFrame, default: str = "default") -> DataFrame:
    """JN21: give audit rows their target's tenant, or the default."""
    owner = jobs.select(F.col("id").alias("target"), "tenant_id")
    return audit_events.join(owner, "target", "left").select("id", "action", F.coalesce("tenant_id", F.lit(default)).alias("tenant_id"))


def dashboard_totals(depths: DataFrame, workers: DataFrame) -> DataFrame:
    """AG24: totals over queues and workers."""
    q = depths.agg(total(F.lit(True), F.col("active")).alias("depth"), total(F.lit(True), F.col("running")).alias("running"))
    w = workers.agg(F.count_if(F.col("status") == "healthy").alias("healthy"), F.count("*").alias("workers"))
    return one_row(q, w)


def children(parents: DataFrame, dependencies: DataFrame, jobs: DataFrame) -> DataFrame:
    """JN20: (id, open_parents) of the children of some jobs (id), with how many of all their parents haven't succeeded."""
    own = dependencies.join(parents.select(F.col("id").alias("depends_on_id")), "depends_on_id", "left_semi").select("job_id").distinct()
    state = jobs.select(F.col("id").alias("depends_on_id"), F.col("state").alias("parent_state"))
    all_ = dependencies.join(own, "job_id", "left_semi").join(state, "depends_on_id")
    return all_.groupBy(F.col("job_id").alias("id")).agg(F.count_if(F.col("parent_state") != "SUCCEEDED").alias("open_parents"))


def heads(records: DataFrame, by: list[str]) -> DataFrame:
    """TK7: sequence and hash of the last record of each chain."""
    return records.groupBy(*by).agg(F.max("sequence").alias("sequence"), F.max_by("hash", "sequence").alias("hash"))


def from_text(spark, sql: str, **tables: DataFrame) -> DataFrame:
    """SRC5: rows of a query given as text over named tables ({name})."""
    return spark.sql(sql, **tables)
