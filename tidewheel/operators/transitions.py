"""State transitions as set-at-a-time functions: commands joined with state give outcomes, never exceptions.

Every function takes the time as an argument. Guards are join conditions; numbers that the
ledger draws from counters are dense numbers over the order that the contract fixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.ledger import ACTIVE, TERMINAL, audit_id, dag_id, retry_delay_ns, sha_hex
from tidewheel.operators import graph, reads
from tidewheel.plans.storage import materialize, numbered


def submit(requests: DataFrame, known: DataFrame, jobs: DataFrame, tenants: DataFrame, counter: int, now_ns: int) -> DataFrame:
    """DM1, DM2, STR2: an outcome per request (request, tenant_id, submission_key, digest, job_id, parent, nodes).

    A key seen before with the same digest is replayed, with another it conflicts; the
    first of a batch (by request) stands for its key. Then parents: a missing one or one of
    another tenant is invalid, a failed one makes a dead letter, an open one waits. Admission
    counts all nodes of earlier requests of the tenant too. Ready jobs get dense numbers.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("tenant_id", "submission_key").orderBy("request")
    c = F.col
    own = requests.withColumn("first", F.first("digest").over(w)).withColumn("r", F.row_number().over(w))
    own = own.join(known.select("tenant_id", "submission_key", c("request_digest").alias("old"), c("job_id").alias("old_job")), ["tenant_id", "submission_key"], "left")
    parent = jobs.select(c("id").alias("parent"), c("tenant_id").alias("parent_tenant"), c("state").alias("parent_state"))
    own = own.join(parent, "parent", "left").join(reads.admission(jobs, tenants).select("tenant_id", "max_depth", "active"), "tenant_id", "left")
    seen = F.coalesce("old", F.when(c("r") > 1, c("first")))
    replay = F.when(seen.isNotNull(), F.when(seen == c("digest"), "replayed").otherwise("conflict"))
    invalid = F.when(c("parent").isNotNull() & (c("parent_state").isNull() | (c("parent_tenant") != c("tenant_id"))), "invalid")
    own = materialize(own.select("request", "tenant_id", "nodes", "job_id", "old_job", "parent", "parent_state", "max_depth", "active", F.coalesce(replay, invalid, F.lit("new")).alias("kind")), "asked")
    new = own.where(c("kind") == "new")
    if not new.where("nodes <> 1").limit(1).count():  # single jobs: the first of a tenant, as many as there is room for
        taken = F.row_number().over(Window.partitionBy("tenant_id").orderBy("request"))
        room = F.when(F.coalesce("max_depth", F.lit(0)) > 0, c("max_depth") - F.coalesce("active", F.lit(0)))
        admitted = new.withColumn("taken", taken).where(room.isNull() | (c("taken") <= room)).select("request").withColumn("admitted", F.lit(True))
        return _outcomes(own.join(admitted, "request", "left"), counter, now_ns)
    admitted = _admitted(new.select("request", "tenant_id", "nodes", "max_depth", "active")).withColumn("admitted", F.lit(True))
    return _outcomes(own.join(admitted, "request", "left"), counter, now_ns)


def _admitted(new: DataFrame) -> DataFrame:
    """(request) of those that fit one after another, by request, into their tenant's cap; one without a cap takes all.

    Room only shrinks, so the first of a size that doesn't fit shuts out all later ones of
    that size: a tenant's requests are walked through only as far as they can fill its room,
    and the walk keeps one request for each size.
    """
    from pyspark.sql import Window

    c = F.col
    room = F.when(F.coalesce("max_depth", F.lit(0)) != 0, c("max_depth") - F.coalesce("active", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("tenant_id", "nodes").orderBy("request"))
    few = new.where(room.isNotNull()).withColumn("place", place).where((c("nodes") < 1) | (c("place") * c("nodes") <= room))
    asked = few.groupBy("tenant_id", "max_depth", "active").agg(F.array_sort(F.collect_list(F.struct("request", "nodes"))).alias("asked"))
    kind = {f: new.schema[f].dataType.simpleString() for f in ("nodes", "request")}
    empty = F.struct(F.coalesce("active", F.lit(0)).cast("long").alias("used"), F.array().cast(f"array<struct<nodes:{kind['nodes']},until:{kind['request']}>>").alias("shut"))

    def walk(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["nodes"] <= c("max_depth")
        shut = F.exists(acc["shut"], lambda s: s["nodes"] == x["nodes"])
        more = F.array_append(acc["shut"], F.struct(x["nodes"].alias("nodes"), x["request"].alias("until")))
        return F.struct((acc["used"] + F.when(fits, x["nodes"]).otherwise(0)).cast("long").alias("used"), F.when(fits | shut, acc["shut"]).otherwise(more).alias("shut"))

    shut = asked.select("tenant_id", F.inline(F.aggregate("asked", empty, walk)["shut"]))
    taken = few.join(shut, ["tenant_id", "nodes"], "left").where(c("until").isNull() | (c("request") < c("until")))
    return new.where(room.isNull()).select("request").unionByName(taken.select("request"))


def _outcomes(own: DataFrame, counter: int, now_ns: int) -> DataFrame:
    """The last part of `submit`: outcome, state and ready number of each request."""
    c = F.col
    full = c("admitted").isNull()
    state = F.when(c("parent_state").isin("FAILED", "DEAD_LETTER"), "DEAD_LETTER").otherwise("PENDING")
    own = own.withColumn("outcome", F.when((c("kind") == "new") & full, "rejected").when(c("kind") == "new", "accepted").otherwise(c("kind")))
    own = own.withColumn("state", F.when(c("outcome") == "accepted", state))
    ready = (c("outcome") == "accepted") & (c("state") == "PENDING") & (c("parent").isNull() | (c("parent_state") == "SUCCEEDED"))
    numbers = numbered(own.where(ready).select("request"), "ready_seq", ["request"], counter + 1)
    return own.join(numbers, "request", "left").select("request", "outcome", "state", F.coalesce("ready_seq", F.lit(0)).alias("ready_seq"), F.coalesce("old_job", "job_id").alias("job_id"), F.lit(now_ns).alias("at"))


def start(commands: DataFrame, attempts: DataFrame, now_ns: int) -> DataFrame:
    """DM5, DM6: (job_id, attempt_no, token_hash) to started, running (idempotent) or stale; a lease that ends now is stale."""
    both = commands.join(attempts.select("job_id", "attempt_no", F.col("token_hash").alias("own"), "state", "expires_at"), ["job_id", "attempt_no"], "left")
    live = (F.col("own") == F.col("token_hash")) & (F.col("expires_at") > now_ns)
    outcome = F.when(live & (F.col("state") == "LEASED"), "started").when(live & (F.col("state") == "RUNNING"), "running").otherwise("stale")
    return both.select("job_id", "attempt_no", outcome.alias("outcome"))


def heartbeat(commands: DataFrame, attempts: DataFrame, ttl_ns: int, now_ns: int) -> DataFrame:
    """DM6, JN9: whether each heartbeat is accepted, and the later of the old and the new expiry."""
    own = start(commands, attempts, now_ns).withColumn("accepted", F.col("outcome") != "stale")
    return own.join(attempts.select("job_id", "attempt_no", "expires_at"), ["job_id", "attempt_no"], "left").select("job_id", "attempt_no", "accepted", F.when(F.col("accepted"), F.greatest("expires_at", F.lit(now_ns + ttl_ns))).otherwise(F.col("expires_at")).alias("expires_at"))


def outcome_of(success: Column, failure_retryable: Column, policy_retryable: Column, attempt: Column, most: Column) -> Column:
    """DM7: state after a completion."""
    again = failure_retryable & policy_retryable & (attempt < most)
    return F.when(success, "SUCCEEDED").when(again, "RETRYING").when(failure_retryable, "DEAD_LETTER").otherwise("FAILED")


def complete(commands: DataFrame, jobs: DataFrame, now_ns: int) -> DataFrame:
    """DM7: (job_id, attempt_no, success, failure_retryable) to the job's next state, version, and release time of a retry; stale where the fence differs."""
    c = F.col
    j = jobs.where(c("state").isin(*ACTIVE)).select(c("id").alias("job_id"), c("attempt_no").alias("fence"), "state_version", "max_attempts", F.coalesce(F.get_json_object("retry_json", "$.retryable").cast("boolean"), F.lit(False)).alias("policy"))
    both = commands.join(j, "job_id", "left")
    fits = F.coalesce(c("fence") == c("attempt_no"), F.lit(False))
    state = F.when(fits, outcome_of(c("success"), c("failure_retryable"), c("policy"), c("attempt_no"), c("max_attempts")))
    return both.select("job_id", "attempt_no", F.coalesce(state, F.lit("stale")).alias("state"), F.when(fits, c("state_version") + 1).alias("state_version"), F.when(state == "RETRYING", F.lit(now_ns) + retry_delay_ns(c("job_id"), c("attempt_no"))).alias("available_at"))


def promote(jobs: DataFrame, dependencies: DataFrame, counter: int, now_ns: int, limit: int) -> DataFrame:
    """DM9, STR7: due jobs become PENDING with dense ready numbers in order of (available_at, id)."""
    due = reads.due_jobs(jobs, dependencies, now_ns, limit)
    return numbered(due.select("id", "available_at"), "ready_seq", ["available_at", "id"], counter + 1).select("id", "ready_seq")


def reap(attempts: DataFrame, jobs: DataFrame, counter: int, now_ns: int, limit: int) -> DataFrame:
    """DM10: expired leases requeue at once while attempts are left, else become dead letters."""
    lost = reads.expired_leases(attempts, jobs, now_ns, limit)
    own = lost.select("job_id", "expires_at", F.when(F.col("attempt_no") < F.col("max_attempts"), "PENDING").otherwise("DEAD_LETTER").alias("state"))
    numbers = numbered(own.where("state = 'PENDING'").select("expires_at", "job_id"), "ready_seq", ["expires_at", "job_id"], counter + 1)
    return own.join(numbers.select("job_id", "ready_seq"), "job_id", "left").select("job_id", "state", F.coalesce("ready_seq", F.lit(0)).alias("ready_seq"))


def activate(parents: DataFrame, jobs: DataFrame, dependencies: DataFrame, counter: int) -> DataFrame:
    """DM11, JN20: pending children of just-succeeded parents (id), all of whose parents succeeded, in order of id."""
    child = dependencies.join(parents.select(F.col("id").alias("depends_on_id")), "depends_on_id", "left_semi").select(F.col("job_id").alias("id")).distinct()
    waiting = jobs.where((F.col("state") == "PENDING") & (F.col("ready_seq") == 0)).join(child, "id", "left_semi")
    return numbered(reads.without_open_parent(waiting, dependencies, jobs).select("id"), "ready_seq", ["id"], counter + 1)


def fail_descendants(failed: DataFrame, jobs: DataFrame, dependencies: DataFrame) -> DataFrame:
    """DM12: (id) of open jobs anywhere below the failed ones, which become dead letters."""
    return graph.open_descendants(failed, jobs, dependencies)


def force(commands: DataFrame, jobs: DataFrame) -> DataFrame:
    """DM13: operator actions (job_id, action) to state, whether a live attempt is fenced, and whether recovery is pending; terminal or unknown jobs give an error."""
    c = F.col
    j = jobs.select(c("id").alias("job_id"), c("state").alias("old"))
    both = commands.join(j, "job_id", "left")
    active = c("old").isin(*ACTIVE)
    to = F.when(c("action") == "release", "PENDING").when(c("action").isin("cancel", "fail"), "FAILED").when(c("action") == "dead_letter", "DEAD_LETTER")
    wrong = c("old").isNull() | c("old").isin(*TERMINAL) | to.isNull()
    return both.select("job_id", "action", F.when(wrong, "error").otherwise(to).alias("state"), (~wrong & active).alias("fenced"), (~wrong & active & (c("action") == "release")).alias("recovery_pending"))


def redrive(commands: DataFrame, dead_letters: DataFrame, jobs: DataFrame) -> DataFrame:
    """DM14, DM15: (job_id, request) to a clone's id, once per dead letter; the first request of a batch wins."""
    first = commands.groupBy("job_id").agg(F.min("request").alias("request"))
    both = first.join(dead_letters.select("job_id", "redriven_job_id", F.lit(True).alias("dead")), "job_id", "left").join(jobs.select(F.col("id").alias("job_id"), "tenant_id", "queue_name", "priority", "slot_cost"), "job_id")
    new = F.substring(sha_hex(F.lit("redrive"), F.col("job_id"), F.col("request").cast("string")), 1, 32)
    outcome = F.when(F.col("dead").isNull(), "not dead").when(F.col("redriven_job_id").isNotNull(), "already").otherwise("cloned")
    return both.select("job_id", outcome.alias("outcome"), F.when(outcome == "cloned", new).otherwise(F.col("redriven_job_id")).alias("clone_id"), "tenant_id", "queue_name", "priority", "slot_cost")


def register(beats: DataFrame, workers: DataFrame) -> DataFrame:
    """DM17, STR8: workers after heartbeats (worker_id, capacity_slots, at): the latest time counts, another capacity conflicts."""
    new = beats.groupBy("worker_id").agg(F.max("at").alias("at"), F.min("capacity_slots").alias("lo"), F.max("capacity_slots").alias("hi"))
    both = workers.join(new, "worker_id", "full_outer")
    capacity = F.coalesce("capacity_slots", "lo")
    return both.select("worker_id", capacity.alias("capacity_slots"), F.greatest("last_heartbeat_at", "at").alias("last_heartbeat_at"), F.coalesce((F.col("lo") != capacity) | (F.col("hi") != capacity), F.lit(False)).alias("conflict"))


def next_counter(used: DataFrame, column: str, current: int) -> DataFrame:
    """DM20: the counter after numbers were drawn."""
    return used.agg(F.greatest(F.coalesce(F.max(column), F.lit(0)), F.lit(current)).alias("value"))


def acquire(grants: DataFrame, jobs: DataFrame, tenants: DataFrame, worker: str, token: str, ttl_ns: int, now_ns: int) -> DataFrame:
    """DM4, DM8: leases for granted jobs (job_id): next attempt, generation and version, and the token's hash.

    The scheduler tests a tenant's cap job by job; where its grants together overshoot it,
    the whole transaction fails, so every row's `committed` is false.
    """
    c = F.col
    own = grants.select("job_id").join(jobs.select(c("id").alias("job_id"), "tenant_id", "queue_name", "slot_cost", "attempt_no", "lease_generation", "state_version", "state"), "job_id")
    spent = own.groupBy("tenant_id").agg(F.sum("slot_cost").alias("spent")).join(tenants.select("tenant_id", "max_slots", "active_slots"), "tenant_id")
    over = spent.agg(F.count_if((c("max_slots") > 0) & (c("active_slots") + c("spent") > c("max_slots"))).alias("over"))
    flagged = own.withColumn("one", F.lit(1)).join(F.broadcast(over.withColumn("one", F.lit(1))), "one").drop("one")  # one row
    attempt = c("attempt_no") + 1
    return flagged.select(
        "job_id", "tenant_id", "queue_name", "slot_cost", attempt.alias("attempt_no"), (c("lease_generation") + 1).alias("lease_generation"), (c("state_version") + 1).alias("state_version"), F.lit("SCHEDULED").alias("state"),
        F.lit(worker).alias("worker_id"), sha_hex(F.lit(token), c("job_id"), attempt.cast("string")).alias("token_hash"), F.lit(now_ns).alias("leased_at"), F.lit(now_ns + ttl_ns).alias("expires_at"), ((c("over") == 0) & (c("state") == "PENDING")).alias("committed"),
    )


def reserved(grants: DataFrame, tenants: DataFrame) -> DataFrame:
    """DM8: slots that grants ask of each tenant, and whether its cap lets it have them all."""
    asked = grants.groupBy("tenant_id").agg(F.sum("slot_cost").cast("long").alias("asked"))
    both = tenants.select("tenant_id", "max_slots", "active_slots").join(asked, "tenant_id", "left").withColumn("asked", F.coalesce("asked", F.lit(0)))
    return both.withColumn("fits", (F.col("max_slots") == 0) | (F.col("active_slots") + F.col("asked") <= F.col("max_slots")))


def record_actions(actions: DataFrame, known: DataFrame, now_ns: int) -> DataFrame:
    """DM16: audit events of operator actions (tenant_id, action, idempotency_key, actor, target_type, target_id, digest); a known scope with another digest conflicts."""
    old = known.select("tenant_id", "action", "idempotency_key", F.col("digest").alias("old"))
    both = actions.join(old, ["tenant_id", "action", "idempotency_key"], "left")
    outcome = F.when(F.col("old").isNull(), "recorded").when(F.col("old") == F.col("digest"), "replayed").otherwise("conflict")
    return both.select(audit_id(F.col("tenant_id"), F.col("action"), F.col("idempotency_key")).alias("id"), "tenant_id", "action", "actor", "target_type", "target_id", outcome.alias("outcome"), F.lit(now_ns).alias("occurred_at"))


def create_triggers(requests: DataFrame, known: DataFrame) -> DataFrame:
    """DM18: new cron triggers (id, schedule, next_fire_at); an id that exists conflicts unless its schedule is the same."""
    both = requests.join(known.select("id", F.col("schedule").alias("old")), "id", "left")
    return both.withColumn("outcome", F.when(F.col("old").isNull(), "created").when(F.col("old") == F.col("schedule"), "same").otherwise("conflict")).drop("old")


def save_dag(nodes: DataFrame, jobs: DataFrame, tenant: str, key: str) -> DataFrame:
    """DM19: (dag_id, job_id, node_key) rows of one run; nodes whose job is missing or whose key repeats are marked."""
    from pyspark.sql import Window

    known = jobs.where(F.col("tenant_id") == tenant).select(F.col("id").alias("job_id"), F.lit(True).alias("known"))
    n = F.count("*").over(Window.partitionBy("node_key"))
    message = F.when(F.col("known").isNull(), "missing job").when(F.col("n") > 1, "duplicate node")
    return nodes.withColumn("n", n).join(known, "job_id", "left").select(dag_id(F.lit(tenant), F.lit(key)).alias("dag_id"), "job_id", "node_key", message.alias("message"))


def submit_workflows(nodes: DataFrame, edges: DataFrame, known: DataFrame, jobs: DataFrame, tenants: DataFrame, counter: int, now_ns: int) -> DataFrame:
    """DM2, DM3: (request, node, outcome, ready_seq) of whole workflows: `nodes` has request, tenant_id, submission_key, digest, node, job_id, available_at; `edges` has request, node, parent.

    A workflow is taken whole or not at all: admission counts all its nodes, and a fault or
    a cycle in its graph makes it invalid. Roots that aren't delayed get ready numbers, by
    request and node.
    """
    c = F.col
    n = nodes.select(c("request").cast("string").alias("dag_id"), c("node").alias("id"))
    e = edges.select(c("request").cast("string").alias("dag_id"), c("node").alias("id"), "parent")
    bad = graph.validate(n, e).select("dag_id").unionByName(graph.levels(n, e).where("level is null").select("dag_id")).distinct().select(c("dag_id").alias("bad"))
    whole_ = nodes.groupBy("request", "tenant_id", "submission_key", "digest").agg(F.count("*").alias("nodes"), F.min("job_id").alias("job_id")).withColumn("parent", F.lit(None).cast("string"))
    whole_ = materialize(whole_.join(bad, c("request").cast("string") == c("bad"), "left"), "whole")
    taken = submit(whole_.where("bad is null").drop("bad"), known, jobs, tenants, counter, now_ns).select("request", "outcome")
    taken = materialize(taken.unionByName(whole_.where("bad is not null").select("request", F.lit("invalid").alias("outcome"))), "taken")
    each = nodes.select("request", "node", "available_at").join(taken, "request")
    roots = each.where((c("outcome") == "accepted") & (c("available_at") <= now_ns)).join(edges.select("request", "node").distinct(), ["request", "node"], "left_anti").select("request", "node")
    return each.join(numbered(roots, "ready_seq", ["request", "node"], counter + 1), ["request", "node"], "left").select("request", "node", "outcome", F.coalesce("ready_seq", F.lit(0)).alias("ready_seq"))
