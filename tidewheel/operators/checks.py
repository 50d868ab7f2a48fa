"""Reconciliation: each rule is one query of violations (check, job_id, message); a report counts them."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.ledger import ACTIVE, TERMINAL, is_digest, is_id
from tidewheel.operators.graph import levels, open_descendants
from tidewheel.plans.storage import materialize

#: Moves that an event may make, from state to state; terminal states have none. A state stays as it is only where PENDING is released or promoted.
MOVES = {
    "PENDING": ("SCHEDULED", "FAILED", "DEAD_LETTER"),
    "SCHEDULED": ("RUNNING", "PENDING", "RETRYING", "SUCCEEDED", "FAILED", "DEAD_LETTER"),
    "RUNNING": ("PENDING", "RETRYING", "SUCCEEDED", "FAILED", "DEAD_LETTER"),
    "RETRYING": ("PENDING", "SCHEDULED", "DEAD_LETTER"),
}
STAYS = ("dependency_released", "job_promoted")
#: States of a job's last attempt that fit the state of its completion.
ENDS = {"SUCCEEDED": ("SUCCEEDED",), "FAILED": ("FAILED",), "DEAD_LETTER": ("FAILED", "EXPIRED")}
RECEIPT = ("completion_request_digest", "receipt_state", "receipt_state_version", "receipt_committed_at")


def violation(df: DataFrame, check: str, rules: list[tuple[Column, str]], job: str = "job_id") -> DataFrame:
    """One row per rule that a row breaks; a rule that is null counts as kept."""
    broken = F.filter(F.array(*(F.when(bad, F.lit(message)) for bad, message in rules)), lambda m: m.isNotNull())
    return df.select(F.lit(check).alias("check"), F.col(job).cast("string").alias("job_id"), F.explode(broken).alias("message"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def own(df: DataFrame, name: str, kind: str = "string") -> Column:
    """A column that some ledgers lack; null there, so that its rules count as kept."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def bad_json(x: Column) -> Column:
    """Text that is there and isn't JSON."""
    return x.isNotNull() & F.try_parse_json(x).isNull()


def extra(df: DataFrame, keys: list[str], check: str, message: str, job: Column) -> DataFrame:
    """A violation for each row beyond the first of its keys."""
    more = df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(job).alias("j")).where("n > 1")
    return more.select(F.lit(check).alias("check"), F.col("j").cast("string").alias("job_id"), F.explode(F.array_repeat(F.lit(message), (F.col("n") - 1).cast("int"))).alias("message"))


def manifest(accepted: DataFrame, expected: int | None = None) -> DataFrame:
    """REC1: dense sequence, proper ids, filled fields, unique ids and keys, and the expected count."""
    rows = violation(accepted, "manifest", [(~is_id(F.col("job_id")), "invalid job id"), ((F.coalesce("tenant_id", F.lit("")) == "") | (F.coalesce("submission_key", F.lit("")) == "") | F.col("accepted_at").isNull(), "empty field")])
    repeated = lambda cols, what: accepted.groupBy(*cols).agg(F.count("*").alias("n"), F.min("job_id").alias("j")).where("n > 1").select(F.lit("manifest").alias("check"), F.col("j").alias("job_id"), F.lit(what).alias("message"))
    dense = accepted.agg(F.count("*").alias("n"), F.countDistinct("sequence").alias("d"), F.min("sequence").alias("a"), F.max("sequence").alias("b"))
    gaps = violation(dense.withColumn("job_id", F.lit("")), "manifest", [((F.col("n") > 0) & ((F.col("d") != F.col("n")) | (F.col("a") != 1) | (F.col("b") != F.col("n"))), "sequence not contiguous"), (F.col("n") != (F.col("n") if expected is None else F.lit(expected)), "unexpected count")])
    return union([rows, gaps, repeated(["job_id"], "duplicate job"), repeated(["tenant_id", "submission_key"], "duplicate key")])


def ledger_jobs(accepted: DataFrame, jobs: DataFrame) -> DataFrame:
    """REC2, JN19, SO4: jobs that were never accepted, accepted jobs that are missing."""
    # ids are shuffled as bytes
    both = accepted.select(packed("job_id").alias("a")).join(jobs.select(packed("id").alias("j")), F.col("a") == F.col("j"), "full_outer").withColumn("job_id", F.coalesce("a", "j"))
    both = both.withColumn("job_id", unpacked("job_id"))
    return violation(both, "canonical_ledger", [(F.col("a").isNull(), "job absent from manifest"), (F.col("j").isNull(), "accepted job missing")])


def materialized(jobs: DataFrame) -> DataFrame:
    """REC3: ids unique and proper, filled keys, counters, times in order, terminal time of terminal jobs alone, JSON that parses."""
    terminal, c = F.col("state").isin(*TERMINAL), F.col
    most = F.get_json_object("retry_json", "$.max_attempts").cast("long")
    rules = [
        (~is_id(c("id")), "invalid id"),
        (own(jobs, "execution_key") == "", "empty execution key"),
        ((c("state_version") < 1) | (c("attempt_no") < 0) | (c("lease_generation") < 0), "invalid counters"),
        ((c("created_at") > c("updated_at")) | (c("created_at") <= 0), "updated before created"),
        (terminal != c("terminal_at").isNotNull(), "terminal time disagrees with state"),
        (terminal & ((c("terminal_at") < c("created_at")) | (c("terminal_at") > c("updated_at"))), "terminal time out of order"),
        ((c("state") != "PENDING") & (c("ready_seq") != 0), "ready sequence outside PENDING"),
        (c("slot_cost") < 1, "invalid slot cost"),
        (F.try_parse_json(c("payload_json")).isNull(), "invalid payload"),
        (F.try_parse_json(c("payload_json")).isNotNull() & ~F.coalesce(F.get_json_object("payload_json", "$.type"), F.lit("")).isin("noop", "shell"), "invalid payload type"),
        (F.try_parse_json(c("retry_json")).isNull() | (F.coalesce(most, F.lit(0)) < 1), "invalid retry policy"),
        (bad_json(own(jobs, "failure_json")), "invalid failure"),
    ]
    return union([violation(jobs, "materialized_jobs", rules, "id"), extra(jobs, ["id"], "materialized_jobs", "duplicate job", F.col("id"))])


def completions(accepted: DataFrame, jobs: DataFrame, done: DataFrame) -> DataFrame:
    """REC4, AG12: one completion per terminal job, in agreement with it, accepted, and a success."""
    c = F.col
    j = jobs.select(c("id").alias("jid"), c("state").alias("jstate"), c("state_version").alias("jversion"), c("attempt_no").alias("jattempt"), "terminal_at").dropDuplicates(["jid"])
    known = accepted.select(c("job_id").alias("aid")).distinct()
    both = done.withColumn("failure", own(done, "failure_json")).join(j, c("job_id") == c("jid"), "left").join(known, c("job_id") == c("aid"), "left")
    rules = [
        (c("aid").isNull(), "completion absent from manifest"),
        (c("jid").isNull(), "orphan completion"),
        ((c("state") != c("jstate")) | (c("state_version") != c("jversion")) | (c("attempt_no") != c("jattempt")), "completion disagrees with job"),
        (c("jid").isNotNull() & ((c("committed_at") <= 0) | (c("committed_at") != c("terminal_at"))), "commit time differs from terminal time"),
        (c("jid").isNotNull() & (c("state") != "SUCCEEDED"), "outcome is no success"),
        (c("jid").isNotNull() & (c("attempt_no") > 0) & ~is_digest(c("output_digest")), "invalid digest"),
        (c("jid").isNotNull() & bad_json(c("failure")), "invalid failure"),
    ]
    lost = accepted.select("job_id").distinct().join(done.select("job_id"), "job_id", "left_anti")
    open_ = j.join(done.select(c("job_id").alias("jid")), "jid", "left_anti").where(c("jstate").isin(*TERMINAL))
    early = j.where(~c("jstate").isin(*TERMINAL)).join(done.select(c("job_id").alias("jid")), "jid", "left_semi")
    always = lambda df, what, job="job_id": violation(df, "canonical_ledger", [(F.lit(True), what)], job)
    return union([extra(done, ["job_id"], "canonical_ledger", "duplicate completion", c("job_id")), violation(both, "canonical_ledger", rules), always(lost, "no canonical completion"), always(open_, "terminal job without completion", "jid"), always(early, "completion of an open job", "jid")])


def idempotency(accepted: DataFrame, requests: DataFrame) -> DataFrame:
    """REC5: each accepted submission has one request, for that job, with a digest, kind, time and stable response; each request's job was accepted."""
    c = F.col
    a = accepted.select("tenant_id", "submission_key", c("job_id").alias("wanted")).dropDuplicates(["tenant_id", "submission_key"])
    r = requests.withColumn("response", own(requests, "response_json")).withColumn("made", own(requests, "created_at", "long"))
    known = accepted.select(c("job_id").alias("aid")).distinct()
    both = a.join(r, ["tenant_id", "submission_key"], "full_outer").join(known, c("job_id") == c("aid"), "left").withColumn("j", F.coalesce("job_id", "wanted"))
    there, answer = c("request_kind").isNotNull(), F.get_json_object("response", "$.id")
    rules = [
        (c("wanted").isNull(), "request absent from manifest"),
        (~there, "missing request"),
        (there & ~c("job_id").eqNullSafe(c("wanted")) & c("wanted").isNotNull(), "request names another job"),
        (there & ((c("request_kind") != "job") | (F.coalesce("request_digest", F.lit("")) == "") | (c("made") <= 0)), "invalid request"),
        (there & bad_json(c("response")), "invalid response"),
        (there & c("response").isNotNull() & ~bad_json(c("response")) & ~answer.eqNullSafe(c("job_id")), "response names another job"),
        (there & c("job_id").isNotNull() & c("aid").isNull(), "job of request absent from manifest"),
    ]
    return union([violation(both, "idempotency", rules, "j"), extra(requests, ["tenant_id", "submission_key"], "idempotency", "duplicate request", c("job_id"))])


def attempt_rows(attempts: DataFrame, jobs: DataFrame) -> DataFrame:
    """REC6: rows of attempts each for itself: job, worker, token, numbers, times, receipt all or nothing."""
    c, closed = F.col, ~F.col("state").isin("LEASED", "RUNNING")
    both = attempts.join(jobs.select(c("id").alias("job_id"), F.lit(True).alias("known")).distinct(), "job_id", "left")
    fields = [own(attempts, f) for f in RECEIPT]
    n = reduce(Column.__add__, (f.isNotNull().cast("int") for f in fields))
    rules = [
        (c("known").isNull(), "attempt without job"),
        ((F.coalesce("worker_id", F.lit("")) == "") | ~is_digest(c("token_hash")), "invalid worker or token"),
        ((c("attempt_no") < 1) | (c("lease_generation") < 1), "number not positive"),
        ((c("leased_at") <= 0) | (c("leased_at") > c("heartbeat_at")) | (c("heartbeat_at") > c("expires_at")), "times out of order"),
        (c("started_at") < c("leased_at"), "started before lease"),
        (closed != c("completed_at").isNotNull(), "completion time disagrees with state"),
        (closed & (c("completed_at") < c("leased_at")), "completed before lease"),
        (fields[0].isNotNull() & ~is_digest(fields[0]), "invalid digest of completion"),
        ((n != 0) & (n != 4), "partial receipt"),
        ((c("state") == "EXPIRED") & (n != 0), "receipt of an expired attempt"),
        (bad_json(own(attempts, "failure_json")), "invalid failure"),
    ]
    return violation(both, "attempts_and_leases", rules)


def attempt_chain(attempts: DataFrame, jobs: DataFrame, done: DataFrame | None = None, drained: bool = False) -> DataFrame:
    """REC7, WN5: contiguous numbers, rising generations, one active attempt at most and only of an active job, the job's fence on the last, and the last in agreement with the completion; none active once `drained`."""
    w = Window.partitionBy("job_id").orderBy("attempt_no", "lease_generation")
    c, live = F.col, F.col("state").isin("LEASED", "RUNNING")
    ranked = attempts.select("job_id", "attempt_no", "lease_generation", "state").withColumn("r", F.row_number().over(w)).withColumn("g", F.lag("lease_generation").over(w))
    rows = violation(ranked, "attempts_and_leases", [(c("attempt_no") != c("r"), "attempt numbers not contiguous"), (c("lease_generation") <= c("g"), "generation not increasing")])
    end = F.struct("attempt_no", "lease_generation")
    last = attempts.withColumn("receipt", own(attempts, "receipt_committed_at", "long")).groupBy("job_id").agg(F.max(end).alias("last"), F.max_by("state", end).alias("end"), F.max_by("receipt", end).alias("receipt"), F.count_if(live).alias("live"))
    j = jobs.select(c("id").alias("job_id"), "attempt_no", "lease_generation", "state").dropDuplicates(["job_id"])
    both = j.join(last, "job_id", "left")
    none = c("last").isNull()
    rules = [
        (~none & ((c("last.attempt_no") != c("attempt_no")) | (c("last.lease_generation") != c("lease_generation"))), "fence differs from last attempt"),
        (none & ((c("attempt_no") != 0) | (c("lease_generation") != 0)), "fence without attempts"),
        ((c("live") > 0) & ~c("state").isin(*ACTIVE), "active attempt of inactive job"),
    ]
    parts = [rows, violation(both, "attempts_and_leases", rules), violation(last, "attempts_and_leases", [(c("live") > 1, "more than one active attempt")])]
    if done is not None and "receipt_committed_at" in attempts.columns:
        ended = done.where("attempt_no > 0").select("job_id", c("state").alias("want"), c("attempt_no").alias("no"), "committed_at").dropDuplicates(["job_id"]).join(j.select("job_id"), "job_id", "left_semi").join(last, "job_id")
        fits = F.coalesce(reduce(Column.__or__, ((c("want") == s) & c("end").isin(*ends) for s, ends in ENDS.items())), F.lit(False))
        parts.append(violation(ended, "attempts_and_leases", [((c("last.attempt_no") != c("no")) | ~fits | ~c("receipt").eqNullSafe(c("committed_at")), "last attempt disagrees with completion")]))
    if drained:
        parts.append(violation(attempts.agg(F.count_if(live).alias("n")).withColumn("job_id", F.lit("")), "attempts_and_leases", [(c("n") > 0, "active attempts after the drain")]))
    return union(parts)


def allowed(previous: Column, state: Column, kind: Column) -> Column:
    """Whether an event may move a job from one state to another."""
    moves = reduce(Column.__or__, ((previous == old) & state.isin(*news) for old, news in MOVES.items()))
    stays = (previous == state) & (previous == "PENDING") & kind.isin(*STAYS)
    return F.coalesce(moves | stays, F.lit(False))


def event_log(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """REC8, WN2-WN4: dense sequence (by counts, not by a window over all), admission first and once, versions, moves, the fold equals the job, and no event without a job."""
    c = F.col
    w = Window.partitionBy("job_id").orderBy("event_seq")
    known = jobs.select(c("id").alias("job_id"), c("state").alias("js"), c("state_version").alias("jv"), F.lit(True).alias("known")).dropDuplicates(["job_id"])
    bad = (c("occurred_at") <= 0) | F.try_parse_json(c("payload_json")).isNull()
    own = events.select("job_id", "event_seq", "event_type", "state", "state_version", bad.alias("bad"))
    ranked = own.withColumn("r", F.row_number().over(w)).withColumn("previous", F.lag("state").over(w)).withColumn("last", F.lead(F.lit(1)).over(w).isNull())
    ranked = ranked.withColumn("admissions", F.count_if(c("event_type") == "job_admitted").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # events are shuffled once, by job; a job's last event stands for its fold
    both = known.join(ranked.drop("event_seq"), "job_id", "full_outer")
    rules = [
        (c("bad"), "invalid payload or time"),
        (c("known") & (c("r") == 1) & (c("event_type") != "job_admitted"), "admission not first and once"),
        (c("known") & (c("state_version") != c("r")), "version not contiguous"),
        (c("known") & (c("r") > 1) & ~allowed(c("previous"), c("state"), c("event_type")), "move not allowed"),
        (c("last") & c("known").isNull(), "events without job"),
        (c("r").isNull() | (c("last") & c("state").isNull()), "job without events"),
        (c("last") & c("known") & (c("admissions") != 1), "not one admission"),
        (c("last") & ((c("state") != c("js")) | (c("state_version") != c("jv"))), "fold differs from job"),
    ]
    return union([violation(both, "event_log", rules), event_sequence(events)])


def event_sequence(events: DataFrame) -> DataFrame:
    """WN3: the sequence of all events is dense, by counts."""
    c = F.col
    dense = events.agg(F.count("*").alias("n"), F.countDistinct("event_seq").alias("d"), F.min("event_seq").alias("a"), F.max("event_seq").alias("b")).withColumn("job_id", F.lit(""))
    return violation(dense, "event_log", [((c("n") > 0) & ((c("d") != c("n")) | (c("a") != 1) | (c("b") != c("n"))), "sequence not contiguous")])


def fold_events(events: DataFrame) -> DataFrame:
    """STR4: state and version of each job after its last event."""
    return events.groupBy("job_id").agg(F.max_by("state", "event_seq").alias("state"), F.max_by("state_version", "event_seq").alias("state_version"), F.max("event_seq").alias("last_seq"))


def releases(events: DataFrame) -> DataFrame:
    """AG13: jobs that were released more than once."""
    n = events.where(F.col("event_type") == "dependency_released").groupBy("job_id").count()
    return violation(n, "dag", [(F.col("count") > 1, "released more than once")])


def dependencies(edges: DataFrame, jobs: DataFrame, events: DataFrame) -> DataFrame:
    """REC9, GR5, AG13: edges with both ends in one tenant, no cycles, released jobs with all parents succeeded, nothing open anywhere below a failed job (each job once), one release at most."""
    c = F.col
    jobs = materialize(jobs.select(packed("id").alias("id"), "tenant_id", "state", "ready_seq").dropDuplicates(["id"]), "ends")
    edges = edges.select(packed("job_id").alias("job_id"), packed("depends_on_id").alias("depends_on_id"))
    end = lambda p: jobs.select(c("id").alias(f"{p}_id"), c("tenant_id").alias(f"{p}_tenant"), c("state").alias(f"{p}_state"), c("ready_seq").alias(f"{p}_ready"))
    both = materialize(edges.join(end("child"), c("job_id") == c("child_id"), "left").join(end("parent"), c("depends_on_id") == c("parent_id"), "left"), "both")
    rules = [
        (c("child_id").isNull() | c("parent_id").isNull(), "edge end missing"),
        (c("child_tenant") != c("parent_tenant"), "edge crosses tenants"),
        (((c("child_ready") > 0) | c("child_state").isin(*ACTIVE, "SUCCEEDED")) & (c("parent_state") != "SUCCEEDED"), "released before parents succeeded"),
    ]
    inner = both.where(c("child_id").isNotNull() & c("parent_id").isNotNull()).select("job_id", "depends_on_id")
    ends = inner.select(F.lit("").alias("dag_id"), c("job_id").alias("id"), c("depends_on_id").alias("parent"))
    bent = levels(jobs.select(F.lit("").alias("dag_id"), "id"), ends).withColumnRenamed("id", "job_id")
    below = open_descendants(jobs.where(c("state").isin("FAILED", "DEAD_LETTER")).select("id"), jobs, inner)
    named = lambda df, k="job_id": df.withColumn(k, unpacked(k))
    parts = [violation(named(both), "dag", rules), releases(events), violation(named(bent), "dag", [(c("level").isNull(), "on or below a cycle")])]
    return union([*parts, violation(named(below, "id"), "dag", [(F.lit(True), "open below a failed job")], "id")])


def packed(name: str) -> Column:
    """An id as bytes, half as long where it is proper; other texts keep all of theirs behind another first byte."""
    own = F.col(name)
    return F.when(is_id(own), F.concat(F.unhex(F.lit("01")), F.unhex(own))).otherwise(F.concat(F.unhex(F.lit("00")), own.cast("binary")))


def unpacked(name: str) -> Column:
    own = F.col(name)
    rest = F.expr(f"substring({name}, 2)")
    return F.when(F.hex(F.substring(own, 1, 1)) == "01", F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def slots(jobs: DataFrame, queues: DataFrame, tenants: DataFrame, drained: bool = False) -> DataFrame:
    """REC10: active slots of queues and tenants are what active jobs hold, within caps of slots and depth; none are held once `drained`."""
    c, name = F.col, F.concat_ws("/", "tenant_id", "queue_name")
    held = F.when(c("state").isin(*ACTIVE), c("slot_cost")).otherwise(0)
    q = jobs.where(c("state").isin(*ACTIVE)).groupBy("tenant_id", "queue_name").agg(F.sum(held).cast("long").alias("want")).join(queues, ["tenant_id", "queue_name"], "full_outer").withColumn("name", name)
    open_ = jobs.where(~c("state").isin(*TERMINAL)).groupBy("tenant_id").agg(F.sum(held).cast("long").alias("want"), F.count("*").alias("depth"))
    t = open_.join(tenants.withColumn("most", own(tenants, "max_depth", "long")), "tenant_id", "full_outer")
    wrong = (F.coalesce("want", F.lit(0)) != c("active_slots"), "active slots differ")
    parts = [
        violation(q, "slot_accounting", [(c("active_slots").isNull(), "queue row missing"), wrong, (c("weight") < 1, "invalid weight")], "name"),
        violation(t, "slot_accounting", [(c("active_slots").isNull(), "tenant row missing"), wrong, ((c("max_slots") > 0) & (c("active_slots") > c("max_slots")), "slots over cap"), ((c("most") > 0) & (c("depth") > c("most")), "depth over cap")], "tenant_id"),
    ]
    if drained:
        parts.append(violation(jobs.agg(F.sum(held).alias("n")).withColumn("job_id", F.lit("")), "slot_accounting", [(c("n") > 0, "reservations after the drain")]))
    return union(parts)


def counters(jobs: DataFrame, counters: DataFrame | int) -> DataFrame:
    """REC11, AG15: the counter of ready sequences is there once and not behind; the sequences are unique."""
    c = F.col
    if isinstance(counters, int):
        counters = jobs.sparkSession.createDataFrame([("ready_seq", counters)], "name string, value long")
    ready = jobs.where(c("ready_seq") > 0).select("ready_seq", c("id"))
    value = counters.where("name = 'ready_seq'").agg(F.max("value").alias("value"))
    head = ready.agg(F.max("ready_seq").alias("value"))
    both = value.select("value", F.lit("v").alias("what")).unionByName(head.select("value", F.lit("h").alias("what"))).agg(F.max(F.when(c("what") == "v", c("value"))).alias("v"), F.max(F.when(c("what") == "h", c("value"))).alias("h")).withColumn("job_id", F.lit(""))
    return union([
        violation(both, "materialized_jobs", [(c("v").isNull(), "counter missing"), (c("v") < c("h"), "counter behind ready sequence")]),
        extra(counters, ["name"], "materialized_jobs", "duplicate counter", F.lit("")),
        extra(ready, ["ready_seq"], "materialized_jobs", "ready sequence repeated", c("id")),
    ])


def schema_versions(migrations: DataFrame) -> DataFrame:
    """REC12: versions from 1 without a gap, each with a name, a digest and a time; at least one."""
    c = F.col
    d = migrations.agg(F.count("*").alias("n"), F.countDistinct("version").alias("d"), F.min("version").alias("a"), F.max("version").alias("b")).withColumn("job_id", F.lit(""))
    whole = violation(d, "schema_migrations", [(c("n") == 0, "no migrations"), ((c("n") > 0) & ((c("d") != c("n")) | (c("a") != 1) | (c("b") != c("n"))), "versions not contiguous")])
    rules = [(~is_digest(c("checksum")), "invalid checksum"), (own(migrations, "name") == "", "empty name"), (own(migrations, "applied_at", "long") <= 0, "invalid time")]
    return union([whole, violation(migrations, "schema_migrations", rules, "version")])


def foreign_keys(child: DataFrame, key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    """REC15: rows whose key has no parent; null keys have none to have."""
    lost = child.where(F.col(key).isNotNull()).select(F.col(key).alias("k")).join(parent.select(F.col(parent_key).alias("k")), "k", "left_anti")
    return violation(lost, "foreign_keys", [(F.lit(True), name)], "k")


#: Names of the checks that a report must have; two on the database file itself can't run here.
CHECKS = ("manifest", "canonical_ledger", "materialized_jobs", "idempotency", "attempts_and_leases", "event_log", "dag", "slot_accounting", "schema_migrations", "foreign_keys")


def report(violations: DataFrame, ran: Iterable[str] = ()) -> DataFrame:
    """REC13: every check with its number of violations, and whether it passed; both are null for a check that found nothing and isn't among those that `ran`."""
    names = violations.sparkSession.createDataFrame([(c, c in set(ran)) for c in CHECKS], "check string, ran boolean")
    n = violations.groupBy("check").agg(F.count("*").alias("n"))
    found = F.coalesce("n", F.when(F.col("ran"), F.lit(0).cast("long")))
    return names.join(n, "check", "left").select("check", found.alias("violations"), (found == 0).alias("passed"))


def details(violations: DataFrame, most: int = 1000) -> DataFrame:
    """TK10, SO5: the first distinct details in order of check, job and message."""
    return violations.distinct().orderBy("check", "job_id", "message").limit(most)


def capped(violations: DataFrame, most: int = 1000) -> DataFrame:
    """TK10: `details`, each with whether there were more."""
    some = details(violations, most + 1).withColumn("r", F.row_number().over(Window.orderBy("check", "job_id", "message")))  # of at most `most` + 1 rows
    return some.withColumn("truncated", F.count("*").over(Window.partitionBy()) > most).where(F.col("r") <= most).drop("r")


def constraints(df: DataFrame, not_null: list[str], rules: dict[str, Column], unique: list[list[str]], keys: dict[str, DataFrame]) -> DataFrame:
    """FLT9: (rule, n) of what declared constraints would refuse: nulls, broken checks (null is kept), repeated keys, values that a parent table lacks."""
    name = lambda d, what, n=F.count("*"): d.agg(n.alias("n")).select(F.lit(what).alias("rule"), "n")
    parts = [name(df.where(F.col(c).isNull()), f"{c} is null") for c in not_null] + [name(df.where(~rule), what) for what, rule in rules.items()]
    parts += [name(df.groupBy(*cols).count().where("count > 1"), f"{', '.join(cols)} repeated") for cols in unique]
    parts += [name(df.where(F.col(c).isNotNull()).join(parent.select(c), c, "left_anti"), f"{c} unknown") for c, parent in keys.items()]
    return union(parts).where("n > 0")


def weaker(jobs: DataFrame, accepted: DataFrame, done: DataFrame, attempts: DataFrame, events: DataFrame) -> DataFrame:
    """REC16, WN4, WN6: the benchmark's weaker rules as (check, job_id, message): lost and orphan jobs, repeats, outcomes, attempts that only rise, versions that step by one, and the fold."""
    c = F.col
    ids, known = jobs.select(c("id").alias("job_id")).distinct(), accepted.where(F.coalesce("job_id", F.lit("")) != "").select("job_id")
    once = known.distinct()
    always = lambda df, check, what: violation(df, check, [(F.lit(True), what)])
    lost = once.join(ids, "job_id", "left_anti").unionByName(once.join(done.select("job_id"), "job_id", "left_anti")).distinct()
    both = done.select("job_id", "state").join(jobs.select(c("id").alias("job_id"), c("state").alias("js")), "job_id", "left")
    w = Window.partitionBy("job_id").orderBy("attempt_no", "lease_generation")
    step = attempts.select("job_id", "attempt_no", "lease_generation", "state").withColumn("a", F.lag("attempt_no", 1, 0).over(w)).withColumn("g", F.lag("lease_generation", 1, 0).over(w))
    v = Window.partitionBy("job_id").orderBy("event_seq")
    versions = events.select("job_id", "event_seq", "state_version").withColumn("v", F.lag("state_version", 1, 0).over(v))
    fold = jobs.select(c("id").alias("job_id"), c("state").alias("js"), c("state_version").alias("jv")).join(fold_events(events), "job_id", "left")
    bad = F.coalesce((c("state") != c("js")) | (c("state_version") != c("jv")), F.lit(True))
    return union([
        always(lost, "lost", "lost job"),
        always(ids.join(once, "job_id", "left_anti"), "orphan", "orphan job"),
        always(known.groupBy("job_id").count().where("count > 1"), "accepted", "accepted twice"),
        always(done.groupBy("job_id").count().where("count > 1"), "completions", "duplicate completion"),
        always(once.join(done.where("state <> 'SUCCEEDED'").select("job_id"), "job_id", "left_semi"), "unsuccessful", "unsuccessful job"),
        violation(jobs, "active", [(~c("state").isin(*TERMINAL), "active job")], "id"),
        violation(both, "materialization", [(c("js").isNull(), "completion without job"), (c("js") != c("state"), "completion disagrees with job")]),
        violation(step, "attempts", [(c("attempt_no") <= c("a"), "attempt numbers not rising"), (c("lease_generation") <= c("g"), "generations not rising"), (c("state").isin("LEASED", "RUNNING"), "active attempt")]),
        violation(versions, "events", [(c("state_version") != c("v") + 1, "version not one more")]),
        violation(fold, "events", [(bad, "fold differs from job")]),
    ])


def narrow(jobs: DataFrame, accepted: DataFrame, done: DataFrame, attempts: DataFrame, terminal: bool = True, succeeded: bool = False, quiescent: bool = False) -> DataFrame:
    """REC17: the contract's weaker set, with states in upper case; repeats count once less, and open or failed jobs fail on demand."""
    c, state = F.col, F.upper("state")
    again = lambda df, keys, what: violation(df.groupBy(*keys).agg(F.count("*").alias("n")).select("job_id", F.explode(F.sequence(F.lit(2), F.greatest(c("n"), F.lit(2)).cast("int"))).alias("i"), "n").where("n > 1"), "contract", [(F.lit(True), what)])
    orphan = done.select("job_id").join(jobs.select(c("id").alias("job_id")), "job_id", "left_anti")
    lost = accepted.select("job_id").join(jobs.select(c("id").alias("job_id")), "job_id", "left_anti")
    parts = [again(done, ["job_id"], "duplicate completion"), again(attempts, ["job_id", "attempt_no"], "duplicate attempt"), again(attempts, ["job_id", "lease_generation"], "duplicate generation"), violation(orphan, "contract", [(F.lit(True), "orphan completion")])]
    if terminal:
        parts.append(violation(lost, "contract", [(F.lit(True), "lost job")]))
    rules = [(F.lit(succeeded) & state.isin("FAILED", "DEAD_LETTER"), "unsuccessful job"), (F.lit(quiescent) & ~state.isin(*TERMINAL), "active job")]
    return union([*parts, violation(jobs, "contract", rules, "id")])
