"""Evidence of benchmark and fault campaigns: samples, summaries, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.ledger import TERMINAL, stable_key, whole
from tidewheel.operators.reads import one_row
from tidewheel.operators.timing import distribution, nearest_rank


def benchmark_samples(accepted: DataFrame, jobs: DataFrame, attempts: DataFrame, done: DataFrame) -> DataFrame:
    """EV1, WN8: per accepted job its admission, first lease, final lease and completion; `complete` is false where one is missing or times run backwards."""
    leases = attempts.groupBy("job_id").agg(F.min("leased_at").alias("first_lease"), F.max_by("leased_at", "attempt_no").alias("final_lease"))
    born = jobs.select(F.col("id").alias("job_id"), F.col("created_at").alias("admitted"))
    both = accepted.select("job_id").join(born, "job_id", "left").join(leases, "job_id", "left").join(done.select("job_id", F.col("committed_at").alias("completed")), "job_id", "left")
    order = (F.col("admitted") <= F.col("first_lease")) & (F.col("first_lease") <= F.col("final_lease")) & (F.col("final_lease") <= F.col("completed"))
    return both.withColumn("complete", F.coalesce(order, F.lit(False)))


def run_summary(samples: DataFrame) -> DataFrame:
    """EV2: (measure, n, p50, p95, p99, max, per_minute): three latencies with distributions, three rates from first to last."""
    good = samples.where("complete")
    spans = {"admission_to_lease": ("first_lease", "admitted"), "lease_to_completion": ("completed", "final_lease"), "end_to_end": ("completed", "admitted")}
    pairs = F.array(*(F.struct(F.lit(k).alias("measure"), (F.col(a) - F.col(b)).alias("ns")) for k, (a, b) in spans.items()))
    latency = distribution(good.select(F.inline(pairs)), "ns", ["measure"]).select("measure", "n", "p50", "p95", "p99", "max", F.lit(None).cast("double").alias("per_minute"))
    times = F.array(*(F.struct(F.lit(k).alias("measure"), F.col(c).alias("t")) for k, c in (("admissions", "admitted"), ("leases", "first_lease"), ("completions", "completed"))))
    span = F.max("t") - F.min("t")
    rate = good.select(F.inline(times)).groupBy("measure").agg(F.count("*").alias("n"), F.when((F.count("*") >= 2) & (span > 0), F.round(F.count("*") * 60e9 / span, 6)).alias("per_minute"))
    none = F.lit(None).cast("long")
    return latency.unionByName(rate.select("measure", "n", *(none.alias(c) for c in ("p50", "p95", "p99", "max")), "per_minute"))


def residual(tenants: DataFrame, queues: DataFrame) -> DataFrame:
    """SO2: labelled reservations that should be zero after a drain."""
    t = tenants.where("active_slots <> 0").select(F.concat(F.lit("tenant/"), F.col("tenant_id")).alias("label"), "active_slots")
    return t.unionByName(queues.where("active_slots <> 0").select(F.concat_ws("/", F.lit("queue"), "tenant_id", "queue_name").alias("label"), "active_slots"))


def passes(report: DataFrame, violations: str = "violations") -> DataFrame:
    """EV5, EV10c: one verdict from a report of checks, with sorted reasons; a check that didn't run (null) is a reason too."""
    n = F.col(violations)
    bad = F.filter(F.array_sort(F.collect_set(F.when(n.isNull() | (n > 0), F.col("check")))), lambda c: c.isNotNull())
    return report.agg(F.array_join(bad, ",").alias("reasons"), F.sum(n).alias("violations"), (F.count_if(n.isNull() | (n != 0)) == 0).alias("passed"))


def suite(runs: DataFrame, measured: int = 3) -> DataFrame:
    """EV6, AG20: over (run, warmup, per_minute, config): exactly one warm-up and `measured` others of one configuration give the median rate; else null."""
    own = F.when(~F.col("warmup"), F.col("per_minute"))
    ok = (F.count_if("warmup") == 1) & (F.count(own) == measured) & (F.countDistinct("config") == 1)
    return runs.agg(ok.alias("valid"), F.percentile(own, F.lit(0.5)).alias("m")).select("valid", F.when(F.col("valid"), F.col("m")).alias("median"))


def verdict(results: DataFrame) -> DataFrame:
    """EV9: invalid before miss before qualified, over (part, valid, met)."""
    return results.agg(F.when(F.count_if(~F.col("valid")) > 0, "invalid").when(F.count_if(~F.col("met")) > 0, "miss").otherwise("qualified").alias("verdict"))


def recoveries(kills: DataFrame, attempts: DataFrame) -> DataFrame:
    """EV7, JN15: per killed lease (kill_sequence, job_id, killed_generation, killed_at) its first successor by generation, and ms from the kill; null without one."""
    later = attempts.select("job_id", F.col("lease_generation").alias("g"), F.col("leased_at").alias("t"), "attempt_no")
    both = kills.join(later, "job_id", "left")
    after = F.when(F.col("g") > F.col("killed_generation"), F.col("g"))
    found = both.groupBy("kill_sequence", "job_id", "killed_generation", "killed_at").agg(F.min(after).alias("generation"), F.min_by("t", after).alias("leased_at"))
    return found.withColumn("recovery_ms", whole(F.col("leased_at") - F.col("killed_at"), 1_000_000))


def affected(leases: DataFrame, lower: int, upper: int) -> DataFrame:
    """JN18: whether a kill between two instants hit each lease: no if it ended before, yes if it ended after unless it succeeded or still runs, null (undecidable) between; `decided` fails on these."""
    end = F.col("completed_at")
    return leases.withColumn("affected", F.when(end.isNull(), True).when(end < lower, False).when(end > upper, F.lit(True) & (F.col("state") != "SUCCEEDED")))


def decided(leases: DataFrame, lower: int, upper: int) -> DataFrame:
    """JN18: `affected`, where a lease that ended between the instants, has no state that fits its end or isn't there fails the evaluation."""
    own = affected(leases, lower, upper)
    fits = F.when(F.col("completed_at").isNull(), F.col("state").isin("LEASED", "RUNNING")).otherwise(F.col("state").isin("SUCCEEDED", "FAILED", "EXPIRED"))
    good = F.col("affected").isNotNull() & F.coalesce(fits, F.lit(False))
    return own.withColumn("affected", F.when(good, F.col("affected")).otherwise(F.raise_error(F.lit("a lease ended within the uncertain boundary, or its state doesn't fit its end")).cast("boolean")))


def campaign(samples: DataFrame, target_ms: int) -> DataFrame:
    """EV8, EV13: pooled p99 of recovery, passed strictly below the target."""
    return nearest_rank(samples, "recovery_ms", [99]).withColumn("passed", F.col("p99") < target_ms)


def action_log(actions: DataFrame) -> DataFrame:
    """EV11: (sequence, message) of gaps and of kills whose calibrated time isn't observed plus offset; `actions` has sequence, observed_ns, offset_ns, calibrated_ns, kind, kill_sequence."""
    dense = actions.select("sequence").join(actions.select((F.col("sequence") + 1).alias("sequence")), "sequence", "left_anti").where("sequence <> 1").withColumn("message", F.lit("sequence not contiguous"))
    wrong = actions.where("calibrated_ns <> observed_ns + offset_ns").select("sequence", F.lit("clock differs").alias("message"))
    twice = actions.where("kind = 'kill'").withColumn("n", F.count("*").over(Window.partitionBy("kill_sequence"))).where("n > 1").select("sequence", F.lit("kill repeated").alias("message"))
    return dense.unionByName(wrong).unionByName(twice)


def sample_rows(samples: DataFrame, expected: DataFrame) -> DataFrame:
    """EV10b, EV12: (kill_sequence, job_id, message) where recovery samples and the expected set differ, or a sample contradicts itself."""
    e = expected.select("kill_sequence", "job_id", F.col("recovery_ms").alias("want"), F.lit(True).alias("e"))
    both = samples.withColumn("s", F.lit(True)).join(e, ["kill_sequence", "job_id"], "full_outer")
    c = F.col
    message = F.when(c("s").isNull(), "missing sample").when(c("e").isNull(), "unexpected sample").when(c("generation") <= c("killed_generation"), "successor not later").when(c("leased_at") <= c("killed_at"), "lease before kill").when(c("recovery_ms") != c("want"), "recovery differs")
    return both.select("kill_sequence", "job_id", message.alias("message")).where(c("message").isNotNull())


def submissions(sent: DataFrame, drained: DataFrame, run: str, domain: str, prefix: str, expected: int) -> DataFrame:
    """EV3, AG23: (rule, item) that a run's submissions and drain samples break.

    `sent` has run_id, seed, index, idempotency_key, job_id, error, duplicate,
    ambiguous_retry, attempt_count; `drained` has run_id, job_id, state, terminal_at.
    """
    c = F.col
    rows = F.array(
        F.when(c("run_id") != run, F.lit("submission of another run")),
        F.when(F.coalesce("error", F.lit("")) != "", F.lit("submission failed")),
        F.when(c("duplicate") & ~c("ambiguous_retry"), F.lit("reused an admission")),
        F.when(c("attempt_count") < 1, F.lit("no attempts")),
        F.when(c("idempotency_key") != stable_key(domain, prefix, c("run_id"), c("seed"), c("index")), F.lit("unstable key")),
    )
    out = sent.select(F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("rule"), c("index").cast("string").alias("item"))
    twice = lambda df, k, rule: df.groupBy(k).count().where("count > 1").select(F.lit(rule).alias("rule"), c(k).cast("string").alias("item"))
    jobs = sent.where(F.coalesce("job_id", F.lit("")) != "").select("job_id").distinct()
    open_ = drained.where(~c("state").isin(*TERMINAL) | c("terminal_at").isNull()).select(F.lit("drain sample not terminal").alias("rule"), c("job_id").alias("item"))
    parts = [
        twice(sent, "index", "duplicate index"),
        twice(sent, "idempotency_key", "duplicate key"),
        twice(drained, "job_id", "duplicate drain sample"),
        open_,
        drained.where(c("run_id") != run).select(F.lit("drain sample of another run").alias("rule"), c("job_id").alias("item")),
        drained.select("job_id").distinct().join(jobs, "job_id", "left_anti").select(F.lit("drained job never submitted").alias("rule"), c("job_id").alias("item")),
        jobs.join(drained.select("job_id"), "job_id", "left_anti").select(F.lit("submitted job not drained").alias("rule"), c("job_id").alias("item")),
        sent.agg(F.count("*").alias("n")).where(c("n") != expected).select(F.lit("unexpected count").alias("rule"), c("n").cast("string").alias("item")),
    ]
    for p in parts:
        out = out.unionByName(p)
    return out


def environment(runs: DataFrame, run: str, expected: dict[str, object]) -> DataFrame:
    """EV4, EV10d: (run, column, found) wherever a run's setting isn't the expected one; a null setting isn't either."""
    cells = F.array(*(F.when(~F.col(k).eqNullSafe(F.lit(v)), F.struct(F.lit(k).alias("column"), F.col(k).cast("string").alias("found"))) for k, v in expected.items()))
    return runs.select(run, F.inline(F.filter(cells, lambda c: c.isNotNull())))


def differences(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """EV10a: rows of either side alone; none if stored evidence equals what was computed again."""
    names = stored.columns
    return stored.exceptAll(recomputed.select(names)).withColumn("side", F.lit("stored")).unionByName(recomputed.select(names).exceptAll(stored).withColumn("side", F.lit("recomputed")))


def report_accounting(report: DataFrame, required: list[str], total: int, details: int, truncated: bool, histogram: DataFrame, jobs: int) -> DataFrame:
    """EV10c: one row of verdicts on a report's own sums: its checks, its total, its cut, its states."""
    seen = report.agg(F.array_sort(F.collect_set("check")).alias("checks"), F.coalesce(F.sum("violations"), F.lit(0)).alias("sum"))
    states = histogram.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("states"))
    both = one_row(seen.select(F.concat_ws(",", "checks").alias("checks"), "sum"), states)
    return both.select((F.col("checks") == ",".join(sorted(required))).alias("checks"), (F.col("sum") == total).alias("total"), F.lit(truncated == (details < total)).alias("cut"), (F.col("states") == jobs).alias("states"))


def contained(actions: DataFrame, start: int, end: int) -> DataFrame:
    """EV10b: actions whose calibrated time lies outside of the campaign."""
    return actions.where(~F.col("calibrated_ns").between(start, end)).select("sequence", F.lit("outside of the campaign").alias("message"))


def benchmark_run(runs: DataFrame, jobs: int, workers: int, slots: int) -> DataFrame:
    """EV10a: (run, message) where a run's manifest or summary isn't what a qualifying run has.

    `runs` has run, summary_run, phase, summary_phase, scored, status, valid, qualification,
    job_count, worker_count, worker_slots, canonical_jobs, lease_grants, repeats, digest and
    recorded_digest.
    """
    c = F.col
    rules = [
        (~c("recorded_digest").rlike("^[0-9a-fA-F]{64}$") | (c("digest") != F.lower("recorded_digest")), "digest of the summary differs"),
        ((c("status") != "valid") | (c("phase") != "warmup") & (c("phase") != "measured"), "invalid status or phase"),
        (c("scored") != (c("phase") == "measured"), "scored disagrees with the phase"),
        (~c("qualification") | (c("job_count") != jobs) | (c("worker_count") != workers) | (c("worker_slots") != slots), "not the qualifying workload"),
        ((c("summary_run") != c("run")) | (c("summary_phase") != c("phase")) | ~c("valid"), "summary of another run or invalid"),
        ((c("canonical_jobs") != jobs) | (c("lease_grants") != jobs) | (c("repeats") != 0), "counts differ from the workload"),
    ]
    broken = F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(m)) for bad, m in rules)), lambda m: m.isNotNull())
    twice = runs.groupBy("run").count().where("count > 1").select("run", F.lit("run id repeated").alias("message"))
    return runs.select("run", F.explode(broken).alias("message")).unionByName(twice)


def report_faults(reports: DataFrame, required: list[str], jobs: int) -> DataFrame:
    """EV10c: (report, message) where a report of checks contradicts itself.

    `reports` has report, expected, checks (array of name, violations, passed), total,
    details, truncated, passed, states (array of state, n), job_count, accepted,
    completions, active_jobs, active_attempts and reservations.
    """
    c = F.col
    sum_ = lambda a, f: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x[f])
    names = F.array_sort(F.transform("checks", lambda k: k["name"]))
    only = F.filter("states", lambda s: s["n"] != 0)
    whole_ = (c("accepted") == jobs) & (c("job_count") == jobs) & (c("completions") == jobs) & (c("active_jobs") == 0) & (c("active_attempts") == 0) & (c("reservations") == 0) & (F.size(only) == 1) & F.exists("states", lambda s: (s["state"] == "SUCCEEDED") & (s["n"] == jobs))
    rules = [
        (c("expected") != jobs, "other number of jobs expected"),
        ((c("total") < 0) | (c("details") > c("total")) | (c("truncated") != (c("details") < c("total"))), "details disagree with the total"),
        (F.exists("checks", lambda k: (k["name"] == "") | (k["violations"] < 0) | (k["passed"] != (k["violations"] == 0))), "check disagrees with its count"),
        (F.size(F.array_distinct(names)) != F.size(names), "check repeated"),
        (F.array_distinct(names) != F.array(*map(F.lit, sorted(required))), "checks missing or unknown"),
        ((sum_("checks", "violations") != c("total")) | (c("passed") != (c("total") == 0)), "status disagrees with the checks"),
        ((sum_("states", "n") != c("job_count")) | F.exists("states", lambda s: (s["state"] == "") | (s["n"] < 0)), "states disagree with the jobs"),
        (c("passed") & ~whole_, "passed with loss or residue"),
    ]
    broken = F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(m)) for bad, m in rules)), lambda m: m.isNotNull())
    return reports.select("report", F.explode(broken).alias("message"))


def replay_faults(runs: DataFrame, decisions: int, processes: int) -> DataFrame:
    """EV10d: (kind, message) of replay evidence (kind, process, decisions, matched, digest): exact decisions, all matched, one digest, the exact number of processes."""
    c = F.col
    own = runs.groupBy("kind").agg(F.countDistinct("process").alias("n"), F.count_if(c("decisions") != decisions).alias("short"), F.count_if(c("matched") != c("decisions")).alias("off"), F.countDistinct("digest").alias("digests"), F.count_if(~c("digest").rlike("^[0-9a-f]{64}$")).alias("bad"))
    rules = [(c("n") != processes, "other number of processes"), (c("short") > 0, "other number of decisions"), (c("off") > 0, "decisions that don't match"), ((c("digests") != 1) | (c("bad") > 0), "digests differ or are invalid")]
    broken = F.filter(F.array(*(F.when(bad, F.lit(m)) for bad, m in rules)), lambda m: m.isNotNull())
    return own.select("kind", F.explode(broken).alias("message"))


def kill_faults(events: DataFrame) -> DataFrame:
    """EV11: (message, n) over kills (sequence, kill_sequence, observed_ns, offset_ns, calibrated_ns, before: fences at the kill, affected: fences that it hit)."""
    c = F.col
    n = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("message"), "n").where("n > 0")
    hit = events.select("kill_sequence", "before", F.explode("affected").alias("fence"))
    dense = events.agg(F.countDistinct("kill_sequence").alias("d"), F.max("kill_sequence").alias("m")).where((c("d") != c("m")) & c("m").isNotNull())
    parts = [
        n(events.where("calibrated_ns <> observed_ns + offset_ns"), "clock differs"),
        n(events.groupBy("kill_sequence").count().where("count > 1"), "kill repeated"),
        n(dense, "kill missing"),
        n(events.where(F.size(F.array_distinct("before")) != F.size("before")), "lease repeated before the kill"),
        n(hit.where(~F.array_contains(c("before"), c("fence"))), "hit lease wasn't there before"),
        n(hit.groupBy("kill_sequence", "fence").count().where("count > 1"), "hit lease repeated"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
