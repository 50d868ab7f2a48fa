"""Timing of jobs from events (the flagship query), and statistics over durations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.ledger import TERMINAL, attempt_of, duration_between
from tidewheel.plans.storage import materialize

READY = ("job_admitted", "job_promoted", "dependency_released", "lease_reaped", "operator_release")


def timing_events(events: DataFrame, jobs: DataFrame, attempts: DataFrame, completions: DataFrame, after: int = 0, limit: int | None = None) -> DataFrame:
    """TS12: per event the four latencies in ns, null where they don't apply.

    All windows and joins are by job alone, so each table is shuffled once: JN11 (the latest
    ready time strictly before) is one running maximum, a job's attempts (JN12, at most 100)
    and their predecessors (JN13) come as an array, and JN10 and JN14 look up in sets.
    """
    by_job = Window.partitionBy("job_id").orderBy("event_seq")
    before = by_job.rowsBetween(Window.unboundedPreceding, -1)
    own = events.select("event_seq", "job_id", "event_type", "state", "occurred_at", attempt_of(F.col("payload_json")).alias("attempt_no"))
    ready = F.max(F.when(F.col("event_type").isin(*READY), F.col("occurred_at"))).over(before)
    loss = F.when((F.col("event_type") == "lease_reaped") & (F.col("state") == "PENDING"), F.struct("attempt_no", "occurred_at"))
    own = own.withColumn("ready_at", ready).withColumn("losses", F.collect_set(loss).over(Window.partitionBy("job_id")))
    chain = Window.partitionBy("job_id").orderBy("attempt_no")
    lag = lambda c: F.lag(c).over(chain)
    lost = F.when((lag("state") == "EXPIRED") & (lag("attempt_no") == F.col("attempt_no") - 1), F.struct(lag("attempt_no").alias("attempt_no"), lag("completed_at").alias("occurred_at")))
    leases = attempts.select("job_id", "attempt_no", "leased_at", "completed_at", lost.alias("lost")).groupBy("job_id").agg(F.collect_list(F.struct("attempt_no", "leased_at", "completed_at", "lost")).alias("leases"))
    born = jobs.select(F.col("id").alias("job_id"), "created_at")
    ended = completions.groupBy("job_id").agg(F.collect_set("committed_at").alias("commits"))
    own_lease = F.try_element_at(F.filter("leases", lambda x: x["attempt_no"] == F.col("attempt_no")), F.lit(1))
    full = own.join(born, "job_id").join(leases, "job_id", "left").join(ended, "job_id", "left")
    full = full.withColumn("lease", own_lease).select("*", "lease.leased_at", "lease.completed_at", "lease.lost", F.array_contains("commits", F.col("occurred_at")).alias("ended"))
    kind, lease = F.col("event_type"), F.col("event_type") == "lease_acquired"
    lost_at = F.when(F.array_contains("losses", F.col("lost")), F.col("lost.occurred_at"))
    out = full.where(F.col("event_seq") > after).select(
        "event_seq", "event_type", "state",
        F.when(lease, duration_between(F.col("ready_at"), F.col("leased_at"))).alias("ready_to_lease"),
        F.when(lease, duration_between(lost_at, F.col("leased_at"))).alias("lease_recovery"),
        F.when(kind.isin("job_completed", "retry_scheduled"), duration_between(F.col("leased_at"), F.col("completed_at"))).alias("lease_to_completion"),
        F.when(F.col("state").isin(*TERMINAL) & F.col("ended"), duration_between(F.col("created_at"), F.col("occurred_at"))).alias("end_to_end"),
    )
    return out if limit is None else out.orderBy("event_seq").limit(limit)


#: Distinct values of a group that one task ranks, and parts into which a larger group's range is cut at a time.
RANKED, PARTS = 1 << 20, 1 << 12


def _ranked(counts: DataFrame, value: str, percents: list[int], by: list[str], extremes: bool) -> DataFrame:
    w = Window.partitionBy(*by)
    ranked = counts.withColumn("upto", F.sum("c").over(w.orderBy(value))).withColumn("n", F.sum("c").over(w))
    rank = lambda p: F.call_function("div", F.lit(p) * F.col("n") + 99, F.lit(100))
    ends = [F.sum("c").alias("n"), F.min(value).alias("min"), F.max(value).alias("max")] if extremes else []
    return ranked.groupBy(*by).agg(*ends, *(F.min(F.when(F.col("upto") >= rank(p), F.col(value))).alias(f"p{p}") for p in percents))


def _narrowed(counts: DataFrame, value: str, percents: list[int], by: list[str], sizes: DataFrame, extremes: bool) -> DataFrame:
    """As `_ranked` for groups of any size: the range that holds a rank is cut into PARTS, whose counts say which part holds it, until few values are left."""
    rank = F.call_function("div", F.col("p") * F.col("n") + 99, F.lit(100))
    kind = counts.schema[value].dataType
    state = sizes.withColumn("p", F.explode(F.array(*map(F.lit, percents)))).select(*by, "p", "n", "min", "max", rank.alias("rank"), F.col("min").alias("lo"), F.col("max").alias("hi"), F.lit(0).cast("long").alias("before"), F.col("d").alias("left"))
    state = materialize(state, "ranks")
    on = [*by]
    inside = lambda s: _join(counts, s.where(F.col("left") > RANKED), on).where(F.col(value).between(F.col("lo"), F.col("hi")))
    while state.where((F.col("left") > RANKED) & (F.col("lo") < F.col("hi"))).limit(1).count():
        part = F.least(F.floor((F.col(value) - F.col("lo")) * PARTS / (F.col("hi") - F.col("lo"))).cast("int"), F.lit(PARTS - 1))
        cells = inside(state).groupBy(*on, "p", part.alias("part")).agg(F.sum("c").alias("c"), F.min(value).alias("a"), F.max(value).alias("z"), F.count("*").alias("left"))
        w = Window.partitionBy(*on, "p").orderBy("part")  # PARTS rows
        cells = cells.withColumn("upto", F.sum("c").over(w))
        own = state.where(F.col("left") > RANKED).select(*on, "p", "n", "min", "max", "rank", "before")
        hit = own.join(cells, [*on, "p"]).where((F.col("before") + F.col("upto") >= F.col("rank")) & (F.col("before") + F.col("upto") - F.col("c") < F.col("rank")))
        hit = hit.select(*on, "p", "n", "min", "max", "rank", F.col("a").alias("lo"), F.col("z").alias("hi"), (F.col("before") + F.col("upto") - F.col("c")).alias("before"), "left")
        state = materialize(state.where(F.col("left") <= RANKED).unionByName(hit), "ranks")
    some = _join(counts, state, on).where(F.col(value).between(F.col("lo"), F.col("hi")))
    upto = F.col("before") + F.sum("c").over(Window.partitionBy(*on, "p").orderBy(value))
    found = some.withColumn("upto", upto).where(F.col("upto") >= F.col("rank")).groupBy(*on, "p").agg(F.min(value).alias("v"), F.first("n").alias("n"), F.first("min").alias("min"), F.first("max").alias("max"))
    ends = [F.first("n").alias("n"), F.first("min").alias("min"), F.first("max").alias("max")] if extremes else []
    return found.groupBy(*on).agg(*ends, *(F.min(F.when(F.col("p") == p, F.col("v"))).cast(kind).alias(f"p{p}") for p in percents))


def _join(counts: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """With the states of its group: at most one row per percentile and RANKED values, so they are sent to all tasks."""
    state = F.broadcast(state)
    return counts.join(state, by) if by else counts.join(state, F.lit(True))


def nearest_rank(df: DataFrame, value: str, percents: list[int], by: list[str] | None = None, extremes: bool = False) -> DataFrame:
    """AG16: exact nearest-rank percentiles, rank (p*n + 99) div 100, by group; with `extremes` also n, min and max.

    Equal values are counted before they are ranked. A group of more than RANKED distinct
    values isn't ranked in one task: its range is narrowed down first.
    """
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    counts = materialize(counts, "counts")
    sizes = counts.groupBy(*by).agg(F.sum("c").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.count("*").alias("d"))
    big = materialize(sizes.where(F.col("d") > RANKED), "sizes")
    if big.limit(1).count() == 0:
        return _ranked(counts, value, percents, by, extremes)
    large = _narrowed(counts, value, percents, by, big, extremes)
    if not by:
        return large
    return _ranked(counts.join(F.broadcast(big.select(*by)), by, "left_anti"), value, percents, by, extremes).unionByName(large)


def distribution(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """AG17: count, min, p50, p95, p99 and max; groups with a negative value are left out, empty ones don't appear."""
    found = nearest_rank(df, value, [50, 95, 99], by, extremes=True)
    return found.where((F.col("n") > 0) & (F.col("min") >= 0)).select(*(by or []), "n", "min", "max", "p50", "p95", "p99")


def long_latencies(timing: DataFrame) -> DataFrame:
    """One row per latency: stage, ns."""
    stages = ("ready_to_lease", "lease_recovery", "lease_to_completion", "end_to_end")
    pairs = F.array(*(F.struct(F.lit(s).alias("stage"), F.col(s).alias("ns")) for s in stages))
    return timing.select(F.inline(F.filter(pairs, lambda p: p["ns"].isNotNull())))


def median(df: DataFrame, value: str) -> DataFrame:
    """AG18: the mean of the two middle values of an even number; null if any value isn't finite."""
    bad = F.count_if(F.isnan(F.col(value).cast("double")) | (F.abs(F.col(value).cast("double")) == float("inf")))
    return df.agg(F.when(bad == 0, F.percentile(value, F.lit(0.5))).alias("median"))


def rate_per_minute(df: DataFrame, time_ns: str, by: list[str] | None = None) -> DataFrame:
    """AG19: count over the time from first to last; null of fewer than two samples or no time between."""
    n, span = F.count(time_ns), F.max(time_ns) - F.min(time_ns)
    return df.groupBy(*(by or [])).agg(F.when((n >= 2) & (span > 0), n * 60e9 / span).alias("per_minute"))
