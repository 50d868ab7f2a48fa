"""Service levels over time: histograms, sliding ratios, rates, and alerts that hold for a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.ledger import whole

MINUTE = 60_000_000_000
#: Upper bounds of the histograms in seconds.
JOB_LATENCY = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0)
LEASE_RECOVERY = (0.1, 0.25, 0.5, 1.0, 2.0, 3.0, 4.0, 5.0, 7.5, 10.0, 15.0, 30.0)
STORE_CALL = (0.00025, 0.0005, 0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)
#: What the alerts ask for.
RATIO, OBSERVATIONS, RATIO_MINUTES, DEPTH, DEPTH_MINUTES = 0.99, 20, 5, 10, 10


def buckets(observations: DataFrame, bounds: tuple[float, ...] = JOB_LATENCY) -> DataFrame:
    """TS1: cumulative counts (stage, le, n) of (stage, ns); infinity is the last bucket. One row per stage and bound leaves a task."""
    seconds = F.col("ns") / 1e9
    counts = observations.groupBy("stage").agg(*(F.count_if(seconds <= b).alias(f"b{i}") for i, b in enumerate(bounds)), F.count("*").alias(f"b{len(bounds)}"))
    rows = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate((*bounds, float("inf")))))
    return counts.select("stage", F.inline(rows))


def minute_counts(observations: DataFrame, limit_s: float) -> DataFrame:
    """(stage, minute, good, n) of (stage, at_ns, ns): what a scrape per minute would add."""
    return observations.groupBy("stage", whole(F.col("at_ns"), MINUTE).alias("minute")).agg(F.count_if(F.col("ns") <= int(limit_s * 1e9)).alias("good"), F.count("*").alias("n"))


def sliding_ratio(per_minute: DataFrame, minutes: int = 30) -> DataFrame:
    """TS2-TS4: over the minutes up to each one with samples: good, n, and their ratio (null of nothing). Exact event counts, no extrapolation."""
    w = Window.partitionBy("stage").orderBy("minute").rangeBetween(-(minutes - 1), 0)
    out = per_minute.withColumn("good", F.sum("good").over(w)).withColumn("n", F.sum("n").over(w))
    return out.withColumn("ratio", F.try_divide("good", "n"))


def increase(samples: DataFrame, minutes: int = 30) -> DataFrame:
    """Increase of counters (series, minute, value) over a sliding range, resets counted from zero."""
    own = Window.partitionBy("series").orderBy("minute")
    previous = F.lag("value").over(own)
    step = F.when(previous.isNull(), 0).when(F.col("value") < previous, F.col("value")).otherwise(F.col("value") - previous)
    return samples.withColumn("step", step).withColumn("increase", F.sum("step").over(own.rangeBetween(-(minutes - 1), 0)))


def rates(samples: DataFrame) -> DataFrame:
    """TS7: per-minute rate of counters (series, at_ns, value) between samples, with resets."""
    own = Window.partitionBy("series").orderBy("at_ns")
    previous, since = F.lag("value").over(own), F.lag("at_ns").over(own)
    step = F.when(F.col("value") < previous, F.col("value")).otherwise(F.col("value") - previous)
    return samples.withColumn("per_minute", step * 60e9 / (F.col("at_ns") - since)).where(F.col("per_minute").isNotNull())


def alerts(grid: DataFrame, condition: Column, hold: int) -> DataFrame:
    """TS5, TS6: (series, minute, firing) on an evaluation grid of minutes: the condition must have held for `hold` minutes without a break. Null is false."""
    own = Window.partitionBy("series").orderBy("minute")
    on = F.coalesce(condition, F.lit(False))
    marked = grid.withColumn("on", on).withColumn("off_at", F.max(F.when(~on, F.col("minute"))).over(own))
    marked = marked.withColumn("since", F.min(F.when(F.col("on"), F.col("minute"))).over(Window.partitionBy("series", "off_at").orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)))
    return marked.select("series", "minute", (F.col("on") & (F.col("minute") - F.col("since") >= hold)).alias("firing"))


def histogram_quantile(cumulative: DataFrame, q: float, by: str = "stage") -> DataFrame:
    """TS8: quantile from cumulative buckets (by, le, n), linear within a bucket; in the last one its lower bound; null of none."""
    w = Window.partitionBy(by).orderBy("le")
    full = cumulative.withColumn("total", F.max("n").over(Window.partitionBy(by))).withColumn("low", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("before", F.coalesce(F.lag("n").over(w), F.lit(0)))
    rank = F.lit(q) * F.col("total")
    hit = full.where((F.col("n") >= rank) & (F.col("before") < rank) & (F.col("total") > 0))
    value = F.when(F.col("le") == float("inf"), F.col("low")).otherwise(F.col("low") + (F.col("le") - F.col("low")) * (rank - F.col("before")) / (F.col("n") - F.col("before")))
    return hit.select(by, value.alias("value"))


def gauges(samples: DataFrame, labels: list[str]) -> DataFrame:
    """TS9: last value of each series, summed by labels; `samples` has series, at_ns, value and the labels."""
    last = samples.groupBy("series", *labels).agg(F.max_by("value", "at_ns").alias("value"))
    return last.groupBy(*labels).agg(F.sum("value").alias("value"))


def zero_filled(counts: DataFrame, dimension: DataFrame, label: str, n: str = "n") -> DataFrame:
    """TS10, TS11: every label of a bounded set with its count, 0 where there is none."""
    return dimension.join(counts, label, "left").select(label, F.coalesce(n, F.lit(0)).alias(n))


def or_zero(sums: DataFrame, minutes: DataFrame, columns: list[str]) -> DataFrame:
    """TS2, TS3: sums (stage, minute, ...) at every minute of `minutes` (minute) for every stage, 0 where there was nothing."""
    grid = sums.select("stage").distinct().join(minutes.select("minute").distinct(), F.lit(True))  # stages are a bounded set of labels
    return grid.join(sums, ["stage", "minute"], "left").select("stage", "minute", *(F.coalesce(c, F.lit(0)).alias(c) for c in columns))


def exposition(metrics: DataFrame) -> DataFrame:
    """SNK4: (metric, line) in text form from (metric, labels: a map, value); labels by name, values escaped."""
    quoted = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), quoted(e["value"]), F.lit('"')))
    labels = F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    return metrics.select("metric", F.concat("metric", labels, F.lit(" "), F.col("value").cast("string")).alias("line"))
