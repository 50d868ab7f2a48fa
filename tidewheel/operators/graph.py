"""Graphs of dependencies: unbranched chains by pointer doubling, closures by frontier, order and cycles by peeling, validation by joins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.ledger import TERMINAL
from tidewheel.plans.storage import materialize

#: Rounds after which what rounds left behind is written as one table, so that plans stay short.
ROUNDS = 16


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def gathered(parts: list[DataFrame], what: str) -> list[DataFrame]:
    return [materialize(union(parts), what)] if len(parts) >= ROUNDS else parts


def chains(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with one parent whose one child they are, of distinct (from, id): (id, head, at) with the first node of their chain and the distance to it, and (id, least) of those on a cycle of its own.

    Pointers double, so a chain of n takes log n rounds; no two open pointers meet, so no key is hot.
    """
    child = edges.groupBy("id").agg(F.count("*").alias("n"), F.first("from").alias("up")).where("n = 1").select("id", "up")
    parent = edges.groupBy("from").agg(F.count("*").alias("n")).where("n = 1").select(F.col("from").alias("up"))
    link = materialize(child.join(parent, "up").select("id", "up"), "links")
    left = link.select("id", "up", F.lit(1).cast("long").alias("at"), F.lit(True).alias("open"))
    done, reach, most = [left.where("NOT open")], 1, link.count()
    while reach <= most and not left.isEmpty():
        ahead = union([*done, left]).select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("at").alias("more"), F.col("open").alias("on"))
        # no pointer starts from the first node of a chain
        moved = left.select("id", "up", "at").join(ahead, "up", "left").select("id", F.coalesce("next", "up").alias("up"), (F.col("at") + F.coalesce("more", F.lit(0))).alias("at"), F.coalesce("on", F.lit(False)).alias("open"))
        moved = materialize(moved, "chains")
        done, left, reach = gathered([*done, moved.where("NOT open")], "chains"), moved.where("open"), 2 * reach
    return union(done).select("id", F.col("up").alias("head"), "at"), rings(link, left.select("id"))


def rings(link: DataFrame, on: DataFrame) -> DataFrame:
    """(id, least) of the nodes that lie on cycles of links: the least node of each cycle, by pointers that double."""
    left, reach, most = link.join(on, "id", "left_semi").select("id", "up", F.least("id", "up").alias("least")), 1, on.count()
    while reach < most:
        ahead = left.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("least").alias("other"))
        left = materialize(left.join(ahead, "up").select("id", F.col("next").alias("up"), F.least("least", "other").alias("least")), "rings")
        reach *= 2
    return left.select("id", "least")


def descendants(edges: DataFrame, start: DataFrame, open_only: DataFrame | None = None) -> DataFrame:
    """GR1, SO3: (id) reachable from `start` (id) along (job_id depends_on depends_on_id), the start itself left out unless on a cycle.

    A frontier moves one chain a round until nothing is found, and drops what was seen, so
    diamonds don't multiply; `open_only` (id) bounds it to some jobs.
    """
    step = edges.select(F.col("depends_on_id").alias("from"), F.col("job_id").alias("id")).distinct()
    if open_only is not None:
        step = step.join(open_only.select("id").distinct(), "id", "left_semi")
    step = materialize(step, "edges")
    inside, ring = chains(step)
    of = lambda df, c: df.join(inside.withColumnRenamed("id", c), c, "left").withColumn("head", F.coalesce("head", c)).withColumn("at", F.coalesce("at", F.lit(0)))
    outer = step.join(inside.select("id").unionByName(ring.select("id")), "id", "left_anti")
    hop = materialize(of(outer, "from").select(F.col("head").alias("from"), "id").distinct(), "hops")
    begun = materialize(of(start.select("id").distinct(), "id").groupBy("head").agg(F.min("at").alias("first")), "starts")
    frontier, seen = begun.select(F.col("head").alias("id")), []
    while True:
        found = hop.join(frontier.withColumnRenamed("id", "from"), "from").select("id").distinct()
        frontier = materialize(found if not seen else found.join(union(seen), "id", "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        seen = gathered([*seen, frontier], "seen")
    # later nodes of the chains of starts, whole chains that were reached, and cycles with a start
    out = [inside.join(begun, "head").where("at > first").select("id")]
    if seen:
        whole = union(seen)
        out += [whole, inside.join(whole.withColumnRenamed("id", "head"), "head", "left_semi").select("id")]
    met = ring.withColumnRenamed("id", "_ring").join(start.select(F.col("id").alias("_ring")), "_ring", "left_semi").select("least").distinct()
    out.append(ring.join(met, "least", "left_semi").select("id"))
    return union(out).distinct()


def open_descendants(failed: DataFrame, jobs: DataFrame, edges: DataFrame) -> DataFrame:
    """GR1, DM12: (id) of open jobs anywhere below the failed ones (id), also where terminal jobs stand between."""
    return jobs.where(~F.col("state").isin(*TERMINAL)).join(descendants(edges, failed), "id", "left_semi").select("id").distinct()


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GR2, GR3: (dag_id, id, level): the longest path from a root, nodes on or below a cycle with null.

    Unbranched chains count as one node; all DAGs peel together until nothing is free: each
    round takes the chains whose parents are all taken.
    """
    own = materialize(nodes.select(F.struct("dag_id", "id").alias("id")).distinct(), "nodes")
    step = edges.select(F.struct(F.col("dag_id"), F.col("parent").alias("id")).alias("from"), F.struct("dag_id", "id").alias("id"))
    step = materialize(step.join(own, "id", "left_semi").join(own.withColumnRenamed("id", "from"), "from", "left_semi").distinct(), "edges")
    inside, ring = chains(step)
    inside = materialize(inside, "inside")
    linked = inside.select("id").unionByName(ring.select("id"))
    hop = step.join(linked, "id", "left_anti").join(inside.withColumnRenamed("id", "from"), "from", "left")
    hop = materialize(hop.select(F.coalesce("head", "from").alias("from"), "id", (F.coalesce("at", F.lit(0)) + 1).cast("long").alias("w")), "hops")
    left = materialize(own.join(linked, "id", "left_anti").withColumn("level", F.lit(0).cast("long")), "left")
    taken = []
    while True:
        waiting = hop.join(left.select(F.col("id").alias("from")), "from", "left_semi").select("id").distinct()
        free = materialize(left.join(waiting, "id", "left_anti"), "level")
        if free.isEmpty():
            break
        taken = gathered([*taken, free], "levels")
        below = hop.join(free.select(F.col("id").alias("from"), "level"), "from").groupBy("id").agg(F.max(F.col("level") + F.col("w")).alias("below"))
        left = materialize(left.join(free.select("id"), "id", "left_anti").join(below, "id", "left").select("id", F.greatest("level", "below").alias("level")), "left")
    heads = union([*taken, left.withColumn("level", F.lit(None).cast("long"))])
    rest = inside.join(heads.withColumnRenamed("id", "head"), "head").select("id", (F.col("level") + F.col("at")).alias("level"))
    alone = ring.select("id", F.lit(None).cast("long").alias("level"))
    return union([heads, rest, alone]).select("id.dag_id", "id.id", "level")


def lexical_order(nodes: DataFrame, edges: DataFrame, named: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """GR2: (dag_id, id, position) in lexical topological order: the least ready key comes next; a DAG with a cycle has no rows.

    A DAG with one node a level has no choice and is in order of its levels, whatever its size.
    Others are sorted in a task each. Where nodes are numbers that stand for keys, `named`
    puts the keys in the place of dag_id, id and, where there is one, parent.
    """
    found = materialize(levels(nodes, edges), "levels")
    forced = found.groupBy("dag_id").agg(F.count("*").alias("n"), F.count("level").alias("k"), F.max("level").alias("last"))
    forced = materialize(forced.where("k = n AND last + 1 = n").select("dag_id"), "forced")
    straight = found.join(forced, "dag_id", "left_semi").select("dag_id", "id", (F.col("level") + 1).alias("position"))
    straight = named(straight)
    nodes, edges = named(nodes.join(forced, "dag_id", "left_anti")), named(edges.join(forced, "dag_id", "left_anti"))

    def order(key: tuple, left, right):
        import heapq

        import pandas as pd

        names = sorted(set(left["id"]))
        parents = {n: set() for n in names}
        for a, b in zip(right["id"], right["parent"], strict=True):
            if a in parents and b in parents:
                parents[a].add(b)
        below: dict[str, list[str]] = {n: [] for n in names}
        for n, ps in parents.items():
            for p in ps:
                below[p].append(n)
        ready = [n for n in names if not parents[n]]
        heapq.heapify(ready)
        out = []
        while ready:
            n = heapq.heappop(ready)
            out.append(n)
            for m in below[n]:
                parents[m].discard(n)
                if not parents[m]:
                    heapq.heappush(ready, m)
        out = out if len(out) == len(names) else []
        return pd.DataFrame({"dag_id": pd.Series([key[0]] * len(out), dtype=object), "id": pd.Series(out, dtype=object), "position": pd.Series(range(1, len(out) + 1), dtype="int64")})

    left, right = nodes.select(F.col("dag_id").alias("own"), "id"), edges.select(F.col("dag_id").alias("dag"), "id", "parent")
    return straight.unionByName(left.groupBy("own").cogroup(right.groupBy("dag")).applyInPandas(order, "dag_id string, id string, position long"))


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GR4: (dag_id, id, message) of blank and duplicate keys, unknown and duplicate parents, and parents of oneself."""
    blank = nodes.where(F.trim("id") == "").select("dag_id", "id", F.lit("blank key").alias("message"))
    twice = nodes.groupBy("dag_id", "id").count().where("count > 1").select("dag_id", "id", F.lit("duplicate key").alias("message"))
    unknown = edges.join(nodes.select("dag_id", F.col("id").alias("parent")), ["dag_id", "parent"], "left_anti").select("dag_id", "id", F.lit("unknown parent").alias("message"))
    again = edges.groupBy("dag_id", "id", "parent").count().where("count > 1").select("dag_id", "id", F.lit("duplicate parent").alias("message"))
    own = edges.where(F.col("id") == F.col("parent")).select("dag_id", "id", F.lit("own parent").alias("message"))
    return blank.unionByName(twice).unionByName(unknown).unionByName(again).unionByName(own)


def check_parents(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """GR6: (request, message) for parents that are missing, of another tenant, or named twice; `requests` has request, tenant_id, depends_on_id."""
    parent = jobs.select(F.col("id").alias("depends_on_id"), F.col("tenant_id").alias("owner"))
    both = requests.join(parent, "depends_on_id", "left")
    lost = both.where(F.col("owner").isNull()).select("request", F.lit("missing parent").alias("message"))
    other = both.where(F.col("owner") != F.col("tenant_id")).select("request", F.lit("parent of another tenant").alias("message"))
    twice = requests.groupBy("request", "depends_on_id").count().where("count > 1").select("request", F.lit("duplicate parent").alias("message"))
    return lost.unionByName(other).unionByName(twice)
