"""What the derived ledger shuffles: orders and lines once, and nothing again for what one order's rows give."""

import hashlib
import json
import os
import random
import threading

import duckdb
import pytest

from tests.oracle import rows_of
from tidewheel import queries_checks, queries_more
from tidewheel.operators import checks, evidence, graph, reads, scheduling, transitions
from tidewheel.queries import registered, samples_of
from tidewheel.queries_checks import drained
from tidewheel.queries_more import log_of, versions
from tidewheel.registry import now_of
from tidewheel.sources import derive
from tidewheel.sources.derive import BASE, Ledger, duckdb_ctes

SF = "/root/testdata/sf0.001"


@pytest.fixture
def ledger(spark):
    return Ledger(spark, SF)


@pytest.mark.parametrize("name", ["jobs", "attempts", "job_completions", "dead_letters", "audit_events", "idempotency_requests", "ev0", "evagg"])
def test_tables_of_jobs_are_read_from_lives_without_shuffles(ledger, name):
    made = ledger.table(name)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "lives" in "".join(made.inputFiles())
    assert set(ledger._made) == {"lives"}


def test_orders_and_lines_are_shuffled_once_by_key(spark, monkeypatch):
    """And orders narrow: texts that follow from them are made after the shuffle."""
    seen, write = {}, derive.materialize
    monkeypatch.setattr(derive, "materialize", lambda df, what: seen.setdefault(what, df._jdf.queryExecution().executedPlan().toString()) and write(df, what))
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _ = Ledger(spark, SF).jobs
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    dealt = [line.split("hashpartitioning(")[1].split("#")[0] for line in seen["lives"].splitlines() if "Exchange hashpartitioning(" in line]
    assert sorted(dealt) == ["c_custkey", "k", "k", "o_custkey"]
    assert "nation-" not in seen["lives"].split("Exchange hashpartitioning(k", 1)[1]


def test_time_needs_no_numbers(ledger):
    assert now_of(ledger) == ledger.ledger_events.agg({"occurred_at": "max"}).first()[0]
    fresh = Ledger(ledger.spark, SF)
    now_of(fresh)
    assert "ledger_events" not in fresh._tables


def test_checks_derive_only_the_tables_they_use(ledger):
    d = drained(ledger, True)
    d["jobs"], d["man"]
    assert set(d) == {"jobs", "man"} and "ledger_events" not in ledger._tables


def test_repeated_orders_and_lines_agree_with_sql(spark, tmp_path):
    """Keys that occur twice: jobs, attempts and events come out as the SQL has them."""
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE TABLE {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    con.execute("INSERT INTO orders SELECT * REPLACE (CASE o_orderstatus WHEN 'F' THEN 'P' ELSE 'F' END AS o_orderstatus, o_orderdate + INTERVAL 40 DAY AS o_orderdate) FROM orders WHERE o_orderkey % 10 = 3")
    con.execute("DELETE FROM lineitem WHERE l_orderkey % 10 = 4")
    for t in BASE:
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    x = Ledger(spark, str(tmp_path))
    for name in ("attempts", "jobs", "ev0", "job_completions"):
        found = con.execute(f"WITH {duckdb_ctes()} SELECT * FROM {name}")
        columns = [c[0] for c in found.description]
        assert rows_of(map(tuple, x.table(name).select(*columns).collect())) == rows_of(found.fetchall())


def repeated_orders(tmp_path) -> str:
    """A folder of tables in which some orders occur twice, in other states, and some have no lines."""
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE TABLE {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    con.execute("INSERT INTO orders SELECT * REPLACE (CASE o_orderstatus WHEN 'F' THEN 'P' ELSE 'F' END AS o_orderstatus, o_orderdate + INTERVAL 40 DAY AS o_orderdate) FROM orders WHERE o_orderkey % 10 = 3")
    con.execute("INSERT INTO orders SELECT * FROM orders WHERE o_orderkey % 10 = 5")
    con.execute("DELETE FROM lineitem WHERE l_orderkey % 10 = 4")
    for t in BASE:
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    return str(tmp_path)


def joined_sides(df):
    """Types of the columns on both sides of each join of a plan."""
    todo, found = [df._jdf.queryExecution().optimizedPlan()], []
    while todo:
        node = todo.pop()
        below = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Join":
            found += [{side.output().apply(i).name(): side.output().apply(i).dataType().simpleString() for i in range(side.output().size())} for side in below]
        todo += below
    return found


def test_samples_are_joined_by_keys(ledger):
    """No text is shuffled for samples, nor are accepted jobs numbered."""
    sides = joined_sides(samples_of(ledger))
    assert len(sides) == 6 and not any("string" in side.values() for side in sides)
    assert "manifest" not in ledger._tables and set(ledger._made) == {"lives"}


def test_samples_by_keys_are_those_by_ids(spark, tmp_path):
    """Also where keys occur twice, in other states."""
    x = Ledger(spark, repeated_orders(tmp_path))
    want = evidence.benchmark_samples(x.manifest, x.jobs, x.attempts, x.job_completions)
    found = samples_of(x)
    assert found.columns == want.columns
    assert rows_of(map(tuple, found.collect())) == rows_of(map(tuple, want.collect()))
    assert found.groupBy("job_id").count().where("count > 1").count() > 0


def test_audit_rows_find_their_owners_by_keys(ledger, tmp_path):
    sides = joined_sides(registered()["JN21_owned_audit"](ledger.spark, SF))
    assert len(sides) == 2 and {side["target"] for side in sides} == {"bigint"}
    x = Ledger(ledger.spark, repeated_orders(tmp_path))
    found = reads.owned_audit(x.keyed("audit_events", "target"), x.keyed("jobs", "id"))
    assert rows_of(map(tuple, found.collect())) == rows_of(map(tuple, reads.owned_audit(x.audit_events, x.jobs).collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_admission_of_workflows_against_a_walk(spark, seed):
    """Walked through one by one: each that still fits its tenant's cap is taken."""
    r = random.Random(seed)
    caps = {"a": (0, 3), "b": (40, 5), "c": (25, 30), "d": (None, 0), "e": (7, None)}
    asked = [(i, t, r.randint(1, 6), *caps[t]) for i in range(200) for t in [r.choice("abcde")]]
    want, used = [], {t: n or 0 for t, (_, n) in caps.items()}
    for i, t, n, most, _ in asked:
        if not most or used[t] + n <= most:
            used[t] += n
            want.append(i)
    new = spark.createDataFrame(asked, "request long, tenant_id string, nodes long, max_depth long, active long")
    assert sorted(x.request for x in transitions._admitted(new).collect()) == want


def test_no_list_of_requests_is_carried_through_the_walk(spark):
    """A tenant without a cap isn't walked through, one with a cap only as far as its room."""
    new = spark.range(20000).selectExpr("id AS request", "IF(id % 2 = 0, 'free', 'full') AS tenant_id", "1 + id % 3 AS nodes", "IF(id % 2 = 0, 0L, 9L) AS max_depth", "0L AS active")
    taken = transitions._admitted(new)
    assert taken.count() == 10000 + 5  # of 2, 1, 3, 2 and 1 nodes


@pytest.mark.parametrize("name", ["SO3_reachable", "GR1_failed_descendants", "GR3_levels", "GR2_lexical_order"])
def test_rounds_over_graphs_move_numbers(spark, monkeypatch, name):
    seen, write = {}, graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, what: seen.setdefault(what, df.schema.simpleString()) and write(df, what))
    registered()[name](spark, SF)
    assert {"links", "hops"} <= set(seen) and not any("string" in s or "least" in s for s in seen.values())


def test_least_nodes_of_rings(spark):
    """Rings of lengths that pointers of a power of two don't run through."""
    edges = [(f"r{n}-{i}", f"r{n}-{(i + 1) % n}") for n in (1, 2, 3, 4, 6, 8) for i in range(n)] + [(f"c{i}", f"c{i + 1}") for i in range(9)]
    inside, ring = graph.chains(spark.createDataFrame(edges, "`from` string, id string"))
    assert sorted((r.id, r.head, r["at"]) for r in inside.collect()) == [(f"c{i}", "c0", i) for i in range(1, 10)]
    assert {r.id: r.least for r in ring.collect()} == {f"r{n}-{i}": f"r{n}-0" for n in (1, 2, 3, 4, 6, 8) for i in range(n)}


@pytest.mark.parametrize("name", ["REC15_foreign_keys", "AG13_releases"])
def test_events_are_not_numbered_for_checks_that_read_no_numbers(spark, tmp_path, name):
    for t in BASE:
        (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    registered()[name](spark, str(tmp_path))
    assert "ev" not in drained(Ledger.of(spark, str(tmp_path)), False)


def test_event_log_shuffles_events_once(ledger):
    d = drained(ledger, True)
    found = checks.event_log(d["ev"], d["jobs"])._jdf.queryExecution().optimizedPlan().toString()
    assert found.count("Window [") <= 2 and "max_by" not in found


def test_lost_and_orphan_jobs_are_found_by_bytes(spark):
    """Ids that differ in case alone, or aren't ids, stay apart and come back as they are."""
    ids = lambda *texts: spark.createDataFrame([(t,) for t in texts], "id string")
    good, other = "0123456789abcdef" * 2, "f" * 32
    found = checks.ledger_jobs(ids(good, other, "", "z").withColumnRenamed("id", "job_id"), ids(good, other.upper(), "é", None))
    assert {side[c] for side in joined_sides(found) for c in side} == {"binary"}
    lost, orphan = "accepted job missing", "job absent from manifest"
    assert sorted(((r.message, r.job_id) for r in found.collect()), key=str) == sorted([(lost, other), (lost, ""), (lost, "z"), (orphan, other.upper()), (orphan, "é"), (lost, None), (orphan, None)], key=str)


def test_ids_come_back_from_bytes(spark):
    texts = ["0123456789abcdef" * 2, "0123456789ABCDEF" * 2, "gone", "", "é", "\x01" + "a" * 16, None]
    df = spark.createDataFrame([(t,) for t in texts], "id string").select("id", checks.packed("id").alias("p"))
    assert [(r.id, r.back) for r in df.select("id", checks.unpacked("p").alias("back")).collect()] == [(t, t) for t in texts]
    assert df.select("p").distinct().count() == len(texts)


def test_log_is_written_and_compared_as_bytes(ledger):
    """The JSON of records is neither written nor shuffled, nor are hashes as text."""
    log = log_of(ledger)
    assert {f.name: f.dataType.simpleString() for f in ledger._made["log"].schema} == {"cust": "bigint", "sequence": "bigint", "job": "binary", "previous_hash": "binary", "hash": "binary"}
    first = log.where("sequence = 2").orderBy("cust").first()
    assert hashlib.sha256(first.material.encode()).hexdigest() == first.hash and json.loads(first.material)["previous_hash"] == first.previous_hash != ""
    faults = scheduling.chain_faults(log, by=["cust"])
    node = faults._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Join":
        node = node.children().head()
    sides = [node.left().output(), node.right().output()]
    types = {side.apply(i).name(): side.apply(i).dataType().simpleString() for side in sides for i in range(side.size())}
    assert "material" not in types and types["previous_hash"] == types["wanted"] == "binary" and faults.count() == 0


def test_odd_hashes_are_compared_whole(spark):
    """Texts that aren't digests, also one that ends in a line break, break a chain as before."""
    good = scheduling.chained(spark.createDataFrame([(1, i, f'"decision":{{"job_id":"{i}"}}') for i in range(1, 6)], "cust long, sequence long, body string"), ["cust"])
    assert scheduling.chain_faults(good, by=["cust"]).count() == 0
    for odd in ("concat(previous_hash, chr(10))", "upper(previous_hash)", "''", "concat(previous_hash, '0')"):
        bent = good.selectExpr("cust", "sequence", f"CASE WHEN sequence = 3 THEN {odd} ELSE previous_hash END AS previous_hash", "material", "hash", "schema_version")
        assert [tuple(r) for r in scheduling.chain_faults(bent, by=["cust"]).collect()] == [(1, 3, "previous hash differs")]


def test_a_version_gives_every_table_back_and_holds_no_digests(spark):
    """SRC3: the ten tables, all rows and columns, from what is written without what can be computed."""
    x = Ledger(spark, SF)
    for name, df in versions(x).items():
        own = x.table(name)
        assert df.columns == own.columns and [f.dataType for f in df.schema] == [f.dataType for f in own.schema]
        assert df.exceptAll(own).isEmpty() and own.exceptAll(df).isEmpty(), name
    written = {f.name for n in ("jobs", "attempts", "job_completions", "idempotency_requests") for f in spark.read.parquet(*versions(x)[n].inputFiles()).schema}
    assert not written & {"id", "job_id", "token_hash", "execution_key", "completion_request_digest", "output_digest", "request_digest", "response_json"}


@pytest.mark.parametrize("query", [queries_more.tailed, queries_more.ran_out])
def test_streams_carry_keys_and_leave_neither_inbox_nor_texts(spark, monkeypatch, query):
    """STR5, SRC11, STR6: what is written is narrow, and files that only the stream reads go with it."""
    x, made = Ledger(spark, SF), []
    monkeypatch.setattr(queries_more, "folder", lambda x, what, own=queries_more.folder: made.append(own(x, what)) or made[-1])
    found = query(x)
    found = found[0] if isinstance(found, tuple) else found
    assert not found.isEmpty()
    assert not [f for f in made if "inbox" in f and os.path.exists(f.replace("file:", ""))]
    written = spark.read.option("recursiveFileLookup", "true").parquet(*found.inputFiles()).schema
    assert "string" not in {f.dataType.simpleString() for f in written}


def test_leases_are_the_same_in_many_shares_and_need_no_numbers(spark, monkeypatch):
    """STR6: one stream for each share of the jobs, whose state and cursor go when it ends."""
    x = Ledger(spark, SF)
    whole = queries_more.ran_out(x).collect()
    monkeypatch.setattr(queries_more, "BEATS_AT_ONCE", 6000)
    parts = queries_more.ran_out(x)
    assert len({f.split("share=")[1].split("/")[0] for f in parts.inputFiles()}) > 1
    assert sorted(parts.collect()) == sorted(whole)
    assert "coded-False" not in x._made


def test_checks_of_a_report_run_side_by_side_over_jobs_made_once(spark, monkeypatch):
    """REC13: two checks wait for each other; both see the jobs as they were written."""
    met, seen = threading.Barrier(2, timeout=60), []

    def check(d):
        met.wait()
        seen.append("".join(d["jobs"].inputFiles()))
        return checks.materialized(d["jobs"])

    monkeypatch.setattr(queries_checks, "FOUND", {"REC3_materialized": check, "REC9_dag": check})
    x = Ledger(spark, SF)
    found = queries_checks.violations(x, True)
    once = checks.materialized(drained(x, True)["jobs"])
    assert found.count() == 2 * once.count() > 0
    assert len(seen) == 2 and all("tidewheel-jobs" in files and "lives" not in files for files in seen)
