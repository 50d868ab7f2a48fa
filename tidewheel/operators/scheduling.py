"""Scheduling decisions (deficit round robin), decision records, replay and chain checks.

One decision is sequential, so it is a function of one row's snapshot; many decisions run in parallel.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.ledger import is_digest, whole

ALGORITHM, SCHEMA_VERSION = "drr-v1", 1
#: Fixed order of fields in the canonical JSON of candidates, queues, snapshots, grants, states and decisions.
CANDIDATE = ("job_id", "tenant_id", "queue", "priority", "ready_seq", "slot_cost", "recovery")
QUEUE = ("tenant_id", "name", "weight", "deficit", "candidates")
SNAPSHOT = ("sequence", "logical_time_ns", "worker_slots", "batch_limit", "cursor", "queues", "config_hash", "algorithm")
GRANT = ("job_id", "tenant_id", "queue", "slot_cost")
STATE = ("tenant_id", "queue", "deficit")
DECISION = ("sequence", "grants", "queues", "next_cursor")

SNAPSHOT_TYPE = (
    "struct<sequence:long,logical_time_ns:long,worker_slots:int,batch_limit:int,cursor:int,queues:array<struct<tenant_id:string,name:string,weight:int,deficit:int,"
    "candidates:array<struct<job_id:string,tenant_id:string,queue:string,priority:int,ready_seq:long,slot_cost:int,recovery:boolean>>>>,config_hash:string,algorithm:string>"
)
DECISION_TYPE = "struct<sequence:long,grants:array<struct<job_id:string,tenant_id:string,queue:string,slot_cost:int>>,queues:array<struct<tenant_id:string,queue:string,deficit:int>>,next_cursor:int>"


def recovery_reserve(slots: Column) -> Column:
    """SCH4: slots kept for recovered jobs."""
    return F.when(slots <= 1, 0).otherwise(whole((slots + 3).cast("long"), 4)).cast("long")


def decide(snapshot: dict) -> dict:
    """SCH2: one decision. Queues take turns from the cursor; a turn adds the weight to the deficit, and heads are granted while deficit and slots last."""
    if snapshot["worker_slots"] < 0 or snapshot["batch_limit"] < 0 or snapshot.get("algorithm") not in (None, "", ALGORITHM):
        raise ValueError("invalid snapshot")
    order = lambda c: (not c["recovery"], -c["priority"], c["ready_seq"], c["job_id"])
    queues = sorted((dict(q, candidates=sorted(q["candidates"] or (), key=order)) for q in snapshot["queues"] or ()), key=lambda q: (q["tenant_id"], q["name"]))
    slots, batch, grants, cursor, idle = snapshot["worker_slots"], snapshot["batch_limit"], [], 0, 0
    if queues and slots and batch:
        cursor = max(0, snapshot["cursor"]) % len(queues)
        while len(grants) < batch and slots > 0 and idle < len(queues):
            queue, before = queues[cursor], len(grants)
            cursor = (cursor + 1) % len(queues)
            if waiting := queue["candidates"]:
                queue["deficit"] += max(1, queue["weight"])
                while waiting and len(grants) < batch and waiting[0]["slot_cost"] <= min(queue["deficit"], slots):
                    head = waiting.pop(0)
                    if head["slot_cost"] < 1:
                        raise ValueError("invalid slot cost")
                    grants.append({k: head[k] for k in GRANT})
                    queue["deficit"] -= head["slot_cost"]
                    slots -= head["slot_cost"]
            idle = 0 if len(grants) > before else idle + 1
    states = [{"tenant_id": q["tenant_id"], "queue": q["name"], "deficit": q["deficit"]} for q in queues]
    return {"sequence": snapshot["sequence"], "grants": grants, "queues": states, "next_cursor": cursor}


def canonical(value) -> str:
    """SC15: compact JSON with the ledger's escapes, which HTML-escape and keep other characters as they are."""
    text = json.dumps(value, separators=(",", ":"), ensure_ascii=False)
    for c in "<>&  ":
        text = text.replace(c, f"\\u{ord(c):04x}")
    return text


def ordered(value: dict, fields: tuple[str, ...], **inner: tuple) -> dict:
    return {f: [ordered(x, *inner[f]) if len(inner[f]) == 1 else ordered(x, inner[f][0], **inner[f][1]) for x in value[f] or ()] if f in inner else value[f] for f in fields}


def decision_json(decision: dict) -> str:
    """RPL3: a decision's canonical JSON, without the line's end."""
    return canonical(ordered(decision, DECISION, grants=(GRANT,), queues=(STATE,)))


def record_hash(previous: str, sequence: int, snapshot: dict, decision: dict) -> str:
    """Hash of a decision record: SHA-256 of its canonical JSON without the hash."""
    material = {"schema_version": SCHEMA_VERSION, "sequence": sequence, "previous_hash": previous, "input": ordered(snapshot, SNAPSHOT, queues=(QUEUE, {"candidates": (CANDIDATE,)})), "decision": ordered(decision, DECISION, grants=(GRANT,), queues=(STATE,))}
    return hashlib.sha256(canonical(material).encode()).hexdigest()


def decisions(snapshots: DataFrame) -> DataFrame:
    """SCH2 over many snapshots: (sequence, snapshot JSON) to (sequence, decision, line), in parallel."""
    import pandas as pd

    def run(parts):
        for part in parts:
            made = [decide(json.loads(s)) for s in part["snapshot"]]
            yield pd.DataFrame({"sequence": part["sequence"], "line": [decision_json(d) for d in made]})

    return snapshots.select("sequence", "snapshot").mapInPandas(run, "sequence long, line string").withColumn("decision", F.from_json("line", DECISION_TYPE))


def snapshots(candidates: DataFrame, queues: DataFrame, now_ns: int, slots: int, batch: int, cursor: int, sequence: int) -> DataFrame:
    """SCH1: one snapshot from ranked candidates; without a recovered one, the reserve is held back. No slots: no row."""
    c = candidates.select("tenant_id", "queue_name", F.struct(F.col("id").alias("job_id"), "tenant_id", F.col("queue_name").alias("queue"), F.col("priority").cast("int").alias("priority"), "ready_seq", F.col("slot_cost").cast("int").alias("slot_cost"), F.col("recovery_pending").alias("recovery")).alias("c"))
    per = c.groupBy("tenant_id", "queue_name").agg(F.collect_list("c").alias("candidates"))
    full = queues.join(per, ["tenant_id", "queue_name"]).select(F.struct("tenant_id", F.col("queue_name").alias("name"), F.col("weight").cast("int").alias("weight"), F.col("deficit").cast("int").alias("deficit"), "candidates").alias("q"))
    one = full.agg(F.array_sort(F.collect_list("q")).alias("queues"))  # at most `batch` candidates of each queue
    recovered = F.exists("queues", lambda q: F.exists(q["candidates"], lambda x: x["recovery"]))
    reserve = F.when(recovered, 0).otherwise(recovery_reserve(F.lit(slots)))
    left = (F.lit(slots) - F.least(F.lit(slots), reserve)).cast("int")
    s = F.struct(F.lit(sequence).cast("long").alias("sequence"), F.lit(now_ns).alias("logical_time_ns"), left.alias("worker_slots"), F.lit(batch).alias("batch_limit"), F.lit(cursor).alias("cursor"), "queues", F.lit("").alias("config_hash"), F.lit(ALGORITHM).alias("algorithm"))
    return one.where(left > 0).select(F.lit(sequence).cast("long").alias("sequence"), F.to_json(s).alias("snapshot"))


def queue_snapshots(candidates: DataFrame, slots: int) -> DataFrame:
    """SCH1 by queue: its weight, its candidates in order, and the slots that are left where no recovered job waits anywhere and the reserve is held back."""
    waiting = candidates.agg(F.coalesce(F.bool_or("recovery_pending"), F.lit(False)).alias("waiting"))
    per = candidates.groupBy("tenant_id", "queue_name").agg(F.first("weight").alias("weight"), F.count("*").alias("candidates"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda c: c["id"]), ",").alias("ids"))
    left = F.lit(slots).cast("long") - F.when(F.col("waiting"), 0).otherwise(F.least(F.lit(slots).cast("long"), recovery_reserve(F.lit(slots))))
    return per.join(F.broadcast(waiting), F.lit(True)).select("tenant_id", "queue_name", "weight", "candidates", "ids", left.alias("slots"))  # one row


def unit_cost_order(candidates: DataFrame, cursor: int, take: int) -> DataFrame:
    """SCH2 where all costs are 1 and no deficit is left over, in closed form: by round, then turn, then rank."""
    w = Window.orderBy("tenant_id", "queue_name")
    queues = candidates.select("tenant_id", "queue_name").distinct().withColumn("qi", F.row_number().over(w) - 1).withColumn("nq", F.count("*").over(Window.partitionBy()))  # a row per queue
    both = candidates.join(queues, ["tenant_id", "queue_name"])
    round_ = F.ceil(F.col("rank") / F.greatest("weight", F.lit(1)))
    turn = F.pmod(F.col("qi") - cursor, F.col("nq"))
    return both.select("id", "tenant_id", "queue_name", round_.alias("round"), turn.cast("long").alias("turn"), "rank").orderBy("round", "turn", "rank").limit(take)


def grant_order(candidates: DataFrame, cursor: int, take: int, slots: int) -> DataFrame:
    """SCH2 by windows: the first grants (id, round, turn, cost so far) while slots last.

    A job is granted in the round in which its queue's weights and old deficit reach the
    cost of it and all before it; rounds and turns order the grants. A full cycle of queues
    without a grant ends the decision. What follows the first job that the slots don't
    cover isn't in the result, as smaller jobs of other queues may then come first.
    """
    queue = Window.partitionBy("tenant_id", "queue_name").orderBy("rank")
    turns = Window.orderBy("tenant_id", "queue_name")
    queues = candidates.select("tenant_id", "queue_name").distinct().withColumn("qi", F.row_number().over(turns) - 1).withColumn("nq", F.count("*").over(Window.partitionBy()))  # a row per queue
    both = candidates.withColumn("reach", F.sum("slot_cost").over(queue)).join(queues, ["tenant_id", "queue_name"])
    weight = F.greatest("weight", F.lit(1))
    round_ = F.greatest(F.lit(1), F.ceil((F.col("reach") - F.col("deficit")) / weight)).cast("long")
    turn = F.pmod(F.col("qi") - cursor, F.col("nq")).cast("long")
    some = both.select("id", "tenant_id", "queue_name", "slot_cost", "rank", "nq", round_.alias("round"), turn.alias("turn")).orderBy("round", "turn", "rank").limit(take)
    order = Window.orderBy("round", "turn", "rank")  # of at most `take` rows
    at = (F.col("round") - 1) * F.col("nq") + F.col("turn")
    some = some.withColumn("gap", at - F.coalesce(F.lag(at).over(order), F.lit(-1))).withColumn("used", F.sum("slot_cost").over(order))
    ended = F.max((F.col("gap") > F.col("nq")).cast("int")).over(order)
    return some.withColumn("ended", ended).where((F.col("ended") == 0) & (F.col("used") <= slots)).select("id", "tenant_id", "queue_name", "round", "turn", F.col("used").cast("long").alias("used"))


def range_digests(lines: DataFrame, size: int = 1000) -> DataFrame:
    """SNK1: (first, n, sha256) of each `size` lines in order of sequence, hashed where they are; equal logs have equal ranges, and a range that differs says where."""
    own = lines.groupBy((F.call_function("div", F.col("sequence") - 1, F.lit(size)) * size + 1).alias("first")).agg(F.sort_array(F.collect_list(F.struct("sequence", "line"))).alias("rows"))  # at most `size` lines
    text = F.array_join(F.transform("rows", lambda r: F.concat(r["line"], F.lit("\n"))), "")
    return own.select("first", F.size("rows").cast("long").alias("n"), F.sha2(text.cast("binary"), 256).alias("sha256"))


def record_text(sequence: Column, previous: Column, body: Column) -> Column:
    """The JSON of a record that is hashed."""
    return F.concat(F.lit('{"schema_version":1,"sequence":'), sequence.cast("string"), F.lit(',"previous_hash":"'), previous, F.lit('",'), body, F.lit("}"))


def chained(records: DataFrame, by: list[str]) -> DataFrame:
    """SCH5, RPL5: records (sequence, body: JSON fields) of many short chains with previous_hash, material and hash: SHA-256 over sequence, previous hash and body."""
    rows = records.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("sequence", "body"))).alias("rows"))
    start = F.struct(F.lit("").alias("hash"), F.array().cast("array<struct<sequence:bigint,previous_hash:string,material:string,hash:string>>").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        material = record_text(r["sequence"], acc["hash"], r["body"])
        own = F.sha2(material.cast("binary"), 256)
        return F.struct(own.alias("hash"), F.concat(acc["out"], F.array(F.struct(r["sequence"].cast("long").alias("sequence"), acc["hash"].alias("previous_hash"), material.alias("material"), own.alias("hash")))).alias("out"))

    return rows.select(*by, F.inline(F.aggregate("rows", start, step)["out"])).withColumn("schema_version", F.lit(1))


def synthetic(spark, n: int) -> DataFrame:
    """RPL4: n snapshots of one job of one slot each."""
    job = F.lower(F.lpad(F.hex("sequence"), 32, "0"))
    candidate = F.concat(F.lit('{"job_id":"'), job, F.lit('","tenant_id":"qualification","queue":"replay","priority":0,"ready_seq":'), F.col("sequence").cast("string"), F.lit(',"slot_cost":1,"recovery":false}'))
    snapshot = F.concat(F.lit('{"sequence":'), F.col("sequence").cast("string"), F.lit(',"logical_time_ns":'), F.col("sequence").cast("string"), F.lit(',"worker_slots":1,"batch_limit":1,"cursor":0,"queues":[{"tenant_id":"qualification","name":"replay","weight":1,"deficit":0,"candidates":['), candidate, F.lit(']}],"config_hash":"","algorithm":"drr-v1"}'))
    return spark.range(1, n + 1).select(F.col("id").alias("sequence")).select("sequence", snapshot.alias("snapshot"))


def digest(lines: DataFrame) -> str:
    """RPL1, SNK1: SHA-256 of the lines in order of sequence; ranges are sorted apart and only pass by, one after another."""
    total = hashlib.sha256()
    for r in lines.select("sequence", "line").repartitionByRange("sequence").sortWithinPartitions("sequence").toLocalIterator(prefetchPartitions=True):
        total.update(r.line.encode() + b"\n")
    return total.hexdigest()


def divergences(log: DataFrame) -> DataFrame:
    """RPL1: first recorded decision that a replay doesn't give, with both lines; `log` has sequence, snapshot and line."""
    made = decisions(log).select("sequence", F.col("line").alias("expected"))
    return log.select("sequence", F.col("line").alias("actual")).join(made, "sequence").where("expected <> actual").orderBy("sequence").limit(1)


def chain_faults(records: DataFrame, boundary: int = 1, by: list[str] | None = None) -> DataFrame:
    """RPL2, WN7, SRC7: (sequence, message) of breaks: gaps, wrong previous hashes, wrong versions, wrong own hashes.

    `records` has schema_version, sequence, previous_hash, hash and material (the JSON that
    was hashed), of one chain or of one for each `by`. The previous record is found by a
    join on sequence - 1, so no task sorts all; what a record says of itself is found
    before, so that its JSON isn't shuffled, and hashes go as bytes.
    """
    by = by or []
    # proper digests are half as long; other texts keep all of theirs behind another first byte
    short = lambda x: F.when(is_digest(x) & (F.length(x) == 64), F.concat(F.unhex(F.lit("01")), F.unhex(x))).otherwise(F.concat(F.unhex(F.lit("00")), x.cast("binary")))
    before = records.select(*by, (F.col("sequence") + 1).alias("sequence"), short(F.col("hash")).alias("wanted"))
    own = records.select(*by, "sequence", "schema_version", short(F.col("previous_hash")).alias("previous_hash"), (F.sha2(F.col("material").cast("binary"), 256) != F.col("hash")).alias("differs"))
    both = own.join(before, [*by, "sequence"], "left")
    first = F.col("sequence") == boundary
    rules = [(F.col("schema_version") != SCHEMA_VERSION, "unsupported schema"), (~first & F.col("wanted").isNull(), "sequence not contiguous"), (F.col("previous_hash") != F.when(first, short(F.lit(""))).otherwise(F.col("wanted")), "previous hash differs"), (F.col("differs"), "hash differs")]
    broken = F.filter(F.array(*(F.when(bad, F.lit(m)) for bad, m in rules)), lambda m: m.isNotNull())
    return both.select(*by, "sequence", F.explode(broken).alias("message"))


def append(previous: str, snapshot: dict, decision: dict) -> dict:
    """RPL5, SCH5: the next record of a chain."""
    if snapshot["sequence"] != decision["sequence"]:
        raise ValueError("sequences differ")
    return {"schema_version": SCHEMA_VERSION, "sequence": snapshot["sequence"], "previous_hash": previous, "input": snapshot, "decision": decision, "hash": record_hash(previous, snapshot["sequence"], snapshot, decision)}
