"""Reconciliation queries: a drained ledger, one with a fault for every rule, and SQL that states the rules again."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from tidewheel.operators import checks, evidence
from tidewheel.plans.storage import materialize
from tidewheel.registry import query
from tidewheel.sources.derive import Ledger

#: The ledger of succeeded jobs alone, as it is after a drain; events get new numbers.
CLEAN = {
    "jobs": "SELECT * FROM {jobs} WHERE state = 'SUCCEEDED'",
    "att": "SELECT a.* FROM {attempts} a JOIN {jobs} j ON j.id = a.job_id WHERE j.state = 'SUCCEEDED'",
    "done": "SELECT c.* FROM {job_completions} c JOIN {jobs} j ON j.id = c.job_id WHERE j.state = 'SUCCEEDED'",
    "req": "SELECT r.* FROM {idempotency_requests} r JOIN {jobs} j ON j.id = r.job_id WHERE j.state = 'SUCCEEDED'",
    "man": "SELECT * FROM {manifest}",
    "edges": "SELECT d.* FROM {job_dependencies} d JOIN {jobs} c ON c.id = d.job_id JOIN {jobs} p ON p.id = d.depends_on_id WHERE c.state = 'SUCCEEDED' AND p.state = 'SUCCEEDED'",
    "ev": "SELECT e.event_seq AS old, e.job_id, e.event_type, e.state, e.state_version, e.occurred_at, e.payload_json, j.k FROM {ledger_events} e JOIN {jobs} j ON j.id = e.job_id WHERE j.state = 'SUCCEEDED'",
    "queues": "SELECT tenant_id, queue_name, weight, CAST(0 AS BIGINT) AS active_slots FROM {queue_state}",
    "tenants": "SELECT tenant_id, max_depth, max_slots, CAST(0 AS BIGINT) AS active_slots FROM {tenant_limits}",
    "count": "SELECT name, value FROM {counters}",
    "mig": "SELECT * FROM {schema_migrations}",
}
_JOB = "id, tenant_id, queue_name, slot_cost, payload_json, retry_json, state, attempt_no, state_version, lease_generation, CAST(ready_seq AS BIGINT) AS ready_seq, execution_key, created_at, updated_at, terminal_at, failure_json, k"


def _object(text: str) -> str:
    return f"concat(chr(123), '{text}', chr(125))"


def _bent(column: str, *cases: tuple[str, str]) -> str:
    """A column with other values where k modulo 61, or a condition, says so."""
    when = " ".join(f"WHEN {f'k % 61 IN ({at})' if at[0].isdigit() else at} THEN {value}" for at, value in cases)
    return f"CASE {when} ELSE {column} END AS {column}"


#: The same with faults: each residue of an order's key modulo 61 bends one thing.
FAULTY = {
    "jobs": "SELECT "
    + ", ".join([
        _bent("id", ("1", "upper(id)")), _bent("tenant_id", ("55", "'nowhere'")), _bent("queue_name", ("57", "'unknown'")), _bent("slot_cost", ("8", "0")),
        _bent("payload_json", ("9", "'x'"), ("10", _object('"type":"other"'))), _bent("retry_json", ("11", "'x'"), ("12", _object('"max_attempts":0'))),
        _bent("state", ("6, 57", "'RUNNING'"), ("20, 60", "'FAILED'"), ("56, 58, 59", "'PENDING'")), "attempt_no", _bent("state_version", ("3", "0")), _bent("lease_generation", ("43", "lease_generation + 1")),
        "CAST(CASE WHEN k % 61 = 7 THEN 7 WHEN k % 61 = 58 THEN 5 WHEN k % 61 = 59 THEN k + 1000 ELSE 0 END AS BIGINT) AS ready_seq", _bent("execution_key", ("2", "''")), "created_at", _bent("updated_at", ("4", "created_at - 1")),
        _bent("terminal_at", ("5, 56, 58", "NULL")), _bent("failure_json", ("13", "'x'")), "k",
    ])
    + f" FROM {{jobs}} WHERE k % 61 <> 17 UNION ALL SELECT {_JOB} FROM {{jobs}} WHERE k % 61 = 14",
    "man": "SELECT sequence, " + ", ".join([_bent("submission_key", ("49", "''")), _bent("job_id", ("47", "concat('z', substr(job_id, 2))")), _bent("tenant_id", ("46", "''")), "accepted_at", "k"]) + " FROM {man} WHERE k % 61 <> 16 UNION ALL SELECT sequence, submission_key, job_id, tenant_id, accepted_at, k FROM {man} WHERE k % 61 = 48",
    "done": "SELECT job_id, " + ", ".join([_bent("state", ("20", "'FAILED'")), "state_version", _bent("attempt_no", ("18", "attempt_no + 1")), _bent("output_digest", ("21", "'x'")), _bent("committed_at", ("19", "committed_at - 1")), _bent("failure_json", ("22", "'x'")), "k"]) + " FROM {done} WHERE k % 61 <> 23 UNION ALL SELECT job_id, state, state_version, attempt_no, output_digest, committed_at, failure_json, k FROM {done} WHERE k % 61 = 15",
    "req": "SELECT tenant_id, " + ", ".join([_bent("submission_key", ("25", "concat('other-', submission_key)")), _bent("request_kind", ("27", "'x'")), _bent("request_digest", ("51", "''")), _bent("job_id", ("26", "md5('other')")), _bent("created_at", ("52", "0")), _bent("response_json", ("28", "'x'"), ("29", _object('"id":"y"'))), "k"]) + " FROM {req} WHERE k % 61 <> 30 UNION ALL SELECT tenant_id, submission_key, request_kind, request_digest, job_id, created_at, response_json, k FROM {req} WHERE k % 61 = 24",
    "att": "SELECT job_id, "
    + ", ".join([
        _bent("attempt_no", ("41", "attempt_no + 1"), ("32", "attempt_no - 1")), _bent("worker_id", ("53", "''")), _bent("lease_generation", ("42", "1")), _bent("token_hash", ("31", "'x'")), _bent("state", ("35", "'RUNNING'"), ("39", "'EXPIRED'"), ("44", "'FAILED'")),
        "leased_at", _bent("heartbeat_at", ("33", "leased_at - 1")), "expires_at", _bent("started_at", ("34", "leased_at - 1")), _bent("completed_at", ("36", "NULL"), ("54", "leased_at - 1")), _bent("completion_request_digest", ("37", "'x'")), _bent("receipt_state", ("38", "NULL")),
        "receipt_state_version", "receipt_committed_at", _bent("failure_json", ("40", "'x'")), "k",
    ])
    + " FROM {att} WHERE k % 61 <> 45",
    "ev": "SELECT event_seq, job_id, "
    + ", ".join([_bent("event_type", ("k % 61 = 50 AND state_version = 1", "'job_promoted'"), ("k % 61 = 52 AND state_version = 2", "'job_admitted'"), ("k % 61 = 54 AND state_version IN (2, 3)", "'dependency_released'")), _bent("state", ("k % 61 = 51 AND state_version = 2", "'RUNNING'")), _bent("occurred_at", ("47", "0")), _bent("payload_json", ("48", "'x'")), "CASE WHEN k % 61 = 49 AND state_version = 2 THEN 9 ELSE state_version END AS state_version", "k"])
    + " FROM {ev} WHERE NOT (k % 61 = 46 AND state_version = 2) AND k % 61 <> 53",
    "edges": "SELECT job_id, CASE WHEN job_id LIKE '0%' THEN 'gone' ELSE depends_on_id END AS depends_on_id FROM {edges} UNION ALL SELECT depends_on_id, job_id FROM {edges} WHERE job_id LIKE '1%'",
    "queues": "SELECT tenant_id, queue_name, CASE WHEN queue_name = 'idle' THEN 0 ELSE weight END AS weight, CASE WHEN weight = 2 THEN 1 ELSE 0 END AS active_slots FROM {queues}",
    "tenants": "SELECT tenant_id, 1 AS max_depth, 5 AS max_slots, CASE WHEN length(tenant_id) = 8 THEN 9 ELSE 0 END AS active_slots FROM {tenants} WHERE tenant_id <> 'nation-3'",
    "count": "SELECT name, CAST(100 AS BIGINT) AS value FROM {count} UNION ALL SELECT 'other', CAST(1 AS BIGINT) FROM {count} UNION ALL SELECT 'other', CAST(2 AS BIGINT) FROM {count}",
    "mig": "SELECT version, CASE WHEN version = 4 THEN 'bent' ELSE checksum END AS checksum, CASE WHEN version = 5 THEN '' ELSE name END AS name, CASE WHEN version = 3 THEN 0 ELSE applied_at END AS applied_at FROM {mig} WHERE version <> 2",
}


class Drained(dict):
    """The tables of CLEAN, or of FAULTY, each derived when first asked for; `moves` is `ev` without its numbers."""

    def __init__(self, x: Ledger, faulty: bool):
        super().__init__()
        self.x, self.faulty = x, faulty

    def __missing__(self, name: str) -> DataFrame:
        x = self.x
        own = {"jobs": "jobs", "att": "attempts", "done": "job_completions", "req": "idempotency_requests"}
        if self.faulty:
            clean = drained(x, False)
            sql = FAULTY["ev" if name == "moves" else name]
            df = x.spark.sql(sql, **{t: clean["moves" if name == "moves" else t] for t in CLEAN if "{" + t + "}" in sql})
        elif name in own:
            df = x.of_succeeded(own[name])
        elif name == "edges":
            df = x.edges(succeeded=True)
        elif name == "ev":
            df = x.events(succeeded=True)
        elif name == "moves":
            df = x.events(succeeded=True, numbers=False)
        else:
            df = x.spark.sql(CLEAN[name], **{t: x.table(t) for t in ("manifest", "queue_state", "tenant_limits", "counters", "schema_migrations") if "{" + t + "}" in CLEAN[name]})
        self[name] = df
        return df


def drained(x: Ledger, faulty: bool) -> Drained:
    """The tables of CLEAN, or of FAULTY, made once per ledger."""
    return x.kept(f"drained-{faulty}", lambda: Drained(x, faulty))


def _ctes(faulty: bool) -> str:
    """`c_` tables, and `f_` tables that are the faulty ones or the same again, for DuckDB."""
    base = {t: t for t in ("jobs", "attempts", "job_completions", "idempotency_requests", "manifest", "job_dependencies", "ledger_events", "queue_state", "tenant_limits", "counters", "schema_migrations")}
    clean = [f"c_{n} AS ({sql.format(**base)})" if n != "ev" else f"c_ev AS (SELECT *, row_number() OVER (ORDER BY old) AS event_seq FROM ({sql.format(**base)}))" for n, sql in CLEAN.items()]
    names = {n: f"c_{n}" for n in CLEAN}
    return ", ".join([*clean, *(f"f_{n} AS ({FAULTY[n].format(**names) if faulty else f'SELECT * FROM c_{n}'})" for n in CLEAN)])


_TERMINAL = "('SUCCEEDED', 'FAILED', 'DEAD_LETTER')"
_ACTIVE = "('SCHEDULED', 'RUNNING')"
_LIVE = "('LEASED', 'RUNNING')"


def _digest(x: str) -> str:
    return f"coalesce(regexp_full_match({x}, '[0-9a-f]{{64}}'), false)"


#: Helping tables of the rules in SQL.
HELP = f"""j1 AS (SELECT * FROM f_jobs QUALIFY row_number() OVER (PARTITION BY id ORDER BY k, state_version, queue_name) = 1),
    e1 AS (SELECT *, row_number() OVER w AS r, lag(state) OVER w AS previous FROM f_ev WINDOW w AS (PARTITION BY job_id ORDER BY event_seq)),
    l1 AS (SELECT job_id, max(attempt_no * 1000000 + lease_generation) AS last, arg_max(state, attempt_no * 1000000 + lease_generation) AS state, arg_max(coalesce(receipt_committed_at, -1), attempt_no * 1000000 + lease_generation) AS receipt, count(*) FILTER (WHERE state IN {_LIVE}) AS live FROM f_att GROUP BY job_id),
    fold1 AS (SELECT job_id, arg_max(state, event_seq) AS state, arg_max(state_version, event_seq) AS v, count(*) FILTER (WHERE event_type = 'job_admitted') AS n FROM f_ev GROUP BY job_id),
    g1 AS (SELECT DISTINCT job_id AS lower, depends_on_id AS upper FROM f_edges WHERE job_id IN (SELECT id FROM j1) AND depends_on_id IN (SELECT id FROM j1)),
    up AS (SELECT lower, upper FROM g1 UNION SELECT up.lower, g1.upper FROM up JOIN g1 ON g1.lower = up.upper),
    bent AS (SELECT DISTINCT lower FROM up WHERE upper IN (SELECT lower FROM up WHERE lower = upper)),
    open1 AS (SELECT DISTINCT lower FROM up JOIN j1 p ON p.id = up.upper JOIN j1 c ON c.id = up.lower WHERE p.state IN ('FAILED', 'DEAD_LETTER') AND c.state NOT IN {_TERMINAL} AND up.lower <> up.upper),
    held AS (SELECT tenant_id, queue_name, sum(slot_cost) AS n FROM f_jobs WHERE state IN {_ACTIVE} GROUP BY ALL),
    deep AS (SELECT tenant_id, count(*) AS depth, sum(CASE WHEN state IN {_ACTIVE} THEN slot_cost ELSE 0 END) AS n FROM f_jobs WHERE state NOT IN {_TERMINAL} GROUP BY tenant_id)"""

_COMPLETED = "f_done c LEFT JOIN j1 j ON j.id = c.job_id"
_ASKED = "f_req r LEFT JOIN (SELECT DISTINCT ON (tenant_id, submission_key) tenant_id AS t, submission_key AS s, job_id AS wanted FROM f_man) m ON m.t = r.tenant_id AND m.s = r.submission_key"
_MOVE = """(previous = 'PENDING' AND state IN ('SCHEDULED', 'FAILED', 'DEAD_LETTER') OR previous = 'PENDING' AND state = 'PENDING' AND event_type IN ('dependency_released', 'job_promoted')
    OR previous = 'SCHEDULED' AND state IN ('RUNNING', 'PENDING', 'RETRYING', 'SUCCEEDED', 'FAILED', 'DEAD_LETTER') OR previous = 'RUNNING' AND state IN ('PENDING', 'RETRYING', 'SUCCEEDED', 'FAILED', 'DEAD_LETTER') OR previous = 'RETRYING' AND state IN ('PENDING', 'SCHEDULED', 'DEAD_LETTER'))"""
_RECEIPTS = "((completion_request_digest IS NOT NULL)::INT + (receipt_state IS NOT NULL)::INT + (receipt_state_version IS NOT NULL)::INT + (receipt_committed_at IS NOT NULL)::INT)"


def _extra(table: str, keys: str) -> str:
    """One row for each beyond the first of its keys."""
    return f"(SELECT row_number() OVER (PARTITION BY {keys}) AS again FROM {table}) WHERE again > 1"


#: Inventory id -> check and its rules: message, and FROM ... WHERE of the rows that break it.
RULES: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "REC1_manifest": ("manifest", [
        ("invalid job id", "f_man WHERE NOT regexp_full_match(job_id, '[0-9a-f]{32}')"),
        ("empty field", "f_man WHERE tenant_id = '' OR submission_key = '' OR accepted_at IS NULL"),
        ("sequence not contiguous", "(SELECT count(*) AS n, count(DISTINCT sequence) AS d, min(sequence) AS a, max(sequence) AS b FROM f_man) WHERE n > 0 AND (d <> n OR a <> 1 OR b <> n)"),
        ("duplicate job", "(SELECT job_id FROM f_man GROUP BY job_id HAVING count(*) > 1)"),
        ("duplicate key", "(SELECT tenant_id FROM f_man GROUP BY tenant_id, submission_key HAVING count(*) > 1)"),
    ]),
    "REC2_ledger_jobs": ("canonical_ledger", [
        ("job absent from manifest", "f_jobs WHERE id NOT IN (SELECT job_id FROM f_man)"),
        ("accepted job missing", "f_man WHERE job_id NOT IN (SELECT id FROM f_jobs)"),
    ]),
    "REC3_materialized": ("materialized_jobs", [
        ("duplicate job", _extra("f_jobs", "id")),
        ("invalid id", "f_jobs WHERE NOT regexp_full_match(id, '[0-9a-f]{32}')"),
        ("empty execution key", "f_jobs WHERE execution_key = ''"),
        ("invalid counters", "f_jobs WHERE state_version < 1 OR attempt_no < 0 OR lease_generation < 0"),
        ("updated before created", "f_jobs WHERE updated_at < created_at OR created_at <= 0"),
        ("terminal time disagrees with state", f"f_jobs WHERE (state IN {_TERMINAL}) <> (terminal_at IS NOT NULL)"),
        ("terminal time out of order", f"f_jobs WHERE state IN {_TERMINAL} AND (terminal_at < created_at OR terminal_at > updated_at)"),
        ("ready sequence outside PENDING", "f_jobs WHERE state <> 'PENDING' AND ready_seq <> 0"),
        ("invalid slot cost", "f_jobs WHERE slot_cost < 1"),
        ("invalid payload", "f_jobs WHERE NOT json_valid(payload_json)"),
        ("invalid payload type", "f_jobs WHERE json_valid(payload_json) AND coalesce(json_extract_string(CASE WHEN json_valid(payload_json) THEN payload_json END, '$.type'), '') NOT IN ('noop', 'shell')"),
        ("invalid retry policy", "f_jobs WHERE NOT json_valid(retry_json) OR coalesce(TRY_CAST(json_extract_string(CASE WHEN json_valid(retry_json) THEN retry_json END, '$.max_attempts') AS BIGINT), 0) < 1"),
        ("invalid failure", "f_jobs WHERE failure_json IS NOT NULL AND NOT json_valid(failure_json)"),
    ]),
    "REC4_completions": ("canonical_ledger", [
        ("duplicate completion", _extra("f_done", "job_id")),
        ("completion absent from manifest", "f_done WHERE job_id NOT IN (SELECT job_id FROM f_man)"),
        ("orphan completion", "f_done WHERE job_id NOT IN (SELECT id FROM j1)"),
        ("completion disagrees with job", f"{_COMPLETED} WHERE c.state <> j.state OR c.state_version <> j.state_version OR c.attempt_no <> j.attempt_no"),
        ("commit time differs from terminal time", f"{_COMPLETED} WHERE j.id IS NOT NULL AND (committed_at <= 0 OR coalesce(committed_at <> terminal_at, false))"),
        ("outcome is no success", f"{_COMPLETED} WHERE j.id IS NOT NULL AND c.state <> 'SUCCEEDED'"),
        ("invalid digest", f"{_COMPLETED} WHERE j.id IS NOT NULL AND c.attempt_no > 0 AND NOT {_digest('output_digest')}"),
        ("invalid failure", f"{_COMPLETED} WHERE j.id IS NOT NULL AND c.failure_json IS NOT NULL AND NOT json_valid(c.failure_json)"),
        ("no canonical completion", "(SELECT DISTINCT job_id FROM f_man) WHERE job_id NOT IN (SELECT job_id FROM f_done)"),
        ("terminal job without completion", f"j1 WHERE state IN {_TERMINAL} AND id NOT IN (SELECT job_id FROM f_done)"),
        ("completion of an open job", f"j1 WHERE state NOT IN {_TERMINAL} AND id IN (SELECT job_id FROM f_done)"),
    ]),
    "REC5_idempotency": ("idempotency", [
        ("duplicate request", _extra("f_req", "tenant_id, submission_key")),
        ("request absent from manifest", f"{_ASKED} WHERE wanted IS NULL"),
        ("request names another job", f"{_ASKED} WHERE wanted IS NOT NULL AND job_id IS DISTINCT FROM wanted"),
        ("invalid request", f"{_ASKED} WHERE request_kind <> 'job' OR coalesce(request_digest, '') = '' OR created_at <= 0"),
        ("invalid response", f"{_ASKED} WHERE NOT json_valid(response_json)"),
        ("response names another job", f"{_ASKED} WHERE json_valid(response_json) AND json_extract_string(CASE WHEN json_valid(response_json) THEN response_json END, '$.id') IS DISTINCT FROM job_id"),
        ("job of request absent from manifest", f"{_ASKED} WHERE job_id NOT IN (SELECT job_id FROM f_man)"),
        ("missing request", "(SELECT DISTINCT tenant_id, submission_key FROM f_man) m WHERE NOT EXISTS (SELECT 1 FROM f_req r WHERE r.tenant_id = m.tenant_id AND r.submission_key = m.submission_key)"),
    ]),
    "REC6_attempt_rows": ("attempts_and_leases", [
        ("attempt without job", "f_att WHERE job_id NOT IN (SELECT id FROM j1)"),
        ("invalid worker or token", f"f_att WHERE worker_id = '' OR NOT {_digest('token_hash')}"),
        ("number not positive", "f_att WHERE attempt_no < 1 OR lease_generation < 1"),
        ("times out of order", "f_att WHERE leased_at <= 0 OR heartbeat_at < leased_at OR expires_at < heartbeat_at"),
        ("started before lease", "f_att WHERE started_at < leased_at"),
        ("completion time disagrees with state", f"f_att WHERE (state NOT IN {_LIVE}) <> (completed_at IS NOT NULL)"),
        ("completed before lease", f"f_att WHERE state NOT IN {_LIVE} AND completed_at < leased_at"),
        ("invalid digest of completion", f"f_att WHERE completion_request_digest IS NOT NULL AND NOT {_digest('completion_request_digest')}"),
        ("partial receipt", f"f_att WHERE {_RECEIPTS} NOT IN (0, 4)"),
        ("receipt of an expired attempt", f"f_att WHERE state = 'EXPIRED' AND {_RECEIPTS} <> 0"),
        ("invalid failure", "f_att WHERE failure_json IS NOT NULL AND NOT json_valid(failure_json)"),
    ]),
    "REC7_attempt_chain": ("attempts_and_leases", [
        ("attempt numbers not contiguous", "(SELECT attempt_no, row_number() OVER (PARTITION BY job_id ORDER BY attempt_no, lease_generation) AS r FROM f_att) WHERE attempt_no <> r"),
        ("generation not increasing", "(SELECT lease_generation, lag(lease_generation) OVER (PARTITION BY job_id ORDER BY attempt_no, lease_generation) AS g FROM f_att) WHERE lease_generation <= g"),
        ("fence differs from last attempt", "j1 j JOIN l1 l ON l.job_id = j.id WHERE last <> attempt_no * 1000000 + lease_generation"),
        ("fence without attempts", "j1 WHERE id NOT IN (SELECT job_id FROM f_att) AND (attempt_no <> 0 OR lease_generation <> 0)"),
        ("active attempt of inactive job", f"j1 j JOIN l1 l ON l.job_id = j.id WHERE live > 0 AND j.state NOT IN {_ACTIVE}"),
        ("more than one active attempt", "l1 WHERE live > 1"),
        ("last attempt disagrees with completion", "(SELECT DISTINCT ON (job_id) job_id, state, attempt_no, committed_at FROM f_done WHERE attempt_no > 0) c JOIN j1 j ON j.id = c.job_id JOIN l1 l ON l.job_id = c.job_id WHERE last // 1000000 <> c.attempt_no OR receipt <> committed_at OR NOT (c.state = 'SUCCEEDED' AND l.state = 'SUCCEEDED' OR c.state = 'FAILED' AND l.state = 'FAILED' OR c.state = 'DEAD_LETTER' AND l.state IN ('FAILED', 'EXPIRED'))"),
        ("active attempts after the drain", f"(SELECT count(*) AS n FROM f_att WHERE state IN {_LIVE}) WHERE n > 0"),
    ]),
    "REC8_event_log": ("event_log", [
        ("invalid payload or time", "f_ev WHERE occurred_at <= 0 OR NOT json_valid(payload_json)"),
        ("admission not first and once", "e1 WHERE r = 1 AND event_type <> 'job_admitted' AND job_id IN (SELECT id FROM j1)"),
        ("version not contiguous", "e1 WHERE state_version <> r AND job_id IN (SELECT id FROM j1)"),
        ("move not allowed", f"e1 WHERE r > 1 AND NOT {_MOVE} AND job_id IN (SELECT id FROM j1)"),
        ("sequence not contiguous", "(SELECT count(*) AS n, count(DISTINCT event_seq) AS d, min(event_seq) AS a, max(event_seq) AS b FROM f_ev) WHERE n > 0 AND (d <> n OR a <> 1 OR b <> n)"),
        ("events without job", "fold1 WHERE job_id NOT IN (SELECT id FROM j1)"),
        ("job without events", "j1 WHERE id NOT IN (SELECT job_id FROM f_ev)"),
        ("not one admission", "fold1 WHERE n <> 1 AND job_id IN (SELECT id FROM j1)"),
        ("fold differs from job", "j1 j JOIN fold1 f ON f.job_id = j.id WHERE f.state <> j.state OR f.v <> j.state_version"),
    ]),
    "REC9_dag": ("dag", [
        ("edge end missing", "f_edges WHERE job_id NOT IN (SELECT id FROM j1) OR depends_on_id NOT IN (SELECT id FROM j1)"),
        ("edge crosses tenants", "f_edges e JOIN j1 c ON c.id = e.job_id JOIN j1 p ON p.id = e.depends_on_id WHERE c.tenant_id <> p.tenant_id"),
        ("released before parents succeeded", f"f_edges e JOIN j1 c ON c.id = e.job_id JOIN j1 p ON p.id = e.depends_on_id WHERE (c.ready_seq > 0 OR c.state IN ('SUCCEEDED', 'SCHEDULED', 'RUNNING')) AND p.state <> 'SUCCEEDED'"),
        ("on or below a cycle", "bent"),
        ("open below a failed job", "open1"),
        ("released more than once", "(SELECT job_id FROM f_ev WHERE event_type = 'dependency_released' GROUP BY job_id HAVING count(*) > 1)"),
    ]),
    "REC10_slots": ("slot_accounting", [
        ("queue row missing", "held h WHERE NOT EXISTS (SELECT 1 FROM f_queues q WHERE q.tenant_id = h.tenant_id AND q.queue_name = h.queue_name)"),
        ("active slots differ", "f_queues q LEFT JOIN held h ON h.tenant_id = q.tenant_id AND h.queue_name = q.queue_name WHERE active_slots <> coalesce(n, 0)"),
        ("active slots differ", "f_tenants t LEFT JOIN deep d ON d.tenant_id = t.tenant_id WHERE active_slots <> coalesce(n, 0)"),
        ("invalid weight", "f_queues WHERE weight < 1"),
        ("tenant row missing", "deep WHERE tenant_id NOT IN (SELECT tenant_id FROM f_tenants)"),
        ("slots over cap", "f_tenants WHERE max_slots > 0 AND active_slots > max_slots"),
        ("depth over cap", "f_tenants t JOIN deep d ON d.tenant_id = t.tenant_id WHERE max_depth > 0 AND depth > max_depth"),
        ("reservations after the drain", "(SELECT sum(n) AS n FROM held) WHERE n > 0"),
    ]),
    "REC11_counters": ("materialized_jobs", [
        ("counter missing", "(SELECT count(*) AS n FROM f_count WHERE name = 'ready_seq') WHERE n = 0"),
        ("counter behind ready sequence", "(SELECT (SELECT max(value) FROM f_count WHERE name = 'ready_seq') AS v, (SELECT max(ready_seq) FROM f_jobs WHERE ready_seq > 0) AS h) WHERE v < h"),
        ("duplicate counter", _extra("f_count", "name")),
        ("ready sequence repeated", _extra("(SELECT * FROM f_jobs WHERE ready_seq > 0)", "ready_seq")),
    ]),
    "REC12_schema_versions": ("schema_migrations", [
        ("no migrations", "(SELECT count(*) AS n FROM f_mig) WHERE n = 0"),
        ("versions not contiguous", "(SELECT count(*) AS n, count(DISTINCT version) AS d, min(version) AS a, max(version) AS b FROM f_mig) WHERE n > 0 AND (d <> n OR a <> 1 OR b <> n)"),
        ("invalid checksum", f"f_mig WHERE NOT {_digest('checksum')}"),
        ("empty name", "f_mig WHERE name = ''"),
        ("invalid time", "f_mig WHERE applied_at <= 0"),
    ]),
    "REC15_foreign_keys": ("foreign_keys", [
        ("attempt without job", "f_att WHERE job_id NOT IN (SELECT id FROM f_jobs)"),
        ("completion without job", "f_done WHERE job_id NOT IN (SELECT id FROM f_jobs)"),
        ("request without job", "f_req WHERE job_id NOT IN (SELECT id FROM f_jobs)"),
        ("dependency without job", "f_edges WHERE job_id NOT IN (SELECT id FROM f_jobs)"),
        ("dependency without parent", "f_edges WHERE depends_on_id NOT IN (SELECT id FROM f_jobs)"),
        ("event without job", "f_ev WHERE job_id NOT IN (SELECT id FROM f_jobs)"),
        ("job without tenant", "f_jobs WHERE tenant_id NOT IN (SELECT tenant_id FROM f_tenants)"),
    ]),
}


def keys_of(d: dict[str, DataFrame]) -> DataFrame:
    links = [("att", "job_id", "attempt without job"), ("done", "job_id", "completion without job"), ("req", "job_id", "request without job"), ("edges", "job_id", "dependency without job"), ("edges", "depends_on_id", "dependency without parent"), ("moves", "job_id", "event without job")]
    return checks.union([*(checks.foreign_keys(d[t], c, d["jobs"], "id", name) for t, c, name in links), checks.foreign_keys(d["jobs"], "tenant_id", d["tenants"], "tenant_id", "job without tenant")])


FOUND: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] = {
    "REC1_manifest": lambda d: checks.manifest(d["man"]),
    "REC2_ledger_jobs": lambda d: checks.ledger_jobs(d["man"], d["jobs"]),
    "REC3_materialized": lambda d: checks.materialized(d["jobs"]),
    "REC4_completions": lambda d: checks.completions(d["man"], d["jobs"], d["done"]),
    "REC5_idempotency": lambda d: checks.idempotency(d["man"], d["req"]),
    "REC6_attempt_rows": lambda d: checks.attempt_rows(d["att"], d["jobs"]),
    "REC7_attempt_chain": lambda d: checks.attempt_chain(d["att"], d["jobs"], d["done"], True),
    "REC8_event_log": lambda d: checks.event_log(d["ev"], d["jobs"]),
    "REC9_dag": lambda d: checks.dependencies(d["edges"], d["jobs"], d["moves"]),
    "REC10_slots": lambda d: checks.slots(d["jobs"], d["queues"], d["tenants"], True),
    "REC11_counters": lambda d: checks.counters(d["jobs"], d["count"]),
    "REC12_schema_versions": lambda d: checks.schema_versions(d["mig"]),
    "REC15_foreign_keys": keys_of,
}


def rules_sql(names: list[str], faulty: bool) -> str:
    """`v`: a row (check, message) per violation of these groups of rules."""
    rows = [f"SELECT '{RULES[n][0]}' AS \"check\", '{message}' AS message FROM {source}" for n in names for message, source in RULES[n][1]]
    return f"WITH RECURSIVE {_ctes(faulty)}, {HELP}, v AS ({' UNION ALL '.join(rows)})"


def counted(df: DataFrame) -> DataFrame:
    return df.groupBy("check", "message").agg(F.count("*").alias("n"))


for _name, _found in FOUND.items():
    query(_name, f"{rules_sql([_name], True)} SELECT \"check\", message, count(*) AS n FROM v GROUP BY ALL")(lambda x, f=_found: counted(f(drained(x, True))))


#: Checks of a report that run at once.
SIDE_BY_SIDE = 4


def violations(x: Ledger, faulty: bool) -> DataFrame:
    """All violations of a ledger; each check's are written first, so that the driver doesn't plan them all as one.

    Checks run side by side, as rounds over graphs leave most cores idle; the one with the most rounds begins.
    """

    def make() -> DataFrame:
        own = Drained(x, faulty)
        for name in CLEAN:  # derived here, as what is written once mustn't be made by two threads
            own[name] = drained(x, faulty)[name]
        own["moves"] = drained(x, faulty)["moves"]
        # nearly every check reads jobs, several times
        own["jobs"] = materialize(own["jobs"], "jobs")
        own["done"] = materialize(own["done"], "done")
        names = sorted(FOUND, key=lambda n: n != "REC9_dag")
        with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
            return checks.union(list(pool.map(inheritable_thread_target(x.spark)(lambda n: materialize(FOUND[n](own), "violations")), names)))

    return x.kept(f"violations-{faulty}", make)


def report_of(x: Ledger, faulty: bool) -> DataFrame:
    return checks.report(violations(x, faulty), checks.CHECKS)


_names = ", ".join(f"'{c}'" for c in checks.CHECKS)
_report = f"SELECT c.\"check\", count(v.\"check\") AS violations, count(v.\"check\") = 0 AS passed FROM (SELECT unnest([{_names}]) AS \"check\") c LEFT JOIN v ON v.\"check\" = c.\"check\" GROUP BY c.\"check\""
_verdict = "SELECT coalesce(string_agg(DISTINCT \"check\", ',' ORDER BY \"check\"), '') AS reasons, count(*) AS violations, count(*) = 0 AS passed FROM v"
for _faulty, _kind in ((False, "clean"), (True, "faulty")):
    query(f"REC13_{_kind}_report", f"{rules_sql(list(FOUND), _faulty)} {_report}")(lambda x, f=_faulty: report_of(x, f))
    query("EV5_verdict" if not _faulty else "EV5_faulty_verdict", f"{rules_sql(list(FOUND), _faulty)} {_verdict}")(lambda x, f=_faulty: evidence.passes(report_of(x, f)))

#: Groups of rules as inventory items of their own.
for _name, _of, _messages in (
    ("JN19_lost_and_orphan", "REC2_ledger_jobs", ("job absent from manifest", "accepted job missing")),
    ("AG12_duplicate_completions", "REC4_completions", ("duplicate completion",)),
    ("AG15_counter_head", "REC11_counters", ("counter behind ready sequence",)),
    ("WN2_job_sequence", "REC8_event_log", ("version not contiguous", "move not allowed")),
    ("WN5_attempt_chain", "REC7_attempt_chain", ("attempt numbers not contiguous", "generation not increasing", "fence differs from last attempt")),
    ("GR5_ledger_dag", "REC9_dag", ("edge end missing", "edge crosses tenants", "on or below a cycle", "open below a failed job")),
):
    _in = ", ".join(f"'{m}'" for m in _messages)
    query(_name, f"{rules_sql([_of], True)} SELECT message, count(*) AS n FROM v WHERE message IN ({_in}) GROUP BY ALL")(lambda x, f=FOUND[_of], m=_messages: f(drained(x, True)).where(F.col("message").isin(*m)).groupBy("message").agg(F.count("*").alias("n")))

query("WN3_global_sequence", f"{rules_sql(['REC8_event_log'], True)} SELECT message, count(*) AS n FROM v WHERE message = 'sequence not contiguous' GROUP BY ALL")(lambda x: checks.event_sequence(drained(x, True)["ev"]).groupBy("message").agg(F.count("*").alias("n")))
query("AG13_releases", f"{rules_sql(['REC9_dag'], True)} SELECT message, count(*) AS n FROM v WHERE message = 'released more than once' GROUP BY ALL")(lambda x: checks.releases(drained(x, True)["moves"]).groupBy("message").agg(F.count("*").alias("n")))
query("SO4_set_differences", f"WITH {_ctes(True)} SELECT 'lost' AS side, job_id FROM (SELECT job_id FROM f_man EXCEPT SELECT id FROM f_jobs) UNION ALL SELECT 'orphan', id FROM (SELECT id FROM f_jobs EXCEPT SELECT job_id FROM f_man)")(
    lambda x: (lambda d: d["man"].select("job_id").subtract(d["jobs"].select("id")).select(F.lit("lost").alias("side"), "job_id").unionByName(d["jobs"].select(F.col("id").alias("job_id")).subtract(d["man"].select("job_id")).select(F.lit("orphan").alias("side"), "job_id")))(drained(x, True))
)
query("SO5_sorted_unique", f"{rules_sql(['REC4_completions', 'REC6_attempt_rows'], True)} SELECT \"check\", string_agg(DISTINCT message, ',' ORDER BY message) AS messages FROM v GROUP BY ALL")(
    lambda x: (lambda d: checks.union([FOUND[n](d) for n in ("REC4_completions", "REC6_attempt_rows")]).groupBy("check").agg(F.array_join(F.array_sort(F.collect_set("message")), ",").alias("messages")))(drained(x, True))
)
_detail = f"(SELECT 'materialized_jobs' AS \"check\", id AS job_id, 'invalid slot cost' AS message FROM f_jobs WHERE slot_cost < 1 UNION SELECT 'materialized_jobs', id, 'empty execution key' FROM f_jobs WHERE execution_key = '')"
query("TK10_details", f"WITH {_ctes(True)} SELECT *, (SELECT count(*) FROM {_detail}) > 5 AS truncated FROM {_detail} ORDER BY 1, 2, 3 LIMIT 5")(
    lambda x: checks.capped(checks.materialized(drained(x, True)["jobs"]).where(F.col("message").isin("invalid slot cost", "empty execution key")), 5)
)
_P = {"jobs": "(SELECT id, upper(state) AS state FROM f_jobs)"}
query(
    "REC17_contract",
    f"""WITH {_ctes(True)}, v AS (SELECT 'duplicate completion' AS message FROM {_extra('f_done', 'job_id')} UNION ALL SELECT 'duplicate attempt' FROM {_extra('f_att', 'job_id, attempt_no')} UNION ALL SELECT 'duplicate generation' FROM {_extra('f_att', 'job_id, lease_generation')}
    UNION ALL SELECT 'orphan completion' FROM f_done WHERE job_id NOT IN (SELECT id FROM f_jobs) UNION ALL SELECT 'lost job' FROM f_man WHERE job_id NOT IN (SELECT id FROM f_jobs)
    UNION ALL SELECT 'unsuccessful job' FROM f_jobs WHERE state IN ('FAILED', 'DEAD_LETTER') UNION ALL SELECT 'active job' FROM f_jobs WHERE state NOT IN {_TERMINAL}) SELECT 'contract' AS "check", message, count(*) AS n FROM v GROUP BY ALL""",
)(lambda x: (lambda d: counted(checks.narrow(d["jobs"], d["man"], d["done"], d["att"], succeeded=True, quiescent=True)))(drained(x, True)))

_WEAK = f"""once AS (SELECT DISTINCT job_id FROM f_man), ids AS (SELECT DISTINCT id FROM f_jobs), fold1 AS (SELECT job_id, arg_max(state, event_seq) AS state, arg_max(state_version, event_seq) AS v FROM f_ev GROUP BY job_id),
    s AS (SELECT *, lag(attempt_no, 1, 0) OVER w AS a, lag(lease_generation, 1, 0) OVER w AS g FROM f_att WINDOW w AS (PARTITION BY job_id ORDER BY attempt_no, lease_generation)),
    v AS (SELECT 'lost' AS "check", 'lost job' AS message FROM once WHERE job_id NOT IN (SELECT id FROM ids) OR job_id NOT IN (SELECT job_id FROM f_done)
    UNION ALL SELECT 'orphan', 'orphan job' FROM ids WHERE id NOT IN (SELECT job_id FROM once) UNION ALL SELECT 'accepted', 'accepted twice' FROM (SELECT job_id FROM f_man GROUP BY job_id HAVING count(*) > 1)
    UNION ALL SELECT 'completions', 'duplicate completion' FROM (SELECT job_id FROM f_done GROUP BY job_id HAVING count(*) > 1) UNION ALL SELECT 'unsuccessful', 'unsuccessful job' FROM once WHERE job_id IN (SELECT job_id FROM f_done WHERE state <> 'SUCCEEDED')
    UNION ALL SELECT 'active', 'active job' FROM f_jobs WHERE state NOT IN {_TERMINAL} UNION ALL SELECT 'materialization', 'completion without job' FROM f_done WHERE job_id NOT IN (SELECT id FROM ids)
    UNION ALL SELECT 'materialization', 'completion disagrees with job' FROM f_done c JOIN f_jobs j ON j.id = c.job_id WHERE c.state <> j.state
    UNION ALL SELECT 'attempts', 'attempt numbers not rising' FROM s WHERE attempt_no <= a UNION ALL SELECT 'attempts', 'generations not rising' FROM s WHERE lease_generation <= g UNION ALL SELECT 'attempts', 'active attempt' FROM s WHERE state IN {_LIVE}
    UNION ALL SELECT 'events', 'version not one more' FROM (SELECT state_version, lag(state_version, 1, 0) OVER (PARTITION BY job_id ORDER BY event_seq) AS p FROM f_ev) WHERE state_version <> p + 1
    UNION ALL SELECT 'events', 'fold differs from job' FROM f_jobs j LEFT JOIN fold1 f ON f.job_id = j.id WHERE f.state IS NULL OR f.state <> j.state OR f.v <> j.state_version)"""


def weak(x: Ledger) -> DataFrame:
    d = drained(x, True)
    return checks.weaker(d["jobs"], d["man"], d["done"], d["att"], d["ev"])


query("REC16_weaker_rules", f"WITH {_ctes(True)}, {_WEAK} SELECT \"check\", message, count(*) AS n FROM v GROUP BY ALL")(lambda x: counted(weak(x)))
query("WN4_version_step", f"WITH {_ctes(True)}, {_WEAK} SELECT count(*) AS n FROM v WHERE message = 'version not one more'")(lambda x: weak(x).where("message = 'version not one more'").agg(F.count("*").alias("n")))
query("WN6_attempts_rise", f"WITH {_ctes(True)}, {_WEAK} SELECT message, count(*) AS n FROM v WHERE message LIKE '% not rising' GROUP BY ALL")(lambda x: weak(x).where("message LIKE '% not rising'").groupBy("message").agg(F.count("*").alias("n")))
