"""Scalar functions of the ledger as column expressions: keys, ages, retry delays, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MS = 1_000_000
TERMINAL = ("SUCCEEDED", "FAILED", "DEAD_LETTER")
ACTIVE = ("SCHEDULED", "RUNNING")
#: Retry caps in seconds, of attempts 1, 2, 3, and 4 or more.
RETRY_CAPS = (2, 4, 8, 16)


def bytes_of(*parts: Column) -> Column:
    return F.concat(*(p.cast("binary") for p in parts))


def sha_hex(*parts: Column) -> Column:
    return F.sha2(bytes_of(*parts), 256)


def whole(x: Column, of: int) -> Column:
    """Integer division of longs, exact beyond 2**53."""
    return F.call_function("div", x, F.lit(of))


def zero() -> Column:
    return F.lit(b"\0")


def retry_delay_ns(job_id: Column, attempt: Column) -> Column:
    """Backoff in ns: the attempt's cap times 80 to 100 %, by a hash of job and attempt."""
    h = sha_hex(job_id, zero(), F.unhex(F.lpad(F.hex(attempt.cast("long")), 16, "0")))
    basis = 8000 + F.conv(F.substring(h, 1, 4), 16, 10).cast("long") % 2001
    n = F.least(attempt, F.lit(4))
    cap = F.element_at(F.array(*(F.lit(c * 1_000_000_000).cast("long") for c in RETRY_CAPS)), n.cast("int"))
    return whole(cap * basis, 10_000)


def age_ms(now_ns: int | Column, then: Column) -> Column:
    """Milliseconds since `then`, truncated, never negative; null of null."""
    now = F.lit(now_ns) if isinstance(now_ns, int) else now_ns
    d = F.greatest(F.lit(0), now - then)
    return F.when(then.isNotNull(), whole(d, MS))


def health(heartbeat_age_ms: Column) -> Column:
    return F.when(heartbeat_age_ms <= 30_000, "healthy").when(heartbeat_age_ms <= 120_000, "stale").otherwise("offline")


def duration_between(origin: Column, end: Column) -> Column:
    """ns between two times; null without an origin or where the end comes first."""
    return F.when(end >= origin, end - origin)


def dag_id(tenant: Column, key: Column) -> Column:
    return F.concat(F.lit("dag-"), F.substring(sha_hex(tenant, zero(), key), 1, 24))


def cron_key(trigger: Column, rfc3339: Column) -> Column:
    return F.concat(F.lit("cron:"), sha_hex(trigger, zero(), rfc3339))


def rfc3339_nano(ns: Column) -> Column:
    """UTC time of epoch ns, without trailing zeros of the fraction."""
    second = whole(ns, 1_000_000_000)
    base = F.date_format(F.timestamp_seconds(second), "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.rtrim(F.lpad(F.pmod(ns, F.lit(1_000_000_000)).cast("string"), 9, "0"), F.lit("0"))
    return F.concat(base, F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""), F.lit("Z"))


def delivery_key(trigger: Column, stream: Column, message: Column) -> Column:
    return F.concat_ws(":", F.lit("redis"), trigger, stream, message)


def is_id(x: Column) -> Column:
    return F.coalesce(x.rlike("^[0-9a-f]{32}$"), F.lit(False))


def is_digest(x: Column) -> Column:
    return F.coalesce(x.rlike("^[0-9a-f]{64}$"), F.lit(False))


def attempt_of(payload: Column) -> Column:
    return F.get_json_object(payload, "$.attempt_no").cast("long")


def is_label(x: Column) -> Column:
    """Identifiers of headers and actions: 1 to 128 bytes of printable ASCII without spaces at the ends."""
    return F.coalesce(F.octet_length(x).between(1, 128) & x.rlike("^[!-~]([ -~]*[!-~])?$"), F.lit(False))


def mapped_clock(server_ns: Column, before_ns: Column, after_ns: Column) -> tuple[Column, Column]:
    """(offset, uncertainty) of a clock read between two host readings: integer halves."""
    return server_ns - (before_ns + whole(after_ns - before_ns, 2)), whole(after_ns - before_ns + 1, 2)


def bounded(x: Column, allowed: tuple[str, ...], rest: str = "other") -> Column:
    """Map a label to a bounded set."""
    return F.when(x.isin(*allowed), x).otherwise(rest)


def audit_id(tenant: Column, action: Column, key: Column) -> Column:
    """SC8: id of an operator action's audit event."""
    return F.concat(F.lit("audit-"), F.substring(scoped_key(tenant, action, key), 1, 24))


def scoped_key(tenant: Column, action: Column, key: Column) -> Column:
    """SC8: idempotency scope of an operator action."""
    return sha_hex(tenant, zero(), action, zero(), key)


def stable_key(domain: str, prefix: str, run: Column, seed: Column, index: Column) -> Column:
    """SC11, AG23: key of a benchmark submission: `prefix` and the first 24 bytes of a hash over domain, run, seed and index."""
    h = sha_hex(F.lit(domain), zero(), run, zero(), seed.cast("string"), zero(), index.cast("string"))
    return F.concat(F.lit(prefix), F.substring(h, 1, 48))


#: What the ledger's JSON escapes by number, besides control characters: HTML and line separators.
ESCAPED = "<>&\u2028\u2029"


def json_text(x: Column) -> Column:
    """SC15: a JSON string with the ledger's escapes."""
    out = F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for c, e in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"), *((c, f"\\u{ord(c):04x}") for c in ESCAPED)):
        out = F.replace(out, F.lit(c), F.lit(e))
    return F.concat(F.lit('"'), out, F.lit('"'))


def json_object(**fields: Column) -> Column:
    """SC15: a JSON object of fields that are JSON already, in the order given."""
    parts = [F.concat(F.lit(f'"{name}":'), x) for name, x in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def request_digest(**fields: Column) -> Column:
    """SC6: digest of a request: SHA-256 of its canonical JSON."""
    return F.sha2(json_object(**fields).cast("binary"), 256)


def json_set(x: Column, name: str, value: Column) -> Column:
    """SC2: a flat JSON object with a field set to a value that is JSON already."""
    there = F.get_json_object(x, f"$.{name}").isNotNull()
    field = F.concat(F.lit(f'"{name}":'), value)
    changed = F.regexp_replace(x, F.lit(rf'"{name}":("(\\.|[^"\\])*"|[^,}}]*)'), F.regexp_replace(field, r"([\\$])", r"\\$1"))
    return F.when(there, changed).when(F.trim(x) == "{}", F.concat(F.lit("{"), field, F.lit("}"))).otherwise(F.concat(F.substring(x, F.lit(1), F.length(x) - 1), F.lit(","), field, F.lit("}")))
