"""Cron schedules: the next time of an expression, and due triggers as a DataFrame operation."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Descriptors and their five fields, and names of months and days.
DESCRIPTORS = {"@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *", "@monthly": "0 0 1 * *", "@weekly": "0 0 * * 0", "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@hourly": "0 * * * *"}
NAMES = {n: i for names, start in (("jan feb mar apr may jun jul aug sep oct nov dec", 1), ("sun mon tue wed thu fri sat", 0)) for i, n in enumerate(names.split(), start)}
UNITS = {"ns": 1e-9, "us": 1e-6, "\u00b5s": 1e-6, "\u03bcs": 1e-6, "ms": 1e-3, "s": 1, "m": 60, "h": 3600}
RANGES = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 6))


def field(text: str, low: int, high: int) -> set[int]:
    out: set[int] = set()
    number = lambda x: NAMES[x.lower()] if x.lower() in NAMES else int(x)
    for part in text.split(","):
        body, _, step = part.partition("/")
        if body in ("*", "?"):
            a, b = low, high
        elif "-" in body:
            a, b = map(number, body.split("-"))
        else:
            a = number(body)
            b = high if step else a
        if not low <= a <= b <= high or (step and int(step) < 1):
            raise ValueError(f"invalid cron field {text!r}")
        out |= set(range(a, b + 1, int(step or 1)))
    return out


def duration(text: str) -> int:
    """Whole seconds, one at least, of a duration such as 1h30m or 1.5h."""
    parts = re.findall(r"([0-9]*\.?[0-9]+|[0-9]+\.)(ns|us|\u00b5s|\u03bcs|ms|s|m|h)", text)
    if not parts or "".join(a + b for a, b in parts) != text.removeprefix("+"):
        raise ValueError(f"invalid duration {text!r}")
    return max(1, int(sum(float(n) * UNITS[u] for n, u in parts)))


def next_time(expression: str, after: datetime) -> datetime:
    """First time of the schedule strictly after an aware time, in UTC; CRON_TZ= names the zone that fields mean."""
    zone = ZoneInfo("UTC")
    if expression.startswith(("CRON_TZ=", "TZ=")):
        head, _, expression = expression.partition(" ")
        zone = ZoneInfo(head.partition("=")[2])
    if expression.startswith("@every "):
        return (after.replace(microsecond=0) + timedelta(seconds=duration(expression[7:].strip()))).astimezone(timezone.utc)
    fields = DESCRIPTORS.get(expression, expression).split()
    if len(fields) != 5:
        raise ValueError("a schedule has five fields")
    minutes, hours, days, months, weekdays = (field(f, *r) for f, r in zip(fields, RANGES, strict=True))
    free_day, free_week = fields[2] in ("*", "?"), fields[4] in ("*", "?")
    local = after.astimezone(zone)
    day = local.date()
    for _ in range(366 * 5):
        week = day.isoweekday() % 7
        fits = (day.day in days and week in weekdays) if free_day or free_week else (day.day in days or week in weekdays)
        if day.month in months and fits:
            for h in sorted(hours):
                for m in sorted(minutes):
                    t = datetime(day.year, day.month, day.day, h, m, tzinfo=zone)
                    if t.astimezone(timezone.utc).astimezone(zone).replace(tzinfo=None) == t.replace(tzinfo=None) and t > after:
                        return t.astimezone(timezone.utc)
        day += timedelta(days=1)
    raise ValueError("no time within five years")


def due(triggers: DataFrame, now_ns: int, limit: int) -> DataFrame:
    """STR3, TK5, SRC10: due triggers (id, schedule, next_fire_at) in order: their nominal time and the next time after now, so missed times fire once."""

    def run(parts):
        now = datetime.fromtimestamp(now_ns // 10**9, timezone.utc)
        for part in parts:
            part["next"] = [int(next_time(s, now).timestamp()) * 10**9 for s in part["schedule"]]
            yield part[["id", "nominal_at", "next"]]

    own = triggers.where(F.col("next_fire_at") <= now_ns).orderBy("next_fire_at", "id").limit(limit).select("id", "schedule", F.col("next_fire_at").alias("nominal_at"))
    return own.mapInPandas(run, "id string, nominal_at long, next long")


