"""Where the modules of queries register them: by inventory id, with DuckDB SQL over the same derived ledger."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.sources.derive import Ledger

TENANT = "nation-7"
QUERIES: dict[str, Callable[[Ledger], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = "(SELECT max(occurred_at) FROM ev0)"


def query(name: str, sql: str | None = None):
    def keep(f: Callable[[Ledger], DataFrame]) -> Callable[[Ledger], DataFrame]:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def now_of(ledger: Ledger) -> int:
    """The time of the last event; events needn't be numbered for it."""
    return ledger.kept("now", lambda: ledger.evagg.agg(F.max("updated_at")).first()[0] or 0)


def key(table: DataFrame, k: int, column: str = "id") -> str:
    """The id of order k's job."""
    return hashlib.md5(f"job:{k}".encode()).hexdigest()
