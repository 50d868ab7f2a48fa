"""Compare a registered query with its DuckDB SQL on one folder of tables."""

import duckdb

from tidewheel.sources.derive import BASE


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(rows):
    fit = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(map(fit, r)) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def agree(spark, con, sf_dir: str, query, sql: str) -> None:
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows_of(map(tuple, df.select(*columns).collect())) == rows_of(tuple(r[i] for i in at) for r in found.fetchall())
