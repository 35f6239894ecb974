"""Compares a registered query with its SQL in DuckDB."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _value(v):
    if v is None or str(v) in ("nan", "<NA>", "NaT", "None"):
        return "NULL"
    if isinstance(v, bool) or str(v) in ("True", "False"):
        return str(v)
    try:
        number = float(v)
    except (TypeError, ValueError):
        return str(v)
    return str(int(number)) if number == int(number) and not isinstance(v, str) else (str(v) if isinstance(v, str) else repr(round(number, 9)))


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(map(_value, r)) for r in frame[names].astype(object).itertuples(index=False))


def assert_same(spark_frame, sql, sf_dir):
    mine, theirs = rows(spark_frame), rows(connect(sf_dir).sql(sql).df())
    assert mine[0] == theirs[0]
    assert mine[1] == theirs[1]
