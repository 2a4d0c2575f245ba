"""Compare registered queries with their SQL, row by row."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from runlens.workload.oracle import ORACLE
from runlens.workload.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def _bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(spark: SparkSession, con, sf_dir: str, name: str) -> str | None:
    """What sets a query apart from its SQL; None when they agree."""
    result = QUERIES[name](spark, sf_dir)
    relation = con.sql(ORACLE[name])
    if sorted(result.columns) != sorted(relation.columns):
        return f"columns {sorted(result.columns)} != {sorted(relation.columns)}"
    got = _bag(result.columns, result.collect())
    want = _bag(relation.columns, relation.fetchall())
    if got == want:
        return None
    extra, missing = list((got - want).items()), list((want - got).items())
    return (
        f"{sum(got.values())} rows, want {sum(want.values())}; "
        f"{len(extra)} unexpected {extra[:3]}; {len(missing)} missing {missing[:3]}"
    )
