"""Side-by-side comparison of a Spark result with its DuckDB counterpart."""

from __future__ import annotations

import glob
import os

import duckdb

KINDS = {
    "tinyint": "int8", "int": "int32", "bigint": "int64", "double": "double",
    "string": "string", "boolean": "bool",
}
DUCK_KINDS = {
    "TINYINT": "int8", "INTEGER": "int32", "BIGINT": "int64", "DOUBLE": "double",
    "VARCHAR": "string", "BOOLEAN": "bool",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _sorted(rows: list, names: list[str]) -> list[tuple]:
    """Rows with their columns by name, in the order of their text; no type is widened."""
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def differences(spark_df, con, sql: str) -> list[str]:
    """Empty if names, types, row count and every value agree."""
    relation = con.sql(sql)
    left = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString())
            for f in spark_df.schema}
    right = {n: DUCK_KINDS.get(str(t), str(t)) for n, t in zip(relation.columns, relation.types)}
    if left != right:
        return [f"schema: {set(left.items()) ^ set(right.items())}"]
    a = _sorted(spark_df.collect(), spark_df.columns)
    b = _sorted(relation.fetchall(), relation.columns)
    if len(a) != len(b):
        return [f"rows: {len(a)} against {len(b)}"]
    return [f"{x!r:.300} against {y!r:.300}" for x, y in zip(a, b) if repr(x) != repr(y)][:3]
