"""Run a registered query and its DuckDB statement on the same tables and compare the results."""

from __future__ import annotations

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _normal(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    text = frame.apply(lambda column: column.map(lambda v: "" if v is None or v is pd.NaT or v != v else str(v)))
    return text.sort_values(list(text.columns)).reset_index(drop=True)


def _kind(arrow_type) -> str:
    return str(arrow_type).replace("large_string", "string").replace("[us, tz=UTC]", "").replace("[us]", "")


def differences(spark: SparkSession, query, statement: str, con, sf_dir: str) -> list[str]:
    """Empty where names, types, row count and all values agree."""
    ours = query(spark, sf_dir).toArrow()
    theirs = con.sql(statement).to_arrow_table()
    problems = []
    left = {f.name: _kind(f.type) for f in ours.schema}
    right = {f.name: _kind(f.type) for f in theirs.schema}
    if left != right:
        problems.append(f"schema {sorted(set(left.items()) ^ set(right.items()))}")
    if ours.num_rows != theirs.num_rows:
        problems.append(f"rows {ours.num_rows} != {theirs.num_rows}")
    if not problems or sorted(left) == sorted(right) and ours.num_rows == theirs.num_rows:
        a, b = _normal(ours.to_pandas()), _normal(theirs.to_pandas())
        unequal = (a != b).any(axis=1)
        if unequal.any():
            first = unequal.idxmax()
            problems.append(
                f"{int(unequal.sum())} rows differ, first\n   {a.loc[first].to_dict()}\n   {b.loc[first].to_dict()}"
            )
    return problems
