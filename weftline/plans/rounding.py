"""Results whose doubles come from sums are rounded alike on both sides of a comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    # scaled, rounded and scaled back, as DuckDB does it: equal doubles stay equal
    scale = F.lit(10.0**digits)
    return df.select(*[(F.round(F.col(f"`{c}`") * scale) / scale + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def sql_rounded(sql: str, columns: str, digits: int = 6) -> str:
    """The SQL with the named columns (blank-separated) rounded."""
    each = ", ".join(f"round({c}, {digits}) + 0.0 as {c}" for c in columns.split())
    with_, body = sql.split("\nSELECT ", 1)
    return f"{with_}\nselect * replace ({each}) from (select {body})"
