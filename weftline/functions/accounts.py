"""Account-name rules: trimming, validity, canonical pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that stand for no account (lower-cased, trimmed).
INVALID_ACCOUNTS = ("", "nan", "none", "[deleted]", "[removed]", "deleted", "removed")
BLANKS = " \t\r\n\x0b\x0c"


def name(col: Column | str) -> Column:
    """The name without blanks, tabs and line ends on both sides (null stays null)."""
    return F.trim(F.col(col) if isinstance(col, str) else col, F.lit(BLANKS))


def valid(col: Column | str) -> Column:
    """True for a usable account name; false (never null) for null and placeholder names."""
    x = name(col)
    return F.coalesce(~F.lower(x).isin(*INVALID_ACCOUNTS), F.lit(False))


def valid_name(col: Column | str) -> Column:
    """The trimmed name, or null where it is not valid."""
    return F.when(valid(col), name(col))


def finite(col: Column | str) -> Column:
    """The number as double, with NaN as null."""
    x = (F.col(col) if isinstance(col, str) else col).cast("double")
    return F.when(~F.isnan(x), x)


def canonical(a: str, b: str) -> tuple[Column, Column]:
    return F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))


# The same rules for the DuckDB oracle.
def sql_name(x: str) -> str:
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def sql_valid(x: str) -> str:
    names = ", ".join(f"'{v}'" for v in INVALID_ACCOUNTS)
    return f"coalesce(lower({sql_name(x)}) not in ({names}), false)"


def sql_finite(x: str) -> str:
    # as text: DuckDB takes Parquet statistics, which leave NaN out, as proof that there is none
    return f"case when {x}::varchar <> 'nan' then {x}::double end"
