"""Text expressions: normalising, composing, prefixes, ratios, chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Placeholders for removed content.
BODY_BLANKS = ("[removed]", "[deleted]", "nan", "none")
WHITE = " \t\r\n\x0b\x0c"


def normalize(x: Column) -> Column:
    """One kind of line end, single blanks, at most one blank line, trimmed; null becomes ''."""
    y = F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), "\r\n?", "\n"), "[ \t]+", " ")
    return F.trim(F.regexp_replace(y, "\n{3,}", "\n\n"), F.lit(WHITE))


def clean(x: Column) -> Column:
    """Normalised, with placeholders for removed text as ''."""
    y = normalize(x)
    return F.when(F.lower(y).isin(*BODY_BLANKS), F.lit("")).otherwise(y)


def compose(title: Column, body: Column) -> Column:
    """Title, blank line, body; only the body if both agree but for case."""
    both = F.when(F.lower(title) == F.lower(body), body).otherwise(F.concat_ws("\n\n", title, body))
    return F.when((title != "") & (body != ""), both).when(body != "", body).otherwise(title)


def ratio(x: Column, pattern: str) -> Column:
    """Matches of the pattern per character."""
    return F.regexp_count(x, F.lit(pattern)) / F.greatest(F.length(x), F.lit(1))


def chunks(x: Column, size: int = 500, overlap: int = 100) -> Column:
    """Overlapping pieces of a text as an array; null or empty gives an empty array."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1)), F.lit(size - overlap))
    return F.when(F.length(x) > 0, F.transform(starts, lambda i: F.substring(x, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def safe_filename(x: Column) -> Column:
    y = F.trim(F.regexp_replace(x, "[^A-Za-z0-9_.-]+", "_"), F.lit("_"))
    return F.when(y == "", F.lit("seed")).otherwise(y)


def ratio_or_zero(a: Column, b: Column) -> Column:
    """a / b, and 0 where that is undefined (ANSI mode raises on division by zero)."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def clamp_int(x: Column, low: int, high: int, default: int) -> Column:
    """Rounded half to even and clamped; the default for what isn't a finite number."""
    v = x.try_cast("double")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(1e300))
    return F.when(ok, F.greatest(F.lit(low), F.least(F.lit(high), F.bround(F.greatest(F.lit(low - 1.0), F.least(F.lit(high + 1.0), v))).cast("int")))).otherwise(F.lit(default))


def exact_mean(col: str, digits: int) -> Column:
    """Mean over the non-null values taken at ``digits`` decimals: they are summed as whole numbers and
    divided once, so the result doesn't depend on the order of rows."""
    return F.sum(F.round(F.col(col) * F.lit(10.0**digits)).cast("long")) / (F.lit(10.0**digits) * F.count(col))


def sql_mean(col: str, digits: int) -> str:
    """The same mean for the DuckDB oracle."""
    return f"(sum(round({col} * 1e{digits})::bigint)::double / (1e{digits} * count({col})))"
