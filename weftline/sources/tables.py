"""Table access: Parquet with pruned columns, typed guards, CSV at the edges."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def require(df: DataFrame, columns: Iterable[str], what: str = "table") -> DataFrame:
    """Fail early, by name, if required columns are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks the columns {missing}")
    return df


def ensure(df: DataFrame, column: str, kind: str, default: object = None) -> DataFrame:
    """Give ``df`` the column with this type, with ``default`` where absent or not castable."""
    if column not in df.columns:
        return df.withColumn(column, F.lit(default).cast(kind))
    value = F.col(column).try_cast(kind)
    return df.withColumn(column, value if default is None else F.coalesce(value, F.lit(default).cast(kind)))


def existing(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Project on those of the columns that exist (a tolerant, still pruned scan)."""
    return df.select(*[c for c in columns if c in df.columns])


def read_csv(spark: SparkSession, path: str | list[str], schema: str | None = None, na_values: Iterable[str] = (), source_file: bool = False) -> DataFrame:
    """CSV or CSV.GZ with header, quoted line ends and an explicit schema (all strings if none
    is given: nothing is inferred). ``na_values`` are read as null in string columns;
    ``source_file`` adds the file's path for multi-file scans."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    df = (reader.schema(schema) if schema else reader).csv(path)
    if source_file:
        df = df.withColumn("source_file", F.col("_metadata.file_path"))
    na = list(na_values)
    if na:
        df = df.select(*[F.when(~F.col(c).isin(na), F.col(c)).alias(c) if t == "string" and c != "source_file" else F.col(c) for c, t in df.dtypes])
    return df


def write_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path, compression=compression)


def row_range(df: DataFrame, order: list[str], start: int, end: int) -> DataFrame:
    """Rows ``start`` (counted from 0) up to ``end`` in the given order. Ranks come from per-partition
    counts of a range-sorted frame, so no single task sees all rows."""
    from weftline.operators.ranking import global_index

    return global_index(df, order, "_at").where((F.col("_at") >= start) & (F.col("_at") < end)).drop("_at")


def pending(source: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows still to be worked on: those of ``source`` whose key ``done`` does not have."""
    return source.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def resume(source: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is done for keys of ``source``, and the untouched rest with nulls in the result columns."""
    kept = done.join(source.select(key).distinct(), key, "left_semi")
    return kept.unionByName(pending(source, done, key), allowMissingColumns=True)


def one_layout(comments: DataFrame) -> DataFrame:
    """(comment_id, post_id, author, created_utc) of either comment layout: with post_id, or with link_id,
    whose prefix is taken off. Only the header decides; no row is read."""
    have = set(comments.columns)
    base = {"comment_id", "author", "created_utc"}
    if base | {"post_id"} <= have:
        post = F.col("post_id")
    elif base | {"link_id"} <= have:
        post = F.regexp_replace(F.col("link_id").cast("string"), "^t3_", "")
    else:
        raise ValueError("comments need comment_id, author, created_utc and post_id or link_id")
    return comments.select("comment_id", post.alias("post_id"), "author", "created_utc")


def merge_batches(spark: SparkSession, path: str | list[str], key: str, schema: str | None = None) -> DataFrame:
    """All files of a glob with ``source_file``; of a repeated key the row of the last file (by name) stays."""
    from weftline.operators.cleaning import keep_last

    df = read_csv(spark, path, schema, source_file=True)
    return keep_last(df, [key], ["source_file", *[c for c in df.columns if c not in (key, "source_file")]])


def write_layers(layers: DataFrame, path: str) -> None:
    """All layers of (layer, source, target, weight) in one pass, one folder each, without zero weights."""
    layers.where(F.round("weight", 9) != 0).write.mode("overwrite").partitionBy("layer").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """A small summary as JSON lines in one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def save_in_steps(source: DataFrame, path: str, key: str, work, every: int) -> int:
    """Works off the rows of ``source`` that the table at ``path`` doesn't have yet, ``every`` rows at a time,
    and appends each step when it is done, so a run that was broken off goes on where it was. Gives the
    number of steps."""
    spark = source.sparkSession
    try:
        left = pending(source, spark.read.parquet(path), key)
    except Exception as e:  # nothing has been saved yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        left = source
    from weftline.operators.ranking import global_index

    rows = global_index(left, [key], "_at")
    steps = -(-rows.count() // every)
    for i in range(steps):
        work(rows.where(F.floor(F.col("_at") / every) == i).drop("_at")).write.mode("append").parquet(path)
    return steps
