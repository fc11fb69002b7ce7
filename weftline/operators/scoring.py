"""Composite account scores from percentile-normalised signals. Scores order a review; they are no verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.ranking import positive_percentiles, top_rows

# Weights of the manipulative, coordinative, reach and automatic signals by profile.
PROFILES = {
    "primary": (0.30, 0.35, 0.15, 0.20),
    "coordination": (0.20, 0.50, 0.10, 0.20),
    "behavior": (0.20, 0.25, 0.15, 0.40),
    "rhetoric": (0.50, 0.25, 0.15, 0.10),
    "equal": (0.25, 0.25, 0.25, 0.25),
    "alt": (0.40, 0.40, 0.10, 0.10),
}
SIGNALS = ("manipulative", "coordinative", "reach", "automatic")


def signals(accounts: DataFrame) -> DataFrame:
    """The four signals. ``accounts`` has user_id, opposed_ratio, out_n, in_n, breadth, co_target,
    co_negative, trigger_out, trigger_in, anomaly_score, rhetoric and nonneutral (all nullable)."""
    base = accounts.select("user_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in accounts.columns if c != "user_id"])
    base = base.withColumn("unusual", F.greatest(F.lit(0.0), -F.col("anomaly_score")))
    raw = {c: f"p_{c}" for c in ("rhetoric", "nonneutral", "opposed_ratio", "out_n", "in_n", "breadth", "co_target", "co_negative", "trigger_out", "trigger_in", "unusual")}
    n = positive_percentiles(base, "user_id", raw)
    trigger = 0.5 * F.col("p_trigger_out") + 0.5 * F.col("p_trigger_in")
    return n.select(
        "user_id", (0.40 * F.col("p_rhetoric") + 0.35 * F.col("p_nonneutral") + 0.25 * F.col("p_opposed_ratio")).alias("manipulative"),
        (0.30 * F.col("p_co_target") + 0.35 * F.col("p_co_negative") + 0.35 * trigger).alias("coordinative"),
        (0.35 * F.col("p_out_n") + 0.25 * F.col("p_in_n") + 0.40 * F.col("p_breadth")).alias("reach"), F.col("p_unusual").alias("automatic"),
    )


def weighted(df: DataFrame, weights: tuple[float, ...], out: str, columns: tuple[str, ...] = SIGNALS) -> DataFrame:
    """Weighted mean of the signals; weights are normalised to sum 1."""
    total = sum(weights)
    if total <= 0:
        raise ValueError("weights must add up to more than 0")
    return df.withColumn(out, sum((F.lit(w / total) * F.col(c) for w, c in zip(weights, columns, strict=True)), F.lit(0.0)))


def weight_audit(spark) -> DataFrame:
    """(profile, score_column, a weight per signal): the normalised weights that scores were made with."""
    rows = [(p, f"score_{p}", *[w / sum(ws) for w in ws]) for p, ws in PROFILES.items()]
    return spark.createDataFrame(rows, "profile string, score_column string, " + ", ".join(f"{s} double" for s in SIGNALS))


def views(df: DataFrame, columns: tuple[str, ...] = SIGNALS) -> DataFrame:
    """One score column per profile."""
    return reduce(lambda d, p: weighted(d, p[1], f"score_{p[0]}", columns), PROFILES.items(), df)


def leaders(df: DataFrame, score: str, n: int, least: float = 0.0, key: str = "user_id") -> DataFrame:
    """The n highest scores of at least ``least``, ties by key, with their rank."""
    return top_rows(df.where(F.col(score) >= least), [F.desc(score), F.asc(key)], n, "place")
