"""Queries on documents: p8 (token ids), p9 (mixing sources), p10 (content scores)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.content import ContentModel, content_scores, offending_sentences
from weftline.llm.mixing import mix_copies, shares
from weftline.llm.tokens import Tokenizer, corpus_ids, corpus_sizes
from weftline.plans.lineage import cut
from weftline.sources.tables import table


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_ids(table(spark, folder, "documents"), F.col("doc_id"), F.col("text"), Tokenizer())


def _sized(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where(F.col("source").isNotNull()).select("doc_id", "source", "text")
    return cut(corpus_sizes(docs, "text"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The mixed collection: one row per copy of a document."""
    copies, _ = mix_copies(_sized(spark, folder), table(spark, folder, "mix_targets"))
    return copies.select("doc_id", "source", F.col("size").alias("tokens"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached shares by source, in tokens."""
    copies, rate = mix_copies(_sized(spark, folder), table(spark, folder, "mix_targets"))
    s = shares(copies, rate)
    return s.select("source", "target_share", "goal_share", "reached_share", "max_repeats", "most_repeats", "rate", "docs", F.col("size").alias("tokens"), "mixed_docs", F.col("mixed_size").alias("mixed_tokens"))


MODEL = ContentModel()


def p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's score, its number of sentences and offending sentences, and its worst one."""
    return content_scores(table(spark, folder, "documents"), table(spark, folder, "content_labels"), MODEL)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_scores(spark, folder).where(F.col("score") >= MODEL.flag).select("doc_id")


def p10_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Where the flagged documents offend: their offending sentences with place and score."""
    return offending_sentences(table(spark, folder, "documents"), table(spark, folder, "content_labels"), MODEL)


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Share of flagged documents by source."""
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce("source", F.lit("(none)")).alias("source"))
    s = p10_scores(spark, folder).select("doc_id", "score")
    hit = (F.col("score") >= MODEL.flag).cast("int")
    return docs.join(s, "doc_id").groupBy("source").agg(F.count("*").alias("docs"), F.sum(hit).alias("flagged"), F.avg(hit).alias("rate"), F.avg("score").alias("mean_score"))


QUERIES = {"p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_scores": p10_scores, "p10_sentences": p10_sentences, "p10_rates": p10_rates}


def oracle_sql() -> dict[str, str]:
    return {}
