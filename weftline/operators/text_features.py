"""Text features of posts, hashed term vectors, top terms, nearest-neighbour retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import ratio
from weftline.operators.cleaning import LABELS
from weftline.operators.ranking import top_per_group

# The token pattern, and the words left out of top terms.
TOKEN = "[a-zA-Z][a-zA-Z0-9']+"
STOP = ("the", "and", "for", "that", "this", "with", "you", "are", "was", "have")
PATTERNS = {"uppercase": "[A-Z]", "digit": "[0-9]", "exclamation": "!", "question": "\\?", "url": "https?://|www\\.", "dollar": "\\$"}


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(TOKEN), F.lit(0))


def text_ratios(posts: DataFrame, text: str) -> DataFrame:
    x = F.coalesce(F.col(text), F.lit(""))
    return posts.select("post_id", F.size(tokens(x)).alias("words"), *[ratio(x, p).alias(f"{n}_ratio") for n, p in PATTERNS.items()])


def comment_feedback(comments: DataFrame) -> DataFrame:
    """Label counts, ratios and score statistics of the comments on each post."""
    return comments.where(F.col("post_id").isNotNull()).groupBy("post_id").agg(
        F.count("*").alias("comments"), F.avg("score").alias("mean_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"),
        *[F.count_if(F.col("label") == x).alias(f"n_{x}") for x in LABELS], *[(F.count_if(F.col("label") == x) / F.count("*")).alias(f"ratio_{x}") for x in LABELS],
    )


def post_features(posts: DataFrame, comments: DataFrame, text: str = "analysis_text") -> DataFrame:
    """Text ratios with reply pressures and controversy; posts without comments count as 0."""
    f = comment_feedback(comments)
    j = text_ratios(posts, text).join(f, "post_id", "left").na.fill(0)
    busy = F.log1p(F.greatest(F.col("comments"), F.lit(1)))
    return j.withColumns({
        "oppositional_pressure": F.col("ratio_oppositional") * busy, "supportive_pressure": F.col("ratio_supportive") * busy,
        "controversy": F.col("ratio_oppositional") * 0.65 + F.col("ratio_mixed") * 0.25 + (100 - F.abs("mean_score")) / 100 * 0.10,
    })


def hashed_terms(docs: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """(key, bucket, weight): L2-normalised term counts in md5 buckets (dim divides 256)."""
    t = docs.select(key, F.explode(tokens(F.col(text))).alias("t"))
    b = t.select(key, (F.conv(F.right(F.md5(F.col("t").cast("binary")), F.lit(2)), 16, 10).cast("int") % dim).alias("bucket")).groupBy(key, "bucket").agg(F.count("*").alias("n"))
    norm = b.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return b.join(norm, key).select(key, "bucket", (F.col("n") / F.col("norm")).alias("weight"))


def top_terms(docs: DataFrame, group: str, text: str, n: int = 12) -> DataFrame:
    """(group, term, count, place): the most frequent terms of at least three letters."""
    t = docs.select(group, F.explode(tokens(F.col(text))).alias("term")).where((F.length("term") >= 3) & ~F.col("term").isin(*STOP))
    return top_per_group(t.groupBy(group, "term").agg(F.count("*").alias("count")), [group], [F.desc("count"), F.asc("term")], n, "place")


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def nearest(queries: DataFrame, index: DataFrame, key: str, vector: str, k: int, max_queries: int = 10_000) -> DataFrame:
    """(query, match, similarity, place): the k most similar index rows by cosine for each row of a
    stated query set. The queries, at most ``max_queries`` rows, are broadcast; the index is scanned
    once, and every partition keeps k rows per query before anything is shuffled."""
    if queries.limit(max_queries + 1).count() > max_queries:
        raise ValueError(f"more than {max_queries} queries: ask in blocks")
    q = queries.select(F.col(key).alias("query"), F.col(vector).alias("qv"), F.sqrt(dot(vector, vector)).alias("qn"))
    x = index.select(F.col(key).alias("match"), F.col(vector).alias("xv"), F.sqrt(dot(vector, vector)).alias("xn"))
    s = x.join(F.broadcast(q), F.col("match") != F.col("query")).select("query", "match", F.round(dot("qv", "xv") / (F.col("qn") * F.col("xn") + 1e-8), 9).alias("similarity"))
    return top_per_group(s, ["query"], [F.desc("similarity"), F.asc("match")], k, "place")


