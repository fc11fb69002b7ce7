"""Cleaning posts and comments: one row per id, valid accounts, repaired scores and labels."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.accounts import finite, valid_name
from weftline.functions.text import clean, compose, normalize
from weftline.operators.ranking import top_per_group

# The stance labels.
LABELS = ("supportive", "oppositional", "neutral", "mixed", "unclear")


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order``, which should be unique within a key."""
    return top_per_group(df, keys, order, 1)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last in the order of the columns (nulls first)."""
    return top_per_group(df, keys, [F.desc_nulls_last(c) for c in order], 1)


def stance(label: Column) -> Column:
    """The label in lower case and trimmed; anything unknown is 'unclear'."""
    x = F.lower(F.trim(label, F.lit(" \t\r\n")))
    return F.when(x.isin(*LABELS), x).otherwise(F.lit("unclear"))


def usable_time(t: Column) -> Column:
    return F.when((t >= 1e9) & (t < 2e9), t)


def distinct_comments(comments: DataFrame) -> DataFrame:
    """One row per comment_id with the fields the pipeline uses. Of rows that differ one whole row stays:
    the first by completeness (source, target, time), then time and the other fields."""
    c = comments.where(F.col("comment_id").isNotNull()).select(
        "comment_id", valid_name("source_author").alias("source"), valid_name("target_author").alias("target"), "post_id", usable_time(F.col("created_utc")).alias("ts"), stance(F.col("feedback_label")).alias("label"),
        F.col("feedback_score").cast("double").alias("score"), finite("edge_weight").alias("weight"), F.col("analysis_char_len").alias("chars"),
    )
    fields = ["ts", "label", "score", "weight", "source", "target", "post_id", "chars"]
    return whole_row(c, "comment_id", [F.col(x).isNull() for x in ("source", "target", "ts")], fields).select("comment_id", "source", "target", "post_id", "ts", "label", "score", "weight", "chars")


def whole_row(df: DataFrame, key: str, first: list[Column], fields: list[str]) -> DataFrame:
    """One whole row per key: the smallest by ``first``, then by ``fields`` (nulls first). One
    aggregation with map-side combining, no sort of a key's rows."""
    order = [c.alias(f"o{i}") for i, c in enumerate(first)]
    g = df.groupBy(key).agg(F.min(F.struct(*order, *fields)).alias("r"))
    return g.select(key, *[F.col(f"r.{c}").alias(c) for c in fields])


def back_fill(comments: DataFrame) -> DataFrame:
    """Score and weight repaired from each other: score = weight * 100, weight = score / 100, else 0."""
    return comments.withColumns({"score": F.coalesce("score", F.col("weight") * 100, F.lit(0.0)), "weight": F.coalesce("weight", F.col("score") / 100, F.lit(0.0))})


def interactions(comments: DataFrame, self_loops: bool = False) -> DataFrame:
    """Comments between two valid accounts, repaired."""
    ok = comments.where(F.col("source").isNotNull() & F.col("target").isNotNull())
    return back_fill(ok if self_loops else ok.where(F.col("source") != F.col("target")))


def cleaning_counts(comments: DataFrame) -> DataFrame:
    """What cleaning keeps and drops, in one pass: (metric, value)."""
    s, t = F.col("source").isNotNull(), F.col("target").isNotNull()
    count = lambda c: F.count_if(c)
    one = comments.agg(
        F.count("*").alias("comments"), count(~s).alias("no_source"), count(s & ~t).alias("no_target"), count(s & t & (F.col("source") == F.col("target"))).alias("self_loops"),
        count(s & t & (F.col("source") != F.col("target"))).alias("kept"), count(F.col("score").isNull()).alias("no_score"), count(F.col("weight").isNull()).alias("no_weight"), count(F.col("ts").isNull()).alias("no_time"),
        F.countDistinct(F.when(s, F.col("source"))).alias("sources"), F.countDistinct(F.when(t, F.col("target"))).alias("targets"),
    )
    names = one.columns
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])))


def clean_posts(posts: DataFrame) -> DataFrame:
    """One row per post_id of a valid author with a usable time. Of several such rows one whole row stays:
    the earliest, then that with the most comments, then by the other fields."""
    p = posts.where(F.col("post_id").isNotNull()).select("post_id", valid_name("author").alias("author"), usable_time(F.col("created_utc")).alias("ts"), "num_comments", "title", "selftext", "analysis_text")
    p = p.where(F.col("author").isNotNull() & F.col("ts").isNotNull())
    first = [F.col("ts"), F.col("num_comments").isNull(), -F.col("num_comments")]
    return whole_row(p, "post_id", first, ["title", "selftext", "analysis_text", "author", "ts", "num_comments"]).select("post_id", "author", "ts", "num_comments", "title", "selftext", "analysis_text")


def analysis_texts(posts: DataFrame, min_chars: int = 20) -> DataFrame:
    """(post_id, analysis_text) composed from cleaned title and body, if long enough; of equal
    texts the one with the smallest post_id stays."""
    t = posts.select("post_id", "ts", normalize(compose(clean(F.col("title")), clean(F.col("selftext")))).alias("analysis_text"))
    t = t.where(F.length("analysis_text") >= min_chars)
    return keep_first(t, ["analysis_text"], [F.col("ts"), F.col("post_id")]).select("post_id", "analysis_text")


def parent_fields(comments: DataFrame) -> DataFrame:
    """Type and id of what a comment answers, from its prefixed parent id."""
    p = F.col("parent_id")
    return comments.withColumns({
        "parent_kind": F.when(p.startswith("t3_"), F.lit("post")).when(p.startswith("t1_"), F.lit("comment")).otherwise(F.lit("unknown")),
        "parent_post": F.when(p.startswith("t3_"), F.substring(p, F.lit(4), F.length(p))),
        "parent_comment": F.when(p.startswith("t1_"), F.substring(p, F.lit(4), F.length(p))),
    })


def functional_bots(posts: DataFrame, min_posts: int = 5, latest: int = 10, threshold: float = 0.7) -> DataFrame:
    """Accounts whose latest posts are nearly alike by mean sequence similarity: (author, posts,
    compared, mean, min, max). At most ``latest`` posts of an account reach Python."""
    text = F.lower(F.regexp_replace(normalize(compose(clean(F.col("title")), clean(F.col("selftext")))), "\\s+", " "))
    p = posts.select("author", "post_id", "ts", text.alias("text"))
    total = p.groupBy("author").agg(F.count("*").alias("posts")).where(F.col("posts") >= min_posts)
    last = top_per_group(p, ["author"], [F.desc("ts"), F.asc("post_id")], latest, "place").join(total, "author")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = pdf.sort_values("place")["text"].tolist()
        got = [SequenceMatcher(None, a, b).ratio() for i, a in enumerate(texts) for b in texts[i + 1 :]]
        return pd.DataFrame({"author": [pdf["author"].iloc[0]], "posts": [int(pdf["posts"].iloc[0])], "compared": [len(texts)], "mean_similarity": [sum(got) / len(got)], "min_similarity": [min(got)], "max_similarity": [max(got)]})

    found = last.groupBy("author").applyInPandas(compare, "author string, posts long, compared long, mean_similarity double, min_similarity double, max_similarity double")
    return found.where(F.col("mean_similarity") >= threshold)


def without_accounts(posts: DataFrame, flagged: DataFrame) -> DataFrame:
    """Posts of all other accounts."""
    return posts.join(flagged.select("author"), "author", "left_anti")
