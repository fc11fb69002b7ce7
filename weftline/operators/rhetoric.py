"""Text scoring as an exchangeable provider, rhetoric features per account, tag similarity.

The scorer that a language model would be is an interface: a function from a text column to a struct
of tags and a score. The lexicon provider below is a deterministic stand-in for it that runs
offline inside whole-stage code; results of a real provider can be read from a table instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import ratio_or_zero
from weftline.operators import similar
from weftline.operators.providers import tone
from weftline.operators.ranking import global_index, top_per_group
from weftline.plans.lineage import cut

# The rhetoric tags; the last one is neutral.
TAGS = ("urgency", "fear", "overconfidence", "authority_claim", "bandwagon", "us_vs_them", "call_to_action", "emotional_amplification", "analytical_neutral")
LOADED = TAGS[:-1]

# The stand-in's own word patterns, one per tag.
LEXICON = {
    "urgency": "\\b(now|today|hurry|before)\\b",
    "fear": "\\b(crash|risk|lose|lost|left|locked)\\b",
    "overconfidence": "\\b(always|never|surely|guaranteed|makes no sense)\\b",
    "authority_claim": "\\b(according to|experts|official|numbers)\\b",
    "bandwagon": "\\b(everyone|everybody|every second|most)\\b",
    "us_vs_them": "\\b(they|them|those)\\b",
    "call_to_action": "\\b(buy|sell|move|join|vote)\\b",
    "emotional_amplification": "!",
}

Provider = Callable[[Column], tuple[Column, Column]]


def lexicon(text: Column) -> tuple[Column, Column]:
    """(tags, score 0 to 100): tags whose pattern occurs, else neutral; the score is the share of loaded tags."""
    x = F.lower(F.coalesce(text, F.lit("")))
    hits = F.filter(F.array(*[F.when(F.regexp_like(x, F.lit(LEXICON[t])), F.lit(t)) for t in LOADED]), lambda v: v.isNotNull())
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(TAGS[-1]))), F.size(hits) * F.lit(100.0 / len(LOADED))


def parsed_tags(raw: Column) -> Column:
    """Tags from a JSON array as text: known ones once each, in order; anything else is ignored."""
    return F.array_distinct(F.filter(F.coalesce(F.from_json(F.regexp_replace(raw, "^\\s*```(?:json)?|```\\s*$", ""), "array<string>"), F.array().cast("array<string>")), lambda v: v.isin(*TAGS)))


def scored(posts: DataFrame, text: str, provider: Provider = lexicon) -> DataFrame:
    tags, score = provider(F.col(text))
    return posts.withColumns({"tags": tags, "rhetoric_score": score, "sentiment": tone(F.col(text)), "chars": F.length(F.coalesce(F.col(text), F.lit("")))})


def rhetoric_features(posts: DataFrame) -> DataFrame:
    """Per author of scored posts: posts, statistics of rhetoric score, sentiment, text length and (where
    there) comment numbers, count of each tag and its share of all tags. Deviations are of the population."""
    number = "num_comments" if "num_comments" in posts.columns else None
    more = [F.avg(F.coalesce(F.col(number), F.lit(0))).alias("mean_num_comments"), F.max(F.coalesce(F.col(number), F.lit(0))).alias("max_num_comments")] if number else []
    stats = [F.stddev_pop("rhetoric_score").alias("std_rhetoric"), F.max("rhetoric_score").alias("max_rhetoric"), F.avg("sentiment").alias("mean_sentiment"), F.stddev_pop("sentiment").alias("std_sentiment"), F.max("sentiment").alias("max_sentiment"), F.min("sentiment").alias("min_sentiment"), F.avg("chars").alias("mean_chars"), F.stddev_pop("chars").alias("std_chars"), *more]
    n = [F.count_if(F.array_contains("tags", t)).alias(f"n_{t}") for t in TAGS]
    f = posts.groupBy(F.col("author").alias("user_id")).agg(F.count("*").alias("posts"), F.avg("rhetoric_score").alias("mean_rhetoric"), *stats, *n)
    total = sum((F.col(f"n_{t}") for t in TAGS), F.lit(0))
    loaded = sum((F.col(f"n_{t}") for t in LOADED), F.lit(0))
    return f.withColumns({f"ratio_{t}": ratio_or_zero(F.col(f"n_{t}"), total) for t in TAGS}).withColumns({"loaded_tags": loaded, "loaded_per_post": F.least(F.lit(1.0), loaded / F.col("posts"))})


def tag_similarity(features: DataFrame, accounts: DataFrame | None = None, min_posts: int = 2, min_tags: int = 2, threshold: float = 0.75, top_k: int = 10, block: int = 5_000) -> DataFrame:
    """(a, b, similarity): accounts with similar tag profiles (cosine over the loaded tags' shares and
    the mean score), each account's ``top_k`` by similarity, then name; a pair keeps the larger value.

    Accounts with equal profiles differ only in name, so profiles, not accounts, are compared: one
    row per distinct profile with its first top_k + 1 names. Blocks of about ``block`` profiles meet
    in their own tasks, and only each profile's best leave a task (similar.top_similar).
    """
    v = [f"ratio_{t}" for t in LOADED]
    f = features.where((F.col("posts") >= min_posts) & (F.col("loaded_tags") >= min_tags))
    if accounts is not None:
        f = f.join(accounts.select("user_id").distinct(), "user_id", "left_semi")
    vec = F.array(*[F.round(c, 9) for c in v], F.round(F.col("mean_rhetoric") / 100, 9))
    p = cut(f.select("user_id", vec.alias("v")))
    names = top_per_group(p, ["v"], [F.asc("user_id")], top_k + 1)
    profiles = names.groupBy("v").agg(F.array_sort(F.collect_list("user_id")).alias("names")).where(F.exists("v", lambda x: x != 0))
    profiles = cut(global_index(profiles.withColumn("h", F.xxhash64("v")), ["h"], "pid").drop("h"))
    blocks = max(1, -(-profiles.count() // block))
    # enough profiles to hold top_k names beside the account itself, with all ties of the last
    out = similar.top_similar(profiles, profiles, "pid", "v", top_k + 1, threshold, 0.0, (blocks, blocks)).toDF("q", "pid", "similarity")
    out = out.withColumn("r", F.rank().over(Window.partitionBy("q").orderBy(F.desc("similarity")))).where(F.col("r") <= top_k + 1).drop("r")
    cand = out.join(profiles.select("pid", F.explode("names").alias("other")), "pid").select("q", "other", "similarity")
    cand = top_per_group(cand, ["q"], [F.desc("similarity"), F.asc("other")], top_k + 1)
    mine = p.join(profiles.select("v", F.col("pid").alias("q")), "v").select("user_id", "q")
    mine = mine.join(cand, "q").where(F.col("user_id") != F.col("other"))
    best = top_per_group(mine, ["user_id"], [F.desc("similarity"), F.asc("other")], top_k)
    return best.groupBy(F.least("user_id", "other").alias("a"), F.greatest("user_id", "other").alias("b")).agg(F.max("similarity").alias("similarity"))
