"""Queries on rhetoric (lexicon stand-in), tag similarity, post clusters, and streaming windows run as batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import chunks
from weftline.operators import behaviour, discovery, providers, rhetoric, text_features
from weftline.operators.cleaning import LABELS
from weftline.operators.providers import CONTRA, PRO
from weftline.plans.interactions import E, P, edges, interactions, posts
from weftline.plans.lineage import cut
from weftline.plans.rounding import rounded, sql_rounded
from weftline.sources.tables import table
from weftline.streaming import windows

NUMERIC = [
    "rhetoric_score", "high_manipulation", "chars", "words", "num_comments", *[f"{n}_ratio" for n in text_features.PATTERNS], "comments", "mean_score", "min_score", "max_score",
    *[f"ratio_{x}" for x in LABELS], "oppositional_pressure", "supportive_pressure", "controversy", *[f"tag_{t}" for t in rhetoric.TAGS],
]
TEXT = [f"term_{i}" for i in range(64)]


def rhetoric_posts(spark: SparkSession, d: str) -> DataFrame:
    return rhetoric.scored(posts(spark, d), "analysis_text")


def tag_similarity(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    nodes = e.select(F.col("source").alias("user_id")).unionByName(e.select(F.col("target").alias("user_id")))
    return rhetoric.tag_similarity(rhetoric.rhetoric_features(rhetoric_posts(spark, d)), nodes)


def cluster_features(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """(post_id, NUMERIC, TEXT): text ratios, comment feedback, rhetoric tags and score, hashed terms of each post."""
    r = rhetoric.scored(posts, "analysis_text")
    said = r.select(
        "post_id", "rhetoric_score", (F.col("rhetoric_score") >= 60).cast("double").alias("high_manipulation"), F.length(F.coalesce("analysis_text", F.lit(""))).cast("double").alias("chars"),
        F.col("num_comments").cast("double").alias("num_comments"), *[F.array_contains("tags", t).cast("double").alias(f"tag_{t}") for t in rhetoric.TAGS],
    )
    terms = text_features.hashed_terms(posts, "post_id", "analysis_text", len(TEXT)).groupBy("post_id").pivot("bucket", list(range(len(TEXT)))).agg(F.first("weight")).toDF("post_id", *TEXT)
    f = text_features.post_features(posts, comments).join(said, "post_id").join(terms, "post_id", "left")
    return f.select("post_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in (*NUMERIC, *TEXT)])


def post_clusters(spark: SparkSession, d: str) -> DataFrame:
    """K-means over post features and hashed terms with, per cluster, size, means and top terms."""
    p = cut(posts(spark, d))
    f = cut(cluster_features(p, interactions(spark, d)))
    labels = cut(behaviour.kmeans(f.withColumnRenamed("post_id", "user_id"), NUMERIC, plain=TEXT).withColumnRenamed("user_id", "post_id"))
    terms = text_features.top_terms(p.join(labels, "post_id"), "cluster", "analysis_text").groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda t: t["term"]), " ").alias("terms"))
    means = f.join(labels, "post_id").groupBy("cluster").agg(F.count("*").alias("posts"), *[F.round(F.avg(c), 4).alias(f"mean_{c}") for c in NUMERIC])
    titles = discovery.first_titles(p.join(labels, "post_id"), "cluster", "title", [F.asc("post_id")])
    total = labels.agg(F.count("*").alias("_all"))  # one row
    means = means.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col("posts") / F.col("_all"), 4)).drop("_all")
    return discovery.suspicion(means.join(terms, "cluster", "left").join(titles, "cluster", "left"))


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))


def retrieved_context(spark: SparkSession, d: str) -> DataFrame:
    """The three pieces of all documents most like each query document (those whose id 50 divides)."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    pieces = docs.select(F.col("doc_id").alias("of"), F.posexplode(chunks(F.col("text"))).alias("no", "chunk")).select(F.concat_ws("-", "of", "no").alias("chunk_id"), "chunk")
    return rounded(providers.context(docs.where(F.col("doc_id") % 50 == 0), pieces, "doc_id", "text", "chunk_id", "chunk"))


QUERIES = {
    "rhetoric_posts": lambda s, d: rhetoric_posts(s, d).select("post_id", F.array_join("tags", ",").alias("tags"), "rhetoric_score", "sentiment"),
    "parsed_tags": lambda s, d: rhetoric_posts(s, d).select("post_id", F.array_join(rhetoric.parsed_tags(F.concat(F.lit("```json\n"), F.to_json(F.concat("tags", F.array(F.lit("unknown")), "tags")), F.lit("\n```"))), ",").alias("tags")),
    "scored_comments": lambda s, d: table(s, d, "analyzed_comments").where(F.col("comment_id").isNotNull()).select("comment_id", providers.stance(F.col("analysis_text")).alias("label"), providers.tone(F.col("analysis_text")).alias("score")).distinct(),
    "retrieved_context": retrieved_context,
    "rhetoric_features": lambda s, d: rounded(rhetoric.rhetoric_features(rhetoric_posts(s, d))),
    "tag_similarity": lambda s, d: rounded(tag_similarity(s, d)),
    "post_clusters": post_clusters,
    "hourly_events": lambda s, d: windows.hourly_activity(events(s, d), "user_id", "ts").select("user_id", F.unix_seconds("hour").alias("hour"), "events"),
    "event_sessions": lambda s, d: windows.sessions(events(s, d), "user_id", "ts").select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "events"),
}

_HIT = {t: f"regexp_matches(lower(coalesce(analysis_text, '')), '{p}')" for t, p in rhetoric.LEXICON.items()}
_R = f"""r0 as (select *, len(regexp_extract_all(lower(coalesce(analysis_text, '')), '{PRO}')) as pro, len(regexp_extract_all(lower(coalesce(analysis_text, '')), '{CONTRA}')) as contra, list_filter([{", ".join(f"case when {h} then '{t}' end" for t, h in _HIT.items())}], lambda v: v is not null) as hits from p),
r as (select post_id, author, num_comments, length(coalesce(analysis_text, '')) as chars, round_even(100.0 * (pro - contra) / greatest(pro + contra, 1), 0)::int as sentiment, case when len(hits) > 0 then hits else ['{rhetoric.TAGS[-1]}'] end as tags, len(hits) * {100 / len(rhetoric.LOADED)} as rhetoric_score from r0),
rf0 as (select author as user_id, count(*) as posts, avg(rhetoric_score) as mean_rhetoric, stddev_pop(rhetoric_score) as std_rhetoric, max(rhetoric_score) as max_rhetoric, avg(sentiment) as mean_sentiment, stddev_pop(sentiment) as std_sentiment, max(sentiment) as max_sentiment, min(sentiment) as min_sentiment, avg(chars) as mean_chars, stddev_pop(chars) as std_chars, avg(coalesce(num_comments, 0)) as mean_num_comments, max(coalesce(num_comments, 0)) as max_num_comments, {", ".join(f"count(*) filter (list_contains(tags, '{t}')) as n_{t}" for t in rhetoric.TAGS)} from r group by 1),
rf as (select *, {", ".join(f"n_{t} / ({' + '.join(f'n_{x}' for x in rhetoric.TAGS)}) as ratio_{t}" for t in rhetoric.TAGS)}, {" + ".join(f"n_{t}" for t in rhetoric.LOADED)} as loaded_tags, least(1, ({" + ".join(f"n_{t}" for t in rhetoric.LOADED)}) / posts) as loaded_per_post from rf0)"""
_V = "[" + ", ".join(f"round(ratio_{t}, 9)" for t in rhetoric.LOADED) + ", round(mean_rhetoric / 100, 9)]"

TAG = f"""tx as (select user_id, {_V} as v from rf where posts >= 2 and loaded_tags >= 2 and user_id in (select source from e union select target from e)),
ts as (select a.user_id as me, b.user_id as other, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 9) as similarity from tx a join tx b on a.user_id <> b.user_id),
tt as (select * from ts where similarity >= 0.75 qualify row_number() over (partition by me order by similarity desc, other) <= 10),
tg as (select least(me, other) as a, greatest(me, other) as b, max(similarity) as similarity from tt group by 1, 2)"""


_TOKEN = "[a-z][a-z0-9'']+"
_CONTEXT = sql_rounded(
    f"""with q0 as (select doc_id, unnest(regexp_extract_all(lower(text), '{_TOKEN}')) as t from documents where doc_id % 50 = 0), q1 as (select doc_id, ('0x' || right(md5(t), 2))::int % 64 as b, count(*) as n from q0 group by 1, 2), q as (select doc_id, b, n / sqrt(sum(n * n) over (partition by doc_id)) as w from q1),
    k as (select doc_id || '-' || (i // 400) as chunk_id, substring(text, i + 1, 500) as x from (select doc_id, text, unnest(range(0, length(text), 400)) as i from documents where length(text) > 0)),
    c0 as (select chunk_id, unnest(regexp_extract_all(lower(x), '{_TOKEN}')) as t from k), c1 as (select chunk_id, ('0x' || right(md5(t), 2))::int % 64 as b, count(*) as n from c0 group by 1, 2), c as (select chunk_id, b, n / sqrt(sum(n * n) over (partition by chunk_id)) as w from c1),
    qs as (select distinct doc_id from q), cs as (select distinct chunk_id from c), d as (select doc_id, chunk_id, sum(q.w * c.w) as s from q join c using (b) group by 1, 2),
    s as (select doc_id, chunk_id, round(coalesce(s, 0) / (1 + 1e-8), 9) as similarity from qs cross join cs left join d using (doc_id, chunk_id))
    \nSELECT doc_id, chunk_id, similarity, row_number() over (partition by doc_id order by similarity desc, chunk_id)::int as place from s qualify row_number() over (partition by doc_id order by similarity desc, chunk_id) <= 3""",
    "similarity",
)


def oracle_sql() -> dict[str, str]:
    return {
        "rhetoric_posts": f"with {P}, {_R} select post_id, array_to_string(tags, ',') as tags, rhetoric_score, sentiment from r",
        "parsed_tags": f"with {P}, {_R} select post_id, array_to_string(tags, ',') as tags from r",
        "scored_comments": f"with x as (select distinct comment_id, lower(coalesce(analysis_text, '')) as x from analyzed_comments where comment_id is not null), y as (select *, len(regexp_extract_all(x, '{PRO}')) as pro, len(regexp_extract_all(x, '{CONTRA}')) as contra from x) select distinct comment_id, case when trim(x) = '' then 'unclear' when pro > contra then 'supportive' when contra > pro then 'oppositional' when pro > 0 then 'mixed' else 'neutral' end as label, round_even(100.0 * (pro - contra) / greatest(pro + contra, 1), 0)::int as score from y",
        "retrieved_context": _CONTEXT,
        "rhetoric_features": sql_rounded(f"with {P}, {_R}\nSELECT * from rf", "mean_rhetoric loaded_per_post std_rhetoric max_rhetoric mean_sentiment std_sentiment mean_chars std_chars mean_num_comments " + " ".join(f"ratio_{t}" for t in rhetoric.TAGS)),
        "tag_similarity": sql_rounded(f"with {E}, {P}, {_R}, {TAG}\nSELECT * from tg", "similarity"),
        "hourly_events": "select user_id, (epoch_us(ts) // 3600000000) * 3600 as hour, count(*) as events from events where user_id is not null group by 1, 2",
        "event_sessions": """with g as (select user_id, epoch_us(ts) as t, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) < 1800000000 then 0 else 1 end as new from events where user_id is not null and ts is not null),
            h as (select *, sum(new) over (partition by user_id order by t rows unbounded preceding) as s from g) select user_id, min(t) as start, max(t) + 1800000000 as end, count(*) as events from h group by user_id, s""",
    }
