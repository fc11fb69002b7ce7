"""Queries on cleaning, the interaction graph and its projections."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.accounts import sql_finite, sql_name, sql_valid
from weftline.functions.text import chunks, clean, normalize, safe_filename, sql_mean
from weftline.operators import cleaning, graph
from weftline.operators.cleaning import LABELS
from weftline.operators.graph import Projection
from weftline.plans.rounding import rounded, sql_rounded
from weftline.sources.tables import table

CO_TARGET, CO_NEGATIVE = Projection(0.15), Projection(0.20)
WHOLE_TARGET, WHOLE_NEGATIVE = (replace(x, max_sources=0) for x in (CO_TARGET, CO_NEGATIVE))  # all sources of every target
GROUP_THRESHOLD, MIN_GROUP, MAX_GROUP = 0.30, 3, 50


def comments(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.distinct_comments(table(spark, d, "analyzed_comments"))


def interactions(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.interactions(comments(spark, d))


def posts(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.clean_posts(table(spark, d, "posts"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edge_stats(interactions(spark, d))


def trigger(spark: SparkSession, d: str) -> DataFrame:
    return graph.trigger_response(interactions(spark, d), posts(spark, d))


def co_target(spark: SparkSession, d: str) -> DataFrame:
    return graph.co_targets(edges(spark, d), "w_log", CO_TARGET)


def co_negative(spark: SparkSession, d: str) -> DataFrame:
    return graph.co_targets(edges(spark, d), "w_opposed", CO_NEGATIVE)


def _groups(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    from weftline.plans.lineage import cut

    pairs = cut(co_negative(spark, d).where(F.col("similarity") >= GROUP_THRESHOLD))
    members, large = graph.group_members(pairs, MIN_GROUP, MAX_GROUP)
    return pairs, members, large


def group_summary(spark: SparkSession, d: str) -> DataFrame:
    pairs, members, _ = _groups(spark, d)
    return graph.group_summary(pairs, members, "similarity")


def group_shared_targets(spark: SparkSession, d: str) -> DataFrame:
    _, members, _ = _groups(spark, d)
    return graph.shared_targets(members, edges(spark, d), "w_opposed")


def post_rows(spark: SparkSession, d: str) -> DataFrame:
    """Normalised title and body of each post."""
    p = posts(spark, d)
    return p.select("post_id", clean(F.col("title")).alias("title"), clean(F.col("selftext")).alias("body"))


def comment_parents(spark: SparkSession, d: str) -> DataFrame:
    c = cleaning.parent_fields(table(spark, d, "analyzed_comments"))
    return c.groupBy("parent_kind", F.coalesce("parent_type", F.lit("")).alias("parent_type")).agg(F.count("*").alias("rows"), F.count("parent_post").alias("with_post"), F.count("parent_comment").alias("with_comment"))


def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    """Per post_id the row with the fewest comments (nulls first)."""
    p = table(spark, d, "posts").where(F.col("post_id").isNotNull()).select("post_id", "num_comments", "analysis_char_len")
    return cleaning.keep_first(p, ["post_id"], [F.asc_nulls_first("num_comments"), F.asc_nulls_first("analysis_char_len")])


def dedup_last(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "posts").where(F.col("post_id").isNotNull()).select("post_id", "num_comments", "analysis_char_len")
    return cleaning.keep_last(p, ["post_id"], ["num_comments", "analysis_char_len"])


def text_chunks(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "documents").select("doc_id", F.posexplode(chunks(F.col("text"))).alias("chunk_no", "chunk"))
    return p.select("doc_id", "chunk_no", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"), F.length("chunk").alias("chars"))


def functional_bots(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cleaning.functional_bots(posts(spark, d)))


QUERIES = {
    "comment_cleaning_counts": lambda s, d: cleaning.cleaning_counts(comments(s, d)),
    "interaction_comments": lambda s, d: rounded(interactions(s, d)),
    "clean_posts": lambda s, d: posts(s, d).select("post_id", "author", "ts", "num_comments"),
    "clean_texts": post_rows,
    "normalized_bodies": lambda s, d: table(s, d, "posts").select("post_id", normalize(F.col("selftext")).alias("body"), safe_filename(F.coalesce("author", F.lit(""))).alias("file")).distinct(),
    "analysis_texts": lambda s, d: cleaning.analysis_texts(posts(s, d)),
    "comment_parents": comment_parents,
    "dedup_keep_first": dedup_first,
    "dedup_keep_last": dedup_last,
    "text_chunks": text_chunks,
    "functional_bots": functional_bots,
    "posts_without_bots": lambda s, d: cleaning.without_accounts(posts(s, d), functional_bots(s, d)).select("post_id", "author"),
    "interaction_edges": lambda s, d: rounded(edges(s, d)),
    "degree_adjusted": lambda s, d: rounded(graph.degree_adjusted(edges(s, d))),
    "edge_layers": lambda s, d: rounded(graph.layers(edges(s, d))),
    "trigger_response": lambda s, d: rounded(trigger(s, d)),
    "co_target": lambda s, d: rounded(co_target(s, d)),
    "co_negative_target": lambda s, d: rounded(co_negative(s, d)),
    "node_index": lambda s, d: graph.node_index(edges(s, d)),
    "coo_signed": lambda s, d: rounded(graph.coo(edges(s, d), graph.node_index(edges(s, d)), "w_signed")),
    "node_reach": lambda s, d: graph.reach(edges(s, d)),
    "co_target_strength": lambda s, d: rounded(graph.strength(co_target(s, d), "similarity")),
    "group_members": lambda s, d: _groups(s, d)[1].select("account", "group_id", "size"),
    "large_components": lambda s, d: _groups(s, d)[2],
    "group_summary": lambda s, d: rounded(group_summary(s, d)),
    "group_shared_targets": lambda s, d: rounded(group_shared_targets(s, d)),
}

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_STANCE = "case when lower(trim(feedback_label, ' ' || chr(9) || chr(10) || chr(13))) in (" + ", ".join(f"'{x}'" for x in LABELS) + ") then lower(trim(feedback_label, ' ' || chr(9) || chr(10) || chr(13))) else 'unclear' end"
C0 = f"""cr as (select comment_id, case when {sql_valid("source_author")} then {sql_name("source_author")} end as source, case when {sql_valid("target_author")} then {sql_name("target_author")} end as target,
    post_id, case when created_utc >= 1e9 and created_utc < 2e9 then created_utc end as ts, {_STANCE} as label, feedback_score::double as score0, {sql_finite("edge_weight")} as weight0, analysis_char_len as chars
    from analyzed_comments where comment_id is not null),
c0 as (select * from cr qualify row_number() over (partition by comment_id order by source is null, target is null, ts is null, ts, label, score0 nulls first, weight0 nulls first, source, target, post_id nulls first, chars nulls first) = 1)"""
C = C0 + """,
c as (select comment_id, source, target, post_id, ts, label, coalesce(score0, weight0 * 100, 0) as score, coalesce(weight0, score0 / 100, 0) as weight, chars from c0 where source <> target)"""
P = f"""p as (select post_id, {sql_name("author")} as author, created_utc as ts, num_comments, title, selftext, analysis_text from posts where post_id is not null and {sql_valid("author")} and created_utc >= 1e9 and created_utc < 2e9
    qualify row_number() over (partition by post_id order by created_utc, num_comments desc nulls last, title nulls first, selftext nulls first, analysis_text nulls first, {sql_name("author")}) = 1)"""
_N = ", ".join(f"count(*) filter (label = '{x}') as n_{x}" for x in LABELS)
_R = ", ".join(f"n_{x} / n as ratio_{x}" for x in LABELS)
E = (
    C
    + f""",
e0 as (select source, target, count(*) as n, {sql_mean("score", 6)} as mean_score, coalesce(stddev_samp(score), 0) as std_score, min(score) as min_score, max(score) as max_score, {sql_mean("weight", 9)} as mean_weight, {_N} from c group by 1, 2),
e as (select *, {_R}, n::double as w_count, ln(1 + n) as w_log, mean_weight * ln(1 + n) as w_signed, greatest(mean_weight * ln(1 + n), 0) as w_positive, greatest(-mean_weight * ln(1 + n), 0) as w_negative, ln(1 + n_oppositional) as w_opposed from e0)"""
)


def sql_projection(name: str, weight: str, cfg: Projection) -> str:
    kept = f" qualify row_number() over (partition by target order by {weight} desc, source) <= {cfg.max_sources}" if cfg.max_sources > 0 else ""
    return f"""{name}_f as (select source, target, {weight} as w from e where {weight} > 0{kept}),
{name}_n as (select source, sqrt(sum(w * w)) as norm from {name}_f group by 1),
{name}_x as (select a.source as a, b.source as b, count(*) as shared, sum(a.w * b.w) as dot from {name}_f a join {name}_f b on a.target = b.target and a.source < b.source group by 1, 2 having count(*) >= {cfg.min_shared}),
{name}_s as (select a, b, shared, round(least(1, dot / (na.norm * nb.norm)), 9) as similarity from {name}_x join {name}_n na on na.source = a join {name}_n nb on nb.source = b),
{name}_t as (select * from {name}_s where similarity >= {cfg.threshold}),
{name}_r as (select *, row_number() over (partition by me order by similarity desc, other) as r from (select a as me, b as other, similarity from {name}_t union all select b, a, similarity from {name}_t)),
{name} as (select * from {name}_t where (a, b) in (select (least(me, other), greatest(me, other)) from {name}_r where r <= {cfg.top_k}))"""


CO_T, CO_N = sql_projection("cot", "w_log", CO_TARGET), sql_projection("con", "w_opposed", CO_NEGATIVE)
WHOLE_T, WHOLE_N = sql_projection("cot", "w_log", WHOLE_TARGET), sql_projection("con", "w_opposed", WHOLE_NEGATIVE)
TR = """t1 as (select target, source, post_id, min(ts) as first, count(*) as n from c where post_id <> '' and ts is not null group by 1, 2, 3),
t2 as (select t1.*, case when first >= p.ts then (first - p.ts) / 60 end as delay from t1 left join p using (post_id)),
t3 as (select target as a, source as b, count(*) as posts_hit, sum(n)::bigint as comments, quantile_cont(delay, 0.5) as median_delay, quantile_cont(delay, 0.9) as p90_delay from t2 group by 1, 2),
tr as (select a, b, tot.posts as a_posts, posts_hit, comments, posts_hit / tot.posts as coverage, comments / posts_hit as comments_per_post, median_delay, p90_delay, posts_hit / tot.posts * ln(1 + posts_hit) * ln(1 + comments) as w_trigger
    from t3 join (select author, count(*) as posts from p group by 1) tot on tot.author = a)"""
_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(coalesce({x}, ''), '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), " + _WS + ")"
_CLEAN = "case when lower(" + _NORM + ") in ('[removed]', '[deleted]', 'nan', 'none') then '' else " + _NORM + " end"
TEXTS = "x as (select post_id, ts, " + _CLEAN.format(x="title") + " as title, " + _CLEAN.format(x="selftext") + " as body from p)"
ANALYSIS = (
    TEXTS
    + """,
y as (select post_id, ts, case when title <> '' and body <> '' then (case when lower(title) = lower(body) then body else title || chr(10) || chr(10) || body end) when body <> '' then body else title end as t0 from x),
z as (select post_id, ts, """
    + _NORM.format(x="t0")
    + """ as analysis_text from y),
an as (select post_id, analysis_text from z where length(analysis_text) >= 20 qualify row_number() over (partition by analysis_text order by ts, post_id) = 1)"""
)
GROUPS = f"""l as (select a, b, similarity from con where similarity >= {GROUP_THRESHOLD}),
le as (select a, b from l union all select b, a from l),
lr(v, u) as (select a, a from le union select lr.v, le.b from lr join le on le.a = lr.u),
lg as (select v as account, min(u) as group_id from lr group by 1),
ls as (select group_id, count(*) as size from lg group by 1),
gm as (select account, group_id, size from lg join ls using (group_id) where size between {MIN_GROUP} and {MAX_GROUP})"""
_ED = "mean_score std_score min_score max_score mean_weight w_count w_log w_signed w_positive w_negative w_opposed " + " ".join(f"ratio_{x}" for x in LABELS)
NODES = "nd as (select account, row_number() over (order by account) - 1 as node_id from (select source as account from e union select target from e))"


def oracle_sql() -> dict[str, str]:
    dedup = "select post_id, num_comments, analysis_char_len from posts where post_id is not null qualify row_number() over (partition by post_id order by num_comments {o}, analysis_char_len {o}) = 1"
    prefixed = "case when starts_with(parent_id, 't3_') then 'post' when starts_with(parent_id, 't1_') then 'comment' else 'unknown' end"
    return {
        "comment_cleaning_counts": f"""with {C0}, one as (select count(*) as comments, count(*) filter (source is null) as no_source, count(*) filter (source is not null and target is null) as no_target, count(*) filter (source = target) as self_loops,
            count(*) filter (source <> target) as kept, count(*) filter (score0 is null) as no_score, count(*) filter (weight0 is null) as no_weight, count(*) filter (ts is null) as no_time, count(distinct source) as sources, count(distinct target) as targets from c0)
            unpivot one on columns(*) into name metric value value""",
        "interaction_comments": sql_rounded(f"with {C}\nSELECT * from c", "ts score weight"),
        "clean_posts": f"with {P} select post_id, author, ts, num_comments from p",
        "clean_texts": f"with {P}, {TEXTS} select post_id, title, body from x",
        "analysis_texts": f"with {P}, {ANALYSIS} select * from an",
        "normalized_bodies": "select distinct post_id, " + _NORM.format(x="selftext") + " as body, case when f = '' then 'seed' else f end as file from (select *, trim(regexp_replace(coalesce(author, ''), '[^A-Za-z0-9_.-]+', '_', 'g'), '_') as f from posts)",
        "comment_parents": f"select {prefixed} as parent_kind, coalesce(parent_type, '') as parent_type, count(*) as rows, count(*) filter ({prefixed} = 'post') as with_post, count(*) filter ({prefixed} = 'comment') as with_comment from analyzed_comments group by 1, 2",
        "dedup_keep_first": dedup.format(o="asc nulls first"),
        "dedup_keep_last": dedup.format(o="desc nulls last"),
        "text_chunks": "select doc_id, (i // 400)::int as chunk_no, md5(substring(text, i + 1, 500)) as chunk_md5, length(substring(text, i + 1, 500))::int as chars from (select doc_id, text, unnest(range(0, length(text), 400)) as i from documents where length(text) > 0)",
        "interaction_edges": sql_rounded(f"with {E}\nSELECT * from e", _ED),
        "degree_adjusted": sql_rounded(
            f"""with {E}, o as (select source, sum(n) as o from e group by 1), i as (select target, sum(n) as i from e group by 1), h as (select (select quantile_cont(o, 0.99) from o) as po, (select quantile_cont(i, 0.99) from i) as pi)
            \nSELECT source, target, n / (1 + exp(greatest(-50, least(50, o / po + i / pi - 2)))) as w_adjusted from e join o using (source) join i using (target), h""",
            "w_adjusted",
        ),
        "edge_layers": sql_rounded(
            f"with {E}, u as (select 'count' as layer, source, target, w_count as weight from e union all select 'signed', source, target, w_signed from e union all select 'positive', source, target, w_positive from e union all select 'negative', source, target, w_negative from e union all select 'opposed', source, target, w_opposed from e)\nSELECT * from u where round(weight, 9) <> 0",
            "weight",
        ),
        "trigger_response": sql_rounded(f"with {C}, {P}, {TR}\nSELECT * from tr", "coverage comments_per_post median_delay p90_delay w_trigger"),
        "co_target": sql_rounded(f"with {E}, {CO_T}\nSELECT * from cot", "similarity"),
        "co_negative_target": sql_rounded(f"with {E}, {CO_N}\nSELECT * from con", "similarity"),
        "node_index": f"with {E}, {NODES} select * from nd",
        "coo_signed": sql_rounded(f"with {E}, {NODES}\nSELECT x.node_id as row, y.node_id as col, w_signed as data from e join nd x on x.account = source join nd y on y.account = target where round(w_signed, 9) <> 0", "data"),
        "node_reach": f"with {E} select account, sum(o)::bigint as out_n, sum(i)::bigint as in_n, sum(t)::bigint as targets, sum(s)::bigint as sources from (select source as account, n as o, 0 as i, 1 as t, 0 as s from e union all select target, 0, n, 0, 1 from e) group by 1",
        "co_target_strength": sql_rounded(f"with {E}, {CO_T}\nSELECT account, sum(w) as strength from (select a as account, similarity as w from cot union all select b, similarity from cot) group by 1", "strength"),
        "group_members": f"with recursive {E}, {CO_N}, {GROUPS} select * from gm",
        "large_components": f"with recursive {E}, {CO_N}, {GROUPS} select group_id, size from ls where size > {MAX_GROUP}",
        "group_summary": sql_rounded(f"with recursive {E}, {CO_N}, {GROUPS}\nSELECT group_id, size, count(*) as edges, sum(similarity) as weight_sum, max(similarity) as weight_max, 2 * count(*) / (size * (size - 1)) as density from l join gm on gm.account = l.a group by 1, 2", "weight_sum weight_max density"),
        "group_shared_targets": sql_rounded(
            f"with recursive {E}, {CO_N}, {GROUPS}, st as (select group_id, target, count(distinct account) as members, round(sum(w_opposed), 9) as weight_sum from e join gm on gm.account = e.source group by 1, 2 having count(distinct account) >= 2)\nSELECT *, (row_number() over (partition by group_id order by members desc, weight_sum desc, target))::int as place from st qualify row_number() over (partition by group_id order by members desc, weight_sum desc, target) <= 10",
            "weight_sum",
        ),
    }
