"""Queries on groups in full: discovery, synchrony, ranking, tiers of pair ends, baselines, audit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import clamp_int
from weftline.functions.accounts import finite, name, sql_finite, sql_name, sql_valid, valid_name
from weftline.operators import behaviour, discovery, expansion, graph, rhetoric, rollup, scoring, temporal
from weftline.operators.ranking import descending_rank
from weftline.plans import accounts, pipeline
from weftline.plans.accounts import _EV, _S, SYNC_LABELS
from weftline.plans.extras import _R, rhetoric_posts
from weftline.plans.interactions import C, CO_N, CO_T, E, GROUP_THRESHOLD, GROUPS, NODES, P, TR, _groups, co_negative, edges, interactions
from weftline.plans.lineage import cut
from weftline.plans.rounding import rounded, sql_rounded
from weftline.plans.summaries import _LABEL, _M, members
from weftline.sources.tables import one_layout, resume, row_range, table

KEYS = ("robust_pairs", "moderate_review_pairs", "n_strong_temporal_sync", "n_moderate_temporal_sync", "extreme_outliers", "high_scores", "inner_edges")
# The signals of a pair and whether its check uses them.
REGISTRY = (("text_fingerprint_distance", "removed_from_formal_stage2"), ("account_lifecycle_overlap", "removed_from_formal_stage2"), ("temporal_synchrony", "kept_as_formal_stage2"))


def outliers(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "account_features").where(F.length(name("user_id")) > 0)
    return f.groupBy(name("user_id").alias("user_id")).agg(F.min("anomaly_label").alias("anomaly_label"), F.min(finite("anomaly_score")).alias("anomaly_score"), F.max(F.coalesce("is_extreme_outlier", F.lit(False))).alias("extreme"))


def account_frame(spark: SparkSession, d: str) -> DataFrame:
    """What groups are described by, for each account: rhetoric, stance, anomaly, volumes."""
    r = rhetoric.rhetoric_features(rhetoric_posts(spark, d)).select("user_id", F.col("mean_rhetoric").alias("rhetoric"), F.col("loaded_per_post").alias("nonneutral"), "posts")
    s = behaviour.stance_features(interactions(spark, d)).select("user_id", F.col("ratio_oppositional").alias("opposed"), "comments")
    return r.join(s, "user_id", "full").join(outliers(spark, d), "user_id", "full")


def group_discovery(spark: SparkSession, d: str) -> DataFrame:
    pairs, m, _ = _groups(spark, d)
    m = cut(m)
    shared = graph.shared_targets(m, edges(spark, d), "w_opposed")
    return discovery.group_overview(pairs, m, shared, account_frame(spark, d), "similarity", "co_negative_target", GROUP_THRESHOLD)


def seed_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(seed, a, b): distinct pairs of each seed's group."""
    e = table(spark, d, "pair_evidence").select(valid_name("group_seed").alias("seed"), valid_name("account_a").alias("x"), valid_name("account_b").alias("y"))
    e = e.where(F.col("seed").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull() & (F.col("x") != F.col("y")))
    return e.select("seed", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def seed_timing(spark: SparkSession, d: str) -> DataFrame:
    p = cut(seed_pairs(spark, d))
    return p.join(temporal.labelled(temporal.pair_timing(p.select("a", "b"), interactions(spark, d), temporal.Windows())), ["a", "b"])


def group_sync(spark: SparkSession, d: str) -> DataFrame:
    return discovery.group_sync(seed_timing(spark, d), "seed", SYNC_LABELS)


def final_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each seed's group: members, scores, outliers, inner links, synchrony, and its rank."""
    m = cut(members(spark, d).select("seed", "candidate").distinct())
    s = accounts.scores(spark, d).select(F.col("user_id").alias("candidate"), "mca_score_primary")
    o = outliers(spark, d).select(F.col("user_id").alias("candidate"), "extreme")
    g = m.join(s, "candidate", "left").join(o, "candidate", "left").groupBy("seed").agg(
        F.count("*").alias("members"), F.count_if(F.col("mca_score_primary") >= 0.5).alias("high_scores"), F.count_if("extreme").alias("extreme_outliers"), F.avg("mca_score_primary").alias("mean_score"), F.max("mca_score_primary").alias("max_score")
    )
    inner = expansion.induced(co_negative(spark, d), m, "similarity").groupBy("seed").agg(F.count("*").alias("inner_edges"))
    numbers = [c for c in ("pairs", *[f"n_{x}" for x in SYNC_LABELS], "robust_pairs", "moderate_review_pairs", "fragile_pairs", "strong_events", "moderate_events")]
    g = g.join(inner, "seed", "left").join(group_sync(spark, d), "seed", "left").join(rollup.first_names(m, "seed", "candidate", [F.asc("candidate")]), "seed")
    return discovery.ranked_groups(g.na.fill(0, ["inner_edges", *numbers]), list(KEYS), "seed")


def pair_tiers(spark: SparkSession, d: str) -> DataFrame:
    return discovery.with_tiers(seed_pairs(spark, d), members(spark, d))


def tier_ablation(spark: SparkSession, d: str) -> DataFrame:
    m = members(spark, d)
    return discovery.tier_ablation(discovery.with_tiers(seed_timing(spark, d), m), m.groupBy("seed", "candidate").agg(F.min("tier").alias("tier")))


def temporal_baselines(spark: SparkSession, d: str) -> DataFrame:
    """Synchrony of the groups' pairs beside 5,000 random pairs and pairs of equal activity."""
    c = cut(interactions(spark, d))
    n = cut(c.groupBy(F.col("source").alias("account")).agg(F.count("*").alias("n")))
    busy = n.where(F.col("n") >= 5)
    own = cut(seed_pairs(spark, d).select("a", "b").distinct())
    inside = members(spark, d).select(F.col("candidate").alias("account")).distinct()
    pool = cut(busy.join(inside, "account", "left_anti"))
    kinds = {"groups": own, "random": discovery.random_pairs(busy, "account"), "matched": discovery.matched_pairs(own, n, pool)}
    every = None
    for k, p in kinds.items():
        p = p.withColumn("kind", F.lit(k))
        every = p if every is None else every.unionByName(p)
    every = cut(every)
    t = temporal.labelled(temporal.pair_timing(every.select("a", "b"), c, temporal.Windows()))
    j = every.join(t, ["a", "b"])
    s = rollup.pair_summary(j, ["kind"])
    robust = j.groupBy("kind").agg(F.avg((F.col("confidence") == "robust").cast("int")).alias("robust_rate"), F.avg((F.col("label") == "strong_temporal_sync").cast("int")).alias("strong_label_rate"))
    return s.join(robust, "kind")


def weight_audit(spark: SparkSession, d: str) -> DataFrame:
    """The normalised weights of every score column."""
    return scoring.weight_audit(spark)


def layer_artifacts(spark: SparkSession, d: str) -> DataFrame:
    e = cut(edges(spark, d))
    from weftline.plans.interactions import CO_NEGATIVE, CO_TARGET, trigger

    return graph.all_layers(e, trigger(spark, d), graph.co_targets(e, "w_log", CO_TARGET), graph.co_targets(e, "w_opposed", CO_NEGATIVE))


def split_comments(spark: SparkSession, d: str) -> DataFrame:
    """(part, comment_id, parent): direct comments with their post, replies with the comment they answer."""
    from weftline.operators.cleaning import parent_fields

    c = parent_fields(table(spark, d, "analyzed_comments").where(F.col("comment_id").isNotNull()))
    direct = c.where(F.col("parent_kind") == "post").select(F.lit("direct").alias("part"), "comment_id", F.col("parent_post").alias("parent"))
    return direct.unionByName(c.where(F.col("parent_kind") == "comment").select(F.lit("reply").alias("part"), "comment_id", F.col("parent_comment").alias("parent"))).distinct()


QUERIES = {
    "layer_artifacts": lambda s, d: rounded(layer_artifacts(s, d)),
    "coo_co_target": lambda s, d: rounded(graph.coo(accounts.co_target(s, d), graph.node_index(edges(s, d)), "similarity", "a", "b", mirror=True)),
    "split_comments": split_comments,
    "one_layout": lambda s, d: one_layout(table(s, d, "analyzed_comments").select("comment_id", F.concat(F.lit("t3_"), "post_id").alias("link_id"), "author", "created_utc")),
    "row_window": lambda s, d: row_range(table(s, d, "documents").select("doc_id", "n_chars"), ["doc_id"], 100, 250),
    "work_left": lambda s, d: resume(table(s, d, "documents").select("doc_id", "source"), table(s, d, "content_labels").where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("category").alias("category")), "doc_id").select("doc_id", "category"),
    "work_sizes": lambda s, d: pipeline.work_sizes(s, d),
    "clamped_counts": lambda s, d: table(s, d, "posts").select("post_id", clamp_int((F.col("num_comments") / 4).cast("string"), 0, 100, -1).alias("quarter")).distinct(),
    "group_discovery": lambda s, d: rounded(group_discovery(s, d)),
    "group_sync": group_sync,
    "final_groups": lambda s, d: rounded(final_groups(s, d)),
    "pair_tiers": pair_tiers,
    "tier_ablation": tier_ablation,
    "temporal_baselines": lambda s, d: rounded(temporal_baselines(s, d)),
    "score_ranks": lambda s, d: descending_rank(accounts.scores(s, d).select("user_id", "mca_score_primary"), "mca_score_primary", "place").select("user_id", "place"),
    "weight_audit": lambda s, d: rounded(weight_audit(s, d)),
    "signal_registry": lambda s, d: s.createDataFrame(REGISTRY, "signal string, status string"),
}

_FEATURES = f"""an as (select {sql_name("user_id")} as user_id, min(anomaly_label) as anomaly_label, min({sql_finite("anomaly_score")}) as anomaly_score, bool_or(coalesce(is_extreme_outlier, false)) as extreme from account_features where length({sql_name("user_id")}) > 0 group by 1),
so as (select source as user_id, count(*) filter (label = 'oppositional') / count(*) as opposed, count(*) as comments from c group by 1)"""
_SEED_PAIRS = f"sp as (select distinct seed, least(x, y) as a, greatest(x, y) as b from (select {sql_name('group_seed')} as seed, {sql_name('account_a')} as x, {sql_name('account_b')} as y from pair_evidence where {sql_valid('group_seed')} and {sql_valid('account_a')} and {sql_valid('account_b')}) where x <> y)"
_CONFIDENCE = """case when same_posts = 0 then 'none' when within_strong >= 2 or (same_posts >= 3 and within_moderate >= 2 and median_delay <= 90) then 'robust' when same_posts = 1 and within_strong = 1 and within_moderate = 1 then 'fragile_single_event'
when median_delay > 120 and (within_strong > 0 or within_moderate > 0) then 'fragile_long_median' when within_strong > 0 or within_moderate > 0 then 'moderate_review' else 'weak_context' end"""


def _timed(pairs: str) -> str:
    """pt: timing, label and confidence of the distinct pairs (a, b) of a frame."""
    return f"""cc as (select source, post_id, ts from c where post_id is not null and ts is not null qualify row_number() over (partition by source order by ts desc, comment_id) <= 100),
pd as (select distinct a, b from {pairs}),
mt as (select pd.a, pd.b, x.post_id, min(abs(x.ts - y.ts) / 60) as d, count(*) filter (abs(x.ts - y.ts) / 60 <= 5) as s, count(*) filter (abs(x.ts - y.ts) / 60 <= 30) as m from pd join cc x on x.source = pd.a join cc y on y.source = pd.b and y.post_id = x.post_id group by 1, 2, 3),
mm as (select a, b, count(*) as same_posts, sum(s) as within_strong, sum(m) as within_moderate, quantile_cont(d, 0.5) as median_delay, min(d) as min_delay from mt group by 1, 2),
p0t as (select a, b, coalesce(same_posts, 0) as same_posts, coalesce(within_strong, 0)::bigint as within_strong, coalesce(within_moderate, 0)::bigint as within_moderate, median_delay from pd left join mm using (a, b)),
pt as (select *, {_LABEL} as label, {_CONFIDENCE} as confidence from p0t)"""


_GS = (
    "gs as (select seed, count(*) as pairs, "
    + ", ".join(f"count(*) filter (label = '{x}') as n_{x}" for x in SYNC_LABELS)
    + """, count(*) filter (confidence = 'robust') as robust_pairs, count(*) filter (confidence = 'moderate_review') as moderate_review_pairs, count(*) filter (confidence in ('fragile_single_event', 'fragile_long_median')) as fragile_pairs,
    sum(within_strong)::bigint as strong_events, sum(within_moderate)::bigint as moderate_events from sp join pt using (a, b) group by 1)"""
)
_TIERS = "mt4 as (select seed, candidate, min(tier) as tier from m group by 1, 2), st4 as (select sp.*, x.tier as tier_a, y.tier as tier_b, coalesce(x.tier = 4, false) or coalesce(y.tier = 4, false) as has_tier4 from sp left join mt4 x on x.seed = sp.seed and x.candidate = sp.a left join mt4 y on y.seed = sp.seed and y.candidate = sp.b)"


def _drawn(seed: int, what: str, number: str, size: str) -> str:
    return f"((('0x' || substring(md5('{seed}:{what}:' || {number}), 1, 12))::bigint) % ({size}))"


_BIN = "case when n <= 0 then 0 when n <= 1 then 1 when n <= 3 then 2 when n <= 5 then 3 when n <= 10 then 4 when n <= 20 then 5 when n <= 50 then 6 when n <= 100 then 7 else 8 end"


def oracle_sql() -> dict[str, str]:
    settings = {"with_tier4": "true", "without_tier4": "not {x}", "tier4_only": "{x}"}
    four = "coalesce(tier = 4, false)"
    ablation = " union all ".join(
        f"select '{s}' as setting, (select count(*) from mt4 where {w.format(x=four)}) as memberships, (select count(distinct candidate) from mt4 where {w.format(x=four)}) as accounts, count(*) as pairs, count(*) filter (label = 'strong_temporal_sync') as strong, count(*) filter (label = 'moderate_temporal_sync') as moderate, count(*) filter (confidence = 'robust') as robust from st4 join pt using (a, b) where {w.format(x='has_tier4')}"
        for s, w in settings.items()
    )
    numbers = ("inner_edges", "pairs", *[f"n_{x}" for x in SYNC_LABELS], "robust_pairs", "moderate_review_pairs", "fragile_pairs", "strong_events", "moderate_events")
    audit = " union all ".join(f"select '{p}' as profile, " + ", ".join(f"{w / sum(ws)}::double as {s}" for s, w in zip(scoring.SIGNALS, ws, strict=True)) for p, ws in scoring.PROFILES.items())
    baselines = f"""n as (select source as account, count(*) as n from c group by 1), busy as (select account, n from n where n >= 5),
        ix as (select account, row_number() over (order by account) - 1 as pos from busy), sz as (select count(*) as size from ix),
        dr as (select id, {_drawn(42, "a", "id", "size")} as i, {_drawn(42, "b", "id", "size")} as j from range(10000) r(id), sz where size > 1),
        dq as (select least(i, j) as i, greatest(i, j) as j, min(id) as id from dr where i <> j group by 1, 2 order by 3 limit 5000),
        rp as (select x.account as a, y.account as b from dq join ix x on x.pos = dq.i join ix y on y.pos = dq.j),
        pool as (select account, {_BIN} as bin from busy where account not in (select candidate from m)),
        px as (select account, bin, row_number() over (order by bin, account) - 1 as pos from pool), pb as (select bin, min(pos) as first, count(*) as size from px group by 1), pn as (select count(*) as total from px),
        own as (select distinct a, b from sp),
        ob as (select own.*, coalesce((select {_BIN} from n where account = a), 0) as bin_a, coalesce((select {_BIN} from n where account = b), 0) as bin_b from own),
        oa as (select coalesce(u.first, 0) + {_drawn(42, "match-a", "a || '|' || b", "coalesce(u.size, total)")} as p, coalesce(v.first, 0) + {_drawn(42, "match-b", "a || '|' || b", "coalesce(v.size, total)")} as q from ob left join pb u on u.bin = bin_a left join pb v on v.bin = bin_b, pn),
        mq as (select distinct least(p, q) as i, greatest(p, q) as j from oa where p <> q),
        mp as (select least(x.account, y.account) as a, greatest(x.account, y.account) as b from mq join px x on x.pos = mq.i join px y on y.pos = mq.j),
        ev3 as (select a, b, 'groups' as kind from own union all select a, b, 'random' from rp union all select a, b, 'matched' from mp)"""
    prefixed = "case when starts_with(parent_id, 't3_') then 'direct' when starts_with(parent_id, 't1_') then 'reply' end"
    layers = {"count": "w_count", "single_signed": "w_signed", "signed": "w_signed", "positive": "w_positive", "negative": "w_negative"}
    return {
        "layer_artifacts": sql_rounded(
            f"""with {E}, {P}, {CO_T}, {CO_N}, {TR}, o as (select source, sum(n) as o from e group by 1), i as (select target, sum(n) as i from e group by 1), h as (select (select quantile_cont(o, 0.99) from o) as po, (select quantile_cont(i, 0.99) from i) as pi),
            u as ({" union all ".join(f"select '{k}' as layer, source, target, {v} as weight from e" for k, v in layers.items())} union all select 'degree_adjusted', source, target, n / (1 + exp(greatest(-50, least(50, o / po + i / pi - 2)))) from e join o using (source) join i using (target), h
            union all select 'trigger_response', a, b, w_trigger from tr union all select 'co_target', a, b, similarity from cot union all select 'co_negative_target', a, b, similarity from con)
            \nSELECT * from u where round(weight, 9) <> 0""",
            "weight",
        ),
        "coo_co_target": sql_rounded(f"with {E}, {CO_T}, {NODES}, m as (select x.node_id as row, y.node_id as col, similarity as data from cot join nd x on x.account = a join nd y on y.account = b)\nSELECT * from m union all select col, row, data from m", "data"),
        "split_comments": f"select distinct {prefixed} as part, comment_id, substring(parent_id, 4) as parent from analyzed_comments where comment_id is not null and {prefixed} is not null",
        "one_layout": "select comment_id, post_id, author, created_utc from analyzed_comments",
        "row_window": "select doc_id, n_chars from (select doc_id, n_chars, row_number() over (order by doc_id) - 1 as p from documents) where p >= 100 and p < 250",
        "work_left": "select doc_id, category from documents left join (select doc_id, min(category) as category from content_labels where doc_id is not null group by 1) using (doc_id)",
        "work_sizes": f"with {P}, k as (select distinct comment_id from analyzed_comments where comment_id is not null and parent_type = 'post' and post_id in (select post_id from p)) select 'posts' as task, (select count(*) from p) as rows union all select 'comments', (select count(*) from k)",
        "clamped_counts": "select distinct post_id, case when num_comments is null then -1 else greatest(0, least(100, round_even(num_comments / 4.0, 0)))::int end as quarter from posts",
        "group_discovery": sql_rounded(
            f"""with recursive {E}, {P}, {_R}, {CO_N}, {GROUPS}, {_FEATURES},
            tg as (select group_id, target, count(distinct account) as k, round(sum(w_opposed), 9) as ws from e join gm on gm.account = e.source group by 1, 2 having count(distinct account) >= 2),
            tp as (select *, row_number() over (partition by group_id order by k desc, ws desc, target) as place from tg),
            tn as (select group_id, count(*) as shared_targets, string_agg(target, '; ' order by place) filter (place <= 5) as top_targets from tp where place <= 10 group by 1),
            gi as (select group_id, size, count(*) as edges, round(sum(similarity), 9) as weight_sum, avg(similarity) as weight_mean, max(similarity) as weight_max from l join gm on gm.account = l.a group by 1, 2),
            go as (select gi.*, coalesce(shared_targets, 0) as shared_targets, coalesce(top_targets, '') as top_targets, 2 * edges / (size * (size - 1)) as density from gi left join tn using (group_id)),
            gr as (select *, (row_number() over (order by weight_sum desc, shared_targets desc, size desc, group_id))::int as place from go),
            gf as (select group_id, avg(coalesce(mean_rhetoric, 0)) as mean_rhetoric, avg(coalesce(loaded_per_post, 0)) as mean_nonneutral, avg(coalesce(opposed, 0)) as mean_opposed, avg(coalesce(anomaly_score, 0)) as mean_anomaly_score, count(*) filter (anomaly_label = -1) / count(*) as anomaly_share, sum(coalesce(comments, 0))::double as total_comments, sum(coalesce(posts, 0))::double as total_posts
                from gm left join rf on rf.user_id = account left join so on so.user_id = account left join an on an.user_id = account group by 1)
            \nSELECT 'co_negative_target_t{int(GROUP_THRESHOLD * 100):03d}_' || lpad(place::varchar, 3, '0') as name, gr.*, mean_rhetoric, mean_nonneutral, mean_opposed, mean_anomaly_score, anomaly_share, total_comments, total_posts from gr join gf using (group_id) where place <= 50""",
            "weight_sum weight_mean weight_max density mean_rhetoric mean_nonneutral mean_opposed mean_anomaly_score anomaly_share total_comments total_posts",
        ),
        "group_sync": f"with {C}, {_SEED_PAIRS}, {_timed('sp')}, {_GS} select * from gs",
        "final_groups": sql_rounded(
            f"""with {E}, {CO_N}, {_M}, {_S}, {_FEATURES}, {_SEED_PAIRS}, {_timed("sp")}, {_GS}, md as (select distinct seed, candidate from m),
            ga as (select seed, count(*) as members, count(*) filter (mca_score_primary >= 0.5) as high_scores, count(*) filter (extreme) as extreme_outliers, avg(mca_score_primary) as mean_score, max(mca_score_primary) as max_score from md left join s on s.user_id = candidate left join an on an.user_id = candidate group by 1),
            gi as (select x.seed, count(*) as inner_edges from con join md x on x.candidate = con.a join md y on y.candidate = con.b and y.seed = x.seed group by 1),
            gn as (select seed, string_agg(candidate, ', ' order by candidate) filter (p <= 12) as names from (select *, row_number() over (partition by seed order by candidate) as p from md) group by 1),
            gj as (select ga.*, names, {", ".join(f"coalesce({c}, 0) as {c}" for c in numbers)} from ga join gn using (seed) left join gi using (seed) left join gs using (seed))
            \nSELECT *, row_number() over (order by {", ".join(f"{k} desc" for k in KEYS)}, seed) as group_rank from gj""",
            "mean_score max_score",
        ),
        "pair_tiers": f"with {_M}, {_SEED_PAIRS}, {_TIERS} select * from st4",
        "tier_ablation": f"with {C}, {_M}, {_SEED_PAIRS}, {_TIERS}, {_timed('sp')} {ablation}",
        "temporal_baselines": sql_rounded(
            f"""with {C}, {_M}, {_SEED_PAIRS}, {baselines}, {_timed("ev3")}, tj as (select * from ev3 join pt using (a, b)), ac as (select kind, count(distinct x) as accounts from (select kind, a as x from tj union all select kind, b from tj) group by 1)
            \nSELECT kind, any_value(accounts) as accounts, count(*) as pairs, avg((same_posts > 0)::int) as same_post_rate, avg((within_strong > 0)::int) as strong_rate, avg((within_moderate > 0)::int) as moderate_rate, sum(same_posts)::bigint as same_posts, sum(within_strong)::bigint as strong_events, avg(median_delay) as mean_median_delay, avg((confidence = 'robust')::int) as robust_rate, avg((label = 'strong_temporal_sync')::int) as strong_label_rate from tj join ac using (kind) group by 1""",
            "same_post_rate strong_rate moderate_rate mean_median_delay robust_rate strong_label_rate",
        ),
        "score_ranks": f"with {_S} select user_id, case when mca_score_primary is not null then rank() over (order by mca_score_primary desc nulls last) end as place from s",
        "weight_audit": sql_rounded(f"with a as ({audit})\nSELECT profile, 'score_' || profile as score_column, {', '.join(scoring.SIGNALS)} from a", " ".join(scoring.SIGNALS)),
        "signal_registry": "select * from (values " + ", ".join(f"('{a}', '{b}')" for a, b in REGISTRY) + ") v(signal, status)",
    }
