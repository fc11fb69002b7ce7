"""Queries on account behaviour, scores, seed expansion, timing and evaluation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.accounts import finite, name, sql_finite, sql_name, sql_valid, valid_name
from weftline.functions.text import sql_mean
from weftline.operators import behaviour, cleaning, evaluation, expansion, graph, rhetoric, scoring, temporal, text_features
from weftline.operators.expansion import Tiers
from weftline.operators.ranking import global_index, positive_percentile
from weftline.plans.extras import _R, TAG, rhetoric_posts, tag_similarity
from weftline.plans.interactions import C, CO_N, CO_T, E, P, TR, WHOLE_N, WHOLE_NEGATIVE, WHOLE_T, WHOLE_TARGET, co_target, comments, edges, interactions, posts, trigger
from weftline.plans.lineage import cut
from weftline.plans.rounding import rounded, sql_rounded
from weftline.sources.tables import table

BEHAVIOUR = ["comment_count", "comment_active_days", "comments_per_day", "mean_comment_interval_seconds", "max_comments_per_hour", "burst_ratio", "night_activity_ratio", "weekend_activity_ratio", "post_count", "posts_per_day", "comment_post_ratio"]
SIGNALS = ("manipulative_signal", "coordinative_signal", "interaction_reach_signal", "automatic_behavior_signal")
TIERS = Tiers()
SYNC = {"no_temporal_sync": 0, "weak_temporal_overlap": 1, "moderate_temporal_sync": 2, "strong_temporal_sync": 3}
SYNC_LABELS = tuple(SYNC)
THRESHOLDS = (0.1, 0.2, 0.3, 0.5)


def features(spark: SparkSession, d: str) -> DataFrame:
    """One row per account (exactly repeated rows are one)."""
    f = table(spark, d, "account_features").where(F.length(name("user_id")) > 0)
    cols = [F.min(finite(c)).alias(c) for c in BEHAVIOUR] + [F.min("cluster_kmeans").alias("cluster_kmeans"), F.min(finite("anomaly_score")).alias("old_anomaly_score")]
    return f.groupBy(name("user_id").alias("user_id")).agg(*cols)


def scores(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "mca_scores").where(F.length(name("user_id")) > 0)
    return s.groupBy(name("user_id").alias("user_id")).agg(*[F.max(finite(c)).alias(c) for c in (*SIGNALS, "mca_score_primary", "mca_score_alt")])


def comment_activity(spark: SparkSession, d: str) -> DataFrame:
    return behaviour.activity(comments(spark, d), "source", "ts")


def post_activity(spark: SparkSession, d: str) -> DataFrame:
    p = posts(spark, d)
    replies = p.groupBy(F.col("author").alias("user_id")).agg(F.avg("num_comments").alias("mean_num_comments"))
    return behaviour.activity(p, "author", "ts").join(replies, "user_id")


def account_signals(spark: SparkSession, d: str) -> DataFrame:
    """Signals of all interacting accounts, from the graph built here."""
    e = cut(edges(spark, d))
    co_t, co_n = graph.co_targets(e, "w_log", _projection("t")), graph.co_targets(e, "w_opposed", _projection("n"))
    tr = cut(trigger(spark, d))
    opposed = e.groupBy(F.col("source").alias("user_id")).agg((F.sum("n_oppositional") / F.sum("n")).alias("opposed_ratio"))
    reach = graph.reach(e).select(F.col("account").alias("user_id"), F.col("out_n"), "in_n", (F.col("targets") + F.col("sources")).alias("breadth"))
    acc = reach.join(opposed, "user_id", "left")
    for frame, out in ((graph.strength(co_t, "similarity"), "co_target"), (graph.strength(co_n, "similarity"), "co_negative"), (tr.groupBy(F.col("a").alias("account")).agg(F.sum("w_trigger").alias("strength")), "trigger_out"), (tr.groupBy(F.col("b").alias("account")).agg(F.sum("w_trigger").alias("strength")), "trigger_in")):
        acc = acc.join(frame.select(F.col("account").alias("user_id"), F.round("strength", 9).alias(out)), "user_id", "left")
    old = features(spark, d).select("user_id", F.col("old_anomaly_score").alias("anomaly_score"))
    said = rhetoric.rhetoric_features(rhetoric_posts(spark, d)).select("user_id", F.round("mean_rhetoric", 9).alias("rhetoric"), F.round("loaded_per_post", 9).alias("nonneutral"))
    acc = acc.join(old, "user_id", "left").join(said, "user_id", "left")
    return scoring.signals(cut(acc))


def _projection(which: str):
    from weftline.plans.interactions import CO_NEGATIVE, CO_TARGET

    return CO_TARGET if which == "t" else CO_NEGATIVE


def score_views(spark: SparkSession, d: str) -> DataFrame:
    return scoring.views(scores(spark, d).na.fill(0.0), SIGNALS).select("user_id", *[f"score_{p}" for p in scoring.PROFILES])


def seeds(spark: SparkSession, d: str) -> DataFrame:
    """The 20 accounts with the highest primary score of at least 0.5."""
    return scoring.leaders(scores(spark, d), "mca_score_primary", 20, 0.5).select(F.col("user_id").alias("seed"), "mca_score_primary", "place")


def _layers(e: DataFrame, spark: SparkSession, d: str, negative: float = WHOLE_NEGATIVE.threshold) -> dict[str, DataFrame]:
    """The layers of the expansion from edges ``e``, over all sources of every target."""
    tr = trigger(spark, d)
    return {
        "co_negative": cut(expansion.both_ways(graph.co_targets(e, "w_opposed", replace(WHOLE_NEGATIVE, threshold=negative)), "similarity")),
        "co_target": cut(expansion.both_ways(graph.co_targets(e, "w_log", WHOLE_TARGET), "similarity")),
        "trigger": cut(expansion.both_ways(tr.withColumn("w_trigger", F.round("w_trigger", 9)), "w_trigger")),
        "tag": cut(expansion.both_ways(tag_similarity(spark, d), "similarity")),
    }


def expansion_seeds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "expansion_members").select(valid_name("seed").alias("seed")).where(F.col("seed").isNotNull()).distinct()


def tiered_expansion(spark: SparkSession, d: str) -> DataFrame:
    return expansion.expand(expansion_seeds(spark, d), _layers(cut(edges(spark, d)), spark, d), TIERS)


def induced_edges(spark: SparkSession, d: str) -> DataFrame:
    layers = _layers(cut(edges(spark, d)), spark, d)
    pairs = layers["co_negative"].where(F.col("me") < F.col("other")).toDF("a", "b", "similarity")
    return expansion.induced(pairs, cut(expansion.expand(expansion_seeds(spark, d), layers, TIERS)), "similarity")


def shared_with_seed(spark: SparkSession, d: str) -> DataFrame:
    e = cut(edges(spark, d))
    return expansion.shared_with_seed(cut(expansion.expand(expansion_seeds(spark, d), _layers(e, spark, d), TIERS)), e, "w_log")


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """Distinct pairs of pair_evidence with their strongest observation."""
    e = table(spark, d, "pair_evidence").select(valid_name("account_a").alias("a"), valid_name("account_b").alias("b"), finite("co_negative_weight").alias("w"), "verification_label", F.col("within_5min_count").alias("strong"), finite("median_delay_minutes").alias("delay"))
    e = e.where(F.col("a") != F.col("b"))
    return e.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("w").alias("w"), F.max("verification_label").alias("label"), F.max("strong").alias("strong"), F.min("delay").alias("delay"))


def pair_timing(spark: SparkSession, d: str) -> DataFrame:
    c = interactions(spark, d)
    return temporal.labelled(temporal.pair_timing(evidence(spark, d).select("a", "b"), c, temporal.Windows()))


def member_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of a seed's included members."""
    m = table(spark, d, "expansion_members").where(F.col("include")).select(valid_name("seed").alias("seed"), valid_name("candidate").alias("candidate")).where(F.col("seed").isNotNull() & F.col("candidate").isNotNull())
    return temporal.group_pairs(m, "seed", "candidate").withColumnRenamed("grp", "seed")


def expansion_timing(spark: SparkSession, d: str) -> DataFrame:
    """Timing of all pairs of members of each seed's expansion."""
    return temporal.group_timing(cut(tiered_expansion(spark, d)), "seed", "candidate", interactions(spark, d), temporal.Windows())


def member_summary(spark: SparkSession, d: str) -> DataFrame:
    """Seeds' groups: members, tiers, mean features of members (missing counts as 0)."""
    m = table(spark, d, "expansion_members").select(valid_name("seed").alias("seed"), valid_name("candidate").alias("candidate"), "tier", "include").where(F.col("seed").isNotNull() & F.col("candidate").isNotNull())
    m = m.groupBy("seed", "candidate").agg(F.min("tier").alias("tier"), F.max("include").alias("include"))
    j = m.join(features(spark, d).select(F.col("user_id").alias("candidate"), "comments_per_day", "burst_ratio", "comment_count"), "candidate", "left").na.fill(0.0)
    return j.groupBy("seed").agg(F.count("*").alias("members"), F.count_if("include").alias("included"), *[F.count_if(F.col("tier") == t).alias(f"tier_{t}") for t in (0, 1, 2, 3, 4, 99)], F.avg("comments_per_day").alias("mean_comments_per_day"), F.avg("burst_ratio").alias("mean_burst"), F.sum("comment_count").alias("comments"))


def knn(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return text_features.nearest(e.where(F.col("vec_id") % 50 == 0), e, "vec_id", "embedding", 3)


def activity_bins(spark: SparkSession, d: str) -> DataFrame:
    f = features(spark, d).withColumn("bin", evaluation.activity_bin("comment_count"))
    return f.where(F.col("bin").isNotNull()).groupBy("bin").agg(F.count("*").alias("accounts"), F.avg("burst_ratio").alias("mean_burst"))


QUERIES = {
    "stance_features": lambda s, d: rounded(behaviour.stance_features(interactions(s, d))),
    "comment_activity": lambda s, d: rounded(comment_activity(s, d), 4),
    "post_activity": lambda s, d: rounded(post_activity(s, d), 4),
    "merged_activity": lambda s, d: rounded(behaviour.merge_activity(comment_activity(s, d), post_activity(s, d)), 4),
    "anomaly_scores": lambda s, d: rounded(behaviour.anomaly(features(s, d), BEHAVIOUR)),
    "kmeans_accounts": lambda s, d: behaviour.kmeans(features(s, d), BEHAVIOUR),
    "positive_percentile": lambda s, d: rounded(positive_percentile(scores(s, d).select("user_id", "coordinative_signal"), "coordinative_signal", "percentile")),
    "account_signals": lambda s, d: rounded(account_signals(s, d)),
    "score_views": lambda s, d: rounded(score_views(s, d), 9),
    "top_accounts": lambda s, d: rounded(scoring.leaders(score_views(s, d), "score_primary", 100), 9).select("user_id", "score_primary", "place"),
    "seeds": seeds,
    "seed_neighbours": lambda s, d: rounded(expansion.neighbours(co_target(s, d), expansion_seeds(s, d), "similarity", 15)),
    "trigger_neighbours": lambda s, d: rounded(expansion.directed_neighbours(trigger(s, d).withColumn("w_trigger", F.round("w_trigger", 9)), expansion_seeds(s, d), "w_trigger", 15)),
    "tiered_expansion": lambda s, d: rounded(tiered_expansion(s, d)),
    "induced_edges": lambda s, d: rounded(induced_edges(s, d)),
    "shared_with_seed": lambda s, d: rounded(shared_with_seed(s, d)),
    "pair_timing": lambda s, d: rounded(pair_timing(s, d)),
    "member_pairs": member_pairs,
    "sync_counts": lambda s, d: temporal.group_counts(table(s, d, "pair_evidence").select(valid_name("group_seed").alias("seed"), "verification_label").where(F.col("seed").isNotNull()), "seed", "verification_label", SYNC_LABELS),
    "account_timing": lambda s, d: temporal.account_rollup(evidence(s, d), "label", SYNC, "delay"),
    "member_summary": lambda s, d: rounded(member_summary(s, d)),
    "weight_spearman": lambda s, d: evaluation.spearman(scores(s, d), "mca_score_primary", "mca_score_alt"),
    "top_overlap": lambda s, d: rounded(evaluation.top_overlap(scores(s, d), "user_id", "mca_score_primary", "mca_score_alt", (20, 50, 100))),
    "signal_sparsity": lambda s, d: rounded(evaluation.sparsity(scores(s, d), list(SIGNALS))),
    "threshold_sweep": lambda s, d: rounded(evaluation.sweep(evidence(s, d), "w", THRESHOLDS)),
    "activity_bins": lambda s, d: rounded(activity_bins(s, d)),
    "text_ratios": lambda s, d: rounded(text_features.text_ratios(posts(s, d), "analysis_text")),
    "post_features": lambda s, d: rounded(text_features.post_features(posts(s, d), interactions(s, d))),
    "hashed_terms": lambda s, d: rounded(text_features.hashed_terms(posts(s, d), "post_id", "analysis_text")),
    "top_terms": lambda s, d: text_features.top_terms(table(s, d, "documents").where(F.col("source").isNotNull()), "source", "text"),
    "knn_embeddings": lambda s, d: rounded(knn(s, d)),
    "row_positions": lambda s, d: global_index(table(s, d, "events").select("event_id"), ["event_id"], "position"),
}

_LABELS = cleaning.LABELS
_F = f"""f as (select {sql_name("user_id")} as user_id, {", ".join(f"min({sql_finite(c)}) as {c}" for c in BEHAVIOUR)}, min({sql_finite("anomaly_score")}) as old_anomaly_score from account_features where length({sql_name("user_id")}) > 0 group by 1)"""
_S = f"""s as (select {sql_name("user_id")} as user_id, {", ".join(f"max({sql_finite(c)}) as {c}" for c in (*SIGNALS, "mca_score_primary", "mca_score_alt"))} from mca_scores where length({sql_name("user_id")}) > 0 group by 1)"""


def _activity(out: str, src: str, entity: str) -> str:
    return f"""{out}_e as (select {entity} as user_id, ts, ts - lag(ts) over (partition by {entity} order by ts) as gap, floor(ts / 3600)::bigint as hour from {src} where {entity} is not null and ts is not null),
{out}_h as (select user_id, hour, count(*) as k from {out}_e group by 1, 2),
{out}_b as (select user_id, max(k) as top, avg(k) as mid, sum(case when hour % 24 < 6 then k else 0 end) as night, sum(case when (hour // 24 + 3) % 7 >= 5 then k else 0 end) as weekend from {out}_h group by 1),
{out}_a as (select user_id, count(*) as events, min(ts) as first, max(ts) as last, avg(gap) as mean_interval, stddev_pop(gap) as std_interval, min(gap) as min_interval from {out}_e group by 1),
{out} as (select user_id, events, first, last, greatest(1, floor((last - first) / 86400) + 1)::bigint as active_days, events / greatest(1, floor((last - first) / 86400) + 1) as per_day, mean_interval, std_interval, min_interval, top as max_per_hour,
    top / (mid + 1e-6) as burst_ratio, night / events as night_ratio, weekend / events as weekend_ratio from {out}_a join {out}_b using (user_id))"""


_ACT = "first last per_day mean_interval std_interval min_interval burst_ratio night_ratio weekend_ratio"
_CA, _PA = _activity("ca", "c0", "source"), _activity("pa", "p", "author")


def _pp(frame: str, raw: str, out: str) -> str:
    return f"(select user_id, case when {raw} > 0 then (rank() over (partition by {raw} > 0 order by {raw}) + (count(*) over (partition by {raw}) - 1) / 2.0) / count(*) over (partition by {raw} > 0) else 0 end as {out} from {frame})"


_RAW = {"rhetoric": 0, "nonneutral": 0, "opposed_ratio": 0, "out_n": 0, "in_n": 0, "breadth": 0, "co_target": 0, "co_negative": 0, "trigger_out": 0, "trigger_in": 0, "unusual": 0}
_SIGNALS = (
    f"""{_F}, {_R}, st as (select account as user_id, round(sum(w), 9) as w from (select a as account, similarity as w from cot union all select b, similarity from cot) group by 1),
sn as (select account as user_id, round(sum(w), 9) as w from (select a as account, similarity as w from con union all select b, similarity from con) group by 1),
so as (select a as user_id, round(sum(w_trigger), 9) as w from tr group by 1), si as (select b as user_id, round(sum(w_trigger), 9) as w from tr group by 1),
rc as (select account as user_id, sum(o) as out_n, sum(i) as in_n, sum(x) as breadth from (select source as account, n as o, 0 as i, 1 as x from e union all select target, 0, n, 1 from e) group by 1),
op as (select source as user_id, sum(n_oppositional) / sum(n) as r from e group by 1),
ac as (select rc.user_id, out_n, in_n, breadth, coalesce(op.r, 0) as opposed_ratio, coalesce(round(rf.mean_rhetoric, 9), 0) as rhetoric, coalesce(round(rf.loaded_per_post, 9), 0) as nonneutral, coalesce(st.w, 0) as co_target, coalesce(sn.w, 0) as co_negative, coalesce(so.w, 0) as trigger_out, coalesce(si.w, 0) as trigger_in, greatest(0, -coalesce(f.old_anomaly_score, 0)) as unusual
    from rc left join op using (user_id) left join st using (user_id) left join sn using (user_id) left join so using (user_id) left join si using (user_id) left join f using (user_id) left join rf using (user_id))"""
    + "\nSELECT user_id, 0.40 * p_rhetoric + 0.35 * p_nonneutral + 0.25 * p_opposed_ratio as manipulative, 0.30 * p_co_target + 0.35 * p_co_negative + 0.35 * (0.5 * p_trigger_out + 0.5 * p_trigger_in) as coordinative, 0.35 * p_out_n + 0.25 * p_in_n + 0.40 * p_breadth as reach, p_unusual as automatic from ac "
    + " ".join(f"join {_pp('ac', r, 'p_' + r)} using (user_id)" for r in _RAW)
)
_VIEWS = ", ".join(" + ".join(f"{w} * coalesce({c}, 0)" for w, c in zip(ws, SIGNALS, strict=True)) + f" as score_{p}" for p, ws in scoring.PROFILES.items())
_SEEDS = f"sd as (select distinct {sql_name('seed')} as seed from expansion_members where {sql_valid('seed')})"


def _ways(out: str, src: str, w: str) -> str:
    return f"{out}_p as (select least(a, b) as a, greatest(a, b) as b, max({w}) as w from {src} where a <> b group by 1, 2), {out} as (select a as me, b as other, w from {out}_p union all select b, a, w from {out}_p)"


def _weights(out: str, src: str) -> str:
    return f"{out} as (select x.*, coalesce(n.w, 0) as co_negative, coalesce(q.w, 0) as tag, coalesce(g.w, 0) as trigger, coalesce(t.w, 0) as co_target from {src} x left join wn n on n.me = seed and n.other = candidate left join wq q on q.me = seed and q.other = candidate left join wg g on g.me = seed and g.other = candidate left join wt t on t.me = seed and t.other = candidate)"


def sql_expand(cfg: Tiers) -> str:
    structure = f"(co_negative > 0 or co_target >= {cfg.co_target} or trigger >= {cfg.trigger})"
    return f"""{_SEEDS}, {_R}, {TAG}, {_ways("wq", "tg", "similarity")}, {_ways("wn", "con", "similarity")}, {_ways("wt", "cot", "similarity")}, {_ways("wg", "(select a, b, round(w_trigger, 9) as w from tr)", "w")},
near as (select seed, other as candidate from sd join wn on me = seed union select seed, other from sd join wt on me = seed union select seed, other from sd join wg on me = seed union select seed, other from sd join wq on me = seed),
{_weights("dw", "near")},
di as (select *, case when co_negative >= {cfg.co_negative} then 1 when tag >= {cfg.tag} and {structure} then 2 when trigger >= {cfg.trigger} and (co_negative > 0 or tag >= {cfg.tag}) then 3 else 99 end as tier, case when co_negative >= {cfg.co_negative} then 'co_negative' when tag >= {cfg.tag} and {structure} then 'tag_with_structure' else 'trigger_with_co_negative_or_tag' end as reason, 0 as links, '' as connectors from dw),
ac as (select * from di where tier < 99 union all select seed, seed, 0, 0, 0, 0, 0, 'seed', 0, '' from sd),
hp as (select ac.seed, wn.other as candidate, count(*) as links, array_to_string(list_slice(list_sort(list(ac.candidate)), 1, 12), ', ') as connectors from ac join wn on wn.me = ac.candidate where wn.w >= {cfg.co_negative} group by 1, 2 having count(*) >= {cfg.min_links}),
h2 as (select * from hp where (seed, candidate) not in (select (seed, candidate) from ac)),
{_weights("hw", "h2")},
al as (select seed, candidate, tier, reason, co_negative, tag, trigger, co_target, links, connectors from ac union all select seed, candidate, 4, 'two_hop', co_negative, tag, trigger, co_target, links, connectors from hw),
ex as (select * from al qualify row_number() over (partition by seed order by tier, co_negative desc, tag desc, trigger desc, co_target desc, candidate) <= {cfg.max_members})"""


_EXPAND = sql_expand(TIERS)
_GRAPH = f"{E}, {P}, {CO_T}, {CO_N}, {TR}"
_WHOLE_GRAPH = f"{E}, {P}, {WHOLE_T}, {WHOLE_N}, {TR}"
_EV = f"""ev as (select least(a, b) as a, greatest(a, b) as b, max(w) as w, max(verification_label) as label, max(strong) as strong, min(delay) as delay from (select {sql_name("account_a")} as a, {sql_name("account_b")} as b, {sql_finite("co_negative_weight")} as w, verification_label, within_5min_count as strong,
    {sql_finite("median_delay_minutes")} as delay from pair_evidence where {sql_valid("account_a")} and {sql_valid("account_b")}) where a <> b group by 1, 2)"""
_TIMING = """cc as (select source, post_id, ts from c where post_id is not null and ts is not null qualify row_number() over (partition by source order by ts desc, comment_id) <= 100),
mt as (select ev.a, ev.b, x.post_id, min(abs(x.ts - y.ts) / 60) as d, count(*) filter (abs(x.ts - y.ts) / 60 <= 5) as s, count(*) filter (abs(x.ts - y.ts) / 60 <= 30) as m from ev join cc x on x.source = ev.a join cc y on y.source = ev.b and y.post_id = x.post_id group by 1, 2, 3),
mm as (select a, b, count(*) as same_posts, sum(s) as within_strong, sum(m) as within_moderate, quantile_cont(d, 0.5) as median_delay, min(d) as min_delay from mt group by 1, 2),
pt as (select a, b, coalesce(same_posts, 0) as same_posts, coalesce(within_strong, 0)::bigint as within_strong, coalesce(within_moderate, 0)::bigint as within_moderate, median_delay, min_delay from ev left join mm using (a, b))"""
_MEMBERS = f"""m0 as (select {sql_name("seed")} as seed, {sql_name("candidate")} as candidate, min(tier) as tier, bool_or(include) as include from expansion_members where {sql_valid("seed")} and {sql_valid("candidate")} group by 1, 2)"""


def _anomaly_sql() -> str:
    z = " + ".join(f"power((coalesce({c}, 0) - (select avg(coalesce({c}, 0)) from f)) / (select case when stddev_pop(coalesce({c}, 0)) = 0 then 1 else stddev_pop(coalesce({c}, 0)) end from f), 2)" for c in BEHAVIOUR)
    return f"with {_F}, d as (select user_id, sqrt({z}) as distance from f), q as (select quantile_cont(distance, 0.95) as cutoff, quantile_cont(distance, 0.99) as far from d)\nSELECT user_id, distance, case when distance >= cutoff then -1 else 1 end as anomaly_label, cutoff - distance as anomaly_score, distance >= far as is_extreme_outlier from d, q"


def oracle_sql() -> dict[str, str]:
    ratios = ", ".join(f"count(*) filter (label = '{x}') / count(*) as ratio_{x}" for x in _LABELS)
    rank = "case label " + " ".join(f"when '{k}' then {v}" for k, v in SYNC.items()) + " else -1 end"
    patterns = {"uppercase": "[A-Z]", "digit": "[0-9]", "exclamation": "!", "question": "\\?", "url": "https?://|www\\.", "dollar": "\\$"}
    tr = ", ".join(f"len(regexp_extract_all(x, '{p}')) / greatest(length(x), 1) as {n}_ratio" for n, p in patterns.items())
    tok = "[a-z][a-z0-9'']+"
    ratio_sql = f"tx as (select post_id, len(regexp_extract_all(lower(x), '{tok}'))::int as words, {tr} from (select post_id, coalesce(analysis_text, '') as x from p))"
    names = " ".join(f"{n}_ratio" for n in patterns)
    n_lab, r_lab = ", ".join(f"count(*) filter (label = '{x}') as n_{x}" for x in _LABELS), ", ".join(f"ratio_{x}" for x in _LABELS)
    zero = ", ".join(f"coalesce({c}, 0) as {c}" for c in ["comments", "mean_score", "min_score", "max_score", *[f"n_{x}" for x in _LABELS], *[f"ratio_{x}" for x in _LABELS]])
    top = lambda c: f"(select user_id, row_number() over (order by {c} desc, user_id) as r from s where {c} is not null)"
    return {
        "stance_features": sql_rounded(f"with {C}\nSELECT source as user_id, count(*) as comments, {sql_mean('score', 6)} as mean_score, stddev_pop(score) as std_score, max(score) as max_score, min(score) as min_score, {sql_mean('weight', 9)} as mean_weight, avg(chars) as mean_chars, count(distinct target) as targets, count(distinct post_id) as posts, {ratios} from c group by 1", "mean_score std_score max_score min_score mean_weight mean_chars " + r_lab.replace(",", "")),
        "comment_activity": sql_rounded(f"with {C}, {_CA}\nSELECT * from ca", _ACT, 4),
        "post_activity": sql_rounded(f"with {P}, {_PA}\nSELECT pa.*, mean_num_comments from pa join (select author as user_id, avg(num_comments) as mean_num_comments from p group by 1) using (user_id)", _ACT + " mean_num_comments", 4),
        "merged_activity": sql_rounded(
            f"""with {C}, {P}, {_CA}, {_PA}, j as (select coalesce(ca.user_id, pa.user_id) as user_id, coalesce(ca.events, 0) as comment_count, coalesce(ca.active_days, 0) as comment_days, coalesce(ca.per_day, 0) as comments_per_day, coalesce(ca.burst_ratio, 0) as burst_ratio, coalesce(ca.night_ratio, 0) as night_ratio,
            coalesce(pa.events, 0) as post_count, coalesce(pa.active_days, 0) as post_days, coalesce(pa.per_day, 0) as posts_per_day from ca full join pa on ca.user_id = pa.user_id)
            \nSELECT *, comment_count + post_count as total, greatest(comment_days, post_days) as active_days, comment_count / (post_count + 1e-6) as comment_post_ratio from j""",
            "comments_per_day burst_ratio night_ratio posts_per_day comment_post_ratio", 4,
        ),
        "anomaly_scores": sql_rounded(_anomaly_sql(), "distance anomaly_score"),
        "positive_percentile": sql_rounded(f"with {_S}, q as (select user_id, coordinative_signal from s)\nSELECT user_id, coordinative_signal, percentile from q join {_pp('q', 'coordinative_signal', 'percentile')} using (user_id)", "coordinative_signal percentile"),
        "account_signals": sql_rounded(f"with {_GRAPH}, {_SIGNALS}", "manipulative coordinative reach automatic"),
        "score_views": sql_rounded(f"with {_S}\nSELECT user_id, {_VIEWS} from s", " ".join(f"score_{p}" for p in scoring.PROFILES), 9),
        "top_accounts": sql_rounded(f"with {_S}, v as (select user_id, {_VIEWS} from s)\nSELECT user_id, score_primary, row_number() over (order by score_primary desc, user_id)::int as place from v where score_primary >= 0 order by 3 limit 100", "score_primary", 9),
        "seeds": f"with {_S} select user_id as seed, mca_score_primary, row_number() over (order by mca_score_primary desc, user_id)::int as place from s where mca_score_primary >= 0.5 order by 3 limit 20",
        "seed_neighbours": sql_rounded(f"with {E}, {CO_T}, {_SEEDS}, {_ways('wt', 'cot', 'similarity')}\nSELECT seed, other as neighbour, w as weight, row_number() over (partition by seed order by w desc, other)::int as place from sd join wt on me = seed qualify row_number() over (partition by seed order by w desc, other) <= 15", "weight"),
        "trigger_neighbours": sql_rounded(
            f"with {C}, {P}, {TR}, {_SEEDS}, dn as (select a as seed, 'out' as direction, b as neighbour, round(w_trigger, 9) as weight from tr union all select b, 'in', a, round(w_trigger, 9) from tr)\nSELECT seed, direction, neighbour, weight, row_number() over (partition by seed, direction order by weight desc, neighbour)::int as place from dn join sd using (seed) qualify row_number() over (partition by seed, direction order by weight desc, neighbour) <= 15",
            "weight",
        ),
        "tiered_expansion": sql_rounded(f"with {_WHOLE_GRAPH}, {_EXPAND}\nSELECT * from ex", "co_negative tag trigger co_target"),
        "induced_edges": sql_rounded(f"with {_WHOLE_GRAPH}, {_EXPAND}\nSELECT x.seed, con.a, con.b, similarity as weight from con join ex x on x.candidate = con.a join ex y on y.candidate = con.b and y.seed = x.seed", "weight"),
        "shared_with_seed": sql_rounded(
            f"with {_WHOLE_GRAPH}, {_EXPAND}, sh as (select x.seed, x.candidate, count(distinct target) as shared, sum(w_log) as ws from ex x join e on e.source = x.candidate where x.seed <> x.candidate and (x.seed, target) in (select (source, target) from e) group by 1, 2)\nSELECT seed, candidate, coalesce(shared, 0) as shared, coalesce(ws, 0) as weight_sum from (select seed, candidate from ex where seed <> candidate) left join sh using (seed, candidate)",
            "weight_sum",
        ),
        "pair_timing": sql_rounded(
            f"""with {C}, {_EV}, {_TIMING}\nSELECT *, case when within_strong > 0 then 'strong_temporal_sync' when within_moderate >= 2 or (same_posts >= 3 and within_moderate > 0) then 'moderate_temporal_sync' when same_posts > 0 then 'weak_temporal_overlap' else 'no_temporal_sync' end as label,
            case when same_posts = 0 then 'none' when within_strong >= 2 or (same_posts >= 3 and within_moderate >= 2 and median_delay <= 90) then 'robust' when same_posts = 1 and within_strong = 1 and within_moderate = 1 then 'fragile_single_event'
            when median_delay > 120 and (within_strong > 0 or within_moderate > 0) then 'fragile_long_median' when within_strong > 0 or within_moderate > 0 then 'moderate_review' else 'weak_context' end as confidence from pt""",
            "median_delay min_delay",
        ),
        "member_pairs": f"with m as (select distinct {sql_name('seed')} as seed, {sql_name('candidate')} as candidate from expansion_members where include and {sql_valid('seed')} and {sql_valid('candidate')}) select x.seed, x.candidate as a, y.candidate as b from m x join m y on x.seed = y.seed and x.candidate < y.candidate",
        "sync_counts": f"select {sql_name('group_seed')} as seed, count(*) as pairs, " + ", ".join(f"count(*) filter (verification_label = '{v}') as n_{v}" for v in SYNC_LABELS) + f" from pair_evidence where {sql_valid('group_seed')} group by 1",
        "account_timing": f"with {_EV}, sides as (select a as account, {rank} as rank, label, delay from ev union all select b, {rank}, label, delay from ev) select account, count(*) as pairs, max(rank)::int as best_rank, max_by(label, rank) as best_label, count(*) filter (rank >= 2) as strong_pairs, min(delay) as min_delay from sides group by 1",
        "member_summary": sql_rounded(
            f"with {_F}, {_MEMBERS}\nSELECT seed, count(*) as members, count(*) filter (include) as included, " + ", ".join(f"count(*) filter (tier = {t}) as tier_{t}" for t in (0, 1, 2, 3, 4, 99)) + ", avg(coalesce(comments_per_day, 0)) as mean_comments_per_day, avg(coalesce(burst_ratio, 0)) as mean_burst, sum(coalesce(comment_count, 0)) as comments from m0 left join f on f.user_id = candidate group by 1",
            "mean_comments_per_day mean_burst comments",
        ),
        "weight_spearman": f"with {_S}, d as (select mca_score_primary as x, mca_score_alt as y from s where mca_score_primary is not null and mca_score_alt is not null), r as (select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as ry from d) select count(*) as rows, round(corr(rx, ry), 9) as rho from r",
        "top_overlap": sql_rounded(f"with {_S}, a as {top('mca_score_primary')}, b as {top('mca_score_alt')}, n as (select unnest([20, 50, 100]) as n), j as (select a.r as x, b.r as y from a full join b using (user_id))\nSELECT n::int as n, count(*) filter (x <= n and y <= n) as overlap, count(*) filter (x <= n and y <= n) / count(*) filter (x <= n or y <= n) as jaccard from j, n group by 1", "jaccard"),
        "signal_sparsity": sql_rounded(f"with {_S}, u as (" + " union all ".join(f"select '{c}' as signal, coalesce({c}, 0) as v from s" for c in SIGNALS) + ")\nSELECT signal, count(*) as rows, count(*) filter (v > 0) as positive, count(*) filter (v > 0) / count(*) as positive_share, avg(v) as mean, quantile_cont(v, 0.9) as p90, quantile_cont(v, 0.95) as p95 from u group by 1", "positive_share mean p90 p95"),
        "threshold_sweep": sql_rounded(f"with {_EV}, t as (select unnest([{', '.join(map(str, THRESHOLDS))}])::double as threshold), x as (select threshold, a, b, w from ev, t where w >= threshold), y as (select threshold, count(distinct z) as accounts from (select threshold, a as z from x union all select threshold, b from x) group by 1)\nSELECT threshold, count(*) as pairs, any_value(accounts) as accounts, avg(w) as mean_weight from x join y using (threshold) group by 1", "threshold mean_weight"),
        "activity_bins": sql_rounded(f"with {_F}, b as (select *, case when comment_count <= 0 then 0 when comment_count <= 1 then 1 when comment_count <= 3 then 2 when comment_count <= 5 then 3 when comment_count <= 10 then 4 when comment_count <= 20 then 5 when comment_count <= 50 then 6 when comment_count <= 100 then 7 else 8 end as bin from f where comment_count is not null)\nSELECT bin, count(*) as accounts, avg(burst_ratio) as mean_burst from b group by 1", "mean_burst"),
        "text_ratios": sql_rounded(f"with {P}, {ratio_sql}\nSELECT * from tx", names),
        "post_features": sql_rounded(
            f"with {C}, {P}, {ratio_sql}, fb as (select post_id, count(*) as comments, avg(score) as mean_score, min(score) as min_score, max(score) as max_score, {n_lab}, {ratios} from c where post_id is not null group by 1), j as (select tx.*, {zero} from tx left join fb using (post_id))\nSELECT *, ratio_oppositional * ln(1 + greatest(comments, 1)) as oppositional_pressure, ratio_supportive * ln(1 + greatest(comments, 1)) as supportive_pressure, ratio_oppositional * 0.65 + ratio_mixed * 0.25 + (100 - abs(mean_score)) / 100 * 0.10 as controversy from j",
            names + " mean_score min_score max_score oppositional_pressure supportive_pressure controversy " + r_lab.replace(",", ""),
        ),
        "hashed_terms": sql_rounded(f"with {P}, t as (select post_id, unnest(regexp_extract_all(lower(analysis_text), '{tok}')) as t from p), b as (select post_id, (('0x' || right(md5(t), 2))::int % 64)::int as bucket, count(*) as n from t group by 1, 2)\nSELECT post_id, bucket, n / sqrt(sum(n * n) over (partition by post_id)) as weight from b", "weight"),
        "top_terms": f"with t as (select source, unnest(regexp_extract_all(lower(text), '{tok}')) as term from documents where source is not null), n as (select source, term, count(*) as count from t where length(term) >= 3 and term not in (" + ", ".join(f"'{x}'" for x in text_features.STOP) + ") group by 1, 2) select source, term, count, row_number() over (partition by source order by count desc, term)::int as place from n qualify row_number() over (partition by source order by count desc, term) <= 12",
        "knn_embeddings": sql_rounded("with q as (select vec_id, embedding::double[] as v from embeddings where vec_id % 50 = 0), x as (select vec_id, embedding::double[] as v from embeddings), s as (select q.vec_id as query, x.vec_id as match, round(list_dot_product(q.v, x.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(x.v, x.v)) + 1e-8), 9) as similarity from q join x on q.vec_id <> x.vec_id)\nSELECT *, row_number() over (partition by query order by similarity desc, match)::int as place from s qualify row_number() over (partition by query order by similarity desc, match) <= 3", "similarity"),
        "row_positions": "select event_id, row_number() over (order by event_id) - 1 as position from events",
    }
