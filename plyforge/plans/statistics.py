"""Classification, ranking and correlation metrics; matches, ratings and verdicts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plyforge.functions import scoring
from plyforge.plans.catalogue import register
from plyforge.plans.sampling import table
from plyforge.stats import metrics, ratings

_TRUTH = "select label_id, game_id, cast(blunder as integer) t, cast(abs(coalesce(cp, 1000)) % 300 as integer) s, cast(ply as double) p, cast(loss_cp as double) l from label_rows where blunder is not null"


def judged(spark, d):
    """Labelled rows with a truth, a score to rank by, and two numbers to correlate."""
    rows = table(spark, d, "label_rows").filter("blunder is not null")
    return rows.select("label_id", "game_id", F.col("blunder").cast("int").alias("t"), (F.abs(F.coalesce("cp", F.lit(1000))) % 300).cast("int").alias("s"), F.col("ply").cast("double").alias("p"), F.col("loss_cp").cast("double").alias("l"))


def rounded(df, *names):
    return df.select([F.round(c, 6).alias(c) if c in names or not names else F.col(c) for c in df.columns])


@register(f"""
    with x as ({_TRUTH}), c as (select count(*) filter (t = 1 and s >= 150) tp, count(*) filter (t = 0 and s >= 150) fp, count(*) filter (t = 1 and s < 150) fn, count(*) filter (t = 0 and s < 150) tn from x),
    r as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0 end pr, case when tp + fn > 0 then tp / (tp + fn) else 0 end re from c)
    select tp, fp, fn, tn, round(pr, 6) "precision", round(re, 6) recall, round(case when pr + re > 0 then 2 * pr * re / (pr + re) else 0 end, 6) f1, round((tp + tn) / (tp + fp + fn + tn), 6) accuracy from r
""")
def confusion_metrics(spark, d):
    rows = judged(spark, d).withColumn("p", (F.col("s") >= 150).cast("int"))
    return rounded(metrics.confusion(rows, "t", "p"), "precision", "recall", "f1", "accuracy")


@register(f"""
    with x as ({_TRUTH}), r as (select t, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0 k from x)
    select round((sum(k) filter (t = 1) - count(*) filter (t = 1) * (count(*) filter (t = 1) + 1) / 2.0) / (count(*) filter (t = 1) * count(*) filter (t = 0)), 6) roc_auc from r
""")
def roc_auc(spark, d):
    return rounded(metrics.roc_auc(judged(spark, d), "s", "t"))


@register(f"""
    with x as ({_TRUTH}), g as (select s, count(*) n, sum(t) pos from x group by s),
    w as (select *, sum(n) over (order by s desc) seen, sum(pos) over (order by s desc) hits from g)
    select round(sum(pos * hits / seen) / sum(pos), 6) average_precision from w
""")
def average_precision(spark, d):
    return rounded(metrics.average_precision(judged(spark, d), "s", "t"))


@register(f"""
    with x as ({_TRUTH}), g as (select s, count(*) n, sum(t) pos from x group by s),
    w as (select cast(s as double) threshold, 2.0 * sum(pos) over (order by s desc) / (sum(n) over (order by s desc) + (select sum(pos) from g)) f1 from g
      union all select 150.5, 2.0 * count(*) filter (s >= 150.5 and t = 1) / (count(*) filter (s >= 150.5) + sum(t)) from x)
    select threshold, round(f1, 6) f1 from w order by w.f1 desc, threshold limit 1
""")
def best_f1_threshold(spark, d):
    return rounded(metrics.best_threshold(judged(spark, d), "s", "t", 150.5), "f1")


@register(f"""
    with x as ({_TRUTH}), y as (select p, l from x where p is not null and l is not null),
    r as (select rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0 a, rank() over (order by l) + (count(*) over (partition by l) - 1) / 2.0 b from y)
    select round((select corr(p, l) from y), 6) pearson, round((select corr(a, b) from r), 6) spearman
""")
def pearson_spearman(spark, d):
    rows = judged(spark, d).select("p", "l").dropna()
    p = rows.agg(F.round(metrics.pearson(F.col("p"), F.col("l")), 6).alias("pearson"))
    return p.crossJoin(rounded(metrics.spearman(rows, "p", "l")))  # one row each


@register(f"with x as ({_TRUTH}) select cast(floor(s / 60) as bigint) band, count(*) n, round(avg(cast((s >= 150) = (t = 1) as integer)), 6) accuracy from x group by 1")
def banded_accuracy(spark, d):
    rows = judged(spark, d)
    return rows.groupBy(F.floor(F.col("s") / 60).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(((F.col("s") >= 150) == (F.col("t") == 1)).cast("double")), 6).alias("accuracy"))


@register("select round(corr(a, b), 6) every, round(corr(a, b) filter (not mates), 6) without_mates from (select cast(ply as double) a, cast(case when mate is null then cp when mate > 0 then 10000 - mate else -10000 - mate end as double) b, mate is not null mates from label_rows) where b is not null")
def corr_two_subsets(spark, d):
    s = scoring.white_score(F.col("cp"), F.col("mate")).cast("double")
    rows = table(spark, d, "label_rows").select(F.col("ply").cast("double").alias("a"), s.alias("b"), F.col("mate").isNotNull().alias("mates")).dropna(subset=["b"])
    quiet = lambda c: F.when(~F.col("mates"), F.col(c))
    return rows.agg(F.round(F.corr("a", "b"), 6).alias("every"), F.round(F.corr(quiet("a"), quiet("b")), 6).alias("without_mates"))


@register(f"""
    with x as (select *, cast(('0x' || substr(md5('threshold:' || game_id), 1, 8)) as bigint) % 2 part, case when l >= 100 then 1 else 0 end rule from ({_TRUTH}) where game_id is not null),
    g as (select s, count(*) n, sum(t) pos from x where part = 0 group by s),
    w as (select cast(s as double) threshold, 2.0 * sum(pos) over (order by s desc) / (sum(n) over (order by s desc) + (select sum(pos) from g)) f1 from g
      union all select 150.5, 2.0 * count(*) filter (s >= 150.5 and t = 1) / (count(*) filter (s >= 150.5) + sum(t)) from x where part = 0),
    best as (select * from w order by f1 desc, threshold limit 1),
    c as (
      select count(*) filter (t = 1) pos, count(*) filter (s >= threshold) called, count(*) filter (s >= threshold and t = 1) hit,
             count(*) filter (s >= 150.5) fcalled, count(*) filter (s >= 150.5 and t = 1) fhit, count(*) filter (rule = 1) rcalled, count(*) filter (rule = 1 and t = 1) rhit, count(*) n
      from x, best where part = 1),
    k as (select t, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0 k from x where part = 1),
    auc as (select (sum(k) filter (t = 1) - count(*) filter (t = 1) * (count(*) filter (t = 1) + 1) / 2.0) / (count(*) filter (t = 1) * count(*) filter (t = 0)) v from k),
    gs as (select s, count(*) n, sum(t) pos from x where part = 1 group by s),
    ws as (select *, sum(n) over (order by s desc) seen, sum(pos) over (order by s desc) hits from gs),
    ap as (select sum(pos * hits / seen) / sum(pos) v from ws)
    select (select count(*) from x) items, (select count(*) from x where t = 1) positives, (select count(*) from x where part = 0) tune_items, n score_items, false degenerate,
      threshold, round(f1, 6) tune_f1, round(hit / called, 6) "precision", round(hit / pos, 6) recall, round(2 * hit / (called + pos), 6) f1, round(2 * fhit / (fcalled + pos), 6) f1_configured,
      round(auc.v, 6) roc_auc, round(ap.v, 6) average_precision, round(2 * rhit / (rcalled + pos), 6) f1_rule, round(100 * (2 * hit / (called + pos) - 2 * rhit / (rcalled + pos)), 6) margin
    from c, best, auc, ap
""")
def composite_measure(spark, d):
    """A detector measured at a threshold chosen on other games, beside a rule without one."""
    from plyforge.operators.ordering import salted_hash

    tune = F.conv(F.substring(salted_hash("threshold", F.col("game_id")), 1, 8), 16, 10).cast("bigint") % 2 == 0
    rows = judged(spark, d).filter("game_id is not null").withColumn("tune", tune).withColumn("rule", F.when(F.col("l") >= 100, 1).otherwise(0))
    out = metrics.detector_summary(rows, "s", "t", "rule", "tune", 150.5)
    return rounded(out, *[c for c, kind in out.dtypes if kind == "double"])


_MATCH = "select match_id, game_index, stage_a, stage_b, a_white, score, a_illegal, b_illegal from (select *, row_number() over (partition by match_id, game_index order by recorded_at, stage_a, stage_b) rk from match_games) where rk = 1 and score is not null"


def matches(spark, d):
    """One row a game with a recorded score: its first delivery."""
    first = F.min(F.struct("recorded_at", "stage_a", "stage_b", "a_white", "score", "a_illegal", "b_illegal")).alias("x")
    return table(spark, d, "match_games").groupBy("match_id", "game_index").agg(first).select("match_id", "game_index", "x.*").drop("recorded_at").filter("score is not null")


@register(f"select match_id rung, count(*) games, count(*) filter (score = 1) wins, count(*) filter (score = 0.5) draws, count(*) filter (score = 0) losses, round(avg(score), 6) score, min(stage_a) stage from ({_MATCH}) group by 1")
def rung_summary(spark, d):
    m = matches(spark, d).groupBy(F.col("match_id").alias("rung"))
    return m.agg(F.count(F.lit(1)).alias("games"), F.count_if(F.col("score") == 1).alias("wins"), F.count_if(F.col("score") == 0.5).alias("draws"), F.count_if(F.col("score") == 0).alias("losses"), F.round(F.avg("score"), 6).alias("score"), F.min("stage_a").alias("stage"))


@register(f"select match_id, a_white, round(avg(score), 6) score, cast(sum(a_illegal + b_illegal) as bigint) illegal from ({_MATCH}) where a_white is not null group by 1, 2")
def color_scores(spark, d):
    m = matches(spark, d).filter("a_white is not null").groupBy("match_id", "a_white")
    return m.agg(F.round(F.avg("score"), 6).alias("score"), F.sum((F.col("a_illegal") + F.col("b_illegal")).cast("bigint")).alias("illegal"))


_POOLED = f"""
    with m as ({_MATCH}), f as (select least(stage_a, stage_b) a, greatest(stage_a, stage_b) b, case when stage_a < stage_b then score else 1 - score end s from m where stage_a <> stage_b),
    p as (select a, b, count(*) n, avg(s) mean, var_samp(s) v from f group by 1, 2 having count(*) > 20)
"""


def pooled(spark, d):
    m = matches(spark, d).filter("stage_a <> stage_b")
    f = m.select(F.least("stage_a", "stage_b").alias("a"), F.greatest("stage_a", "stage_b").alias("b"), F.when(F.col("stage_a") < F.col("stage_b"), F.col("score")).otherwise(1 - F.col("score")).alias("s"))
    return f.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("mean"), F.var_samp("s").alias("v")).filter("n > 20")


@register(_POOLED + """
    select a, b, n, round(mean, 6) mean, round(sqrt(v / n), 6) se, round(400 * log10(mean / (1 - mean)), 4) elo, round(1.959963984540054 * sqrt(v / n) * 400 / (ln(10) * mean * (1 - mean)), 4) half_width from p where mean > 0 and mean < 1
""")
def pooled_pairs(spark, d):
    """Both directions of a pair as one score, with the delta-method interval of its rating difference."""
    p = pooled(spark, d).filter("mean > 0 and mean < 1")
    se = F.sqrt(F.col("v") / F.col("n"))
    half = F.lit(1.959963984540054) * se * 400 / (F.log(F.lit(10.0)) * F.col("mean") * (1 - F.col("mean")))
    return p.select("a", "b", "n", F.round("mean", 6).alias("mean"), F.round(se, 6).alias("se"), F.round(400 * F.log10(F.col("mean") / (1 - F.col("mean"))), 4).alias("elo"), F.round(half, 4).alias("half_width"))


@register(_POOLED + """
    , e as (select a, b, 400 * log10(mean / (1 - mean)) x, power(sqrt(v / n) * 400 / (ln(10) * mean * (1 - mean)), 2) v from p where mean > 0 and mean < 1)
    select x.a, x.b, y.b c, round(x.x + y.x - z.x, 4) residual, round(sqrt(x.v + y.v + z.v), 4) sigma from e x join e y on x.b = y.a join e z on z.a = x.a and z.b = y.b
""")
def triangle_residual(spark, d):
    """How far three pairwise differences are from adding up; one row a triangle of items that all met."""
    p = pooled(spark, d).filter("mean > 0 and mean < 1")
    e = p.select("a", "b", (400 * F.log10(F.col("mean") / (1 - F.col("mean")))).alias("x"), F.pow(F.sqrt(F.col("v") / F.col("n")) * 400 / (F.log(F.lit(10.0)) * F.col("mean") * (1 - F.col("mean"))), F.lit(2.0)).alias("v"))
    x, y, z = e.alias("x"), e.alias("y"), e.alias("z")
    t = x.join(y, F.col("x.b") == F.col("y.a")).join(z, (F.col("z.a") == F.col("x.a")) & (F.col("z.b") == F.col("y.b")))
    return t.select(F.col("x.a").alias("a"), F.col("x.b").alias("b"), F.col("y.b").alias("c"), F.round(F.col("x.x") + F.col("y.x") - F.col("z.x"), 4).alias("residual"), F.round(F.sqrt(F.col("x.v") + F.col("y.v") + F.col("z.v")), 4).alias("sigma"))


@register(f"""
    select match_id, round(case when s <= 0 then -1200 when s >= 1 then 1200 else greatest(-1200, least(1200, 400 * log10(s / (1 - s)))) end, 4) elo, round(1 / (1 + power(10, -s)), 6) expected,
      cast(case when e = 0 then 0 else ceil(3.8414588206941254 * (1 / (1 + power(10, -e / 400))) * (1 - 1 / (1 + power(10, -e / 400))) / power(1 / (1 + power(10, -e / 400)) - 0.5, 2)) end as bigint) games_needed
    from (select match_id, avg(score) s, cast(1 + match_id % 60 as double) e from ({_MATCH}) group by 1)
""")
def elo_difference(spark, d):
    m = matches(spark, d).groupBy("match_id").agg(F.avg("score").alias("s")).withColumn("e", (1 + F.col("match_id") % 60).cast("double"))
    return m.select("match_id", F.round(scoring.elo_difference(F.col("s")), 4).alias("elo"), F.round(1 / (1 + F.pow(F.lit(10.0), -F.col("s"))), 6).alias("expected"), scoring.games_for_edge(F.col("e")).alias("games_needed"))


@register()
def elo_fit(spark, d):
    """Ratings of each stage against the others' published ones, with bootstrap intervals or one-sided bounds."""
    stages = table(spark, d, "stages").select(F.col("stage").alias("stage_b"), (1200 + 50 * F.floor(F.sqrt(F.col("params_m").cast("double")))).alias("opponent_elo"))
    rows = matches(spark, d).join(F.broadcast(stages), "stage_b").select(F.col("stage_a").alias("stage"), "opponent_elo", "score")
    return ratings.estimate(rows, "stage", samples=200)


@register()
def match_intervals(spark, d):
    return ratings.match_summary(matches(spark, d), ["match_id"], samples=300)


@register("""
    with y as (select cast(year(o_orderdate) as bigint) y, avg(o_totalprice) m, stddev_samp(o_totalprice) / sqrt(count(*)) se from orders group by 1),
    c as (select y, m, m - 1.96 * se lo, m + 1.96 * se hi from y), w as (select *, lag(m) over (order by y) pm, lag(hi) over (order by y) phi from c)
    select bool_and(coalesce(m > pm, true)) monotonic, bool_and(coalesce(lo > phi, true)) separated, round(max(m) - min(m), 4) span from w
""")
def sweep_verdicts(spark, d):
    """Whether a measure rises from setting to setting, and whether neighbouring intervals are disjoint."""
    y = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.avg("o_totalprice").alias("m"), (F.stddev_samp("o_totalprice") / F.sqrt(F.count(F.lit(1)))).alias("se"))
    w = Window.orderBy("y")  # a row a setting
    c = y.withColumn("lo", F.col("m") - 1.96 * F.col("se")).withColumn("hi", F.col("m") + 1.96 * F.col("se"))
    c = c.withColumn("pm", F.lag("m").over(w)).withColumn("phi", F.lag("hi").over(w))
    yes = lambda x: F.every(F.coalesce(x, F.lit(True)))
    return c.agg(yes(F.col("m") > F.col("pm")).alias("monotonic"), yes(F.col("lo") > F.col("phi")).alias("separated"), F.round(F.max("m") - F.min("m"), 4).alias("span"))


@register("""
    with r as (select event_type, user_id, sum(value) v, row_number() over (partition by event_type order by sum(value) desc, user_id) rk from events where value is not null group by 1, 2)
    select event_type, max(user_id) filter (rk = 1) crowned, round(max(v) filter (rk = 1) - max(v) filter (rk = 2), 4) head_gap, round(sum(v) filter (v < 0.5 * m) / sum(v), 6) low_mass from (select *, avg(v) over (partition by event_type) m from r) group by 1
""")
def reward_profile(spark, d):
    """The item that reward crowns in each group, its lead, and the share of reward of items below half the mean."""
    from plyforge.operators.ordering import range_rank

    r = table(spark, d, "events").filter("value is not null").groupBy("event_type", "user_id").agg(F.sum("value").alias("v"))
    r = range_rank(r, ["event_type"], [F.col("v").desc(), "user_id"], name="rk")
    means = r.groupBy("event_type").agg(F.avg("v").alias("m"))
    at = lambda c, k: F.max(F.when(F.col("rk") == k, F.col(c)))
    low = F.sum(F.when(F.col("v") < 0.5 * F.col("m"), F.col("v")))
    return r.join(means, "event_type").groupBy("event_type").agg(at("user_id", 1).alias("crowned"), F.round(at("v", 1) - at("v", 2), 4).alias("head_gap"), F.round(low / F.sum("v"), 6).alias("low_mass"))


@register("""
    select round(avg(ln(1 + exp(-0.1 * m))), 6) loss, round(avg(cast(m > 0 as integer)), 6) accuracy, round(avg(m), 6) margin, round(avg(exp(-m / 100) - (-m / 100) - 1), 6) kl
    from (select max(l_quantity) - avg(l_quantity) - 5 m from lineitem group by l_orderkey)
""")
def preference_loss(spark, d):
    """Preference loss, accuracy and margin of pairs, and the k3 estimate of a divergence, over stored numbers."""
    m = table(spark, d, "lineitem").groupBy("l_orderkey").agg((F.max("l_quantity") - F.avg("l_quantity") - 5).alias("m"))
    r = -F.col("m") / 100
    return m.agg(F.round(F.avg(F.log(1 + F.exp(-0.1 * F.col("m")))), 6).alias("loss"), F.round(F.avg((F.col("m") > 0).cast("double")), 6).alias("accuracy"), F.round(F.avg("m"), 6).alias("margin"), F.round(F.avg(F.exp(r) - r - 1), 6).alias("kl"))


_ROUNDED = "select vec_id, embedding, list_transform(embedding, lambda x: round(x, 1)) r from embeddings"


@register(f"""
    with v as ({_ROUNDED})
    select round(avg(cast(list_position(embedding, list_max(embedding)) = list_position(r, list_max(r)) as integer)), 6) agreement, count(*) n,
      round(max(list_max(list_transform(range(1, len(embedding) + 1), lambda i: abs(embedding[i] - r[i])))), 6) max_abs_delta from v
""")
def parity_agreement(spark, d):
    """Share of vectors whose largest entry stays in place when they are rounded, and the largest change of an entry."""
    v = rounded_vectors(spark, d)
    delta = F.array_max(F.zip_with("embedding", "r", lambda a, b: F.abs(a - b)))
    return v.agg(F.round(F.avg((_top("embedding") == _top("r")).cast("double")), 6).alias("agreement"), F.count(F.lit(1)).alias("n"), F.round(F.max(delta), 6).alias("max_abs_delta"))


@register(f"""
    with v as ({_ROUNDED})
    select vec_id, list_position(embedding, list_max(embedding)) expected, list_position(r, list_max(r)) got from v
    where list_position(embedding, list_max(embedding)) <> list_position(r, list_max(r)) order by vec_id limit 20
""")
def parity_mismatches(spark, d):
    """The first 20 vectors whose largest entry moves."""
    v = rounded_vectors(spark, d).select("vec_id", _top("embedding").cast("int").alias("expected"), _top("r").cast("int").alias("got"))
    return v.filter("expected <> got").orderBy("vec_id").limit(20)


def rounded_vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "embedding", F.transform("embedding", lambda x: F.round(x, 1)).alias("r"))


def _top(c):
    return F.array_position(c, F.array_max(c))


@register(f"""
    with m as (select match_id, count(*) n, avg(score) s, sum(a_illegal) i from ({_MATCH}) group by 1), l as (select match_id, 'games' k, cast(n as double) v from m union all select match_id, 'score', s from m union all select match_id, 'illegal', cast(i as double) from m)
    select match_id, round(max(v) filter (k = 'games'), 6) games, round(max(v) filter (k = 'score'), 6) score, round(max(v) filter (k = 'illegal'), 6) illegal from l group by 1
""")
def wide_result_row(spark, d):
    """Measurements in long form to one wide row an item."""
    m = matches(spark, d).groupBy("match_id").agg(F.count(F.lit(1)).cast("double").alias("games"), F.avg("score").alias("score"), F.sum("a_illegal").cast("double").alias("illegal"))
    long = m.unpivot("match_id", ["games", "score", "illegal"], "k", "v")
    return rounded(long.groupBy("match_id").pivot("k", ["games", "score", "illegal"]).agg(F.max("v")), "games", "score", "illegal")
