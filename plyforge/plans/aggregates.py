"""Counts, shares, summaries, conditional folds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plyforge.functions import scoring
from plyforge.plans.catalogue import register
from plyforge.plans.sampling import table
from plyforge.stats import metrics


@register("select eco, count(*) n, round(100.0 * count(*) / sum(count(*)) over (), 6) pct from games where eco is not null group by eco")
def percent_of_total(spark, d):
    n = table(spark, d, "games").filter("eco is not null").groupBy("eco").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@register("""
    select source, count(*) n, round(avg(len), 6) mean, quantile_cont(len, 0.05) p5, quantile_cont(len, 0.5) p50, quantile_cont(len, 0.95) p95, max(len) longest, round(avg(cast(len <= 512 as integer)), 6) share_short
    from (select source, length(text) len from documents) group by source
""")
def length_summary(spark, d):
    docs = table(spark, d, "documents").select("source", F.length("text").alias("len"))
    p = lambda x: F.percentile("len", F.lit(x))
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("len"), 6).alias("mean"), p(0.05).alias("p5"), p(0.5).alias("p50"), p(0.95).alias("p95"), F.max("len").cast("bigint").alias("longest"), F.round(F.avg((F.col("len") <= 512).cast("double")), 6).alias("share_short"))


@register("select eco, count(*) n, round(100 * avg(cast(result = '1-0' as integer)), 6) white_pct from games where eco is not null and result is not null group by eco order by n desc, eco limit 10")
def top_groups_share(spark, d):
    g = table(spark, d, "games").filter("eco is not null and result is not null")
    return g.groupBy("eco").agg(F.count(F.lit(1)).alias("n"), F.round(100 * F.avg((F.col("result") == "1-0").cast("double")), 6).alias("white_pct")).orderBy(F.col("n").desc(), "eco").limit(10)


@register("""
    select count(*) as "rows", count(*) filter (n_chars = length(text)) exact, count(*) filter (n_chars is null) missing, count(*) filter (author is null) anonymous, round(count(*) filter (game_id is not null) / count(*), 4) coverage from documents
""")
def conversion_counters(spark, d):
    c = table(spark, d, "documents")
    return c.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("n_chars") == F.length("text")).alias("exact"), F.count_if(F.col("n_chars").isNull()).alias("missing"), F.count_if(F.col("author").isNull()).alias("anonymous"), F.round(F.count("game_id") / F.count(F.lit(1)), 4).alias("coverage"))


@register("select split, count(*) n, count(blunder) labelled, count(*) filter (blunder = 1) blunders from label_rows group by split")
def label_counts(spark, d):
    return table(spark, d, "label_rows").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count("blunder").alias("labelled"), F.count_if(F.col("blunder") == 1).alias("blunders"))


@register("select k.k as phase, coalesce(n, 0) n from (values ('opening'), ('middlegame'), ('endgame'), ('adjourned')) k(k) left join (select phase, count(*) n from label_rows group by 1) c on c.phase = k.k")
def zero_filled_counts(spark, d):
    keys = spark.createDataFrame([("opening",), ("middlegame",), ("endgame",), ("adjourned",)], "phase string")
    n = table(spark, d, "label_rows").groupBy("phase").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(keys).join(n, "phase", "left").select("phase", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


@register("select o_orderstatus status, count(distinct o_custkey) customers, count(*) n from orders where o_totalprice > 1000 group by 1")
def distinct_counts(spark, d):
    return table(spark, d, "orders").filter("o_totalprice > 1000").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count_distinct("o_custkey").alias("customers"), F.count(F.lit(1)).alias("n"))


@register("select string_split(uci, ' ')[2] reply, count(*) n from games where uci is not null and n_plies >= 2 group by 1")
def position_histogram(spark, d):
    return table(spark, d, "games").filter("uci is not null and n_plies >= 2").groupBy(F.get(F.split("uci", " "), F.lit(1)).alias("reply")).agg(F.count(F.lit(1)).alias("n"))


@register("select user_id, count(*) filter (event_type = 'click') click, count(*) filter (event_type = 'purchase') purchase, count(*) filter (event_type = 'view') \"view\", round(count(*) filter (event_type = 'click') / count(*), 6) click_rate from events group by user_id")
def outcome_pivot(spark, d):
    kinds = ["click", "purchase", "view"]
    e = table(spark, d, "events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in kinds], F.count(F.lit(1)).alias("n"))
    return e.select("user_id", *kinds, F.round(F.col("click") / F.col("n"), 6).alias("click_rate"))


@register("select p_brand brand, max(p_retailprice) - min(p_retailprice) spread from part where p_size in (1, 50) group by 1 having count(distinct p_size) = 2")
def run_spread(spark, d):
    p = table(spark, d, "part").filter(F.col("p_size").isin(1, 50)).groupBy(F.col("p_brand").alias("brand"))
    return p.agg((F.max("p_retailprice") - F.min("p_retailprice")).alias("spread"), F.count_distinct("p_size").alias("k")).filter("k = 2").drop("k")


@register("""
    select event_type, grouping(event_type) as total, count(*) n, round(avg(cast(value > 50 as integer)), 6) rate from events where value is not null group by rollup (event_type)
""")
def band_rates_rollup(spark, d):
    """Rate of each group and of all, in one pass."""
    e = table(spark, d, "events").filter("value is not null")
    return e.rollup("event_type").agg(F.grouping("event_type").cast("bigint").alias("total"), F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("value") > 50).cast("double")), 6).alias("rate"))


@register("select user_id, case when count(distinct event_type) = 1 then min(event_type) else 'mixed' end style from events group by user_id")
def style_mixed(spark, d):
    kinds = F.collect_set("event_type")
    return table(spark, d, "events").groupBy("user_id").agg(F.when(F.size(kinds) == 1, F.array_min(kinds)).otherwise("mixed").alias("style"))


@register("with c as (select event_type, count(*) n from events group by 1), t as (select sum(n) t from c) select round(-sum(n / t * log2(n / t)), 6) entropy from c, t")
def shannon_entropy(spark, d):
    return metrics.entropy_bits(table(spark, d, "events"), "event_type").select(F.round("entropy", 6).alias("entropy"))


@register("select first_moves, n from (select array_to_string(string_split(uci, ' ')[1:4], ' ') first_moves, count(*) n from games where uci is not null group by 1) order by n desc, first_moves limit 5")
def top_lines(spark, d):
    lines = table(spark, d, "games").filter("uci is not null").groupBy(F.substring_index("uci", " ", 4).alias("first_moves")).agg(F.count(F.lit(1)).alias("n"))
    return lines.orderBy(F.col("n").desc(), "first_moves").limit(5)


@register("select l_shipmode_like, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) weighted, round(avg(l_discount), 6) plain from (select l_returnflag l_shipmode_like, l_discount, l_quantity from lineitem) group by 1")
def weighted_mean_metric(spark, d):
    l = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("l_shipmode_like"))  # noqa: E741
    return l.agg(F.round(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity"), 6).alias("weighted"), F.round(F.avg("l_discount"), 6).alias("plain"))


@register("""
    select l_orderkey, l_linenumber, round(case when sd < 1e-12 then 0 else (q - m) / (sd + 1e-4) end, 6) advantage, round(greatest(0, 1 - (best - q) / 50), 6) quality from (
      select l_orderkey, l_linenumber, l_quantity q, avg(l_quantity) over w m, stddev_pop(l_quantity) over w sd, max(l_quantity) over w best from lineitem window w as (partition by l_orderkey))
""")
def group_advantages(spark, d):
    rows = metrics.group_advantages(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q")), "l_orderkey", "q")
    best = F.max("q").over(Window.partitionBy("l_orderkey"))
    return rows.select("l_orderkey", "l_linenumber", F.round("advantage", 6).alias("advantage"), F.round(F.greatest(F.lit(0.0), 1 - (best - F.col("q")) / 50), 6).alias("quality"))


@register("select round(avg(cast(k = 1 as integer)), 6) flat_share, count(*) groups from (select l_orderkey, count(distinct l_returnflag) k from lineitem group by 1)")
def flat_groups(spark, d):
    k = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_returnflag").alias("a"), F.max("l_returnflag").alias("b"))
    return k.agg(F.round(F.avg((F.col("a") == F.col("b")).cast("double")), 6).alias("flat_share"), F.count(F.lit(1)).alias("groups"))


@register("""
    select phase, round(avg(tanh(s / 400.0)), 5) mean_value, count(*) filter (b = 0) lost, count(*) filter (b = 2) even, count(*) filter (b = 4) won, count(*) filter (result_class = 0) white_wins from (
      select *, case when s >= 200 then 4 when s >= 50 then 3 when s >= -50 then 2 when s >= -200 then 1 else 0 end b from (
        select phase, result_class, case when mate is null then cast(cp as bigint) when mate > 0 then 10000 - mate else -10000 - mate end s from label_rows) where s is not null and result_class is not null) group by phase
""")
def value_labels(spark, d):
    s = scoring.white_score(F.col("cp"), F.col("mate"))
    rows = table(spark, d, "label_rows").withColumn("s", s).filter("s is not null").dropna(subset=["result_class"])
    b = scoring.value_bucket(F.col("s"))
    return rows.groupBy("phase").agg(F.round(F.avg(F.tanh(F.col("s") / 400.0)), 5).alias("mean_value"), F.count_if(b == 0).alias("lost"), F.count_if(b == 2).alias("even"), F.count_if(b == 4).alias("won"), F.count_if(F.col("result_class") == 0).alias("white_wins"))
