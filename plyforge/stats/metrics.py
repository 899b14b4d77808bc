"""Classification, ranking and correlation metrics as aggregations and windows.

Ranks and cumulative counts run over distinct scores, not over rows: rows are
first summed by score, in two phases, and the scores are put in ranges, so no
task holds all of them even where every row has a score of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plyforge.operators.ordering import range_running_sum, running_sum
from plyforge.session import cut_lineage


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, accuracy; rows with a null are left out, a zero division is 0."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    c = df.dropna(subset=[truth, predicted]).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    precision, recall = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = c.withColumn("precision", precision).withColumn("recall", recall)
    return out.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn("accuracy", _ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))


def by_score(df: DataFrame, score: str, truth: str) -> DataFrame:
    """(score, pos, n, pos_above, n_above, pos_all, n_all): sums of each distinct score, of those down to it, highest first, and of all."""
    sums = df.dropna(subset=[score, truth]).groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count(F.lit(1)).alias("n"))
    order = [F.col("score").desc()]
    ranged = cut_lineage(sums.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    for amount in ("pos", "n"):
        ranged = running_sum(ranged, [], "__range", order, amount, name=f"{amount}_above").withColumnRenamed(f"{amount}_above_total", f"{amount}_all")
    return ranged.drop("__range")


def roc_auc(df: DataFrame, score: str, truth: str) -> DataFrame:
    """(roc_auc): the share of (positive, negative) pairs in order, ties half; null without both classes."""
    s = by_score(df, score, truth).withColumn("neg_below", (F.col("n_all") - F.col("pos_all")) - (F.col("n_above") - F.col("pos_above")))
    agg = s.agg(F.sum(F.col("pos") * (F.col("neg_below") + (F.col("n") - F.col("pos")) / 2)).alias("u"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    return agg.select(F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("u") / (F.col("p") * F.col("q"))).alias("roc_auc"))


def average_precision(df: DataFrame, score: str, truth: str) -> DataFrame:
    """(average_precision): precision at each score times the recall it adds; ties are one step."""
    s = by_score(df, score, truth)
    agg = s.agg(F.sum(F.col("pos") * F.col("pos_above") / F.col("n_above")).alias("a"), F.sum("pos").alias("p"))
    return agg.select(F.when(F.col("p") > 0, F.col("a") / F.col("p")).alias("average_precision"))


def best_threshold(df: DataFrame, score: str, truth: str, configured: float | None = None) -> DataFrame:
    """(threshold, f1): the score from which predicting 1 gives the best F1; of equals the lowest.

    A configured threshold takes part.
    """
    s = by_score(df, score, truth)
    total = s.agg(F.sum("pos").alias("total"))
    f1 = _ratio(2.0 * F.col("pos_above"), F.col("n_above") + F.col("total"))
    rows = s.crossJoin(F.broadcast(total)).select(F.col("score").cast("double").alias("threshold"), f1.alias("f1"))
    if configured is not None:
        kept = df.dropna(subset=[score, truth])
        hit = kept.agg((2.0 * F.count_if((F.col(score) >= configured) & (F.col(truth) == 1))).alias("a"), (F.count_if(F.col(score) >= configured) + F.count_if(F.col(truth) == 1)).alias("b"))
        rows = rows.unionByName(hit.select(F.lit(float(configured)).alias("threshold"), _ratio(F.col("a"), F.col("b")).alias("f1")))
    return rows.orderBy(F.col("f1").desc(), "threshold").limit(1)


def average_ranks(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """Adds the average rank of each value; ties share the mean of their places, nulls have none."""
    sums = df.groupBy(F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n")).filter("__v is not null")
    summed = range_running_sum(sums, ["__v"], "__n", name="__upto")
    ranks = summed.select("__v", (F.col("__upto") - F.col("__n") + (F.col("__n") + 1) / 2).alias(name))
    return df.join(ranks, F.col(value) == F.col("__v"), "left").drop("__v")


def pearson(a: Column, b: Column) -> Column:
    """Aggregate; null for fewer than two pairs or a constant."""
    return F.nanvl(F.corr(a, b), F.lit(None).cast("double"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """(spearman)"""
    both = df.select(a, b).dropna()
    ranked = average_ranks(average_ranks(both, a, "ra"), b, "rb")
    return ranked.agg(pearson(F.col("ra"), F.col("rb")).alias("spearman"))


def discordant_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """(pairs): the pairs of rows that ``a`` and ``b`` order differently; ties in either and nulls do not count.

    Two rows differ first in one bit of their dense ranks by ``b``.  So for each
    bit the rows are grouped by the bits above it and taken by ``a``; a row with
    bit 0 is discordant with the rows before it that have bit 1.  A row becomes
    one row a bit of the largest rank, not one row a partner.
    """
    rows = cut_lineage(df.select(a, b).dropna())
    ranks = range_running_sum(rows.select(F.col(b).alias("__v")).distinct().withColumn("__one", F.lit(1)), ["__v"], "__one", name="__rank").select("__v", "__rank")
    placed = rows.join(ranks, F.col(b) == F.col("__v")).select(F.col(a).alias("__a"), "__rank")
    top = ranks.agg(F.coalesce(F.max("__rank"), F.lit(0))).first()[0]
    bits = placed.withColumn("__bit", F.explode(F.sequence(F.lit(0), F.lit(max(int(top).bit_length() - 1, 0)))))
    bits = bits.withColumn("__above", F.expr("shiftright(__rank, __bit + 1)")).withColumn("__set", F.expr("shiftright(__rank, __bit) & 1"))
    seen = range_running_sum(bits, ["__a", "__rank"], "__set", group=["__bit", "__above"], name="__ones")
    return seen.filter("__set = 0").agg(F.coalesce(F.sum("__ones"), F.lit(0)).alias("pairs"))


def entropy_bits(df: DataFrame, key: str) -> DataFrame:
    """(entropy): Shannon entropy of the counts of a key, never -0."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    e = n.crossJoin(F.broadcast(total)).agg((-F.sum(p * F.log2(p))).alias("e"))
    return e.select(F.when(F.abs("e") < 1e-15, 0.0).otherwise(F.col("e")).alias("entropy"))


def group_advantages(df: DataFrame, group: str, reward: str, eps: float = 1e-4) -> DataFrame:
    """Adds (reward - mean) / (population deviation + eps) of the group; 0 in a flat group."""
    w = Window.partitionBy(group)
    mean, sd = F.avg(reward).over(w), F.stddev_pop(reward).over(w)
    return df.withColumn("advantage", F.when(sd < 1e-12, 0.0).otherwise((F.col(reward) - mean) / (sd + eps)))


def agreement(df: DataFrame, a: str, b: str) -> list[Column]:
    """Aggregates: share of equal values."""
    return [F.avg((F.col(a) == F.col(b)).cast("double")).alias("agreement")]


def detector_summary(df: DataFrame, score: str, truth: str, baseline: str, tune: str, configured: float) -> DataFrame:
    """One row with all that is said of a detector, beside a rule without a threshold.

    Rows where ``tune`` holds choose the threshold with the best F1; precision,
    recall, F1 (tuned and configured), ranking metrics and the rule's F1 are
    measured on the others.  If a half lacks a class, no rows can be held back:
    the threshold is chosen and measured on all rows, and ``degenerate`` says
    so.  Rows with a null score, truth or baseline are left out.  Columns:
    items, positives, tune_items, score_items, degenerate, threshold, tune_f1,
    precision, recall, f1, f1_configured, roc_auc, average_precision, f1_rule,
    margin (in points of F1).
    """
    rows = cut_lineage(df.select(score, truth, baseline, tune).dropna())
    positive, half = F.col(truth) == 1, F.col(tune)
    counts = rows.agg(F.count(F.lit(1)).alias("items"), F.count_if(positive).alias("positives"), *[F.count_if(h & c).alias(n) for n, h, c in (("tp", half, positive), ("tn", half, ~positive), ("sp", ~half, positive), ("sn", ~half, ~positive))]).first()
    degenerate = not (counts.tp and counts.tn and counts.sp and counts.sn)
    tuned, held = (rows, rows) if degenerate else (rows.filter(half), rows.filter(~half))
    best = best_threshold(tuned, score, truth, configured).first()
    threshold, tune_f1 = (best.threshold, best.f1) if best else (configured, 0.0)
    call = lambda column: F.coalesce(column, F.lit(False)).cast("int")
    judged = held.withColumn("__tuned", call(F.col(score) >= threshold)).withColumn("__fixed", call(F.col(score) >= configured))
    parts = [confusion(judged, truth, c).select(*[F.col(x).alias(f"{p}{x}") for x in ("precision", "recall", "f1")]) for c, p in (("__tuned", ""), ("__fixed", "fixed_"), (baseline, "rule_"))]
    head = [(int(counts["items"]), int(counts["positives"]), int(counts["items"] if degenerate else counts["tp"] + counts["tn"]), int(counts["items"] if degenerate else counts["sp"] + counts["sn"]), degenerate, float(threshold), float(tune_f1))]
    out = rows.sparkSession.createDataFrame(head, "items bigint, positives bigint, tune_items bigint, score_items bigint, degenerate boolean, threshold double, tune_f1 double")
    for part in (*parts, roc_auc(held, score, truth), average_precision(held, score, truth)):
        out = out.crossJoin(F.broadcast(part))  # one row each
    return out.select("items", "positives", "tune_items", "score_items", "degenerate", "threshold", "tune_f1", "precision", "recall", "f1", F.col("fixed_f1").alias("f1_configured"), "roc_auc", "average_precision", F.col("rule_f1").alias("f1_rule"), (100 * (F.col("f1") - F.col("rule_f1"))).alias("margin"))
