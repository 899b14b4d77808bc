"""Mixing sources to target weights, by weighted fair queueing.

The documents of a source are put in shuffled order; a document's virtual finish
time is the tokens of its source up to and with it, divided by the source's
weight.  Taking documents by finish time serves every source at its weight at
any moment.  A source that is used up begins again, at most max_repeats times in
all; one that may not is simply served no more, and the others share what it
leaves.  The queue ends where the next document would pass the total budget.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyforge.operators.ordering import running_sum, salted_hash
from plyforge.session import cut_lineage

#: Documents of a mix that share a bin of virtual time on average, which is what one task sorts, and the fewest bins.
BIN_ROWS, LEAST_BINS = 2_000, 256


def source_name(column: Column) -> Column:
    """Plain lower-case source name; blanks and dashes are underscores."""
    return F.regexp_replace(F.lower(F.regexp_replace(column, r"^\s+|\s+$", "")), r"[\s-]+", "_")


def source_totals(sizes: DataFrame) -> DataFrame:
    """(source, docs, tokens, largest) of rows (source, tokens)."""
    return sizes.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("tokens"), F.coalesce(F.max("tokens"), F.lit(0)).cast("bigint").alias("largest"))


def _valid(targets: DataFrame) -> DataFrame:
    """One row a (mix, source): weights of repeated rows add up, the other fields are the largest; no null names, no weight of 0 or less."""
    rows = targets.select("mix_name", source_name(F.col("source")).alias("source"), F.col("source").alias("source_as_given"), "weight", "max_repeats", "budget_tokens").filter("mix_name is not null and source is not null and weight > 0")
    return rows.groupBy("mix_name", "source").agg(F.sum("weight").alias("weight"), F.coalesce(F.max("max_repeats"), F.lit(1)).alias("max_repeats"), F.coalesce(F.max("budget_tokens"), F.lit(0)).alias("budget_tokens"), F.min("source_as_given").alias("source_as_given"))


def _documents(sizes: DataFrame) -> DataFrame:
    """(doc_id, source, tokens): the documents that a mix may use, each once."""
    return sizes.filter("doc_id is not null and source is not null and tokens > 0").groupBy("doc_id").agg(F.min(F.struct("source", "tokens")).alias("x")).select("doc_id", "x.*")


def supply_report(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, source, source_as_given, share_tokens, available_tokens, short) of each target row.

    ``share_tokens`` is the source's part of the budget by weight,
    ``available_tokens`` all its tokens times max_repeats; ``short`` is less
    available than the share.  A sum only, for ``mix_report`` to check the queue by.
    """
    rows = _valid(targets)
    whole = rows.groupBy("mix_name").agg(F.sum("weight").alias("all"), F.max("budget_tokens").alias("budget"))
    # targets are a row a source and mix
    joined = rows.join(F.broadcast(whole), "mix_name").join(F.broadcast(source_totals(_documents(sizes)).join(F.broadcast(rows.select("source").distinct()), "source", "left_semi")), "source", "left")
    share = F.col("budget") * F.col("weight") / F.col("all")
    have = F.coalesce("tokens", F.lit(0)) * F.col("max_repeats")
    return joined.select("mix_name", "source", "source_as_given", F.round(share, 6).alias("share_tokens"), have.cast("bigint").alias("available_tokens"), (have < share - 1e-6).alias("short"))


def _horizon(rows: list, budget: int) -> float:
    """Virtual time by which the budget is served, counting tokens as if documents could be divided."""
    ends = sorted((r["cap"] / r["weight"], r["weight"]) for r in rows if r["cap"] > 0)
    served, time, rate = 0.0, 0.0, sum(w for _, w in ends)
    for end, w in ends:
        if served + (end - time) * rate >= budget:
            return time + (budget - served) / rate
        served, time, rate = served + (end - time) * rate, end, rate - w
    return time


def mix_documents(sizes: DataFrame, targets: DataFrame, *, salt: str = "mix1", bins: int | None = None) -> DataFrame:
    """(mix_name, position, source, doc_id, pass, tokens, finish): the mixes, in order.

    ``sizes`` has doc_id, source (plain) and tokens; documents without tokens,
    id or source are left out (they add nothing to a share).  A repeated doc_id
    is one document.  Documents of a source are shuffled by salted hash, the
    same in every pass; equal finish times follow source, pass and id.  ``pass``
    counts from 1 to at most max_repeats.  A row is part of the mix if all
    tokens up to and with it fit the budget.
    Sources, mixes and bins are summed up before anything is sorted, so a task
    sees a hash bucket of a source or a time bin of a mix, never either whole;
    there are as many bins as the largest mix has use for (see ``BIN_ROWS``).
    """
    spark = sizes.sparkSession
    docs = cut_lineage(_documents(sizes))
    plan = _valid(targets)
    totals = source_totals(docs).join(F.broadcast(plan.select("source").distinct()), "source", "left_semi")
    have = {r.source: r for r in totals.collect()}  # a row a source that a target names
    by_mix: dict[str, list[dict]] = {}
    for r in plan.collect():
        if r.source in have:
            t = have[r.source]
            by_mix.setdefault(r.mix_name, []).append({"mix_name": r.mix_name, "source": r.source, "weight": float(r.weight), "max": int(r.max_repeats), "total": int(t.tokens), "largest": int(t.largest), "docs": int(t.docs), "cap": int(t.tokens) * int(r.max_repeats), "budget": int(r.budget_tokens)})
    rows, most = [], 0
    for mix in by_mix.values():
        budget = max(r["budget"] for r in mix)
        # no document may finish later than this and still be within the budget
        slack = sum(r["largest"] for r in mix) / min(r["weight"] for r in mix)
        until = _horizon(mix, budget) * (1 + 1e-9) + slack
        most = max(most, sum(int(min(r["max"], until * r["weight"] / r["total"]) * r["docs"]) for r in mix))
        for r in mix:
            passes = min(r["max"], int(until * r["weight"] / r["total"]) + 1)
            if passes > 0 and budget > 0:
                rows.append((r["mix_name"], r["source"], r["weight"], passes, r["total"], budget, until))
    queue = spark.createDataFrame(rows, "mix_name string, source string, weight double, passes int, total bigint, budget bigint, until double")
    named = docs.join(F.broadcast(queue.select("source").distinct()), "source", "left_semi").withColumn("h", salted_hash(salt, F.col("doc_id"))).withColumn("bucket", F.substring("h", 1, 3))
    summed = running_sum(named, ["source"], "bucket", ["h", "doc_id"], "tokens", name="upto").select("doc_id", "source", "tokens", "upto")
    bins = bins or max(LEAST_BINS, most // BIN_ROWS)
    # only the passes that end within the horizon are made into rows
    last = F.least(F.col("passes"), F.floor((F.col("until") * F.col("weight") - F.col("upto")) / F.col("total")).cast("int") + 1)
    served = summed.join(F.broadcast(queue), "source").withColumn("last", last).filter("last > 0")
    served = served.withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("last")))).withColumn("finish", ((F.col("pass") - 1) * F.col("total") + F.col("upto")) / F.col("weight"))
    served = served.withColumn("bin", F.floor(F.col("finish") / F.col("until") * bins).cast("int"))
    served = cut_lineage(served.select("mix_name", "source", "doc_id", "pass", "tokens", "finish", "bin", "budget").withColumn("one", F.lit(1)))
    order = ["finish", "source", "pass", "doc_id"]
    kept = running_sum(served, ["mix_name"], "bin", order, "tokens", name="upto").filter("upto <= budget").drop("upto_total")
    placed = running_sum(kept, ["mix_name"], "bin", order, "one", name="position")
    return placed.select("mix_name", "position", "source", "doc_id", "pass", "tokens", "finish").repartitionByRange("mix_name", "position").sortWithinPartitions("mix_name", "position")


def mix_report(mixed: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, source, source_as_given, target_share, actual_share, tokens, uses, most_repeats, short) of each target row.

    A source is ``short`` if the queue has served every document of it
    max_repeats times and its share was not reached.  The queue serves a source
    that cannot reach its share whole before the budget ends, so the plain sum
    of its supply must say the same; the report fails if it does not.
    """
    got = cut_lineage(mixed.groupBy("mix_name", "source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"), F.max("pass").alias("most_repeats")))
    whole = got.groupBy("mix_name").agg(F.sum("tokens").alias("all"))
    rows = _valid(targets)
    weights = rows.groupBy("mix_name").agg(F.sum("weight").alias("weights"), F.max("budget_tokens").alias("budget"))
    supply = supply_report(sizes, targets).select("mix_name", "source", "available_tokens", F.col("short").alias("supply_short"))
    out = rows.join(F.broadcast(weights), "mix_name").join(got, ["mix_name", "source"], "left").join(whole, "mix_name", "left").join(supply, ["mix_name", "source"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    dry = (zero("tokens") == F.col("available_tokens")) & (zero("most_repeats") == F.when(F.col("available_tokens") > 0, F.col("max_repeats")).otherwise(0))
    short = dry & (zero("tokens") < F.col("budget") * F.col("weight") / F.col("weights") - 1e-6)
    checked = F.when(short == F.col("supply_short"), short).otherwise(F.raise_error(F.concat(F.lit("queue and supply differ: "), F.col("mix_name"), F.lit(" "), F.col("source"))).cast("boolean"))
    return out.select("mix_name", "source", "source_as_given", F.round(F.col("weight") / F.col("weights"), 6).alias("target_share"), F.round(F.coalesce(zero("tokens") / F.col("all"), F.lit(0.0)), 6).alias("actual_share"), zero("tokens").cast("bigint").alias("tokens"), zero("uses").cast("bigint").alias("uses"), zero("most_repeats").alias("most_repeats"), checked.alias("short"))
