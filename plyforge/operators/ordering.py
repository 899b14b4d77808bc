"""Exact ranks, bottom-k and running sums that never put a whole group into one task.

A window partitioned by a group sorts that group in a single task.  Here each
group is first cut into buckets whose order is known (the leading digits of a
uniform hash, or a range of the order key), bucket totals are summed by an
ordinary two-phase aggregation, and only rows of one bucket meet in a task.
With hash buckets the digits follow the size of the table (``hash_digits``):
a bucket holds some thousand rows of the largest group, and the window over
bucket totals sees a row a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plyforge.session import cut_lineage


def salted_hash(salt: str, *columns: Column) -> Column:
    """32 hex digits of md5 over ``salt:col:col``; uniform, and the same in any engine."""
    return F.md5(F.concat_ws(":", F.lit(salt), *[c.cast("string") for c in columns]))


#: Rows that one hash bucket of a group may hold on average, and the digits tried.
BUCKET_ROWS, DIGITS = 4_000, (2, 3, 4, 5)


def hash_digits(df: DataFrame) -> int:
    """Leading hex digits that cut even a single group of all rows into buckets of at most ``BUCKET_ROWS``.

    Counts the rows once; at most 16 ** 5 buckets, which holds for 4e9 rows a
    group and keeps larger buckets at a sortable size far beyond that.
    """
    n = df.count()
    return next((k for k in DIGITS if n <= BUCKET_ROWS * 16**k), DIGITS[-1])


def _bucket_offsets(df: DataFrame, group: Sequence[str], bucket: str, amount: Column, name: str) -> DataFrame:
    """Total of ``amount`` in the earlier buckets of the group, and in the whole group."""
    totals = df.groupBy(*group, bucket).agg(F.sum(amount).alias("__amount"))
    earlier = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)],
        F.col(bucket).alias("__b"),
        F.coalesce(F.sum("__amount").over(earlier), F.lit(0)).cast("bigint").alias(name),
        F.sum("__amount").over(Window.partitionBy(*group)).cast("bigint").alias(f"{name}_total"),
    )


def _attach(df: DataFrame, offsets: DataFrame, group: Sequence[str], bucket: str) -> DataFrame:
    on = F.col(bucket).eqNullSafe(F.col("__b"))
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return df.join(offsets, on, "inner").drop("__b", *[f"__g{i}" for i in range(len(group))])


def grouped_rank(df: DataFrame, group: Sequence[str], hash_col: str, ties: Sequence[str] = (), *, name: str = "rank", digits: int | None = None) -> DataFrame:
    """Adds ``name``: the 1-based place of each row in its group by (hash_col, ties).

    ``hash_col`` holds hex digits, uniformly spread.  Null group values form a
    group of their own.  ``<name>_total`` is the size of the group.
    """
    keyed = df.withColumn("__bucket", F.substring(hash_col, 1, digits or hash_digits(df.select(hash_col))))
    offsets = _bucket_offsets(keyed, group, "__bucket", F.lit(1), "__before")
    local = F.row_number().over(Window.partitionBy(*group, "__bucket").orderBy(hash_col, *ties))
    out = _attach(keyed, offsets, group, "__bucket").withColumn(name, F.col("__before") + local)
    return out.withColumnRenamed("__before_total", f"{name}_total").drop("__bucket", "__before")


def bottom_k(df: DataFrame, group: Sequence[str], hash_col: str, k: Column, ties: Sequence[str] = (), *, digits: int | None = None, rank: str | None = None) -> DataFrame:
    """The ``k`` rows of each group that are smallest by (hash_col, ties), with their place as ``rank`` if that is named.

    ``k`` may use the columns of ``df`` and ``group_size``.  Buckets beyond the
    k-th row are dropped before any sort, so the sort sees little more than k.
    """
    keyed = df.withColumn("__bucket", F.substring(hash_col, 1, digits or hash_digits(df.select(hash_col))))
    offsets = _bucket_offsets(keyed, group, "__bucket", F.lit(1), "__before")
    near = _attach(keyed, offsets, group, "__bucket").withColumnRenamed("__before_total", "group_size").withColumn("__k", k)
    near = near.filter(F.col("__before") < F.col("__k"))
    local = F.row_number().over(Window.partitionBy(*group, "__bucket").orderBy(hash_col, *ties))
    kept = near.withColumn("__n", F.col("__before") + local).filter("__n <= __k").drop("__bucket", "__before", "__k")
    return kept.withColumnRenamed("__n", rank) if rank else kept.drop("__n")


def running_sum(df: DataFrame, group: Sequence[str], bucket: str, order: Sequence[Column | str], amount: str, *, name: str = "running") -> DataFrame:
    """Adds the inclusive sum of ``amount`` in group order, and ``<name>_total``.

    ``bucket`` must be a non-decreasing function of ``order`` within a group and
    keep few rows each; rows equal in ``order`` need a unique last key.
    """
    offsets = _bucket_offsets(df, group, bucket, F.coalesce(F.col(amount), F.lit(0)), "__before")
    local = F.sum(F.coalesce(F.col(amount), F.lit(0))).over(Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return _attach(df, offsets, group, bucket).withColumn(name, F.col("__before") + local).withColumnRenamed("__before_total", f"{name}_total").drop("__before")


def range_running_sum(df: DataFrame, order: Sequence[Column | str], amount: str, *, group: Sequence[str] = (), name: str = "running", partitions: int | None = None) -> DataFrame:
    """Adds the inclusive sum of ``amount`` in the given order, over all rows or within each group, and ``<name>_total``.

    Rows are put in ranges of (group, order) (sampled bounds, so a range holds
    about an equal part of the rows whatever their distribution), written once,
    and summed by range and then within it: no task sees more than a range.
    Rows that are equal in the whole order share a range and are taken one after
    the other.  Null amounts count as 0.
    """
    ranged = df.repartitionByRange(partitions, *group, *order) if partitions else df.repartitionByRange(*group, *order)
    ranged = cut_lineage(ranged.withColumn("__range", F.spark_partition_id()))
    return running_sum(ranged, list(group), "__range", order, amount, name=name).drop("__range")


def range_rank(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], *, name: str = "rank") -> DataFrame:
    """Adds ``name``: the 1-based place of each row in its group by any order, a group being spread over ranges of it."""
    return range_running_sum(df.withColumn("__one", F.lit(1)), order, "__one", group=group, name=name).drop("__one", f"{name}_total")


def previous_row(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, *, name: str = "previous") -> DataFrame:
    """Adds ``name``: the ``value`` of the row before in the group, by ``order``; null for a group's first row.

    Rows are put in ranges of (group, order); a row looks back within its range,
    and the first of a group in a range takes the last of that group in an
    earlier range.  A group of any size is spread over as many ranges as it
    fills.  Nulls sort first; rows equal in the whole order come in any order.
    """
    ranged = cut_lineage(df.repartitionByRange(*group, *order).withColumn("__range", F.spark_partition_id()))
    within = Window.partitionBy("__range", *group).orderBy(*order)
    placed = ranged.withColumn("__local", F.lag(F.struct(F.col(value).alias("v"))).over(within))
    # a row a range and group that lies in it
    last = ranged.groupBy("__range", *group).agg(F.max(F.struct(*order, F.col(value).alias("__v"))).getField("__v").alias("__v"))
    earlier = F.lag(F.struct(F.col("__v").alias("v"))).over(Window.partitionBy(*group).orderBy("__range"))
    before = last.withColumn("__before", earlier).filter("__before is not null").select(F.col("__range").alias("__r"), *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], "__before")
    same = F.col("__range") == F.col("__r")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    joined = placed.join(before, same & F.col("__local").isNull(), "left")
    return joined.withColumn(name, F.coalesce("__local", "__before").getField("v")).drop("__range", "__local", "__r", "__before", *[f"__g{i}" for i in range(len(group))])
