"""Filling containers of fixed capacity, by best-two-fit.

A bin is filled greedily, largest item first; when nothing fits any more, its
smallest item is exchanged for the two unpacked items that fill the widened gap
best, if they fill it better.  These decisions depend on how many items of each
size are left and not on which items they are, and sizes are whole numbers up
to the capacity.  So the packing is worked out on the histogram of sizes, in
runs of equal bins, exactly as one bin after another would be; then each item
finds its bin by its rank among the items of its size.  The driver sees one
number a size; no task holds more than a hash bucket of a size.
"""

from __future__ import annotations

from bisect import bisect_right, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyforge.operators.ordering import grouped_rank, running_sum, salted_hash
from plyforge.session import cut_lineage


def _fill(counts: dict[int, int], sizes: list[int], capacity: int) -> tuple[dict[int, int], dict[int, int]]:
    """The next bin, by greedy filling and one exchange for two: {size: number in it}, {size: number it took to decide}."""
    used: dict[int, int] = {}
    gap, limit = capacity, len(sizes)
    while True:
        limit = bisect_right(sizes, gap, 0, limit)
        if not limit:
            break
        size = sizes[limit - 1]
        n = min(counts[size], gap // size)
        used[size] = n
        gap -= n * size
        limit -= 1
    taken = dict(used)
    if gap and used:
        small = min(used)
        room = gap + small
        left = lambda s: counts[s] - used.get(s, 0)
        best, pair = small, None
        i, j = 0, bisect_right(sizes, room) - 1
        while i <= j:
            a, b = sizes[i], sizes[j]
            if a + b > room or not left(b):
                j -= 1
            elif not left(a) or (a == b and left(a) < 2):
                i += 1
            else:
                if a + b > best:
                    best, pair = a + b, (a, b)
                i += 1
        if pair:
            used[small] -= 1
            if not used[small]:
                del used[small]
            for s in pair:
                used[s] = used.get(s, 0) + 1
                taken[s] = max(taken.get(s, 0), used[s])
    return used, taken


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Runs (number of equal bins, {size: number in each}) that pack all items of 1..capacity.

    A bin is repeated as long as all items that decided it are there: until then
    the next bin would come out the same, because nothing it could choose
    instead has been added.  Each run uses up some size, so there are a few
    runs a size, however many items there are.
    """
    counts = {s: n for s, n in histogram.items() if n and 0 < s <= capacity}
    sizes, runs = [], []
    for s in counts:
        insort(sizes, s)
    while sizes:
        used, taken = _fill(counts, sizes, capacity)
        repeat = min((counts[s] - n) // used[s] + 1 for s, n in taken.items() if s in used)
        runs.append((repeat, used))
        for s, n in used.items():
            counts[s] -= n * repeat
            if not counts[s]:
                sizes.remove(s)
    return runs


def pack_items(items: DataFrame, item: str, size: str, capacity: int, *, salt: str = "pack1") -> DataFrame:
    """(bin BIGINT, item, piece INT, tokens BIGINT): where each item goes.

    Items up to the capacity stay whole (piece 0).  A larger item is cut into
    full bins of its own, pieces 0, 1, ..., and its rest, if any, is packed like
    an item.  Items of size 0 or less, or of null size, take no room: bin is
    null.  Every row is an item of its own, also if ``item`` repeats or is null;
    which of the items of one size goes where follows the salted hash of ``item``.
    Extra columns are ignored; an empty table gives no rows.
    """
    spark = items.sparkSession
    kind = dict(items.dtypes)[item]
    rows = cut_lineage(items.select(F.col(item).alias("item"), F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("size")))
    void = rows.filter("size <= 0").select(F.lit(None).cast("bigint").alias("bin"), "item", F.lit(0).alias("piece"), F.col("size").alias("tokens"))
    full = F.expr(f"size div {capacity}")
    large = rows.filter(F.col("size") > capacity).withColumn("h", salted_hash(salt, F.col("item"), F.col("size")))
    rest = F.col("size") % capacity
    loose = (
        rows.filter(F.col("size").between(1, capacity)).select("item", F.lit(0).alias("piece"), "size")
        .unionByName(large.filter(rest > 0).select("item", full.cast("int").alias("piece"), rest.alias("size")))
    )
    histogram = {r["size"]: r.n for r in loose.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    slots, start, seen = {}, 0, {}
    for repeat, used in pack_histogram(histogram, capacity):
        for s, n in used.items():
            first = seen.get(s, 0)
            slots.setdefault(s, []).append((first, first + repeat * n, start, n))
            seen[s] = first + repeat * n
        start += repeat
    # a row a size with its few slots, so at most capacity rows; an item picks its slot and is never multiplied
    slots = spark.createDataFrame(list(slots.items()), "size bigint, slots array<struct<first: bigint, past: bigint, start: bigint, each: int>>")
    placed = grouped_rank(loose.withColumn("h", salted_hash(salt, F.col("item"), F.col("piece"))), ["size"], "h", ["item"], name="r").withColumn("r", F.col("r") - 1)
    mine = F.get(F.filter("slots", lambda x: (x["first"] <= F.col("r")) & (F.col("r") < x["past"])), F.lit(0))
    packed = placed.join(F.broadcast(slots), "size").withColumn("slot", mine).select(F.expr("slot.start + (r - slot.first) div slot.each").alias("bin"), "item", "piece", F.col("size").alias("tokens"))
    # the full bins of large items are numbered after the others
    ranked = grouped_rank(large.withColumn("one", F.lit(1)), ["one"], "h", ["item"], name="r")
    own = ranked.select(F.col("r").alias("owner"), "item", "h", F.explode(F.sequence(F.lit(0), full.cast("int") - 1)).alias("piece"), full.alias("pieces"))
    before = running_sum(ranked.withColumn("pieces", full).withColumn("bucket", F.substring("h", 1, 3)), ["one"], "bucket", ["r"], "pieces", name="upto").select(F.col("r").alias("owner"), (F.col("upto") - F.col("pieces")).alias("before"))
    own = own.join(before, "owner").select((F.lit(start) + F.col("before") + F.col("piece")).alias("bin"), "item", "piece", F.lit(capacity).cast("bigint").alias("tokens"))
    return packed.unionByName(own).unionByName(void).withColumn("item", F.col("item").cast(kind)).withColumnRenamed("item", item)


def packing_report(packed: DataFrame, capacity: int) -> DataFrame:
    """(bins, items, tokens, unused_share, least_bins): how full the bins are."""
    bins = packed.filter("bin is not null").groupBy("bin").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    total = F.coalesce(F.sum("t"), F.lit(0)).cast("bigint")
    return bins.agg(
        F.count(F.lit(1)).alias("bins"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("items"), total.alias("tokens"),
        F.when(F.count(F.lit(1)) > 0, F.round(1 - total / (F.count(F.lit(1)) * capacity), 6)).alias("unused_share"), F.ceil(total / capacity).cast("bigint").alias("least_bins"),
    )
