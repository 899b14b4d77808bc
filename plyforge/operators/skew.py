"""Equi-joins of many rows with one row a key, where a key may hold a third of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hot keys looked for: so many times the shuffle partitions, and never more than the second figure (their list is broadcast, 16 bytes each).
KEYS_PER_PARTITION, MOST_KEYS = 4, 20_000


def hot_keys(rows: DataFrame, keys: Sequence[str], *, least: int = 1000) -> DataFrame:
    """(__hot, __salts): hashes of the keys that hold more rows than a part, and the parts to cut them into.

    A part is a quarter of what a shuffle partition holds on average, ``least``
    rows at the smallest, so it follows the rows and the partitions.  The keys
    are found by a sketch of bounded size in one pass, without a shuffle of the
    rows; a key it overrates is cut for nothing, which changes no result.  Rows
    with a null key do not count.
    """
    parts = KEYS_PER_PARTITION * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    k = min(parts, MOST_KEYS)
    sketch = rows.select(*keys).dropna().select(F.xxhash64(*keys).alias("__hot")).agg(F.expr(f"approx_top_k(__hot, {k}, {16 * k})").alias("__top"), F.count(F.lit(1)).alias("__n"))
    part = F.greatest(F.col("__n") / parts, F.lit(float(least)))
    found = sketch.select(F.explode("__top").alias("__x"), part.alias("__part"))
    return found.filter(F.col("__x.count") > F.col("__part")).select(F.col("__x.item").alias("__hot"), F.ceil(F.col("__x.count") / F.col("__part")).cast("int").alias("__salts"))


def salted_lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str], *, how: str = "left", spread: str | None = None) -> DataFrame:
    """``rows`` joined with ``table``, which has one row a key.

    Hot keys (see ``hot_keys``) are looked for first; they are few by
    definition, so their list may be broadcast at any size.  Rows of a hot key
    are spread over its salts, by ``spread`` or at random, and the table's row
    of that key is repeated as often; all others join once.  Where no key is
    hot this is the plain join.  Null keys find nothing, as in a plain join.
    ``rows`` are read once to find hot keys and once to be joined, so give a
    table or something written out.
    """
    keys = list(keys)
    found = hot_keys(rows, keys).collect()
    if not found:
        return rows.join(table, keys, how)
    hot = F.broadcast(rows.sparkSession.createDataFrame(found, "__hot bigint, __salts int"))
    spread_by = F.xxhash64(spread) if spread else F.floor(F.rand(7) * 1e9).cast("bigint")
    salt = F.when(F.col("__salts").isNotNull(), F.pmod(spread_by, F.col("__salts")).cast("int")).otherwise(0)
    left = rows.withColumn("__hot", F.xxhash64(*keys)).join(hot, "__hot", "left").withColumn("__salt", salt).drop("__hot", "__salts")
    repeated = F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))
    right = table.withColumn("__hot", F.xxhash64(*keys)).join(hot, "__hot", "left").withColumn("__salt", repeated).drop("__hot", "__salts")
    return left.join(right, [*keys, "__salt"], how).drop("__salt")
