"""Sampling, splitting and balancing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plyforge.operators.ordering import salted_hash
from plyforge.plans.catalogue import register


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@register("""
    select band, count(*) n, cast(sum(o_orderkey) as bigint) keys from (
      select cast(floor(o_totalprice / 50000) as bigint) band, o_orderkey,
             row_number() over (partition by floor(o_totalprice / 50000) order by md5('42:' || o_orderkey), o_orderkey) rk
      from orders where o_totalprice is not null) where rk <= 300 group by band
""")
def stratified_cap(spark, d):
    banded = table(spark, d, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") / 50000).alias("band")).filter("band is not null")
    ranked = banded.withColumn("rk", F.row_number().over(Window.partitionBy("band").orderBy(salted_hash("42", F.col("o_orderkey")), "o_orderkey")))
    return ranked.filter("rk <= 300").groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


def ranked(df, by, salt, *key):
    """Adds ``rk``: the place within ``by`` by salted hash of the key."""
    order = [salted_hash(salt, *[F.col(k) for k in key]), *key]
    return df.withColumn("rk", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


@register("""
    select bin, game_id, batch_no from (
      select *, row_number() over (partition by bin order by md5('42:' || game_id), game_id, batch_no) rk from (
        select game_id, batch_no, cast(((white_elo + black_elo) // 2) // 100 * 100 as bigint) bin from games where white_elo is not null and black_elo is not null))
    where bin between 1700 and 2300 and rk <= 25
""")
def elo_bins(spark, d):
    """Flat sample: at most n games of each rating bin, by a hash of seed and id together."""
    mean = F.expr("((cast(white_elo as int) + cast(black_elo as int)) div 2) div 100 * 100")
    rows = table(spark, d, "games").select("game_id", "batch_no", mean.alias("bin")).filter(F.col("bin").between(1700, 2300))
    order = [salted_hash("42", F.col("game_id")), "game_id", "batch_no"]
    return rows.withColumn("rk", F.row_number().over(Window.partitionBy("bin").orderBy(*order))).filter("rk <= 25").select("bin", "game_id", "batch_no")


@register("""
    select puzzle_id, band, case when rk <= 40 then 'test' else 'train' end part from (
      select *, row_number() over (partition by band order by md5('s:' || puzzle_id), puzzle_id) rk from (
        select puzzle_id, case when r < 1000 then null when r < 1500 then '1000-1500' when r < 2000 then '1500-2000' else '2000+' end band from (
          select puzzle_id, arg_max(struct_pack(r := rating), struct_pack(b := batch_no, i := ingested_at)).r r from puzzles group by 1)) where band is not null)
    where rk <= 140
""")
def band_test_train_split(spark, d):
    """Per band the first 40 by stable key are test, the next 100 train, the rest is dropped."""
    latest = table(spark, d, "puzzles").groupBy("puzzle_id").agg(F.max_by(F.struct("rating"), F.struct("batch_no", "ingested_at")).getField("rating").alias("r"))
    band = F.when(F.col("r") < 1000, None).when(F.col("r") < 1500, "1000-1500").when(F.col("r") < 2000, "1500-2000").when(F.col("r").isNotNull(), "2000+")
    rows = ranked(latest.withColumn("band", band).filter("band is not null"), ["band"], "s", "puzzle_id").filter("rk <= 140")
    return rows.select("puzzle_id", "band", F.when(F.col("rk") <= 40, "test").otherwise("train").alias("part"))


@register("""
    with c as (select o_orderstatus s, count(*) n from orders group by 1), m as (select least(min(n), 300) k from c)
    select o_orderstatus status, o_orderkey from (select *, row_number() over (partition by o_orderstatus order by md5('b:' || o_orderkey), o_orderkey) rk from orders), m where rk <= k
""")
def phase_balance(spark, d):
    """As many rows of each group as the smallest has, at most 300; one group without rows empties the result."""
    orders = table(spark, d, "orders")
    cap = orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).agg(F.least(F.min("n"), F.lit(300)).alias("k"))  # one row
    rows = ranked(orders.select("o_orderstatus", "o_orderkey"), ["o_orderstatus"], "b", "o_orderkey")
    return rows.filter("rk <= 300").crossJoin(F.broadcast(cap)).filter("rk <= k").select(F.col("o_orderstatus").alias("status"), "o_orderkey")


@register("""
    with t as (select count(*) n from documents), r as (select doc_id, row_number() over (order by md5('42:' || doc_id), doc_id) rk from documents)
    select f.f as fraction, count(*) n, cast(sum(doc_id) as bigint) ids from r, t, (values (0.1), (0.25), (0.5), (1.0)) f(f) where rk <= greatest(1, round_even(n * f.f, 0)) group by 1
""")
def nested_fractions(spark, d):
    """Nested subsets by one hash order: each fraction contains the smaller ones.

    The global rank is made of hash buckets and their offsets, not of one sort.
    """
    from plyforge.operators.ordering import grouped_rank

    docs = table(spark, d, "documents").select("doc_id", F.lit(1).alias("one")).withColumn("h", salted_hash("42", F.col("doc_id")))
    rows = grouped_rank(docs, ["one"], "h", ["doc_id"], name="r")
    take = F.explode(F.array(*[F.lit(x) for x in (0.1, 0.25, 0.5, 1.0)]))
    long = rows.select("doc_id", "r", "r_total", take.alias("fraction")).filter(F.col("r") <= F.greatest(F.lit(1.0), F.bround(F.col("r_total") * F.col("fraction"), 0)))
    return long.groupBy("fraction").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


@register("select o_orderkey from orders order by md5('9:' || o_orderkey), o_orderkey limit 500")
def seeded_row_sample(spark, d):
    return table(spark, d, "orders").select("o_orderkey").orderBy(salted_hash("9", F.col("o_orderkey")), "o_orderkey").limit(500)


@register("select band, puzzle_id, batch_no from (select coalesce(trim(band), '') band, puzzle_id, batch_no, row_number() over (partition by coalesce(trim(band), '') order by md5('p:' || puzzle_id), puzzle_id, batch_no) rk from puzzles) where rk <= 20")
def per_band_sample(spark, d):
    rows = table(spark, d, "puzzles").select(F.coalesce(F.trim("band"), F.lit("")).alias("band"), "puzzle_id", "batch_no")
    order = [salted_hash("p", F.col("puzzle_id")), "puzzle_id", "batch_no"]
    return rows.withColumn("rk", F.row_number().over(Window.partitionBy("band").orderBy(*order))).filter("rk <= 20").drop("rk")


@register("""
    select game_id, batch_no, cut, array_to_string(string_split(uci, ' ')[1:cut], ' ') prefix from (
      select game_id, batch_no, uci, 1 + cast(('0x' || substr(md5('c:' || game_id), 1, 8)) as bigint) % (n_plies - 1) cut from games where n_plies > 1)
""")
def random_cut_point(spark, d):
    """One seeded ply of each game and the moves before it."""
    from plyforge.functions.text import prefix

    draw = F.conv(F.substring(salted_hash("c", F.col("game_id")), 1, 8), 16, 10).cast("bigint")
    rows = table(spark, d, "games").filter("n_plies > 1").withColumn("cut", 1 + draw % (F.col("n_plies").cast("bigint") - 1))
    return rows.select("game_id", "batch_no", "cut", prefix(F.col("uci"), F.col("cut").cast("int")).alias("prefix"))


@register("select game_id, batch_no, case when rk <= 50 then 'val' else 'train' end part from (select game_id, batch_no, month_key, row_number() over (partition by month_key order by md5('h:' || game_id), game_id, batch_no) rk from games where month_key >= '2025-01')")
def holdout_by_month(spark, d):
    """The first 50 games of a month by hash validate, the rest trains."""
    rows = table(spark, d, "games").filter("month_key >= '2025-01'").select("game_id", "batch_no", "month_key")
    from plyforge.operators.ordering import grouped_rank

    rows = grouped_rank(rows.withColumn("h", salted_hash("h", F.col("game_id"))), ["month_key"], "h", ["game_id", "batch_no"], name="rk")
    return rows.select("game_id", "batch_no", F.when(F.col("rk") <= 50, "val").otherwise("train").alias("part"))


@register("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100 offset 50")
def holdout_offset_limit(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").offset(50).limit(100)


@register("select doc_id, cast(row_number() over (order by md5('e3:' || doc_id), doc_id) - 1 as bigint) as place, cast((row_number() over (order by md5('e3:' || doc_id), doc_id) - 1) // 64 as bigint) batch from documents")
def hash_shuffle(spark, d):
    """Seeded order of an epoch and the batch of each row, ranked by hash buckets."""
    from plyforge.operators.ordering import grouped_rank

    docs = table(spark, d, "documents").select("doc_id", F.lit(1).alias("one")).withColumn("h", salted_hash("e3", F.col("doc_id")))
    place = F.col("r") - 1
    return grouped_rank(docs, ["one"], "h", ["doc_id"], name="r").select("doc_id", place.alias("place"), F.expr("(r - 1) div 64").alias("batch"))


@register("select game_id, case when cast(('0x' || substr(md5('s1:' || game_id), 1, 8)) as bigint) % 1000000 < 100000 then 'val' else 'train' end part from (select distinct game_id from label_rows where game_id is not null)")
def split_by_entity(spark, d):
    """Split as a pure function of the entity: no shuffle but the distinct."""
    draw = F.conv(F.substring(salted_hash("s1", F.col("game_id")), 1, 8), 16, 10).cast("bigint") % 1_000_000
    return table(spark, d, "label_rows").select("game_id").dropna().distinct().select("game_id", F.when(draw < 100_000, "val").otherwise("train").alias("part"))


@register()
def split_by_crc(spark, d):
    """The same by crc32, with the stable row order and the threshold half; SQL engines lack crc32."""
    from plyforge.functions import ids

    rows = table(spark, d, "label_rows").select("game_id", "ply").dropna().distinct()
    return rows.select("game_id", "ply", ids.entity_split(F.col("game_id"), 42, 0.1).alias("part"), ids.row_key(42, F.col("game_id"), F.col("ply")).alias("row_order"), ids.half(F.col("game_id"), 42).alias("half"))


@register()
def stable_u64_split(spark, d):
    from plyforge.functions import ids

    rows = table(spark, d, "puzzles").select("puzzle_id").distinct().withColumn("k", ids.stable_u64(F.col("puzzle_id")))
    return rows.withColumn("part", F.when(F.substring("k", 1, 1) < "2", "test").otherwise("train"))
