"""Results tables, memo tables, catalogues, manifests, ingestion, subword training."""

from __future__ import annotations

from pyspark.sql import functions as F

from plyforge.plans.catalogue import register
from plyforge.plans.sampling import table
from plyforge.sources import results
from plyforge.sources.manifest import size_class


@register("select n_nationkey k, case when n_regionkey = 2 then upper(n_name) || '!' else n_name end as label from nation union all select 100 + r_regionkey, r_name from region")
def results_upsert(spark, d):
    old = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("label"))
    new = table(spark, d, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("k"), F.concat(F.upper("n_name"), F.lit("!")).alias("label"))
    more = table(spark, d, "region").select((100 + F.col("r_regionkey")).alias("k"), F.col("r_name").alias("label"))
    return results.upsert(old, new.unionByName(more), "k")


@register("select r_regionkey, r_name from region where r_name not in ('ASIA', 'EUROPE')")
def results_drop(spark, d):
    return results.drop_rows(table(spark, d, "region").select("r_regionkey", "r_name"), "r_name", ["ASIA", "EUROPE"])


@register("select s source, n as \"rows\", case when n < 1000 then 'n<1K' when n < 10000 then '1K<n<10K' when n < 100000 then '10K<n<100K' else '100K<n<1M' end size_class from (select source s, count(*) n from documents where lang is distinct from 'und' group by 1)")
def manifest_counts(spark, d):
    n = table(spark, d, "documents").filter(~F.col("lang").eqNullSafe("und")).groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    return n.select("source", "rows", size_class(F.col("rows")).alias("size_class"))


@register("""
    with memo as (select user_id, event_type, max(value) v from events where event_id % 3 = 0 group by 1, 2), items as (select distinct user_id, event_type from events)
    select count(*) items, count(m.user_id) hits, count(*) - count(m.user_id) misses from items i left join memo m on i.user_id = m.user_id and i.event_type is not distinct from m.event_type
""")
def cache_hits_misses(spark, d):
    events = table(spark, d, "events")
    keys = ["user_id", "event_type"]
    memo = events.filter("event_id % 3 = 0").groupBy(*keys).agg(F.max("value").alias("v"))
    items = events.select(*keys).distinct()
    done = results.with_memo(items, memo, keys, lambda missing: missing.withColumn("v", F.lit(None).cast("double")).withColumn("miss", F.lit(True)).drop("miss"))
    missing = results.missing_items(items, memo, keys).agg(F.count(F.lit(1)).alias("misses"))
    return done.agg(F.count(F.lit(1)).alias("items")).crossJoin(missing).select("items", (F.col("items") - F.col("misses")).alias("hits"), "misses")


@register("select puzzle_id, batch_no from puzzles where list_contains(themes, 'endgame') or band in ('2000+', '1500-2000')")
def catalogue_filter(spark, d):
    return table(spark, d, "puzzles").filter(F.array_contains("themes", "endgame") | F.col("band").isin("2000+", "1500-2000")).select("puzzle_id", "batch_no")


@register("select g.game_id, g.batch_no, md5(g.site) = md5(o.site) or g.uci = o.uci as matches from games g join (select * from (select *, row_number() over (partition by game_id order by batch_no, ingested_at) rk from games) where rk = 1) o using (game_id) where g.site is not null")
def provenance_check(spark, d):
    """Whether the contents recorded for an id agree with those of its first delivery."""
    games = table(spark, d, "games")
    first = games.groupBy("game_id").agg(F.min(F.struct("batch_no", "ingested_at", "site", "uci")).alias("x")).select("game_id", F.col("x.site").alias("s"), F.col("x.uci").alias("u"))
    return games.filter("site is not null").join(first, "game_id").select("game_id", "batch_no", ((F.md5("site") == F.md5("s")) | (F.col("uci") == F.col("u"))).alias("matches"))


@register("select source, count(*) n from documents where doc_id % 2 = 1 group by 1")
def incremental_missing(spark, d):
    """Items not yet processed, against a table of processed ones."""
    docs = table(spark, d, "documents")
    done = docs.filter("doc_id % 2 = 0").select("doc_id")
    return results.missing_items(docs, done, ["doc_id"]).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@register("""
    select regexp_replace(word, '[^a-z]', '', 'g') token, cast(count(*) as bigint) n from (select unnest(string_split(lower(text), ' ')) word from documents) where length(regexp_replace(word, '[^a-z]', '', 'g')) >= 8 group by 1 order by length(token) desc, token limit 50
""")
def longest_tokens(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.split(F.lower("text"), " ")).alias("w")).select(F.regexp_replace("w", "[^a-z]", "").alias("token")).filter(F.length("token") >= 8)
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.length("token").desc(), "token").limit(50)


@register()
def bpe_train(spark, d):
    """Merges of a byte-pair vocabulary over the moves of all games, in order."""
    from plyforge.functions.bpe import train_bpe

    words = table(spark, d, "games").filter("uci is not null").select(F.explode(F.split("uci", " ")).alias("word"))
    return spark.createDataFrame([(i, a, b, a + b) for i, (a, b) in enumerate(train_bpe(words, "word", 200))], "rank int, left string, right string, token string")
