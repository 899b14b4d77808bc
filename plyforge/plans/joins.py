"""Semi, anti, shifted, cast-key and theta joins; deduplication and consolidation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plyforge.functions import scoring, text
from plyforge.operators.ordering import salted_hash
from plyforge.plans.catalogue import register
from plyforge.plans.sampling import table
from plyforge.stats.metrics import discordant_pairs


@register("select e.line_id, e.depth from engine_lines e where exists (select 1 from label_rows l where l.fen = e.fen)")
def semi_join_reduce(spark, d):
    return table(spark, d, "engine_lines").select("line_id", "fen", "depth").join(table(spark, d, "label_rows").select("fen"), "fen", "left_semi").drop("fen")


@register("select distinct l.game_id from label_rows l where not exists (select 1 from games g where g.game_id = l.game_id)")
def anti_join_missing(spark, d):
    return table(spark, d, "label_rows").select("game_id").distinct().join(table(spark, d, "games").select("game_id"), "game_id", "left_anti")


@register("""
    select fen, count(*) n_seen, cast(min(label_id) as bigint) first_label, arg_min(struct_pack(g := game_id, p := ply), label_id).g game_id, arg_min(struct_pack(g := game_id, p := ply), label_id).p ply
    from label_rows group by fen
""")
def first_row_dedupe(spark, d):
    first = F.min_by(F.struct("game_id", "ply"), "label_id")
    rows = table(spark, d, "label_rows").groupBy("fen").agg(F.count(F.lit(1)).alias("n_seen"), F.min("label_id").alias("first_label"), first.alias("x"))
    return rows.select("fen", "n_seen", "first_label", "x.game_id", "x.ply")


@register("""
    select game_id, batch_no, eco from (select *, row_number() over (partition by game_id order by month_key, batch_no, ingested_at) rk from games) where rk = 1
""")
def keep_first_dedupe(spark, d):
    """One row an id, the first in a stated order; a two-phase minimum, not a window."""
    first = F.min(F.struct("month_key", "batch_no", "ingested_at", "eco"))
    return table(spark, d, "games").groupBy("game_id").agg(first.alias("x")).select("game_id", "x.batch_no", "x.eco")


def scored_lines(lines: DataFrame) -> DataFrame:
    """Lines with a score and a move: fen4, move, sign, white, cp, mate, depth, knodes."""
    sign = scoring.mover_sign(F.col("fen"))
    rows = lines.filter("line is not null and line <> '' and (cp is not null or mate is not null)")
    return rows.select(F.substring_index("fen", " ", 4).alias("fen4"), text.first_token(F.col("line")).alias("move"), sign.alias("sign"), scoring.white_score(F.col("cp"), F.col("mate")).alias("white"), "cp", "mate", "depth", "knodes", "line_id")


_RANKED = """
    with s as (
      select array_to_string(string_split(fen, ' ')[1:4], ' ') fen4, split_part(line, ' ', 1) mv, case when split_part(fen, ' ', 2) = 'w' then 1 else -1 end sign,
             case when mate is null then cp when mate > 0 then 10000 - mate else -10000 - mate end white, cp, mate, depth, knodes, line_id
      from engine_lines where line is not null and line <> '' and (cp is not null or mate is not null)),
    r as (select *, row_number() over (partition by fen4 order by coalesce(sign * mate > 0, false) desc, depth desc nulls last, sign * white desc nulls last, mv, line_id) rk from s)
"""


@register(_RANKED + "select fen4, line_id, mv as move, cast(rk as bigint) rk from r where rk <= 3")
def best_line_ranked(spark, d):
    """Three best lines a position; the rank limit is pushed below the sort's shuffle by Catalyst."""
    order = scoring.line_order(F.col("sign"), F.col("white"), F.col("mate"), F.col("depth"), F.col("move"))
    ranked = scored_lines(table(spark, d, "engine_lines")).withColumn("rk", F.row_number().over(Window.partitionBy("fen4").orderBy(*order, "line_id")).cast("bigint"))
    return ranked.filter("rk <= 3").select("fen4", "line_id", "move", "rk")


@register(_RANKED + """
    select fen4, cast(count(*) as bigint) n_lines, arg_min(struct_pack(m := mv, c := cp, x := mate, d := depth), rk).m best_move, arg_min(struct_pack(m := mv, c := cp, x := mate, d := depth), rk).c cp,
           arg_min(struct_pack(m := mv, c := cp, x := mate, d := depth), rk).x mate, arg_min(struct_pack(m := mv, c := cp, x := mate, d := depth), rk).d depth, string_agg(mv, ' ' order by rk) filter (rk <= 5) moves
    from r group by fen4
""")
def consolidated_lines(spark, d):
    """Best line and the five best moves of each position.

    Each map task keeps five lines a position before anything is collected:
    ranks within spark partitions, then over the survivors.
    """
    rows = scored_lines(table(spark, d, "engine_lines"))
    mates = F.coalesce(F.col("sign") * F.col("mate") > 0, F.lit(False))
    # ascending struct order equals the ranking order
    key = F.struct((~mates).alias("a"), (-F.coalesce(F.col("depth"), F.lit(-1))).alias("b"), (-F.col("sign") * F.col("white")).alias("c"), F.col("move"), F.col("line_id"))
    keyed = rows.withColumn("key", key).withColumn("salt", F.pmod(F.xxhash64("line_id"), F.lit(16)))
    part = keyed.withColumn("rk", F.row_number().over(Window.partitionBy("fen4", "salt").orderBy("key"))).filter("rk <= 5")
    counts = rows.groupBy("fen4").agg(F.count(F.lit(1)).alias("n_lines"))
    lists = part.groupBy("fen4").agg(F.slice(F.array_sort(F.collect_list(F.struct("key", "move", "cp", "mate", "depth"))), 1, 5).alias("pvs"))
    best = F.element_at("pvs", 1)
    out = lists.select("fen4", best.getField("move").alias("best_move"), best.getField("cp").alias("cp"), best.getField("mate").alias("mate"), best.getField("depth").alias("depth"), F.array_join(F.transform("pvs", lambda p: p["move"]), " ").alias("moves"))
    return out.join(counts, "fen4").select("fen4", "n_lines", "best_move", "cp", "mate", "depth", "moves")


@register("""
    with l as (select label_id, game_id, ply, loss, row_number() over (partition by game_id, ply order by label_id) rk from (
      select label_id, game_id, ply, case when split_part(fen, ' ', 2) = 'w' then 1 else -1 end * case when mate is null then cast(cp as bigint) when mate > 0 then 10000 - mate else -10000 - mate end loss from label_rows) where loss is not null),
    o as (select * from l where rk = 1)
    select a.label_id, a.game_id, a.ply, b.loss + a.loss loss_cp, case when b.loss is null then null else cast(b.loss + a.loss >= 100 as integer) end blunder
    from o a left join o b on a.game_id = b.game_id and a.ply = b.ply + 1
""")
def shifted_self_join(spark, d):
    """Each position against the one a ply before: what the move cost its mover.  Both sides share one shuffle by game and ply."""
    mover = scoring.mover_sign(F.col("fen")) * scoring.white_score(F.col("cp"), F.col("mate"))
    scored = table(spark, d, "label_rows").select("label_id", "game_id", "ply", mover.alias("mover")).filter("mover is not null")
    one = scored.groupBy("game_id", "ply").agg(F.min(F.struct("label_id", "mover")).alias("x")).select("game_id", "ply", "x.*")
    before = one.select("game_id", (F.col("ply") + F.lit(1).cast("smallint")).cast("smallint").alias("ply"), F.col("mover").alias("best_before"))
    loss = F.col("best_before") + F.col("mover")
    return one.join(before, ["game_id", "ply"], "left").select("label_id", "game_id", "ply", loss.alias("loss_cp"), F.when(loss.isNotNull(), (loss >= 100).cast("int")).alias("blunder"))


@register("""
    select p.puzzle_id, p.batch_no, g.eco from puzzles p join (select game_id, min(eco) eco from games group by 1) g on cast(g.game_id as varchar) = cast(p.game_id as varchar)
""")
def cast_key_join(spark, d):
    games = table(spark, d, "games").groupBy("game_id").agg(F.min("eco").alias("eco")).select(F.col("game_id").cast("string").alias("k"), "eco")
    return table(spark, d, "puzzles").withColumn("k", F.col("game_id").cast("string")).join(games, "k").select("puzzle_id", "batch_no", "eco")


@register("""
    select p.puzzle_id, p.batch_no, g.n_rows, l.n_labels from puzzles p
    left join (select game_id, count(*) n_rows from games group by 1) g using (game_id) left join (select game_id, count(*) n_labels from label_rows group by 1) l using (game_id)
""")
def attach_key_property(spark, d):
    g = table(spark, d, "games").groupBy("game_id").agg(F.count(F.lit(1)).alias("n_rows"))
    l = table(spark, d, "label_rows").groupBy("game_id").agg(F.count(F.lit(1)).alias("n_labels"))  # noqa: E741
    return table(spark, d, "puzzles").select("puzzle_id", "batch_no", "game_id").join(g, "game_id", "left").join(l, "game_id", "left").drop("game_id")


@register("""
    with g as (select * from (select *, row_number() over (partition by game_id order by batch_no, ingested_at) rk from games) where rk = 1)
    select l.label_id, array_to_string(string_split(g.uci, ' ')[1:l.ply], ' ') prefix from label_rows l join g using (game_id) where l.ply + 3 <= 60
""")
def prefix_join(spark, d):
    """The moves that led to a labelled position, where prompt and answer fit a block of 60."""
    games = table(spark, d, "games").groupBy("game_id").agg(F.min(F.struct("batch_no", "ingested_at", "uci")).alias("x")).select("game_id", "x.uci")
    rows = table(spark, d, "label_rows").select("label_id", "game_id", "ply").filter(F.col("ply").cast("int") + 3 <= 60)
    return rows.join(games, "game_id").select("label_id", text.prefix(F.col("uci"), F.col("ply").cast("int")).alias("prefix"))


@register("""
    with c as (select c_nationkey k, c_mktsegment seg, count(*) n from customer group by 1, 2)
    select a.k, a.seg seg_a, b.seg seg_b, a.n - b.n diff from c a join c b on a.k = b.k and a.seg < b.seg
""")
def unordered_pairs(spark, d):
    """Pairs of entities within a key, each pair once; entities are few by nature (segments of a nation)."""
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("seg")).agg(F.count(F.lit(1)).alias("n"))
    a, b = c.alias("a"), c.alias("b")
    return a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.seg") < F.col("b.seg"))).select(F.col("a.k").alias("k"), F.col("a.seg").alias("seg_a"), F.col("b.seg").alias("seg_b"), (F.col("a.n") - F.col("b.n")).alias("diff"))


@register("""
    with s as (select n_name, sum(s_acctbal) bal, count(*) n from supplier join nation on s_nationkey = n_nationkey group by 1)
    select count(*) inversions from s a join s b on a.n_name < b.n_name and (a.bal - b.bal) * (a.n - b.n) < 0
""")
def inversions(spark, d):
    """Pairs of nations that two measures order differently."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.sum("s_acctbal").alias("bal"), F.count(F.lit(1)).alias("n"))
    return discordant_pairs(s, "bal", "n").withColumnRenamed("pairs", "inversions")


@register("""
    with e as (select event_type, cast(ts as date) as dt, max_by(value, struct_pack(t := ts, i := event_id)) v from events group by 1, 2)
    select cast(dt as varchar) as "day", max(v) filter (event_type = 'click') click, max(v) filter (event_type = 'purchase') purchase, max(v) filter (event_type = 'view') "view" from e group by dt
""")
def series_alignment(spark, d):
    """Last value a day of several series, one row for every day of any of them."""
    last = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"))
    series = ["click", "purchase", "view"]
    return last.groupBy(F.col("day").cast("string").alias("day")).agg(*[F.max(F.when(F.col("event_type") == s, F.col("v"))).alias(s) for s in series])


@register("""
    with ranked as (select event_type, user_id, max_by(value, struct_pack(t := ts, i := event_id)) v, max(ts) last from events group by 1, 2)
    select event_type, user_id, v, cast(last as varchar) last_ts from (select *, row_number() over (partition by event_type order by last desc, user_id) rk from ranked) where rk = 1
""")
def metric_history_latest(spark, d):
    """The newest history of each type: last value of the user seen last."""
    runs = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"), F.max("ts").alias("last"))
    newest = F.max(F.struct(F.col("last"), (-F.col("user_id")).alias("u"), "user_id", "v"))
    return runs.groupBy("event_type").agg(newest.alias("x")).select("event_type", "x.user_id", "x.v", F.col("x.last").cast("string").alias("last_ts"))


@register("""
    with r as (select label_id, game_id, last_move, case when mate is null then cast(cp as bigint) when mate > 0 then 10000 - mate else -10000 - mate end s from label_rows),
    b as (select game_id, last_move best, s top from (select *, row_number() over (partition by game_id order by s desc, label_id) rk from r where s is not null) where rk = 1),
    w as (select *, row_number() over (partition by game_id order by s desc, label_id) rk from r join b using (game_id) where top - s >= 300)
    select game_id, best chosen, last_move rejected, top - s gap from w where rk = 1 and last_move <> best
""")
def preference_pairs(spark, d):
    """Best position of each game, and the first that is at least 300 worse; games are bounded in plies."""
    score = scoring.white_score(F.col("cp"), F.col("mate"))
    rows = table(spark, d, "label_rows").select("label_id", "game_id", "last_move", score.alias("s")).filter("s is not null")
    order = F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("neg"), "label_id", "last_move", "s")))
    lists = rows.groupBy("game_id").agg(order.alias("pvs")).withColumn("best", F.element_at("pvs", 1))
    worse = F.filter("pvs", lambda p: F.col("best.s") - p["s"] >= 300)
    pairs = lists.withColumn("bad", F.get(worse, F.lit(0))).filter("bad is not null and bad.last_move <> best.last_move")
    return pairs.select("game_id", F.col("best.last_move").alias("chosen"), F.col("bad.last_move").alias("rejected"), (F.col("best.s") - F.col("bad.s")).alias("gap"))


@register("""
    select game_id, round(sum(w * ln(1 + exp(-x))) / sum(w), 6) loss from (
      select a.game_id, cast(abs(a.t - b.t) as double) w, (case when a.t > b.t then 1 else -1 end) * (a.p - b.p) / 100.0 x from
        (select game_id, label_id, t, cast(ply as double) p from (select *, case when mate is null then cast(cp as bigint) when mate > 0 then 10000 - mate else -10000 - mate end t from label_rows) where t is not null) a join
        (select game_id, label_id, t, cast(ply as double) p from (select *, case when mate is null then cast(cp as bigint) when mate > 0 then 10000 - mate else -10000 - mate end t from label_rows) where t is not null) b
        on a.game_id = b.game_id and a.label_id < b.label_id and a.t <> b.t) group by 1
""")
def pairwise_rank_loss(spark, d):
    """Logistic loss over the pairs of positions of a game, weighted by the difference of their targets.

    Pairs are formed in arrays of one game, whose length its plies bound.
    """
    rows = table(spark, d, "label_rows").select("game_id", "label_id", scoring.white_score(F.col("cp"), F.col("mate")).alias("t"), F.col("ply").cast("double").alias("p")).filter("t is not null")
    lists = rows.groupBy("game_id").agg(F.array_sort(F.collect_list(F.struct("label_id", "t", "p"))).alias("xs"))
    weight = lambda a, b: F.abs(a["t"] - b["t"]).cast("double")
    margin = lambda a, b: F.when(a["t"] > b["t"], 1).otherwise(-1) * (a["p"] - b["p"]) / 100.0
    none = F.struct(F.lit(0.0).alias("loss"), F.lit(0.0).alias("weight"))
    add = lambda x, loss, weight: F.struct((x["loss"] + loss).alias("loss"), (x["weight"] + weight).alias("weight"))
    later = lambda a, i: F.aggregate(F.slice("xs", i + 2, F.size("xs")), none, lambda x, b: add(x, weight(a, b) * F.log(1 + F.exp(-margin(a, b))), weight(a, b)))
    # no pair becomes a row: a game is folded where its list is; equal targets weigh nothing
    summed = lists.select("game_id", F.aggregate(F.transform("xs", later), none, lambda x, y: add(x, y["loss"], y["weight"])).alias("x")).filter("x.weight > 0")
    return summed.select("game_id", F.round(F.col("x.loss") / F.col("x.weight"), 6).alias("loss"))


def hash_rank(df: DataFrame, by: list[str], salt: str, key: str) -> DataFrame:
    return df.withColumn("rk", F.row_number().over(Window.partitionBy(*by).orderBy(salted_hash(salt, F.col(key)), key)))
