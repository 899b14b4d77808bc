"""Folds of evaluation facts: rating bands, answer outcomes, before/after effects, one wide row a stage."""

from __future__ import annotations

from pyspark.sql import functions as F

from plyforge.chess import frames
from plyforge.functions import scoring, text
from plyforge.plans.catalogue import register
from plyforge.plans.sampling import table
from plyforge.plans.statistics import _MATCH, matches


@register("""
    with g as (select game_id, white_elo, black_elo from (select *, row_number() over (partition by game_id order by batch_no, ingested_at) rk from games) where rk = 1),
    p as (select case when split_part(fen, ' ', 2) = 'w' then white_elo else black_elo end elo, loss_cp, blunder from label_rows join g using (game_id) where fen is not null)
    select case when elo is null then 'unrated' when elo < 1800 then '<1800' when elo >= 2600 then '2600+' else (elo // 200 * 200) || '-' || (elo // 200 * 200 + 200) end band,
      count(*) positions, round(avg(loss_cp), 4) mean_loss, count(*) filter (blunder = 1) blunders from p group by 1
""")
def mover_bands(spark, d):
    """Losses by rating band of the side to move, 200 wide with open ends; rows of unknown games are left out, of unrated sides kept apart."""
    first = F.min(F.struct("batch_no", "ingested_at", "white_elo", "black_elo")).alias("x")
    games = table(spark, d, "games").groupBy("game_id").agg(first).select("game_id", "x.white_elo", "x.black_elo")
    rows = table(spark, d, "label_rows").filter("fen is not null").select("game_id", "fen", "loss_cp", "blunder").join(games, "game_id")
    elo = F.when(scoring.turn(F.col("fen")) == "w", F.col("white_elo")).otherwise(F.col("black_elo"))
    return rows.groupBy(F.coalesce(scoring.rating_band(elo), F.lit("unrated")).alias("band")).agg(F.count(F.lit(1)).alias("positions"), F.round(F.avg("loss_cp"), 4).alias("mean_loss"), F.count_if(F.col("blunder").cast("int") == 1).alias("blunders"))


@register("""
    with r as (
      select part_file, regexp_replace(trim(fen), '\\s+', ' ', 'g') f, coalesce(nullif(regexp_replace(lower(move), '[=\\s-]', '', 'g'), ''), nullif(regexp_replace(lower(regexp_extract(line, '^\\s*(\\S+)', 1)), '[=\\s-]', '', 'g'), '')) m from engine_lines),
    o as (
      select part_file, case when m is null then 'empty' when not regexp_full_match(m, '[a-h][1-8][a-h][1-8][qrbn]?') then 'unparseable'
        when (m = 'e1h1' and contains(split_part(f, ' ', 3), 'K') or m = 'e1a1' and contains(split_part(f, ' ', 3), 'Q')) and split_part(f, ' ', 2) = 'w' then 'illegal'
        when (m = 'e8h8' and contains(split_part(f, ' ', 3), 'k') or m = 'e8a8' and contains(split_part(f, ' ', 3), 'q')) and split_part(f, ' ', 2) = 'b' then 'illegal' else 'legal' end outcome from r),
    p as (select part_file, count(*) asked, count(*) filter (outcome = 'legal') legal, count(*) filter (outcome = 'illegal') illegal, count(*) filter (outcome = 'unparseable') unparseable, count(*) filter (outcome = 'empty') empty from o group by 1)
    select *, round(legal / asked, 6) legal_rate, (select round(avg(legal / asked), 6) from p) mean_rate from p
""")
def answer_rates(spark, d):
    """What became of the answers of each source, its rate of legal ones, and the mean of these rates over the sources asked.

    An answer is a first move in coordinates; it is empty, not a move in any
    position, illegal in its position (castling written as king takes rook
    among them), or legal.
    """
    rows = frames.spread(table(spark, d, "engine_lines").select("part_file", "fen", text.plain_move(F.col("move"), F.col("line")).alias("move")))
    legal = frames.is_legal(F.col("fen"), F.col("move"))
    outcome = F.when(F.col("move").isNull(), "empty").when(~F.col("move").rlike("^[a-h][1-8][a-h][1-8][qrbn]?$"), "unparseable").when(F.col("legal"), "legal").otherwise("illegal")
    judged = rows.withColumn("legal", legal).withColumn("outcome", outcome)
    parts = judged.groupBy("part_file").agg(F.count(F.lit(1)).alias("asked"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("legal", "illegal", "unparseable", "empty")])
    rate = F.col("legal") / F.col("asked")
    mean = parts.agg(F.round(F.avg(rate), 6).alias("mean_rate"))  # one row
    return parts.withColumn("legal_rate", F.round(rate, 6)).crossJoin(F.broadcast(mean))


_FACTS = """
    with f as (select * from (select *, row_number() over (partition by match_id, game_index order by recorded_at, stage_a, stage_b) rk from match_games) where rk = 1 and score is not null),
    openings as (select stage_a stage, coalesce(opening, '?') opening, count(*) n from f group by 1, 2),
    bits as (select stage, -sum(n / total * log2(n / total)) v from (select *, sum(n) over (partition by stage) total from openings) group by 1),
    m as (select stage_a stage, avg(score) s, avg(cast(a_illegal > 0 as integer)) i from f group by 1),
    facts as (
      select stage, 'score' metric, 'percent' unit, s v from m union all select stage, 'games with illegal moves', 'percent', i from m
      union all select stage, 'difference', 'elo', case when s <= 0 then -1200 when s >= 1 then 1200 else greatest(-1200, least(1200, 400 * log10(s / (1 - s)))) end from m
      union all select stage, 'openings', 'bits', case when abs(v) < 1e-15 then 0 else v end from bits)
"""


def stage_facts(spark, d):
    """(stage, metric, unit, v): measurements of each item in long form."""
    first = F.min(F.struct("recorded_at", "stage_a", "stage_b", "score", "a_illegal", "opening")).alias("x")
    f = table(spark, d, "match_games").groupBy("match_id", "game_index").agg(first).select("x.*").filter("score is not null").withColumnRenamed("stage_a", "stage")
    m = f.groupBy("stage").agg(F.avg("score").alias("s"), F.avg((F.col("a_illegal") > 0).cast("double")).alias("i"))
    n = f.groupBy("stage", F.coalesce("opening", F.lit("?")).alias("opening")).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.col("total")
    bits = n.join(n.groupBy("stage").agg(F.sum("n").alias("total")), "stage").groupBy("stage").agg((-F.sum(share * F.log2(share))).alias("v"))
    fact = lambda metric, unit, v: F.struct(F.lit(metric).alias("metric"), F.lit(unit).alias("unit"), v.cast("double").alias("v"))
    played = m.select("stage", F.explode(F.array(fact("score", "percent", F.col("s")), fact("games with illegal moves", "percent", F.col("i")), fact("difference", "elo", scoring.elo_difference(F.col("s"))))).alias("x"))
    varied = bits.select("stage", fact("openings", "bits", F.when(F.abs("v") < 1e-15, 0.0).otherwise(F.col("v"))).alias("x"))
    return played.unionByName(varied).select("stage", "x.*")


@register(_FACTS + """
    , shown as (select *, case unit when 'percent' then printf('%.1f %%', round(v * 100, 1)) when 'elo' then printf('%.0f', round(v)) else printf('%.4f bits', round(v, 4)) end cell from facts where v is not null)
    select a.stage, b.stage base_stage, a.metric, b.cell base, a.cell adapted from shown a join shown b on a.metric = b.metric
    where starts_with(a.stage, b.stage || '-') and b.stage in (select stage from stages) and a.stage in (select stage from stages)
""")
def effect_rows(spark, d):
    """Each metric of a base item and of the ones adapted from it, in cells with their units; a metric missing on a side has no row."""
    listed = table(spark, d, "stages").select("stage").dropna().distinct()
    facts = stage_facts(spark, d).join(listed, "stage", "left_semi").filter("v is not null")
    shown = facts.select("stage", "metric", text.unit_cell(F.col("v"), F.col("unit")).alias("cell"))
    base = shown.select(F.col("stage").alias("base_stage"), F.col("metric"), F.col("cell").alias("base"))
    # the base's name is the item's without its last part, so pairs meet by equality
    adapted = shown.withColumn("base_stage", F.explode(text.name_prefixes(F.col("stage"))))
    return adapted.join(base, ["base_stage", "metric"]).select("stage", "base_stage", "metric", "base", F.col("cell").alias("adapted"))


@register(f"""
    with m as ({_MATCH}), x as (select stage_a stage, coalesce(family, 'other') family, score, a_illegal from m left join stages on stage = stage_b),
    cells as (select stage, family, printf('%.1f %%', round(avg(score) * 100, 1)) c from x group by 1, 2),
    whole as (select stage, count(*) games, printf('%.1f %%', round(avg(score) * 100, 1)) score, printf('%.1f %%', round(avg(cast(a_illegal > 0 as integer)) * 100, 1)) illegal from x group by 1)
    select stage, coalesce(games, 0) games, coalesce(score, 'n/a') score, coalesce(illegal, 'n/a') illegal,
      {", ".join(f"coalesce(max(c) filter (cells.family = '{f}'), 'n/a') as vs_{f}" for f in ("heron", "otter", "lynx", "ibex", "marten", "wolf"))}
    from (select stage, params_m from stages) left join whole using (stage) left join cells using (stage) group by all
""".replace("group by all", "group by stage, games, score, illegal"))
def stage_rows(spark, d):
    """One wide row a stage: games, score, illegal games, and its score against each family; ``n/a`` where nothing was measured."""
    stages = table(spark, d, "stages").select("stage", "family")
    families = sorted(r.family for r in stages.select("family").dropna().distinct().collect())  # a few names
    x = matches(spark, d).select(F.col("stage_a").alias("stage"), "stage_b", "score", "a_illegal").join(F.broadcast(stages.select(F.col("stage").alias("stage_b"), "family")), "stage_b", "left")
    whole = x.groupBy("stage").agg(F.count(F.lit(1)).alias("games"), F.avg("score").alias("s"), F.avg((F.col("a_illegal") > 0).cast("double")).alias("i"))
    cells = x.groupBy("stage").pivot("family", families).agg(F.avg("score"))
    rows = stages.select("stage").join(whole, "stage", "left").join(cells, "stage", "left")
    return rows.select("stage", F.coalesce("games", F.lit(0)).alias("games"), text.percent(F.col("s")).alias("score"), text.percent(F.col("i")).alias("illegal"), *[text.percent(F.col(f)).alias(f"vs_{f}") for f in families])


@register("select label_id, game_id, ply from label_rows where lower(trim(split)) in ('val', 'valid', 'validation', 'dev')")
def split_filter(spark, d):
    """Rows of one recorded split, however it is spelled."""
    return table(spark, d, "label_rows").filter(F.lower(F.trim("split")).isin("val", "valid", "validation", "dev")).select("label_id", "game_id", "ply")


@register("""
    select game_id, batch_no, '[WhiteElo "' || coalesce(cast(white_elo as varchar), '?') || '"]' || chr(10) || '[BlackElo "' || coalesce(cast(black_elo as varchar), '?') || '"]' || chr(10) || '[Result "' || coalesce(result, '*') || '"]' header, cast(utc_date as date) played from games
""")
def game_headers(spark, d):
    """Header text of each game with missing ratings as ``?``, and its date read back from the way headers write it."""
    elo = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    written = F.coalesce(F.date_format("utc_date", "yyyy.MM.dd"), F.lit("????.??.??"))
    return table(spark, d, "games").select("game_id", "batch_no", text.headers(elo("white_elo"), elo("black_elo"), F.coalesce("result", F.lit("*"))).alias("header"), text.parse_date(written).alias("played"))
