"""Corpus filters, guarded casts, unions by month, reason codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from plyforge.functions import scoring, text
from plyforge.plans.catalogue import register
from plyforge.plans.sampling import table


def corpus_rows(games, min_elo: int = 1800, min_base: int = 180, max_elo: int | None = None, terminations=None, without_event: str | None = None):
    """Rated standard games: both ratings and the base time at least so high, ended in one of ``terminations``, of no event that names ``without_event``.

    The last two need the columns ``termination`` and ``event`` and are left out
    where they are not asked for; case does not count in an event.  A null fails
    its test, so a game without an event is dropped as well.
    """
    keep = (F.col("white_elo") >= min_elo) & (F.col("black_elo") >= min_elo) & (text.base_time(F.col("time_control")) >= min_base)
    if max_elo:
        keep = keep & (F.col("white_elo") <= max_elo) & (F.col("black_elo") <= max_elo)
    if terminations is not None:
        keep = keep & F.col("termination").isin(list(terminations))
    if without_event is not None:
        keep = keep & ~F.col("event").ilike(f"%{without_event}%")
    return games.filter(keep)


@register("""
    select game_id, white_elo, black_elo, time_control, 'corpus' as part from games
    where white_elo >= 1800 and black_elo >= 1800 and result in ('1-0', '0-1', '1/2-1/2')
      and regexp_matches(split_part(time_control, '+', 1), '^\\s*[+-]?[0-9]{1,9}\\s*$')
      and try_cast(trim(split_part(time_control, '+', 1)) as integer) >= 180
""")
def corpus_filter(spark, d):
    return corpus_rows(table(spark, d, "games").filter(F.col("result").isin("1-0", "0-1", "1/2-1/2"))).select("game_id", "white_elo", "black_elo", "time_control", F.lit("corpus").alias("part"))


@register("""
    with e as (select game_id, min(nullif(regexp_extract(text, '\\[Event "([^"]*)"\\]', 1), '')) event from documents where game_id is not null group by 1)
    select game_id, batch_no, white_elo, black_elo, event, result termination from games left join e using (game_id)
    where white_elo >= 1500 and black_elo >= 1500 and white_elo <= 2700 and black_elo <= 2700 and regexp_matches(split_part(time_control, '+', 1), '^\\s*[+-]?[0-9]{1,9}\\s*$')
      and try_cast(trim(split_part(time_control, '+', 1)) as integer) >= 60 and result in ('1-0', '0-1') and not (event ilike '%blitz%')
""")
def corpus_by_event(spark, d):
    """The whole corpus filter: ratings within bounds, base time, decisive ending, and no blitz event; the event is the one a game's document names."""
    event = F.nullif(F.regexp_extract("text", r'\[Event "([^"]*)"\]', 1), F.lit(""))
    named = table(spark, d, "documents").filter("game_id is not null").groupBy("game_id").agg(F.min(event).alias("event"))
    games = table(spark, d, "games").withColumn("termination", F.col("result")).join(named, "game_id", "left")
    return corpus_rows(games, 1500, 60, 2700, ("1-0", "0-1"), "blitz").select("game_id", "batch_no", "white_elo", "black_elo", "event", "termination")


@register("""
    select o_orderkey, case when regexp_matches(split_part(o_orderpriority, '-', 1), '^\\s*[0-9]+\\s*$') then cast(split_part(o_orderpriority, '-', 1) as integer) end base
    from orders where o_totalprice >= 200000 and not (o_orderpriority ilike '%low%')
""")
def try_cast_base(spark, d):
    o = table(spark, d, "orders").filter((F.col("o_totalprice") >= 200000) & ~F.col("o_orderpriority").ilike("%low%"))
    return o.select("o_orderkey", text.safe_int(F.split_part("o_orderpriority", F.lit("-"), F.lit(1))).alias("base"))


@register("""
    select '2024-01' as part, game_id, eco from games where month_key = '2024-01'
    union all select '2024-02', game_id, eco from games where month_key = '2024-02'
    union all select '2024-03', game_id, eco from games where month_key = '2024-03'
""")
def month_union_all(spark, d):
    games = table(spark, d, "games")
    parts = [games.filter(F.col("month_key") == m).select(F.lit(m).alias("part"), "game_id", "eco") for m in ("2024-01", "2024-02", "2024-03")]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


@register("""
    select puzzle_id, rating, batch_no, cast(row_number() over (partition by rating // 500 order by nb_plays desc nulls last, puzzle_id, batch_no) - 1 as bigint) place
    from puzzles where rating_deviation <= 100 and nb_plays >= 100 and rating >= 1000
""")
def quality_filter(spark, d):
    from plyforge.operators.ordering import range_rank

    kept = table(spark, d, "puzzles").filter("rating_deviation <= 100 and nb_plays >= 100 and rating >= 1000").select("puzzle_id", "rating", "batch_no", "nb_plays", F.expr("rating div 500").alias("band"))
    ranked = range_rank(kept, ["band"], [F.col("nb_plays").desc_nulls_last(), "puzzle_id", "batch_no"], name="rk")
    return ranked.select("puzzle_id", "rating", "batch_no", (F.col("rk") - 1).cast("bigint").alias("place"))


@register("""
    select reason, count(*) n, cast(sum(coalesce(n_plies, 0)) as bigint) plies from (
      select n_plies, case when result is null or result not in ('1-0', '0-1', '1/2-1/2') then 'illegal' when n_plies is null then 'unknown'
                           when n_plies < 40 then 'short' when n_plies > 90 then 'long' else 'kept' end reason from games) group by reason
""")
def range_reason_codes(spark, d):
    known = F.coalesce(F.col("result").isin("1-0", "0-1", "1/2-1/2"), F.lit(False))
    reason = F.when(~known, "illegal").when(F.col("n_plies").isNull(), "unknown").when(F.col("n_plies") < 40, "short").when(F.col("n_plies") > 90, "long").otherwise("kept")
    return table(spark, d, "games").withColumn("reason", reason).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.col("n_plies").cast("bigint"), F.lit(0))).alias("plies"))


@register("""
    select line_id, sign, case when mate is null then cast(cp as bigint) when mate > 0 then 10000 - mate else -10000 - mate end white,
           sign * case when mate is null then cast(cp as bigint) when mate > 0 then 10000 - mate else -10000 - mate end mover,
           first from (
      select *, case when split_part(fen, ' ', 2) = 'w' then 1 else -1 end sign, split_part(line, ' ', 1) "first" from engine_lines where line is not null and line <> '' and (cp is not null or mate is not null))
""")
def mover_sign_scores(spark, d):
    sign = scoring.mover_sign(F.col("fen"))
    white = scoring.white_score(F.col("cp"), F.col("mate"))
    rows = table(spark, d, "engine_lines").filter("line is not null and line <> '' and (cp is not null or mate is not null)")
    return rows.select("line_id", sign.alias("sign"), white.alias("white"), (sign * white).alias("mover"), text.first_token(F.col("line")).alias("first"))


@register("""
    select band, count(*) n, round(avg(gap), 6) mean_gap from (
      select abs(cp) gap, cast(floor(abs(cp) / 100.0) as bigint) band from label_rows where mate is null and cp is not null and abs(cp) < 2000) group by band
""")
def mate_free_subset(spark, d):
    gap = F.abs("cp")
    rows = table(spark, d, "label_rows").filter(F.col("mate").isNull() & (gap < 2000))
    return rows.withColumn("gap", gap).withColumn("band", F.floor(F.col("gap") / 100)).groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("gap"), 6).alias("mean_gap"))


def matches_style(first_move: str | None = None, eco: tuple[str, ...] = (), min_elo: int = 0):
    """Predicate of a style slice; values are literals of an expression, never parts of SQL text."""
    keep = (F.col("white_elo") >= min_elo) & (F.col("black_elo") >= min_elo)
    if first_move:
        keep = keep & (text.first_token(F.col("uci")) == first_move)
    if eco:
        keep = keep & reduce(lambda a, b: a | b, [F.col("eco").startswith(p) for p in eco])
    return keep


STYLES = {"king": {"first_move": "e2e4"}, "queen": {"first_move": "d2d4"}, "open": {"eco": ("C", "B2"), "min_elo": 1800}, "flank": {"eco": ("A",)}}


@register("""
    with g as (select *, lower(hex(cast(game_id as varchar))) h from games where uci is not null),
    m as (select 'king' style, * from g where split_part(uci, ' ', 1) = 'e2e4' and white_elo >= 0 and black_elo >= 0
      union all select 'queen', * from g where split_part(uci, ' ', 1) = 'd2d4' and white_elo >= 0 and black_elo >= 0
      union all select 'open', * from g where (eco like 'C%' or eco like 'B2%') and white_elo >= 1800 and black_elo >= 1800
      union all select 'flank', * from g where eco like 'A%' and white_elo >= 0 and black_elo >= 0)
    select style, game_id, batch_no from (select *, row_number() over (partition by style order by md5('7:' || game_id), game_id, batch_no) rk from m) where rk <= 200
""")
def style_slices(spark, d):
    """All slices in one scan: a row goes to each style it matches, then the first 200 of each by hash."""
    from pyspark.sql import Window

    from plyforge.operators.ordering import salted_hash

    names = F.array_compact(F.array(*[F.when(F.coalesce(matches_style(**spec), F.lit(False)), F.lit(name)) for name, spec in STYLES.items()]))
    rows = table(spark, d, "games").filter("uci is not null").select("game_id", "batch_no", F.explode(names).alias("style"))
    ranked = rows.withColumn("rk", F.row_number().over(Window.partitionBy("style").orderBy(salted_hash("7", F.col("game_id")), "game_id", "batch_no")))
    return ranked.filter("rk <= 200").select("style", "game_id", "batch_no")
