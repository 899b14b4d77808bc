"""The board kernel over the games, lines and puzzles tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plyforge.chess import frames
from plyforge.functions import text
from plyforge.plans.catalogue import register
from plyforge.plans.sampling import table


@register("""
    select game_id, batch_no, cast(len(string_split(uci, ' ')) as bigint) plies, uci back from games where uci is not null
""")
def san_round_trip(spark, d):
    """Every game written as SAN and read back: replays, disambiguates and parses whole games."""
    games = frames.spread(table(spark, d, "games").filter("uci is not null").select("game_id", "batch_no", "uci")).select("game_id", "batch_no", frames.numbered_san(F.col("uci")).alias("movetext"), F.lit("1-0").alias("Result"))
    back = frames.convert_games(games, least=0, most=10_000)
    return back.filter("reason = 'kept'").select("game_id", "batch_no", F.col("n_plies").cast("bigint").alias("plies"), F.col("uci").alias("back"))


@register("""
    with g as (select * from (select *, row_number() over (partition by game_id order by batch_no, ingested_at) rk from games where uci is not null) where rk = 1)
    select sum(len(string_split(uci, ' '))) as walked, (select count(*) from (select distinct game_id from g)) games from g
""")
def walk_counts(spark, d):
    """Positions walked and games: the sum of plies."""
    walked = frames.walk_positions(first_games(spark, d))
    return walked.agg(F.count(F.lit(1)).alias("walked"), F.count_distinct("game_id").alias("games"))


def first_games(spark, d):
    games = table(spark, d, "games").filter("uci is not null").groupBy("game_id").agg(F.min(F.struct("batch_no", "ingested_at", "uci", "result")).alias("x"))
    return games.select("game_id", "x.uci", "x.result")


@register()
def walk_positions(spark, d):
    """One row a distinct position: where it first stood and how often it was seen."""
    return frames.distinct_positions(frames.walk_positions(first_games(spark, d)))


@register()
def walked_phases(spark, d):
    """Positions walked in each of the three phases."""
    walked = frames.walk_positions(first_games(spark, d))
    return walked.groupBy("phase").agg(F.count(F.lit(1)).alias("n"))


def first_moves(spark, d):
    """(line_id, fen, move) of every engine line, the move in one spelling."""
    return table(spark, d, "engine_lines").select("line_id", "fen", text.plain_move(F.col("move"), F.col("line")).alias("move"))


@register()
def legal_moves(spark, d):
    """Whether each row's first move is legal in its position; null without a move. Here all are but castlings written as king takes rook."""
    rows = frames.spread(first_moves(spark, d))
    return rows.select("line_id", frames.is_legal(F.col("fen"), F.col("move")).alias("legal"))


@register()
def legal_move_ids(spark, d):
    rows = table(spark, d, "puzzles").select("puzzle_id", "batch_no", frames.legal_move_ids(F.col("fen")).alias("ids"))
    return rows.select("puzzle_id", "batch_no", F.size("ids").alias("n"), F.array_min("ids").alias("low"), F.array_max("ids").alias("high"))


@register()
def rebuild_prefix(spark, d):
    """For puzzles whose game is known: the ply at which the puzzle's position stood."""
    from pyspark.sql import types as T

    from plyforge.chess.games import prefix_to

    rows = table(spark, d, "puzzles").select("puzzle_id", "batch_no", "game_id", "fen", "prefix_plies").join(first_games(spark, d), "game_id", "left")
    found = frames._scalar(prefix_to, T.IntegerType(), F.col("uci"), F.col("fen"))
    reason = F.when(F.col("uci").isNull(), "missing_game").when(F.col("ply").isNull(), "no_match").otherwise("ok")
    return rows.withColumn("ply", found).select("puzzle_id", "batch_no", "ply", reason.alias("reason"), "prefix_plies")


@register()
def blunder_heuristic(spark, d):
    """How many first moves the one-reply material rule calls blunders; null are rows without a legal move or a position."""
    rows = frames.spread(first_moves(spark, d))
    judged = rows.select("line_id", frames.blunder_verdict(F.col("fen"), F.col("move")).alias("blunder"))
    return judged.groupBy("blunder").agg(F.count(F.lit(1)).alias("n"))


@register()
def game_endings(spark, d):
    games = first_games(spark, d)
    return games.groupBy(F.coalesce(frames.game_over(F.col("uci")), F.lit("going on")).alias("ending"), "result").agg(F.count(F.lit(1)).alias("n"))


@register()
def opening_book(spark, d):
    return frames.opening_book(spark, 64, 6, 3)


@register()
def pgn_documents(spark, d):
    """The PGN texts of the documents, converted, with the reason of each that cannot be."""
    docs = table(spark, d, "documents").filter(F.lower(F.trim("source")).contains("pgn"))
    tag = lambda name: F.nullif(F.regexp_extract("text", rf'\[{name} "([^"]*)"\]', 1), F.lit(""))
    moves = F.regexp_replace("text", r'(?:^|\s)\[\w+ "[^"]*"\]', " ")
    raw = docs.select("doc_id", moves.alias("movetext"), tag("Result").alias("Result"), text.safe_int(tag("WhiteElo")).alias("white_elo"), text.safe_int(tag("BlackElo")).alias("black_elo"))
    return frames.convert_games(raw, least=20, most=300).select("doc_id", "reason", "n_plies", "white_elo", "black_elo")
