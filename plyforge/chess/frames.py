"""The kernel over DataFrames: Arrow batches in, Arrow batches out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plyforge.chess import games as G


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, for work that costs far more than moving its rows.

    Small files come as few partitions; a table that already has at least one a
    core is left as it is, so large inputs are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def _scalar(function, kind: T.DataType, *columns: Column) -> Column:
    @F.pandas_udf(kind)
    def run(*series: pd.Series) -> pd.Series:
        clean = [s.astype(object).where(s.notna(), None) for s in series]
        return pd.Series([function(*row) for row in zip(*clean)], dtype=object)

    return run(*columns)


def legal_moves(fen: Column) -> Column:
    return _scalar(G.legal_moves, T.ArrayType(T.StringType()), fen)


def is_legal(fen: Column, move: Column) -> Column:
    return _scalar(G.is_legal, T.BooleanType(), fen, move)


def numbered_san(moves: Column) -> Column:
    return _scalar(G.numbered_san, T.StringType(), moves)


def answer_outcome(fen: Column, answer: Column) -> Column:
    return _scalar(G.answer_outcome, T.StringType(), fen, answer)


def blunder_verdict(fen: Column, move: Column) -> Column:
    return _scalar(G.blunder_verdict, T.BooleanType(), fen, move)


def game_over(moves: Column) -> Column:
    return _scalar(G.game_over, T.StringType(), moves)


def position_after(moves: Column, move: Column) -> Column:
    kind = T.StringType()
    return _scalar(lambda a, b: (G.position_after(a, b) or (None,))[0], kind, moves, move)


def legal_move_ids(fen: Column) -> Column:
    """Sorted vocabulary ids of the legal moves."""
    from plyforge.functions.vocab import vocabulary

    table = {t: i for i, t in enumerate(vocabulary())}
    return _scalar(lambda f: None if (m := G.legal_moves(f)) is None else sorted(table[x] for x in m), T.ArrayType(T.IntegerType()), fen)


def convert_games(raw: DataFrame, *, text: str = "movetext", result: str = "Result", least: int = 20, most: int = 300) -> DataFrame:
    """Adds reason, uci and n_plies to raw games; filter ``reason = 'kept'`` and count reasons in one pass."""

    def run(batches):
        for df in batches:
            clean = df[[text, result]].astype(object).where(df[[text, result]].notna(), None)
            rows = [G.conversion(t, r, least, most) for t, r in clean.itertuples(index=False)]
            yield df.assign(reason=[r[0] for r in rows], uci=[r[1] for r in rows], n_plies=pd.array([r[2] for r in rows], dtype="Int16"))

    schema = T.StructType([*raw.schema.fields, T.StructField("reason", T.StringType()), T.StructField("uci", T.StringType()), T.StructField("n_plies", T.ShortType())])
    return spread(raw).mapInPandas(run, schema)


def walk_positions(games: DataFrame) -> DataFrame:
    """One row a ply: game_id, ply, fen4, last_move, phase, result.  ``games`` has game_id, uci and result."""

    def run(batches):
        for df in batches:
            out = [(g, ply, fen, move, phase, r) for g, u, r in df[["game_id", "uci", "result"]].itertuples(index=False) for ply, fen, move, phase in G.walk(u)]
            yield pd.DataFrame(out, columns=["game_id", "ply", "fen4", "last_move", "phase", "result"])

    return spread(games.select("game_id", "uci", "result")).mapInPandas(run, "game_id bigint, ply smallint, fen4 string, last_move string, phase string, result string")


def distinct_positions(walked: DataFrame, limit: int | None = None) -> DataFrame:
    """One row a position: the facts of its first occurrence by (game_id, ply), and how often it was seen."""
    first = F.min_by(F.struct("game_id", "ply", "last_move", "result", "phase"), F.struct("game_id", "ply"))
    out = walked.groupBy("fen4").agg(first.alias("x"), F.count(F.lit(1)).alias("n_seen")).select("fen4", "x.*", "n_seen")
    return out.orderBy("game_id", "ply").limit(limit) if limit else out


def opening_book(spark: SparkSession, pairs: int, plies: int = 6, seed: int = 0) -> DataFrame:
    """(pair, opening): random legal openings."""
    return spark.range(pairs).select(F.col("id").alias("pair"), _scalar(lambda i: G.random_opening(plies, f"{seed}:{i}"), T.StringType(), F.col("id")).alias("opening"))
