"""The pN_ queries of this subpackage, and the SQL of those that have any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.llm import bin_packing, consensus, frozen_sample, mixing, pairwise, quota_flow, spanning_forest, truncation
from plyforge.llm.token_sizes import token_count

CAPACITY = 2048
SHARES = {"train": "0.8", "val": "0.1", "test": "0.1"}


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- 1: one ranking ------------------------------------------------------------


def _ranking(spark, d):
    return pairwise.rank_items(pairwise.readable_games(_table(spark, d, "match_games")), _table(spark, d, "stages"), "stage")


def p1_found(spark, d):
    return _ranking(spark, d).select("place", "stage")


def p1_strengths(spark, d):
    return _ranking(spark, d).select("place", "stage", F.round("strength", 4).alias("strength"), F.round("offence", 3).alias("offence"), F.round("defence", 3).alias("defence"), "games")


def p1_convergence(spark, d):
    """How many sweeps the ranking took."""
    return _ranking(spark, d).select("sweeps").distinct()


def p1_win_matrix(spark, d):
    games = pairwise.readable_games(_table(spark, d, "match_games"))
    return pairwise.win_matrix(games, "item_a", "item_b", "score")


# ---- 2: frozen sample ----------------------------------------------------------


def p2_found(spark, d):
    draws = frozen_sample.plain_draws(_table(spark, d, "sample_draws"))
    live = frozen_sample.live_records(_table(spark, d, "games"), _table(spark, d, "puzzles"))
    return frozen_sample.lost_records(draws, live, "batch_no").select("sample_name", "draw_no", "item_key")


def p2_games_sample(spark, d):
    return frozen_sample.frozen_sample(_table(spark, d, "games"), "game_id", "batch_no", "0.1", "games").select("game_id", "batch_no")


def p2_puzzles_sample(spark, d):
    return frozen_sample.frozen_sample(_table(spark, d, "puzzles"), "puzzle_id", "batch_no", "0.25", "puzzles").select("puzzle_id", "batch_no")


# ---- 3: splits -----------------------------------------------------------------


def _roots(spark, d):
    return spanning_forest.spanning_forest(spanning_forest.game_edges(_table(spark, d, "games")))


def p3_found(spark, d):
    records = spanning_forest.recorded_splits(_table(spark, d, "label_rows"), _table(spark, d, "puzzles"))
    return spanning_forest.torn_games(records, _roots(spark, d)[1])


def p3_splits(spark, d):
    return spanning_forest.split_records(_table(spark, d, "label_rows"), _table(spark, d, "puzzles"), _roots(spark, d)[1], SHARES)


def p3_forest(spark, d):
    return _roots(spark, d)[0]


def p3_roots_by_batches(spark, d):
    """Roots of all games from a forest of the first batches, saved, read back and extended by the later ones.

    A game delivered again is part of the later edges, tied to the ids it was tied to before.
    """
    from uuid import uuid4

    from plyforge.session import ensure_checkpoint_dir

    games = _table(spark, d, "games")
    early = F.coalesce(F.col("batch_no") <= 3, F.lit(False))
    first, _ = spanning_forest.spanning_forest(spanning_forest.game_edges(games.filter(early)))
    path = f"{ensure_checkpoint_dir(spark)}/forest-{uuid4().hex}"
    spanning_forest.save_forest(first, path)
    _, roots = spanning_forest.extend_forest(spanning_forest.load_forest(spark, path), spanning_forest.game_edges(games))
    return roots.select(F.col("id").alias("game_id"), "root")


def p3_split_report(spark, d):
    """Games, ids and records of each split, and how many of the records have no game."""
    rows = p3_splits(spark, d)
    return rows.groupBy("split").agg(F.count_distinct("root").alias("games"), F.count_distinct("game_id").alias("ids"), F.count(F.lit(1)).alias("records"), F.count_if(F.col("root").isNull()).alias("no_game"))


# ---- 4: best line ----------------------------------------------------------------


def p4_found(spark, d):
    return consensus.best_lines(_table(spark, d, "engine_lines")).filter("n_rows > 1").select("line_id")


def p4_best_lines(spark, d):
    return consensus.built_lines(_table(spark, d, "engine_lines")).withColumn("filled", F.array_join("filled", " "))


def p4_filled_fields(spark, d):
    """The fields of the survivors after the vote on those that were silent."""
    return p4_best_lines(spark, d).select("line_id", "n_rows", "depth", "knodes", "cp", "mate", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("fetched_at"), "filled")


# ---- 5: target shares ------------------------------------------------------------


def _categories(spark, d):
    """Category and, as stratum, the recorded split of each record."""
    return {
        "label_rows": quota_flow.category_records(_table(spark, d, "label_rows"), ["game_id", "ply"], quota_flow.phase_name(F.col("phase")), spanning_forest.split_name(F.col("split"))),
        "puzzles": quota_flow.category_records(_table(spark, d, "puzzles"), ["puzzle_id"], quota_flow.band_name(F.col("band")), spanning_forest.split_name(F.col("split"))),
    }


def p5_target_report(spark, d):
    return quota_flow.target_report(_categories(spark, d), _table(spark, d, "sample_targets"))


def p5_found(spark, d):
    return p5_target_report(spark, d).filter("shortfall > 0").select("sample_name", "category")


def p5_draw_report(spark, d):
    """What was drawn of each target, and what the draw lacks of it."""
    return quota_flow.draw_report(p5_samples(spark, d), _table(spark, d, "sample_targets"))


def p5_samples(spark, d):
    return quota_flow.draw_samples(_categories(spark, d), _table(spark, d, "sample_targets"))


# ---- 6: packing -----------------------------------------------------------------


def _sizes(spark, d):
    return _table(spark, d, "documents").select("doc_id", mixing.source_name(F.col("source")).alias("source"), token_count(F.col("text")).alias("tokens"))


def p6_packed(spark, d):
    return bin_packing.pack_items(_sizes(spark, d), "doc_id", "tokens", CAPACITY)


def p6_found(spark, d):
    """Documents that were divided: the packing divides no other."""
    packed = p6_packed(spark, d)
    return packed.filter((F.col("piece") > 0) | (F.col("tokens") == CAPACITY)).groupBy("doc_id").agg(F.max("piece").alias("last")).filter("last > 0").select("doc_id")


def p6_pieces_by_characters(spark, d):
    """How the packing of texts measured in characters divides each, which SQL can check: nothing lost, nothing divided that fits."""
    sizes = _table(spark, d, "documents").select("doc_id", F.length("text").cast("bigint").alias("tokens"))
    packed = bin_packing.pack_items(sizes, "doc_id", "tokens", CAPACITY)
    return packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("characters"), F.max("tokens").alias("largest"), F.count_distinct("bin").alias("bins"))


def p6_bins_by_characters(spark, d):
    """Bins over their capacity (none) and whether all bins but one are at least half full."""
    sizes = _table(spark, d, "documents").select("doc_id", F.length("text").cast("bigint").alias("tokens"))
    filled = bin_packing.pack_items(sizes, "doc_id", "tokens", CAPACITY).filter("bin is not null").groupBy("bin").agg(F.sum("tokens").alias("t"))
    return filled.agg(F.sum("t").alias("characters"), F.count_if(F.col("t") > CAPACITY).alias("too_full"), (F.count_if(F.col("t") * 2 < CAPACITY) <= 1).alias("dense"))


def p6_report(spark, d):
    return bin_packing.packing_report(p6_packed(spark, d), CAPACITY)


# ---- 7: mixing ------------------------------------------------------------------


def _mix_report(spark, d):
    from plyforge.session import cut_lineage

    sizes = cut_lineage(_sizes(spark, d))
    return mixing.mix_report(cut_lineage(mixing.mix_documents(sizes, _table(spark, d, "mix_targets"))), sizes, _table(spark, d, "mix_targets"))


def p7_found(spark, d):
    """The sources that the queue has used up before their share is served."""
    return _mix_report(spark, d).filter("short").select("mix_name", F.col("source_as_given").alias("source"))


def p7_mix(spark, d):
    return mixing.mix_documents(_sizes(spark, d), _table(spark, d, "mix_targets"))


def p7_report(spark, d):
    return _mix_report(spark, d).drop("source_as_given")


def p7_mix_by_characters(spark, d):
    """The same mixing with characters as the measure of size, which SQL can check."""
    sizes = _table(spark, d, "documents").select("doc_id", mixing.source_name(F.col("source")).alias("source"), F.length("text").cast("bigint").alias("tokens"))
    return mixing.mix_documents(sizes, _table(spark, d, "mix_targets")).select("mix_name", "position", "source", "doc_id", F.col("pass").cast("bigint").alias("pass"), "tokens")


# ---- 8: truncation --------------------------------------------------------------


def p8_found(spark, d):
    return truncation.find_truncated(_table(spark, d, "documents")).filter("truncated").select("doc_id")


def p8_report(spark, d):
    return truncation.truncation_report(truncation.find_truncated(_table(spark, d, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(v)}
