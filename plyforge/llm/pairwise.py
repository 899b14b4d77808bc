"""One global ranking from pairwise comparisons, by offence-defence scaling.

``W[i, j]`` is the number of wins of item i over item j (a draw adds one half
to both).  Sinkhorn iterations rescale the rows and columns of the smoothed
matrix M in turn,

    offence[i] = sum_j M[i, j] / defence[j],   defence[j] = sum_i M[i, j] / offence[i],

until ``M[i, j] / (offence[i] * defence[j])`` has unit row and column sums.
Strength is offence / defence.

Why this is fair to items compared unevenly often: if i beats j with odds
``s[i] / s[j]`` then ``E W[i, j] = C[i, j] * sqrt(s[i] / s[j])`` with a
symmetric C that holds the numbers of comparisons.  Scaling C alone gives the
same t to row and column i, so W has offence ``sqrt(s) * t`` and defence ``t /
sqrt(s)``, and t leaves the quotient: the strength is s whatever the schedule.

Smoothing, fixed before the first sweep:

* each item plays ``prior`` games against one virtual item, half of them won,
  which ties unconnected parts together and keeps strengths finite;
* the diagonal holds an item's own number of games.  Any diagonal is symmetric,
  so it leaves the argument above as it is; it gives M total support, without
  which the scaling need not exist or be unique.

A few games weigh differently here than in a likelihood fit, so strengths of
items that hardly met differ from it; they agree as games accumulate.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyforge.operators.ordering import range_running_sum
from plyforge.session import cut_lineage

#: Items and cells of the win matrix that are solved on the driver (at most about 150 MB there); more are solved by joins, to the same stop.
LOCAL_ITEMS, LOCAL_CELLS = 200_000, 1_000_000
#: The sweeps end when no log strength moves against another by more than this, and fail after so many.
TOLERANCE, SWEEPS = 1e-10, 20_000


class NotConverged(RuntimeError):
    """The sweeps ended before the strengths came to rest."""


def win_matrix(games: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """(winner, loser, wins) summed over all games; ``score`` is a's, in 0..1.

    Rows with a null in a, b or score and games of an item against itself count
    for nothing.  Summed on the map side first: a pair that holds a third of
    the games sends one row a task.
    """
    kept = games.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(score).isNotNull() & (F.col(a) != F.col(b)))
    sides = F.array(
        F.struct(F.col(a).alias("winner"), F.col(b).alias("loser"), F.col(score).cast("double").alias("wins")),
        F.struct(F.col(b).alias("winner"), F.col(a).alias("loser"), (1 - F.col(score).cast("double")).alias("wins")),
    )
    return kept.select(F.explode(sides).alias("x")).select("x.*").groupBy("winner", "loser").agg(F.sum("wins").alias("wins"))


def scale_local(winner: np.ndarray, loser: np.ndarray, wins: np.ndarray, n: int, prior: float = 0.1, tolerance: float = TOLERANCE, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray, int]:
    """(offence, defence, sweeps made) of items 0..n-1 from the cells of the win matrix."""
    if not n:
        return np.ones(0), np.ones(0), 0
    items, virtual = np.arange(n), np.full(n, n)  # the last item is the virtual one
    i, j = np.concatenate([winner, items, virtual]), np.concatenate([loser, virtual, items])
    w = np.concatenate([wins, np.full(2 * n, prior / 2)])
    own = np.bincount(i, w, n + 1) + np.bincount(j, w, n + 1)
    o, d, log_strength = np.ones(n + 1), np.ones(n + 1), np.zeros(n + 1)
    for made in range(1, sweeps + 1):
        o = np.bincount(i, w / d[j], n + 1) + own / d
        d = np.bincount(j, w / o[i], n + 1) + own / o
        new = np.log(o / d)
        moved = np.ptp(new[:n] - log_strength[:n])  # a common factor does not count
        log_strength = new
        if moved <= tolerance:
            level = np.exp(log_strength[:n].mean() / 2)  # scalings are unique up to one factor
            return o[:n] / level, d[:n] * level, made
    raise NotConverged(f"strengths still move by {moved:.3g} after {sweeps} sweeps")


def scale_joined(cells: DataFrame, items: DataFrame, prior: float = 0.1, tolerance: float = TOLERANCE, sweeps: int = SWEEPS) -> DataFrame:
    """The same sweeps by joins, for matrices too large for the driver: (item, offence, defence, sweeps).

    ``cells`` has (winner, loser, wins).  A half-sweep joins the cells with one
    scaling and sums them by the other end, and its result, a row an item, is
    written to the checkpoint folder; the driver holds the virtual item and a
    few totals.
    """
    g = prior / 2
    ends = cells.select(F.explode(F.array(F.struct(F.col("winner").alias("item"), "wins"), F.struct(F.col("loser").alias("item"), "wins"))).alias("x")).groupBy("x.item").agg(F.sum("x.wins").alias("own"))
    state = items.select("item").distinct().join(ends, "item", "left").select("item", (F.coalesce("own", F.lit(0.0)) + prior).alias("own"), F.lit(1.0).alias("o"), F.lit(1.0).alias("d"), F.lit(0.0).alias("x"))
    state = cut_lineage(state)
    n = state.count()
    ghost_own, ghost_o, ghost_d = prior * n, 1.0, 1.0

    def half(by: str, other: str, scaling: str):
        """Sums of the cells over one end, each divided by the scaling of the other end."""
        there = state.select(F.col("item").alias(other), F.col(scaling).alias("__s"))
        return cells.join(there, other).groupBy(F.col(by).alias("item")).agg(F.sum(F.col("wins") / F.col("__s")).alias("__t"))

    moved = float("inf")
    for made in range(1, sweeps + 1):
        by_defence = state.agg(F.sum(1 / F.col("d"))).first()[0] or 0.0
        o = F.coalesce("__t", F.lit(0.0)) + F.lit(g / ghost_d) + F.col("own") / F.col("d")
        state = cut_lineage(state.join(half("winner", "loser", "d"), "item", "left").select("item", "own", o.alias("o"), "d", "x"))
        ghost_o = g * by_defence + ghost_own / ghost_d
        by_offence = state.agg(F.sum(1 / F.col("o"))).first()[0] or 0.0
        d = F.coalesce("__t", F.lit(0.0)) + F.lit(g / ghost_o) + F.col("own") / F.col("o")
        state = cut_lineage(state.join(half("loser", "winner", "o"), "item", "left").select("item", "own", "o", d.alias("d"), F.col("x").alias("before")).withColumn("x", F.log(F.col("o") / F.col("d"))))
        ghost_d = g * by_offence + ghost_own / ghost_o
        step = F.col("x") - F.col("before")
        moved, mean = state.agg(F.coalesce(F.max(step) - F.min(step), F.lit(0.0)), F.avg("x")).first()
        if moved <= tolerance:
            level = float(np.exp((mean or 0.0) / 2))
            return state.select("item", (F.col("o") / level).alias("offence"), (F.col("d") * level).alias("defence"), F.lit(made).alias("sweeps"))
        state = state.drop("before")
    raise NotConverged(f"strengths still move by {moved:.3g} after {sweeps} sweeps")


def rank_items(
    games: DataFrame, items: DataFrame, item: str, a: str = "item_a", b: str = "item_b", score: str = "score", *,
    prior: float = 0.1, tolerance: float = TOLERANCE, sweeps: int = SWEEPS, local_items: int = LOCAL_ITEMS, local_cells: int = LOCAL_CELLS,
) -> DataFrame:
    """(place INT, item, strength, offence, defence, games, sweeps) for every row of ``items``.

    Items without a game have the average strength.  Equal strengths (to nine
    places) are placed by name.  Games with items that ``items`` does not list,
    null scores, and games of an item with itself do not count.  Null items are
    left out; an empty ``items`` gives no rows.  ``sweeps`` is how many it took
    until no log strength moved against another by more than ``tolerance``; ``NotConverged`` is
    raised where the limit of them does not do.  The matrix of up to
    ``local_items`` items and ``local_cells`` cells (neither grows with the
    number of games) is scaled on the driver, a larger one by joins: the same
    sweeps on the same matrix with the same stop.
    """
    spark = games.sparkSession
    names = items.select(F.col(item).alias("item")).dropna().distinct()
    kind = dict(names.dtypes)["item"]
    listed = names.select(F.col("item").alias(a)), names.select(F.col("item").alias(b))
    cells = cut_lineage(win_matrix(games.select(a, b, score).join(listed[0], a, "left_semi").join(listed[1], b, "left_semi"), a, b, score))
    few = names.limit(local_items + 1).count()
    if few <= local_items and cells.limit(local_cells + 1).count() <= local_cells:
        order = sorted(r.item for r in names.collect())
        at = {x: k for k, x in enumerate(order)}
        local = cells.toPandas()
        i, j = (local[side].map(at).to_numpy(dtype=np.int64) for side in ("winner", "loser"))
        wins = local["wins"].to_numpy(dtype=float)
        o, d, made = scale_local(i, j, wins, few, prior, tolerance, sweeps)
        played = np.bincount(i, wins, few) + np.bincount(j, wins, few) if few else np.zeros(0)
        rows = [(order[k], float(o[k] / d[k]), float(o[k]), float(d[k]), float(played[k]), made) for k in range(few)]
        scaled = spark.createDataFrame(rows, f"item {kind}, strength double, offence double, defence double, games double, sweeps int")
    else:
        ends = F.array(F.struct(F.col("winner").alias("item"), "wins"), F.struct(F.col("loser").alias("item"), "wins"))
        played = cells.select(F.explode(ends).alias("x")).groupBy("x.item").agg(F.sum("x.wins").alias("games"))
        solved = scale_joined(cells, names, prior, tolerance, sweeps).join(played, "item", "left")
        scaled = solved.select("item", (F.col("offence") / F.col("defence")).alias("strength"), "offence", "defence", F.coalesce("games", F.lit(0.0)).alias("games"), "sweeps")
    placed = range_running_sum(scaled.withColumn("__down", -F.round("strength", 9)).withColumn("__one", F.lit(1)), ["__down", "item"], "__one", name="place")
    return placed.select(F.col("place").cast("int").alias("place"), F.col("item").alias(item), "strength", "offence", "defence", "games", "sweeps")


#: How a result may be spelled, seen from White.
WHITE_SCORE = {
    "1-0": 1.0, "1:0": 1.0, "white wins": 1.0, "white": 1.0,
    "0-1": 0.0, "0:1": 0.0, "black wins": 0.0, "black": 0.0,
    "1/2-1/2": 0.5, "1/2": 0.5, "½-½": 0.5, "½": 0.5, "0.5-0.5": 0.5, "draw": 0.5,
}
UNFINISHED = ("*", "unfinished", "aborted")


def stage_name(column):
    """The plain name of an item written as a run, a checkpoint path, or in other case."""
    text = F.lower(F.trim(column))
    text = F.regexp_replace(text, r"^.*checkpoints/([^/]+)(/.*)?$", "$1")
    text = F.regexp_replace(text, r"-\d{8}-\d{6}$", "")
    return F.regexp_replace(text, r"[_\s]+", "-")


def readable_games(match_games: DataFrame, keys: Sequence[str] = ("match_id", "game_index")) -> DataFrame:
    """(item_a, item_b, score): one row a game with a readable outcome.

    The result, White against Black, counts through ``a_white``; without one of
    the two, ``score`` (stage_a's) does.  A game marked as unfinished, or whose
    result contradicts its score, has no readable outcome.  Of several
    deliveries of a game the latest readable one counts; rows without a key are
    games of their own.
    """
    read = F.regexp_replace(F.regexp_replace(F.lower(F.trim("result")), "[–—]", "-"), r"\s*([-:/])\s*", "$1")
    # the columns of a step are computed once and used by name in the next
    rows = match_games.select(*keys, stage_name(F.col("stage_a")).alias("item_a"), stage_name(F.col("stage_b")).alias("item_b"), "a_white", F.when(F.col("score").isin(0.0, 0.5, 1.0), F.col("score")).alias("stated"), read.alias("read"), F.col("recorded_at").alias("at"))
    result, white = F.col("read"), F.lit(None).cast("double")
    for value in (1.0, 0.5, 0.0):
        white = F.when(result.isin([k for k, v in WHITE_SCORE.items() if v == value]), F.lit(value)).otherwise(white)
    rows = rows.withColumn("white", white)
    # a draw is the same seen from either side
    by_result = F.when(F.col("white") == 0.5, 0.5).when(F.col("a_white"), F.col("white")).when(~F.col("a_white"), 1 - F.col("white"))
    rows = rows.withColumn("by_result", by_result)
    differ = F.col("by_result").isNotNull() & F.col("stated").isNotNull() & (F.col("by_result") != F.col("stated"))
    score = F.when(result.isin(*UNFINISHED), None).when(differ, None).otherwise(F.coalesce("by_result", "stated"))
    rows = rows.select(*keys, "item_a", "item_b", score.alias("score"), "at")
    named = F.lit(True)
    for k in keys:
        named = named & F.col(k).isNotNull()
    # rows without an outcome are left out by the aggregate: a filter here would be pushed down and compute the score once more
    readable = F.when(F.col("score").isNotNull(), F.struct(F.coalesce(F.col("at").cast("string"), F.lit("")).alias("at"), "item_a", "item_b", "score"))
    one = rows.filter(named).groupBy(*keys).agg(F.max(readable).alias("x")).filter("x is not null").select("x.item_a", "x.item_b", "x.score")
    return one.unionByName(rows.filter(~named).select("item_a", "item_b", "score").filter(F.col("score").isNotNull()))
