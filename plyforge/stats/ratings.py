"""Ratings from games: sufficient statistics by Spark, fits of a few rows on the driver."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG = np.log(10) / 400
#: How far beyond the opponents a fit or a bound may go.
SLACK, BOUND_SLACK = 1000.0, 4000.0


def rung_summary(games: DataFrame) -> DataFrame:
    """(rung, opponent_elo, games, wins, draws, losses, score) of rows (rung, opponent_elo, score)."""
    return games.groupBy("rung").agg(F.min("opponent_elo").alias("opponent_elo"), F.count(F.lit(1)).alias("games"), F.count_if(F.col("score") == 1).alias("wins"), F.count_if(F.col("score") == 0.5).alias("draws"), F.count_if(F.col("score") == 0).alias("losses"), F.avg("score").alias("score"))


def expected(ratings: np.ndarray, opponents: np.ndarray) -> np.ndarray:
    """Expected scores of each rating (last axis added) against each opponent."""
    return 1 / (1 + np.exp(-LOG * (np.asarray(ratings, float)[..., None] - opponents)))


def crossing(rising: Callable[[np.ndarray], np.ndarray], low: np.ndarray, high: np.ndarray, close: float = 1e-7) -> np.ndarray:
    """Where a rising function, worked out for all elements at once, passes 0 between ``low`` and ``high``; the nearer end where it does not.

    Each round takes the midpoint and then the point of the exponential secant
    through it and both ends, so the bracket at least halves and usually
    collapses in a few rounds.
    """
    low, high = np.array(low, float), np.array(high, float)
    at_low, at_high = rising(low), rising(high)
    high = np.where(at_low >= 0, low, high)
    low = np.where(at_high <= 0, high, low)
    while (high - low).max(initial=0.0) > close:
        middle = (low + high) / 2
        at_middle = rising(middle)
        root = np.sqrt(np.maximum(at_middle**2 - at_low * at_high, 1e-300))
        guess = np.clip(middle - (middle - low) * at_middle / root, low, high)
        at_guess = rising(guess)
        for x, y in ((middle, at_middle), (guess, at_guess)):
            inside = (x >= low) & (x <= high)
            up = inside & (y >= 0)
            down = inside & (y < 0)
            high, at_high = np.where(up, x, high), np.where(up, y, at_high)
            low, at_low = np.where(down, x, low), np.where(down, y, at_low)
    return (low + high) / 2


def likely_ratings(opponents: np.ndarray, played: np.ndarray, scored: np.ndarray) -> np.ndarray:
    """Maximum-likelihood ratings: those whose expected total is the total that was scored.

    ``played`` and ``scored`` (games and their sum) are by opponent, one row a
    resample: the likelihood depends on nothing else.  A side that scored
    everything or nothing is held ``SLACK`` beyond the opponents it met.
    """
    opponents = np.asarray(opponents, float)
    played, scored = np.atleast_2d(played).astype(float), np.atleast_2d(scored).astype(float)
    met = np.where(played > 0, opponents, np.nan)
    total = scored.sum(1)
    return crossing(lambda r: (played * expected(r, opponents)).sum(1) - total, np.nanmin(met, 1) - SLACK, np.nanmax(met, 1) + SLACK)


def clean_sheet_bound(opponents: Sequence[float], played: Sequence[float], level: float = 0.95, won: bool = True) -> float:
    """The rating at which winning (losing) every game gets as unlikely as 1 - level."""
    opponents, played = np.asarray(opponents, float), np.asarray(played, float)
    side = 1.0 if won else -1.0  # losing every game as x is winning every game as -x against mirrored opponents

    def surplus(x: np.ndarray) -> np.ndarray:
        return -(played * np.log1p(np.exp(-LOG * (x[..., None] - side * opponents)))).sum(-1) - np.log(1 - level)

    ends = np.sort(side * np.array([opponents.min() - BOUND_SLACK, opponents.max() + BOUND_SLACK]))
    return float(side * crossing(surplus, ends[:1], ends[1:])[0])


def estimate(games: DataFrame, by: str | None = None, samples: int = 500, seed: int = 0, level: float = 0.95) -> DataFrame:
    """(who, elo, ci_low, ci_high, elo_lower, elo_upper, games, score) of rows (opponent_elo, score[, by]).

    Games are summed by opponent and score; the bootstrap redraws those counts
    as a multinomial, which is what resampling games amounts to.  A group is a
    few rows, however many games it has.  Groups with nothing but wins or losses
    have a one-sided bound in place of an interval.
    """
    who = F.col(by).cast("string") if by else F.lit("all")
    counts = games.dropna(subset=["opponent_elo", "score"]).groupBy(who.alias("who"), F.col("opponent_elo").cast("double").alias("o"), F.col("score").cast("double").alias("s")).agg(F.count(F.lit(1)).alias("n"))

    def fit(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["o", "s"])
        o, s, n = df["o"].to_numpy(), df["s"].to_numpy(), df["n"].to_numpy()
        elo = likely_ratings(o, n, n * s)[0]
        row = {"who": df["who"].iloc[0], "elo": elo, "ci_low": None, "ci_high": None, "elo_lower": None, "elo_upper": None, "games": int(n.sum()), "score": float((n * s).sum() / n.sum())}
        if (s >= 1).all():
            row["elo_lower"] = clean_sheet_bound(o, n, level, True)
        elif (s <= 0).all():
            row["elo_upper"] = clean_sheet_bound(o, n, level, False)
        else:
            draws = np.random.default_rng(seed).multinomial(int(n.sum()), n / n.sum(), size=samples)
            fits = likely_ratings(o, draws, draws * s)
            row["ci_low"], row["ci_high"] = np.percentile(fits, [(1 - level) * 50, 100 - (1 - level) * 50])
        return pd.DataFrame([row])

    return counts.groupBy("who").applyInPandas(fit, "who string, elo double, ci_low double, ci_high double, elo_lower double, elo_upper double, games bigint, score double")


def match_summary(games: DataFrame, by: Sequence[str], samples: int = 1000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Wins, draws, losses, score, rating difference with a bootstrap interval, separated flag, of each match."""
    rows = games.dropna(subset=["score"]).groupBy(*by).agg(F.count(F.lit(1)).alias("games"), F.count_if(F.col("score") == 1).alias("wins"), F.count_if(F.col("score") == 0.5).alias("draws"), F.count_if(F.col("score") == 0).alias("losses"), F.avg("score").alias("score"))
    schema = T.StructType([*rows.schema.fields, *[T.StructField(n, T.DoubleType()) for n in ("elo", "ci_low", "ci_high")], T.StructField("separated", T.BooleanType())])

    def diff(p):
        p = np.asarray(p, float)
        with np.errstate(divide="ignore"):
            return np.clip(np.where(p <= 0, -1200, np.where(p >= 1, 1200, 400 * np.log10(p / (1 - p)))), -1200, 1200)

    def run(batches):
        for df in batches:
            low, high = [], []
            for w, d, x in df[["wins", "draws", "losses"]].itertuples(index=False):
                n = w + d + x
                draws = np.random.default_rng(seed).multinomial(n, np.array([w, d, x]) / n, size=samples)
                a, b = np.quantile(diff((draws[:, 0] + draws[:, 1] / 2) / n), [(1 - level) / 2, 1 - (1 - level) / 2])
                low.append(a)
                high.append(b)
            yield df.assign(elo=diff(df["score"]), ci_low=low, ci_high=high, separated=[a > 0 or b < 0 for a, b in zip(low, high)])

    return rows.mapInPandas(run, schema)
