"""One scoring convention for every consumer of engine evaluations.

A mate in n is worth MATE - n for the side that mates; scores are White's until
turned to the mover's side.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MATE = 10_000
#: Centipawn edges of the value buckets, each bucket closed on the left.
VALUE_EDGES = (-200, -50, 50, 200)
#: Class of a result, from White's side.
RESULT_CLASS = {"1-0": 0, "1/2-1/2": 1, "0-1": 2}


def turn(fen: Column) -> Column:
    return F.split_part(fen, F.lit(" "), F.lit(2))


def mover_sign(fen: Column) -> Column:
    """1 if White is to move, else -1."""
    return F.when(turn(fen) == "w", 1).otherwise(-1)


def white_score(cp: Column, mate: Column) -> Column:
    """Centipawns for White; null without cp and mate."""
    return F.when(mate.isNull(), cp.cast("bigint")).when(mate > 0, MATE - mate.cast("bigint")).otherwise(-MATE - mate.cast("bigint"))


def line_order(sign: Column, white: Column, mate: Column, depth: Column, move: Column) -> list[Column]:
    """Best line first: a mate for the mover, then depth, then the mover's score, then the move."""
    mates = F.coalesce(sign * mate > 0, F.lit(False))
    return [mates.desc(), depth.desc_nulls_last(), (sign * white).desc_nulls_last(), move.asc_nulls_last()]


def bounded_value(score: Column, scale: float = 400.0) -> Column:
    return F.tanh(score / F.lit(scale)).cast("float")


def value_bucket(score: Column) -> Column:
    out = F.lit(0)
    for i, edge in enumerate(VALUE_EDGES, 1):
        out = F.when(score >= edge, i).otherwise(out)
    return F.when(score.isNotNull(), out).cast("tinyint")


def recode(column: Column, mapping: dict, kind: str) -> Column:
    """Dictionary recode; anything else is null."""
    out = F.lit(None).cast(kind)
    for k, v in mapping.items():
        out = F.when(column == F.lit(k), F.lit(v).cast(kind)).otherwise(out)
    return out


def side_score(result: Column, is_white: Column) -> Column:
    """1, 0 or a half for one side; anything but a decided result is a half."""
    return F.when(result == "1-0", is_white.cast("double")).when(result == "0-1", (~is_white).cast("double")).otherwise(0.5)


def elo_difference(score: Column, cap: float = 1200.0, mode: str = "clamp") -> Column:
    """400 log10(p / (1 - p)); ``clamp`` cuts at +-cap, ``clip`` first keeps p within a thousandth of 0 and 1."""
    if mode == "clip":
        p = F.least(F.greatest(score, F.lit(1e-3)), F.lit(1 - 1e-3))
        return 400 * F.log10(p / (1 - p))
    free = 400 * F.log10(score / (1 - score))
    return F.when(score <= 0, -cap).when(score >= 1, cap).otherwise(F.greatest(F.lit(-cap), F.least(F.lit(cap), free)))


def expected_score(elo: Column, opponent: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (opponent - elo) / 400))


#: Two-sided normal quantiles.
Z = {0.90: 1.6448536269514722, 0.95: 1.959963984540054, 0.99: 2.5758293035489004}


def games_for_edge(elo: Column, level: float = 0.95) -> Column:
    """Games it takes to tell an edge from nothing; 0 for no edge."""
    p = expected_score(F.abs(elo), F.lit(0.0))
    return F.when(elo == 0, 0).otherwise(F.ceil(Z[level] ** 2 * p * (1 - p) / F.pow(p - 0.5, F.lit(2.0)))).cast("bigint")


def verdict(cp: Column, margin: Column | int) -> Column:
    """Adjudication of a cut game from White's centipawns."""
    margin = margin if isinstance(margin, Column) else F.lit(margin)
    return F.when(cp >= margin, "1-0").when(cp <= -margin, "0-1").when(cp.isNotNull(), "1/2-1/2")


#: First and last edge and width of the rating bands.
BAND_LOW, BAND_TOP, BAND_WIDTH = 1800, 2600, 200


def rating_band(elo: Column) -> Column:
    """``<1800``, ``1800-2000`` and so on, ``2600+``; null for null."""
    low = F.floor(elo / BAND_WIDTH).cast("int") * BAND_WIDTH
    return F.when(elo < BAND_LOW, f"<{BAND_LOW}").when(elo >= BAND_TOP, f"{BAND_TOP}+").when(elo.isNotNull(), F.concat_ws("-", low, low + BAND_WIDTH))
