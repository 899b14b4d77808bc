"""The best representative of each group of duplicate lines, by token-level consensus.

Every row of a group is a sequence of tokens: its depth, nodes, time and id as
field tokens, then the moves of its line.  Fields are columns by construction;
the moves are lined up by progressive alignment.  Each column is put to a vote,
and the row closest to the winning tokens survives, where a column outweighs all
later ones together.

In the field columns a token is weighed by its own size, so that the greatest
outvotes all others of the rows that agree with the earlier columns; the row
closest in these columns is then the greatest by (depth, nodes, time, -id),
which one aggregation finds.  As ids differ, nothing is left for later columns
to decide about which row survives.  What the vote decides is the content: the
moves of the line, where a row votes with the square of its depth, and the
fields in which the survivor is silent.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plyforge.chess.board import Board, Illegal
from plyforge.session import cut_lineage

MAX_DEPTH = 245
GAP = ""


# ---- positions and moves in one form -------------------------------------------


@F.pandas_udf(T.BooleanType())
def _can_capture(fens: pd.Series) -> pd.Series:
    """Whether the en-passant square of the FEN can be captured on; null for null."""
    known: dict[str, bool] = {}

    def one(fen):
        if fen is None:
            return None
        if fen not in known:
            try:
                known[fen] = Board(fen).legal_ep()
            except (Illegal, IndexError):
                known[fen] = False
        return known[fen]

    return fens.map(one, na_action="ignore").astype(object)


def _squeezed(text: Column) -> Column:
    """Trimmed, with single blanks; the regular expression only sees texts that need it."""
    plain = F.trim(text)
    return F.when(plain.contains("  ") | plain.rlike("[\\t\\r\\n]"), F.regexp_replace(F.regexp_replace(plain, r"\s+", " "), "^ | $", "")).otherwise(plain)


def with_position(df: DataFrame, fen: str = "fen", name: str = "position") -> DataFrame:
    """Adds the first four FEN fields in one spelling.

    Blanks are squeezed, castling letters put in the order KQkq, and the
    en-passant square kept only if a capture there is legal.  Missing fields
    count as ``-``; null and empty texts give null.  Fields are cut once and
    then used by name; written as one nested expression they would be cut anew
    for each use.
    """
    part = lambda i: F.coalesce(F.get("__p", F.lit(i)), F.lit(""))
    cut = df.withColumn("__t", _squeezed(F.col(fen))).withColumn("__p", F.split("__t", " ", 5))
    cut = cut.withColumn("__board", part(0)).withColumn("__turn", F.lower(part(1))).withColumn("__given", part(2)).withColumn("__ep", F.lower(part(3)))
    rights = F.concat(*[F.when(F.contains("__given", F.lit(c)), c).otherwise("") for c in "KQkq"])
    cut = cut.withColumn("__rights", F.when(F.col("__given").isin("-", "KQkq"), F.col("__given")).otherwise(rights))
    there = F.col("__ep").isin([f + r for f in "abcdefgh" for r in "36"])
    cut = cut.withColumn("__can", _can_capture(F.when(there, F.concat_ws(" ", "__board", "__turn", F.lit("-"), "__ep"))))
    rights = F.when(F.col("__rights") == "", "-").otherwise(F.col("__rights"))
    whole = F.when(F.length("__t") > 0, F.concat_ws(" ", "__board", "__turn", rights, F.when(F.col("__can"), F.col("__ep")).otherwise("-")))
    return cut.withColumn(name, whole).drop("__t", "__p", "__board", "__turn", "__given", "__ep", "__rights", "__can")


def move_key(move: Column) -> Column:
    """A move in plain lower-case coordinates; null if there is none."""
    return F.nullif(F.translate(F.lower(move), "=- \t\r\n", ""), F.lit(""))


def castling_key(move: Column, position: Column) -> Column:
    """The move, with castling written as the king's two steps also where it was written as king takes rook.

    A castling right says that king and rook stand at home, so no other piece
    can make that move.
    """
    castles = F.lit(None).cast("string")
    for taken, step, right, turn in (("e1h1", "e1g1", "K", "w"), ("e1a1", "e1c1", "Q", "w"), ("e8h8", "e8g8", "k", "b"), ("e8a8", "e8c8", "q", "b")):
        able = position.rlike(f"^\\S+ {turn} [A-Za-z]*{right}")
        castles = F.when((move == taken) & able, step).otherwise(castles)
    return F.when(move.isin("e1h1", "e1a1", "e8h8", "e8a8"), F.coalesce(castles, move)).otherwise(move)


def plain_lines(lines: DataFrame) -> DataFrame:
    """Engine lines with position, first move and line in one spelling each.

    The first move is ``move`` or else the first of ``line``; rows without
    position or first move belong to no group and are left out.  ``able`` says
    whether a row may survive: it has a score and a depth of 1 to 245.
    """
    rows = lines.select("line_id", "fen", "line", "move", "depth", "knodes", "cp", "mate", "fetched_at")
    rows = rows.withColumn("line", F.nullif(F.translate(F.lower(_squeezed(F.col("line"))), "=", ""), F.lit("")))
    rows = rows.withColumn("first", F.coalesce(move_key(F.col("move")), F.split_part("line", F.lit(" "), F.lit(1))))
    rows = with_position(rows).filter("position is not null and first is not null").drop("fen", "move")
    rows = rows.withColumn("first", castling_key(F.col("first"), F.col("position")))
    return rows.withColumn("able", F.coalesce((F.col("cp").isNotNull() | F.col("mate").isNotNull()) & F.col("depth").between(1, MAX_DEPTH), F.lit(False)))


# ---- progressive alignment -------------------------------------------------------

Profile = list[dict[str, float]]


def _merge(profile: Profile, other: Profile, weight: float, other_weight: float) -> Profile:
    """Needleman-Wunsch of two profiles; a pair of columns scores the cosine of their votes."""
    n, m = len(profile), len(other)
    if not n or not m or [max(c, key=c.get) for c in profile] == [max(c, key=c.get) for c in other]:
        longer, gaps = (profile, other) if n >= m else (other, profile)
        if n and m:
            return [{t: a.get(t, 0.0) + b.get(t, 0.0) for t in a | b} for a, b in zip(profile, other)]
        missing = other_weight if n >= m else weight
        return [c | {GAP: c.get(GAP, 0.0) + missing} for c in longer]
    norm, other_norm = ([sum(v * v for v in c.values()) ** 0.5 or 1.0 for c in p] for p in (profile, other))
    gap = -0.4
    score = [[0.0] * (m + 1) for _ in range(n + 1)]
    back = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        score[i][0], back[i][0] = i * gap, 1
    for j in range(1, m + 1):
        score[0][j], back[0][j] = j * gap, 2
    for i in range(1, n + 1):
        a, length = profile[i - 1], norm[i - 1]
        for j in range(1, m + 1):
            b = other[j - 1]
            small, large = (a, b) if len(a) <= len(b) else (b, a)
            same = sum(v * large[t] for t, v in small.items() if t in large) / (length * other_norm[j - 1])
            best, way = score[i - 1][j - 1] + 2 * same - 0.7, 0
            if score[i - 1][j] + gap > best:
                best, way = score[i - 1][j] + gap, 1
            if score[i][j - 1] + gap > best:
                best, way = score[i][j - 1] + gap, 2
            score[i][j], back[i][j] = best, way
    out, i, j = [], n, m
    while i or j:
        way = back[i][j]
        if way == 0:
            a, b = profile[i - 1], other[j - 1]
            out.append({t: a.get(t, 0.0) + b.get(t, 0.0) for t in a | b})
            i, j = i - 1, j - 1
        elif way == 1:
            out.append(profile[i - 1] | {GAP: profile[i - 1].get(GAP, 0.0) + other_weight})
            i -= 1
        else:
            out.append(other[j - 1] | {GAP: other[j - 1].get(GAP, 0.0) + weight})
            j -= 1
    return out[::-1]


def align(variants: list[tuple[Profile, float]]) -> tuple[Profile, float]:
    """One profile of all, taking the heaviest first, so weak variants bend to strong ones."""
    profile, weight = variants[0]
    for other, w in variants[1:]:
        profile, weight = _merge(profile, other, weight, w), weight + w
    return profile, weight


def vote(profile: Profile) -> list[str]:
    """The heaviest token of each column, ties to the smallest; columns won by the gap vanish."""
    won = [min(c, key=lambda t: (-c[t], t)) for c in profile]
    return [t for t in won if t != GAP]


def token_distance(a: list[str], b: list[str]) -> int:
    """Edit distance of two token sequences."""
    if a == b:
        return 0
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def _profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (group, block, parts): each aligned to one profile."""
    for df in batches:
        out = []
        for parts in df["parts"]:
            variants = [([dict(zip(c["tokens"], c["votes"])) for c in p["columns"]], p["weight"]) for p in parts]
            profile, weight = align(variants)
            out.append({"weight": weight, "columns": [{"tokens": list(c), "votes": list(c.values())} for c in profile]})
        yield pd.DataFrame({"group_id": df["group_id"], "block": df["block"], "part": out})


def _votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        yield pd.DataFrame({"group_id": df["group_id"], "consensus": [" ".join(vote([dict(zip(c["tokens"], c["votes"])) for c in p["columns"]])) for p in df["part"]]})


@F.pandas_udf(T.IntegerType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else token_distance(x.split(), y.split()) for x, y in zip(a, b)], dtype="Int64")


_PART = "struct<weight double, columns array<struct<tokens array<string>, votes array<double>>>>"


def consensus(variants: DataFrame, *, block: int = 64) -> DataFrame:
    """(group_id, consensus) of rows (group_id, tokens STRING, weight DOUBLE), one row a distinct text.

    A group of any number of variants is aligned as a tree: blocks of about
    ``block`` become one profile each, their profiles are aligned in blocks
    again, until one is left.  No task sees more than a block of a group, and
    groups of one variant never leave the JVM.
    """
    counted = variants.filter(F.length("tokens") > 0)
    sizes = counted.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.max("tokens").alias("only"))
    alone = sizes.filter("n = 1").select("group_id", F.col("only").alias("consensus"))
    many = counted.join(sizes.filter("n > 1").select("group_id", "n"), "group_id")
    column = lambda t: F.struct(F.array(t).alias("tokens"), F.array(F.col("weight")).alias("votes"))
    parts = many.select("group_id", "n", F.xxhash64("tokens").alias("place"), F.struct("weight", F.transform(F.split("tokens", " "), column).alias("columns")).alias("part"), "tokens")
    most = sizes.agg(F.max("n")).first()[0] or 0
    while True:
        blocks = F.ceil(F.col("n") / F.lit(block)).cast("bigint")
        order = F.array_sort(F.collect_list(F.struct((-F.col("part.weight")).alias("w"), F.col("tokens"), F.col("part"))))
        gathered = parts.withColumn("block", F.pmod("place", blocks)).groupBy("group_id", "block").agg(F.transform(order, lambda x: x["part"]).alias("parts"))
        merged = gathered.mapInPandas(_profiles, f"group_id binary, block bigint, part {_PART}")
        if most <= block:
            break
        # hash blocks are of about block rows; each pass divides a group's parts by as much
        most = -(-most // block)
        merged = cut_lineage(merged)
        left = merged.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
        parts = merged.join(left, "group_id").select("group_id", "n", F.xxhash64("block").alias("place"), "part", F.col("block").cast("string").alias("tokens"))
        most = max(most, left.agg(F.max("n")).first()[0] or 0)
    return alone.unionByName(merged.select("group_id", "part").mapInPandas(_votes, "group_id binary, consensus string"))


#: Up to so many groups (at most about 10 MB of keys) are joined by broadcast, more by shuffle.
FEW_GROUPS = 100_000


def _of_groups(rows: DataFrame, groups: DataFrame, few: int) -> DataFrame:
    """The rows of ``groups`` (group_id), of which there are ``few`` or more than ``FEW_GROUPS``."""
    return rows.join(F.broadcast(groups) if few <= FEW_GROUPS else groups, "group_id", "left_semi")


def ballot(depth: Column) -> Column:
    """The votes of a row: the square of its depth, and one without a possible depth."""
    return F.when(depth.between(1, MAX_DEPTH), (depth * depth).cast("bigint")).otherwise(F.lit(1).cast("bigint"))


def _keyed(lines: DataFrame) -> DataFrame:
    key = F.unhex(F.md5(F.concat_ws(" ", "position", "first")))
    rows = plain_lines(lines).select(key.alias("group_id"), "line_id", "line", "depth", "knodes", "cp", "mate", F.col("fetched_at").cast("timestamp_ntz").alias("fetched_at"), "able")
    trust = F.struct("depth", F.coalesce("knodes", F.lit(-1)).alias("knodes"), F.coalesce("fetched_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("at"), (-F.col("line_id")).alias("neg"))
    return rows.withColumn("votes", ballot(F.col("depth"))).withColumn("trust", F.when(F.col("able") & F.col("line_id").isNotNull(), trust))


def best_lines(lines: DataFrame, *, block: int = 64) -> DataFrame:
    """One survivor for each position and first move that has one.

    Columns: line_id, n_rows of its group, depth, knodes, cp, mate and
    fetched_at of the survivor; ``consensus_line``, the moves voted by the rows
    of the group; ``line``, the existing line closest to them by edit distance
    (the heavier, then the smaller text, if several are as close).

    Only rows with an id, a score and a possible depth may survive.  The first
    columns order them by depth, knodes (missing is least), fetched_at (missing
    is least) and smallest line_id.  All rows of the group vote on the moves,
    each with the square of its depth, and with one if that is missing or
    impossible; rows without a line cast no vote, and a group without any line
    has a null one.  Groups of nothing but unable rows are left out.  Extra
    columns are ignored; an empty table gives no rows.

    Rows are summed by group and line, then by group, both in two phases, so a
    group of any size sends a few rows a task.  A line with more than half of
    the votes wins every column it is in and the gap wins the rest, so it is
    the consensus as it stands; the lines of all other groups are aligned, at
    most ``block`` in one task (see ``consensus``).  The result of a group
    depends on its own rows only.
    """
    return _with_consensus(_keyed(lines), block).drop("group_id")


def _with_consensus(rows: DataFrame, block: int) -> DataFrame:
    kept = F.max(F.when(F.col("trust").isNotNull(), F.struct("trust", "line_id", "depth", "knodes", "cp", "mate", "fetched_at"))).alias("top")
    by_line = rows.groupBy("group_id", "line").agg(F.count(F.lit(1)).alias("n"), F.sum("votes").alias("votes"), kept)
    said = F.when(F.col("line").isNotNull(), F.col("votes"))
    best = F.max(F.when(F.col("line").isNotNull(), F.struct("votes", "line")))
    heads = by_line.groupBy("group_id").agg(F.sum("n").alias("n_rows"), F.max("top").alias("top"), F.sum(said).alias("cast"), best.alias("best")).filter("top is not null")
    names = ["group_id", "n_rows", *[F.col(f"top.{c}").alias(c) for c in ("line_id", "depth", "knodes", "cp", "mate", "fetched_at")]]
    heads = cut_lineage(heads.select(*names, "cast", F.col("best.votes").alias("best_votes"), F.col("best.line").alias("best_line")))
    closed = F.col("best_line").isNull() | (F.col("best_votes") * 2 > F.col("cast"))
    columns = ["group_id", "line_id", "n_rows", "depth", "knodes", "cp", "mate", "fetched_at"]
    plain = heads.filter(closed).select(*columns, F.col("best_line").alias("consensus_line"), F.col("best_line").alias("line"))
    open_groups = heads.filter(~closed)
    few = open_groups.limit(FEW_GROUPS + 1).count()
    if not few:
        return plain
    # the rows are read once more rather than all written: open groups are a small part of most tables
    said = _of_groups(rows.filter("line is not null"), open_groups.select("group_id"), few)
    ballots = cut_lineage(said.groupBy("group_id", F.col("line").alias("tokens")).agg(F.sum("votes").cast("double").alias("weight")))
    voted = cut_lineage(consensus(ballots, block=block))
    near = ballots.join(F.broadcast(voted) if few <= FEW_GROUPS else voted, "group_id").withColumn("far", _distance("tokens", "consensus"))
    closest = near.groupBy("group_id").agg(F.min(F.struct("far", (-F.col("weight")).alias("w"), "tokens")).getField("tokens").alias("line"), F.first("consensus").alias("consensus_line"))
    return plain.unionByName(open_groups.join(closest, "group_id").select(*columns, "consensus_line", "line"))


def built_lines(lines: DataFrame, *, block: int = 64) -> DataFrame:
    """``best_lines`` with the silent fields of each survivor filled by the vote of its group.

    A survivor always has a depth and a score; knodes and fetched_at may be
    missing.  Each row of the group votes for its value with the square of its
    depth; the value with most votes wins, the greatest of equals.  ``filled``
    names the fields that were filled, in the order knodes, fetched_at; a field
    that no row of the group knows stays missing.
    """
    rows = _keyed(lines)
    best = cut_lineage(_with_consensus(rows, block))
    silent = best.filter("knodes is null or fetched_at is null").select("group_id")
    zero = F.lit("1970-01-01").cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", zero, F.col("fetched_at"))
    choices = F.array(F.struct(F.lit(True).alias("nodes"), F.col("knodes").cast("bigint").alias("token")), F.struct(F.lit(False).alias("nodes"), micros.alias("token")))
    ballots = _of_groups(rows, silent, silent.limit(FEW_GROUPS + 1).count())
    counted = ballots.select("group_id", "votes", F.explode(choices).alias("x")).filter("x.token is not null").groupBy("group_id", "x.nodes", "x.token").agg(F.sum("votes").alias("votes"))
    most = lambda of: F.max(F.when(of, F.struct("votes", "token"))).getField("token")
    won = counted.groupBy("group_id").agg(most(F.col("nodes")).alias("won_nodes"), most(~F.col("nodes")).alias("won_time"))
    best = best.join(won, "group_id", "left")
    missing = lambda field, token: F.col(field).isNull() & F.col(token).isNotNull()
    filled = F.array_compact(F.array(F.when(missing("knodes", "won_nodes"), F.lit("knodes")), F.when(missing("fetched_at", "won_time"), F.lit("fetched_at"))))
    return best.select(
        "line_id", "n_rows", "depth", F.coalesce("knodes", F.col("won_nodes").cast("int")).alias("knodes"), "cp", "mate",
        F.coalesce("fetched_at", F.timestamp_add("MICROSECOND", F.col("won_time"), zero)).alias("fetched_at"), "consensus_line", "line", filled.alias("filled"),
    )
