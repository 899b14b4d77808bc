"""Splits that keep related records together.

Records that share a game are joined by edges; Boruvka-style contraction picks
for each component its smallest outgoing edge, contracts along the picks and
repeats.  The picked edges form a spanning forest, which is written out; its
roots are put in bands by size and dealt to the splits systematically.
"""

from __future__ import annotations

from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyforge.operators.ordering import grouped_rank, salted_hash
from plyforge.operators.skew import salted_lookup
from plyforge.session import cut_lineage


def star_edges(df: DataFrame, id_col: str, key: str, centre: Column | None = None) -> DataFrame:
    """(u, v): each id of a key group tied to one id of the group, n - 1 edges and not n * n.

    ``centre`` marks ids that may be the middle (default all); groups without
    one have no edges.  The middle is the smallest such id.
    """
    ids = df.select(F.col(id_col).alias("v"), F.col(key).alias("__key"), (centre if centre is not None else F.lit(True)).alias("__may")).filter(F.col("__key").isNotNull() & F.col("v").isNotNull())
    middle = ids.groupBy("__key").agg(F.min(F.when(F.col("__may"), F.col("v"))).alias("u"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    middle = middle.filter(F.col("u").isNotNull() & (F.col("lo") != F.col("hi"))).select("__key", "u")
    return salted_lookup(ids.select("__key", "v").distinct(), middle, ["__key"], how="inner", spread="v").filter("u <> v").select("u", "v").distinct()


def spanning_forest(edges: DataFrame, *, max_rounds: int = 40) -> tuple[DataFrame, DataFrame]:
    """(forest, roots) of an undirected graph given by its edges (u, v).

    ``forest`` has the picked edges (u, v, round), ``roots`` one row a vertex
    that has an edge: (id, root), root the smallest id of its component.  Each
    round at least halves the number of components with outgoing edges.  The
    result is written to the checkpoint folder after each round, so a lost
    executor costs one round.  Self-loops and rows with a null are ignored.
    ``max_rounds`` halvings are enough for any number of ids a table can hold;
    running out of them is an error and drops nothing.
    """
    spark = edges.sparkSession
    clean = edges.select("u", "v").dropna().filter("u <> v")
    live = cut_lineage(clean.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().withColumn("a", F.col("u")).withColumn("b", F.col("v")))
    kind = dict(clean.dtypes)["u"]
    member = live.select(F.explode(F.array("u", "v")).alias("id")).distinct().withColumn("root", F.col("id"))
    forest = spark.createDataFrame([], f"u {kind}, v {kind}, round int")
    number = 0
    # a, b: the components of u, v
    while not live.isEmpty():
        number += 1
        if number > max_rounds:
            raise RuntimeError("the forest did not close")
        both = live.select("a", "b", "u", "v").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b"), "u", "v"))
        # edges have one total order, so picks close no cycle but pairs that pick each other; a hashed one keeps chains of picks short
        pick = cut_lineage(both.groupBy("a").agg(F.min(F.struct(F.xxhash64("u", "v").alias("h"), "u", "v", "b")).alias("x")).select("a", "x.u", "x.v", "x.b"))
        forest = forest.unionByName(pick.select("u", "v").distinct().withColumn("round", F.lit(number)))
        parent = pick.select(F.col("a").alias("id"), F.col("b").alias("up"))
        mutual = salted_lookup(parent, parent.select(F.col("id").alias("up"), F.col("up").alias("back")), ["up"], spread="id")
        parent = cut_lineage(mutual.select("id", F.when((F.col("back") == F.col("id")) & (F.col("id") < F.col("up")), F.col("id")).otherwise(F.col("up")).alias("up")))
        while True:  # pointer doubling: chains halve each time
            grand = salted_lookup(parent, parent.select(F.col("id").alias("up"), F.col("up").alias("top")), ["up"], spread="id")
            doubled = cut_lineage(grand.select("id", "top", (F.col("top") != F.col("up")).alias("moved")))
            parent = doubled.select("id", F.col("top").alias("up"))
            if doubled.filter("moved").isEmpty():
                break
        step = parent.select(F.col("id").alias("root"), F.col("up").alias("to"))
        member = cut_lineage(salted_lookup(member, step, ["root"], spread="id").select("id", F.coalesce("to", "root").alias("root")))
        # both ends in one lookup: an edge has two rows, put together again by its own key
        ends = live.select("u", "v", F.explode(F.array(F.struct(F.lit(True).alias("first"), F.col("a").alias("at")), F.struct(F.lit(False).alias("first"), F.col("b").alias("at")))).alias("x")).select("u", "v", "x.first", "x.at")
        found = salted_lookup(ends, parent.select(F.col("id").alias("at"), F.col("up").alias("to")), ["at"], spread="v")
        moved = found.groupBy("u", "v").agg(F.max(F.when(F.col("first"), F.col("to"))).alias("a"), F.max(F.when(~F.col("first"), F.col("to"))).alias("b")).filter("a <> b")
        # parallel edges of two components: only the one first in the order can ever be picked
        least = moved.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(F.struct(F.xxhash64("u", "v").alias("h"), "u", "v")).alias("x"))
        live = cut_lineage(least.select("x.u", "x.v", "a", "b"))
    smallest = member.groupBy("root").agg(F.min("id").alias("least"))
    named = salted_lookup(member, smallest, ["root"], spread="id").select("id", F.col("least").alias("root"))
    return cut_lineage(forest), cut_lineage(named)


def save_forest(forest: DataFrame, path: str) -> None:
    """Writes the picked edges (u, v, round) under ``path``, a folder all executors share; an older forest there is replaced."""
    forest.select("u", "v", "round").write.mode("overwrite").parquet(path)


def load_forest(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def extend_forest(forest: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(forest, roots) of the graph that ``forest`` spans and the new ``edges``.

    A forest has one edge less than its component has ids, so old edges are
    never read again however many there were.  The components are those of all
    edges together; an extended forest may be saved and extended in turn, but
    not over the folder it is read from while its rows are still needed.
    """
    return spanning_forest(forest.select("u", "v").unionByName(edges.select("u", "v")))


def deal_splits(roots: DataFrame, shares: Mapping[str, str], salt: str = "deal1") -> DataFrame:
    """Adds ``band`` and ``split`` to rows (root, size).

    Bands are powers of two of the size; roots are put in order of band, largest
    first, and salted hash within it, and dealt along that one order: of any n
    consecutive roots each split gets its share up to one or two, so each band
    and the whole keep the proportions.  Hash buckets bound what one task sorts.
    """
    parts = {name: Fraction(str(share)) for name, share in shares.items()}
    if sum(parts.values()) != 1 or min(parts.values()) < 0:
        raise ValueError("shares must add up to 1")
    keyed = roots.withColumn("band", F.floor(F.log2(F.greatest(F.col("size"), F.lit(1)).cast("double"))).cast("int")).withColumn("__h", salted_hash(salt, F.col("root")))
    placed = grouped_rank(keyed, ["band"], "__h", ["root"], name="__r")
    sizes = placed.groupBy("band").agg(F.max("__r_total").alias("n"))  # at most 64 bands
    before = sizes.alias("s").join(sizes.select(F.col("band").alias("larger"), F.col("n").alias("m")), F.col("larger") > F.col("band"), "left").groupBy("band").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("__before"))
    placed = placed.join(F.broadcast(before), "band").withColumn("__i", F.col("__before") + F.col("__r"))
    # the rarest split takes every 1/share-th root, the next one its part of those left, and so on
    order = sorted((share, name) for name, share in parts.items() if share)
    split, index, left = F.lit(None).cast("string"), "__i", Fraction(1)
    for share, name in order[:-1]:
        part = share / left
        upto = f"(({index}) * {part.numerator} + {part.denominator // 2}) div {part.denominator}"
        upto_last = f"(({index} - 1) * {part.numerator} + {part.denominator // 2}) div {part.denominator}"
        split = F.when(split.isNotNull(), split).when(F.expr(f"{upto} > {upto_last}"), F.lit(name))
        index, left = f"({index} - {upto})", left - share
    return placed.withColumn("split", F.coalesce(split, F.lit(order[-1][1]))).drop("__h", "__r", "__r_total", "__before", "__i")


def link_code(site: Column) -> Column:
    """The eight-character, case-sensitive game code of a link; null if there is none."""
    code = F.regexp_extract(F.trim(site), r"(?i)^(?:https?://)?(?:www\.)?[a-z0-9.-]+\.[a-z]+/(?:game/)?([0-9A-Za-z]{8})(?![0-9A-Za-z])", 1)
    return F.when(code != "", code)


def game_edges(games: DataFrame) -> DataFrame:
    """(u, v): pairs of ids that are one played game.

    Ids whose links carry the same code, and ids of which one has no usable link
    and whose players, date and moves agree (case and blanks of names and blanks
    of moves do not count; a null in any of them agrees with nothing).
    """
    squeeze = lambda c: F.regexp_replace(F.trim(c), r"\s+", " ")
    rows = games.select("game_id", link_code(F.col("site")).alias("code"), F.lower(squeeze(F.col("white_name"))).alias("w"), F.lower(squeeze(F.col("black_name"))).alias("b"), F.col("utc_date").cast("string").alias("d"), squeeze(F.col("uci")).alias("m"))
    played = F.when(F.col("w").isNotNull() & F.col("b").isNotNull() & F.col("d").isNotNull() & F.col("m").isNotNull(), F.sha2(F.concat_ws("\n", "w", "b", "d", "m"), 256))
    rows = rows.select("game_id", "code", played.alias("played"))
    by_code = star_edges(rows, "game_id", "code")
    by_play = star_edges(rows, "game_id", "played", F.col("code").isNull())
    return by_code.unionByName(by_play).distinct()


def split_name(column: Column) -> Column:
    """train, val or test out of the ways a split is spelled; null for anything else."""
    text = F.lower(F.trim(column))
    return F.when(text.isin("train", "training", "trn", "tr"), "train").when(text.isin("val", "valid", "validation", "dev"), "val").when(text.isin("test", "testing", "tst", "te"), "test")


def recorded_splits(label_rows: DataFrame, puzzles: DataFrame) -> DataFrame:
    """(game_id, split): the distinct readable splits of each id."""
    rows = label_rows.select("game_id", split_name(F.col("split")).alias("split")).unionByName(puzzles.select("game_id", split_name(F.col("split")).alias("split")))
    return rows.dropna().distinct()


def torn_games(records: DataFrame, roots: DataFrame) -> DataFrame:
    """(game_id): ids with a record whose component has records in several splits.

    ``records`` has distinct (game_id, split), ``roots`` (id, root); ids without
    a root stand for themselves.  A component's splits are reduced to their
    smallest and largest on the map side.
    """
    placed = records.join(roots.withColumnRenamed("id", "game_id"), "game_id", "left").select("game_id", "split", F.coalesce("root", "game_id").alias("root"))
    torn = placed.groupBy("root").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).filter("lo <> hi").select("root")
    return salted_lookup(placed.select("root", "game_id").distinct(), torn, ["root"], how="inner", spread="game_id").select("game_id")


def _records(label_rows: DataFrame, puzzles: DataFrame) -> DataFrame:
    """(kind, record, game_id): every row of both tables under its label_id or puzzle_id, where the table has that column."""
    named = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), (F.col(key) if key in df.columns else F.lit(None)).cast("string").alias("record"), "game_id")
    return named(label_rows, "label", "label_id").unionByName(named(puzzles, "puzzle", "puzzle_id"))


def split_records(label_rows: DataFrame, puzzles: DataFrame, roots: DataFrame, shares: Mapping[str, str], salt: str = "deal1") -> DataFrame:
    """(kind, record, game_id, root, size, band, split): a split for every record, label rows and puzzles.

    ``size`` counts the records of the whole component.  A record without a
    game_id has a null root and is dealt as a component of its own, a puzzle
    together with its redeliveries; if one of these has a game, it follows that
    (the smallest id).  Only a row with neither game_id nor id of its own is
    not in the result, as it has no name.
    """
    rows = _records(label_rows, puzzles)
    told = rows.filter("kind = 'puzzle' and game_id is not null").groupBy("kind", "record").agg(F.min("game_id").alias("told"))
    lone = rows.filter("game_id is null and record is not null").join(told, ["kind", "record"], "left").select("kind", "record", "game_id", F.col("told").alias("id"))
    tied = rows.filter("game_id is not null").withColumn("id", F.col("game_id")).unionByName(lone.filter("id is not null"))
    tied = salted_lookup(tied, roots, ["id"], spread="record").select("kind", "record", "game_id", F.coalesce("root", "id").alias("root"))
    placed = tied.unionByName(lone.filter("id is null").withColumnRenamed("id", "root"))
    unit = F.coalesce(F.col("root").cast("string"), F.concat_ws(":", "kind", "record"))
    placed = cut_lineage(placed.withColumn("unit", unit))
    dealt = deal_splits(placed.groupBy(F.col("unit").alias("root")).agg(F.count(F.lit(1)).alias("size")), shares, salt)
    out = salted_lookup(placed, dealt.withColumnRenamed("root", "unit"), ["unit"], how="inner", spread="record")
    return out.select("kind", "record", "game_id", "root", "size", "band", "split")
