"""A sample that reruns reproduce and that only grows: frozen batch bottom-k."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plyforge.operators.ordering import bottom_k, hash_digits, salted_hash
from plyforge.session import cut_lineage


def first_arrivals(df: DataFrame, key: Sequence[str], batch: str) -> DataFrame:
    """(*key, batch): one row a record, with the batch it first arrived in.

    A record delivered again stays in its first batch, so batches are immutable.
    Rows without a key are no records; a null batch counts as a batch of its own
    that comes after all others.
    """
    late = F.struct(F.col(batch).isNull().alias("none"), F.col(batch).alias("b"))
    return df.dropna(subset=list(key)).groupBy(*key).agg(F.min(late).alias("x")).select(*key, F.col("x.b").alias(batch))


def frozen_sample(df: DataFrame, key: str | Sequence[str], batch: str, rate: str | Decimal, salt: str = "s1", *, by: Sequence[str] = ()) -> DataFrame:
    """(*by, *key, batch, sample_hash): of each batch exactly ceil(rate * size) records.

    Those with the smallest md5 of ``salt:key`` are taken, ties by key.  The
    choice within a batch depends on that batch alone, so it is the same in any
    run and partitioning, and records that arrive later never displace any.
    ``rate`` is a decimal text in 0..1 and taken exactly.  With ``by`` each of
    its values is a population of its own, with batches of its own; rows with a
    null there are left out.  Extra columns of ``df`` are ignored; an empty
    table gives no rows.  A batch is ranked in hash buckets of which only the
    lower ones are sorted: no task holds a batch.
    """
    share = Decimal(str(rate))
    if not 0 <= share <= 1:
        raise ValueError("rate must be in 0..1")
    num, den = share.as_integer_ratio()
    key = [key] if isinstance(key, str) else list(key)
    arrived = first_arrivals(df.select(*by, *key, batch), [*by, *key], batch).withColumn("sample_hash", salted_hash(salt, *[F.col(k) for k in key]))
    k = F.expr(f"(group_size * {num} + {den - 1}) div {den}")
    return bottom_k(arrived, [*by, batch], "sample_hash", k, key).select(*by, *key, batch, "sample_hash")


def continued_sample(df: DataFrame, chosen: DataFrame, key: str | Sequence[str], batch: str, mark: str, salt: str = "s1", *, by: Sequence[str] = ()) -> DataFrame:
    """(*by, *key, batch, mark, sample_hash): the frozen sample of ``df`` that keeps the records chosen before, by whatever tool.

    ``chosen`` has one row (*by, *key, mark) a record, ``mark`` never null; the
    records of it that are in ``df`` are all in the sample, with their mark.
    The rate of a batch is the share that they are of it and of the batches of
    its population before it, as an exact fraction: batches that arrive later
    change nothing.  In each batch they are the first of ceil(rate * size)
    records; the others, with a null mark, are those with the smallest md5 of
    ``salt:key``.  A batch of which more were chosen keeps them all and takes no
    other.  Otherwise as ``frozen_sample``.
    """
    key = [key] if isinstance(key, str) else list(key)
    record = [*by, *key]
    arrived = first_arrivals(df.select(*record, batch), record, batch).join(chosen.select(*record, mark), record, "left")
    digits = hash_digits(df) + 1  # the first digit says whether the record was chosen
    first = F.when(F.col(mark).isNotNull(), "0").otherwise("1")
    arrived = cut_lineage(arrived.withColumn("__order", F.concat(first, salted_hash(salt, *[F.col(k) for k in key]))))
    # a row a batch of each population
    sizes = arrived.groupBy(*by, batch).agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("__size"), F.count(mark).cast("decimal(38,0)").alias("__chosen"))
    so_far = Window.partitionBy(*by).orderBy(F.col(batch).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    sizes = sizes.withColumn("__all", F.sum("__size").over(so_far).cast("decimal(38,0)")).withColumn("__taken", F.sum("__chosen").over(so_far).cast("decimal(38,0)"))
    quota = F.greatest(F.expr("cast(__chosen as bigint)"), F.expr("(__size * __taken + __all - 1) div __all"))
    same = F.lit(True)
    for i, c in enumerate([*by, batch]):
        same = same & F.col(c).eqNullSafe(F.col(f"__c{i}"))
    quotas = sizes.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate([*by, batch])], quota.alias("__quota"))
    kept = bottom_k(arrived.join(F.broadcast(quotas), same), [*by, batch], "__order", F.col("__quota"), key, digits=digits)
    return kept.select(*record, batch, mark, F.substring("__order", 2, 32).alias("sample_hash"))


def changed_batches(before: DataFrame, after: DataFrame, key: str, batch: str, rate: str | Decimal, salt: str = "s1") -> DataFrame:
    """(batch, lost, joined): batches that are not immutable, because records arrived under an old batch number.

    Draws the sample of both states of a table and counts, by the batches there
    were before, the records that were chosen and no longer are, and those that
    are chosen now and were not.  No rows if the old batches are as they were.
    """
    old, new = (frozen_sample(df, key, batch, rate, salt).select(key, F.col(batch).alias("b")) for df in (before, after))
    known = before.select(F.col(batch).alias("k")).distinct()
    gone = old.join(new, old[key].eqNullSafe(new[key]) & old.b.eqNullSafe(new.b), "left_anti").select("b", F.lit(1).alias("lost"), F.lit(0).alias("joined"))
    come = new.join(old, new[key].eqNullSafe(old[key]) & new.b.eqNullSafe(old.b), "left_anti").join(known, F.col("b").eqNullSafe(F.col("k")), "left_semi").select("b", F.lit(0).alias("lost"), F.lit(1).alias("joined"))
    return gone.unionByName(come).groupBy(F.col("b").alias(batch)).agg(F.sum("lost").alias("lost"), F.sum("joined").alias("joined"))


def held_draws(draws: DataFrame) -> DataFrame:
    """(sample_name, item_kind, item_key, held): one row a record that a sample has drawn, with the list of those draws.

    A sample has few draws.  Rows with a null count for nothing, repeated rows once.
    """
    record = ["sample_name", "item_kind", "item_key"]
    return cut_lineage(draws.select(*record, "draw_no").dropna().groupBy(*record).agg(F.collect_set("draw_no").alias("held")))


def drawn_again(held: DataFrame, live: DataFrame, batch: str | None = None) -> DataFrame:
    """(sample_name, item_kind, item_key, batch_no, held, sample_hash): the frozen samples that go on from recorded draws.

    ``held`` is of ``held_draws``.  Each sample draws from the ``live`` records
    of the kinds that it has drawn, at the share that it has drawn of them so
    far, and keeps all that it has drawn and that still exist; ``held`` is null
    for records that fill a batch up.  ``batch`` names the column of ``live`` with
    the delivery batch; without it all records came in one.
    """
    by = ["sample_name", "item_kind"]
    there = live.select("item_kind", "item_key", (F.col(batch) if batch else F.lit(None).cast("int")).alias("batch_no"))
    # a row a sample and kind
    population = there.join(F.broadcast(held.select(*by).distinct()), "item_kind")
    return continued_sample(population, held, "item_key", "batch_no", "held", by=by)


def lost_records(draws: DataFrame, live: DataFrame, batch: str | None = None) -> DataFrame:
    """Breaches of the append-only rule: (sample_name, draw_no, item_kind, item_key).

    ``draws`` has sample_name, draw_no, item_kind and item_key in plain form,
    ``live`` the item_kind and item_key of records that still exist, and their
    delivery batch if ``batch`` names it.  The samples are drawn again as frozen
    samples of the live records that go on from the recorded draws
    (``drawn_again``), and the recorded draws are judged by them: a row says
    that a record of the frozen sample was in the recorded draw ``draw_no - 1``
    and is not in the recorded ``draw_no``, which was drawn.  A frozen sample
    has no such rows.  Rows with a null count for nothing, repeated rows once.
    """
    held = held_draws(draws)
    sample = drawn_again(held, live, batch)
    after = F.transform("held", lambda d: (d + 1).cast("int"))
    absent = F.filter(after, lambda d: ~F.array_contains("held", d))
    missed = sample.select("sample_name", "item_kind", "item_key", F.explode(absent).alias("draw_no"))
    made = held.select("sample_name", F.explode("held").alias("draw_no")).distinct()
    return missed.join(made, ["sample_name", "draw_no"], "left_semi").select("sample_name", "draw_no", "item_kind", "item_key")


def game_key(text: Column) -> Column:
    """A 64-bit id in signed decimal digits, from signed or unsigned digits, with ``.0`` or blanks."""
    digits = F.regexp_extract(F.trim(text), r"^([+-]?\d{1,20})(?:\.0*)?$", 1)
    number = F.when(digits != "", digits).try_cast("decimal(21,0)") if hasattr(Column, "try_cast") else F.when(digits != "", digits).cast("decimal(21,0)")
    folded = F.when(number > F.lit("9223372036854775807").cast("decimal(21,0)"), number - F.lit("18446744073709551616").cast("decimal(21,0)")).otherwise(number)
    return folded.cast("decimal(20,0)").cast("string")


def puzzle_key(text: Column) -> Column:
    """The plain id out of ``#id``, ``/training/id``, a link, or an id with blanks; case counts."""
    plain = F.regexp_replace(F.trim(text), r"^(?:.*[/#])", "")
    return F.when(plain != "", plain)


def plain_draws(draws: DataFrame) -> DataFrame:
    """Recorded draws with their kind and key in plain form."""
    kind = F.lower(F.trim("item_kind"))
    return draws.select("sample_name", "draw_no", kind.alias("item_kind"), F.when(kind == "game", game_key(F.col("item_key"))).when(kind == "puzzle", puzzle_key(F.col("item_key"))).alias("item_key"))


def live_records(games: DataFrame, puzzles: DataFrame) -> DataFrame:
    """(item_kind, item_key, batch_no) of all games and puzzles."""
    return games.select(F.lit("game").alias("item_kind"), F.col("game_id").cast("string").alias("item_key"), "batch_no").unionByName(puzzles.select(F.lit("puzzle").alias("item_kind"), F.trim("puzzle_id").alias("item_key"), "batch_no"))
