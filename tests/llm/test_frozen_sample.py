import hashlib
import math
import random
from fractions import Fraction

import pytest

from plyforge.llm import frozen_sample as module
from plyforge.llm.frozen_sample import changed_batches, frozen_sample, game_key, lost_records, plain_draws, puzzle_key
from pyspark.sql import functions as F


def brute(rows, rate, salt):
    first = {}
    for key, batch in rows:
        if key is not None:
            order = (batch is None, batch or 0)
            first[key] = min(first.get(key, order), order)
    out = set()
    for b in set(first.values()):
        keys = sorted((k for k, x in first.items() if x == b), key=lambda k: (hashlib.md5(f"{salt}:{k}".encode()).hexdigest(), k))
        out |= set(keys[: math.ceil(Fraction(rate) * len(keys))])
    return out


def table(spark, rows):
    return spark.createDataFrame([(k, b, 0, "x") for k, b in rows], "id bigint, batch int, group_size int, sample_hash string")


def test_each_batch_keeps_exactly_its_smallest_hashes(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(3000), rng.choice([1, 1, 1, 2, 3, None])) for _ in range(6000)] + [(None, 1)] * 5
    for rate in ("0.1", "0", "1", "0.333"):
        got = {r.id for r in frozen_sample(table(spark, rows), "id", "batch", rate, "q").collect()}
        assert got == brute(rows, rate, "q")
    with pytest.raises(ValueError):
        frozen_sample(table(spark, rows), "id", "batch", "1.5")


def test_the_sample_only_grows_and_partitioning_does_not_matter(spark):
    rows = [(i, i % 4 + 1) for i in range(2000)] + [(i, 4) for i in range(0, 2000, 5)]  # delivered again later
    samples = []
    for upto in (1, 2, 3, 4):
        df = table(spark, [r for r in rows if r[1] <= upto])
        a = {r.id for r in frozen_sample(df, "id", "batch", "0.2").collect()}
        assert a == {r.id for r in frozen_sample(df.repartition(7), "id", "batch", "0.2").collect()}
        samples.append(a)
    assert all(a <= b for a, b in zip(samples, samples[1:])) and len(samples[0]) < len(samples[-1])
    assert frozen_sample(table(spark, rows).limit(0), "id", "batch", "0.2").count() == 0


def test_keys_in_any_spelling(spark):
    top = 2**64
    cases = {"12": "12", " -5 ": "-5", "7.0": "7", str(top - 1): "-1", str(2**63): str(-(2**63)), str(2**63 - 1): str(2**63 - 1), "x": None, "": None}
    rows = spark.createDataFrame(list(cases.items()), "k string, want string").withColumn("got", game_key(F.col("k"))).collect()
    assert all(r.got == r.want for r in rows)
    cases = {"aB3xY": "aB3xY", "#aB3xY": "aB3xY", "/training/aB3xY ": "aB3xY", "https://a.b/training/aB3xY": "aB3xY", " ": None}
    rows = spark.createDataFrame(list(cases.items()), "k string, want string").withColumn("got", puzzle_key(F.col("k"))).collect()
    assert all(r.got == r.want for r in rows)


def test_lost_records(spark):
    rows = [("s", 1, "game", "1"), ("s", 1, "Game ", " 2"), ("s", 1, "game", "3"), ("s", 1, "puzzle", "#a"), ("s", 2, "game", "1.0"), ("s", 2, "puzzle", "a"), ("s", 2, "game", "9"), (None, 1, "game", "2"), ("s", None, "game", "2"), ("s", 1, None, "2")]
    draws = plain_draws(spark.createDataFrame(rows, "sample_name string, draw_no int, item_kind string, item_key string"))
    live = spark.createDataFrame([("game", "2"), ("game", "1"), ("game", "9"), ("puzzle", "a"), (None, None)], "item_kind string, item_key string")
    # 3 no longer exists; 9 is new; draw 3 was never made
    assert [tuple(r) for r in lost_records(draws, live).collect()] == [("s", 2, "game", "2")]
    assert lost_records(draws.limit(0), live).count() == 0


def test_the_sample_that_judges_takes_a_share(spark, monkeypatch):
    """Of 1,000 live records 100 were drawn before: the judging sample chooses 100 of 1,000, not all of what it is given."""
    live = spark.createDataFrame([("game", str(i)) for i in range(1000)], "item_kind string, item_key string")
    draws = spark.createDataFrame([("s", d, "game", str(i)) for i in range(100) for d in (1, 2) if (i, d) != (7, 2)], "sample_name string, draw_no int, item_kind string, item_key string")
    sizes, real = [], module.bottom_k

    def spy(df, *args, **more):
        out = real(df, *args, **more)
        sizes.append((df.count(), out.count()))
        return out

    monkeypatch.setattr(module, "bottom_k", spy)
    assert [tuple(r) for r in lost_records(draws, live).collect()] == [("s", 2, "game", "7")]
    assert sizes == [(1000, 100)]


def test_recorded_draws_are_judged_by_a_sample_at_their_share(spark):
    """The sample that judges is a part of the live records: what was drawn before, and the smallest hashes up to ceil(share * size) of each batch."""
    rng = random.Random(9)
    came = {("game", str(i)): rng.choice([1, 1, 1, 2, 3, None]) for i in range(2000)} | {("puzzle", f"p{i}"): rng.choice([1, 2]) for i in range(700)}
    live = [(*item, b) for item, b in came.items()] + [("game", str(i), 9) for i in range(0, 2000, 7) if came["game", str(i)]] + [("game", None, 1), (None, "5", 1)]
    drawn = {}
    for name, kinds, part in (("a", ("game",), 0.1), ("b", ("game", "puzzle"), 0.2), ("c", ("puzzle",), 0.02)):
        for item in rng.sample([i for i in came if i[0] in kinds], int(part * 2000)):
            drawn[name, *item] = {d for d in range(came[item] or 4, 5) if rng.random() < 0.9}
        for i in range(20):  # no longer there
            drawn[name, kinds[0], f"gone{i}"] = {1, 2}
    drawn = {k: v for k, v in drawn.items() if v}
    for item in [i for i, b in came.items() if i[0] == "puzzle" and b == 2][:150]:  # more of one batch than its share
        drawn["c", *item] = {2, 3, 4}
    df = spark.createDataFrame([(n, d, k, x) for (n, k, x), ds in drawn.items() for d in ds for _ in range(2)], "sample_name string, draw_no int, item_kind string, item_key string")
    alive = spark.createDataFrame(live, "item_kind string, item_key string, batch_no int")

    want, filled, kept_all = set(), 0, 0
    for name, kind in {x[:2] for x in drawn}:
        population = [x for k, x in came if k == kind]
        old = {x for x in population if (name, kind, x) in drawn}
        taken = size = 0
        for b in sorted({came[kind, x] for x in population}, key=lambda b: (b is None, b or 0)):
            batch = sorted((x for x in population if came[kind, x] == b), key=lambda x: (x not in old, hashlib.md5(f"s1:{x}".encode()).hexdigest(), x))
            mine = sum(x in old for x in batch)
            taken, size = taken + mine, size + len(batch)
            quota = math.ceil(Fraction(taken, size) * len(batch))
            want |= {(name, kind, x) for x in batch[: max(mine, quota)]}
            filled, kept_all = filled + max(0, quota - mine), kept_all + (mine > quota)
    assert filled and kept_all
    got = module.drawn_again(module.held_draws(df), alive, "batch_no").collect()
    assert {(r.sample_name, r.item_kind, r.item_key) for r in got} == want and len(got) == len(want)
    assert all(r.batch_no == came[r.item_kind, r.item_key] for r in got)
    assert all(r.held is None if (x := (r.sample_name, r.item_kind, r.item_key)) not in drawn else set(r.held) == drawn[x] for r in got)

    # batches that arrive later change nothing
    early = module.drawn_again(module.held_draws(df), alive.filter("batch_no <= 2"), "batch_no").collect()
    assert {(r.sample_name, r.item_kind, r.item_key) for r in early} == {x for x in want if (came[x[1:]] or 4) <= 2}

    # the same in any partitioning, and the lost records are those of the recorded draws
    lost = sorted(tuple(r) for r in lost_records(df.repartition(5), alive.repartition(3), "batch_no").collect())
    made = {(n, d) for (n, _, _), ds in drawn.items() for d in ds}
    assert lost == sorted((n, d + 1, k, x) for (n, k, x), ds in drawn.items() for d in ds if (k, x) in came and d + 1 not in ds and (n, d + 1) in made)
    assert lost


def test_populations_are_drawn_apart(spark):
    rng = random.Random(5)
    rows = {p: [(rng.randrange(500), rng.choice([1, 2, None])) for _ in range(400)] for p in ("a", "b")}
    df = spark.createDataFrame([(p, k, b) for p, xs in rows.items() for k, b in xs] + [(None, 1, 1)], "population string, id bigint, batch int")
    got = {(r.population, r.id) for r in frozen_sample(df, "id", "batch", "0.25", "q", by=["population"]).collect()}
    assert got == {(p, k) for p, xs in rows.items() for k in brute(xs, "0.25", "q")}


def test_late_rows_of_an_old_batch_are_noticed(spark):
    rows = [(i, i % 3 + 1) for i in range(300)]
    before = table(spark, rows)
    assert changed_batches(before, table(spark, rows + [(i, 4) for i in range(500, 600)]), "id", "batch", "0.2").count() == 0
    changed = changed_batches(before, table(spark, rows + [(i, 2) for i in range(500, 900)]), "id", "batch", "0.2").collect()
    assert [r.batch for r in changed] == [2] and changed[0].joined >= 80
