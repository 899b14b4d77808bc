from collections import Counter
from fractions import Fraction

from pyspark.sql import functions as F

from plyforge.llm.quota_flow import Network, Target, band_name, category_records, cell_quotas, draw_report, draw_samples, needed, phase_name, quotas, shortfalls, target_report

TARGETS = "sample_name string, base_table string, category_field string, category string, target_share double, min_records bigint, sample_size bigint, quota bigint"


def test_cheapest_flow_on_a_small_network():
    net = Network()
    a, b = net.arc("s", "a", 4, 1), net.arc("s", "b", 5, 3)
    net.arc("a", "t", 3, 0), net.arc("a", "b", 9, 0), net.arc("b", "t", 4, 0)
    assert net.push("s", "t", 6) == 6 and (net.flow(a), net.flow(b)) == (4, 2)
    assert net.push("s", "t", 99) == 1


def test_needs_and_shortfalls():
    targets = [Target("a", Fraction("0.5"), 0), Target("b", Fraction("0.3333"), 40), Target("c", Fraction("0.1667"), 0)]
    assert [needed(t, 100) for t in targets] == [50, 40, 17]
    assert needed(Target("x", Fraction("0.07"), 0), 100) == 7
    assert shortfalls({("a", 1): 30, ("a", 2): 30, ("b", 1): 39}, targets, 100) == {"a": 0, "b": 1, "c": 17}


def test_quotas_meet_shares_floors_and_the_size():
    targets = [Target("a", Fraction("0.6"), 0), Target("b", Fraction("0.3"), 0), Target("c", Fraction("0.1"), 30)]
    cells = {("a", 1): 500, ("a", 2): 500, ("b", 1): 10, ("c", 1): 100}
    q = quotas(cells, targets, 200, "s")
    by = Counter()
    for (c, _), n in q.items():
        by[c] += n
    assert sum(by.values()) == 200 and by["b"] == 10 and by["c"] >= 30 and all(q[k] <= n for k, n in cells.items())
    assert q == quotas(cells, targets, 200, "s")
    assert abs(q[("a", 1)] - q[("a", 2)]) <= 60  # strata take proportional parts


def test_proportional_cells_in_expectation():
    cells = {("a", 1): 1, ("a", 2): 2}
    got = [quotas(cells, [Target("a", Fraction(1), 0)], 1, str(i))[("a", 2)] for i in range(400)]
    assert 0.5 < sum(got) / 400 < 0.85


def test_spellings(spark):
    p = spark.createDataFrame([(x,) for x in ("Opening", "op", "middle game", "MID", "end-game\t", "eg", "n/a", "?", "", None)], "t string").select(phase_name(F.col("t")).alias("x")).collect()
    assert [r.x for r in p] == ["opening", "opening", "middlegame", "middlegame", "endgame", "endgame", None, None, None, None]
    b = spark.createDataFrame([(x,) for x in ("1000 to 1500", "1000_1500", "1000–1500", " 1500 - 2000", "2000 plus", "≥2000", "2000 +", "n/a", None)], "t string").select(band_name(F.col("t")).alias("x")).collect()
    assert [r.x for r in b] == ["1000-1500"] * 3 + ["1500-2000"] + ["2000+"] * 3 + [None] * 2


def tables(spark, n=1000):
    rows = spark.range(n).select("id", F.when(F.col("id") % 10 < 8, "opening").when(F.col("id") % 10 == 8, "MID").otherwise(None).alias("phase"), F.lit("x").alias("category"))
    rows = rows.unionByName(rows.filter("id < 50")).unionByName(spark.createDataFrame([(None, "op", "x"), (3, "mid", "x")], "id bigint, phase string, category string"))
    return {"t": category_records(rows, ["id"], phase_name(F.col("phase")))}


def test_reports_and_draws(spark):
    rows = [("s", "t", "phase", "opening", 0.5, 0, 200, 1), ("s", "t", "phase", "middlegame", 0.5, 0, 240, 1), ("s", "t", "phase", "endgame", 0.0, 5, 240, 1), ("s", "t", "phase", None, 0.5, 1, 240, 1), ("other", "none", "f", "opening", 1.0, 1, 10, 1)]
    rows[0] = ("s", "t", "phase", "opening", 0.5, 0, 240, 1)
    targets = spark.createDataFrame(rows, TARGETS)
    got = {r.category: (r.needed, r.available, r.shortfall) for r in target_report(tables(spark), targets).filter("sample_name = 's'").collect()}
    assert got == {"opening": (120, 800, 0), "middlegame": (120, 101, 19), "endgame": (5, 0, 5)}
    drawn = draw_samples(tables(spark), targets).collect()
    by = Counter(r.category for r in drawn)
    assert sum(by.values()) == 240 and by["middlegame"] in (100, 101) and len({(r.sample_name, r.record) for r in drawn}) == len(drawn)
    again = draw_samples({k: v.repartition(6) for k, v in tables(spark).items()}, targets).collect()
    assert sorted(drawn) == sorted(again)
    assert draw_samples({"t": tables(spark)["t"].limit(0)}, targets).count() == 0
    assert target_report(tables(spark), targets.limit(0)).count() == 0


def test_strata_keep_their_margins_across_categories():
    targets = [Target(c, Fraction(1, 4), 0) for c in "abcd"]
    cells = {(c, s): n for c in "abcd" for s, n in (("x", 29), ("y", 35), ("z", 36))}
    for i in range(50):
        q, by = quotas(cells, targets, 40, str(i)), Counter()
        for (_, s), n in q.items():
            by[s] += n
        assert sum(q.values()) == 40 and all(sum(q[c, s] for s in "xyz") == 10 for c in "abcd")
        assert by["x"] in (11, 12) and by["y"] == 14 and by["z"] in (14, 15)
        assert all(q[c, "x"] in (2, 3) and q[c, "y"] in (3, 4) and q[c, "z"] in (3, 4) for c in "abcd")


def test_samples_hold_the_margin_of_a_second_field(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") < 2400, "opening").otherwise("middlegame").alias("phase"), F.when(F.col("id") % 10 == 0, "test").when(F.col("id") % 10 == 1, None).otherwise("train").alias("split"))
    rows = rows.unionByName(spark.createDataFrame([(1, "opening", "val"), (None, "opening", "val")], "id bigint, phase string, split string"))
    records = category_records(rows, ["id"], phase_name(F.col("phase")), F.col("split"))
    assert {(r.category, r.stratum): r.n for r in records.groupBy("category", "stratum").agg(F.count(F.lit(1)).alias("n")).collect()} == {
        ("opening", "train"): 1920, ("opening", "test"): 240, ("opening", ""): 239, ("opening", "val"): 1, ("middlegame", "train"): 1280, ("middlegame", "test"): 160, ("middlegame", ""): 160}
    targets = spark.createDataFrame([("s", "t", "phase", c, 0.5, 0, 200, 1) for c in ("opening", "middlegame")], TARGETS)
    drawn = draw_samples({"t": records}, targets).collect()
    cells, margin = Counter((r.category, r.stratum) for r in drawn), Counter(r.stratum for r in drawn)
    assert len({r.record for r in drawn}) == 200 and margin["train"] == 160 and margin["test"] == 20 and margin["val"] in (0, 1)
    assert cells["opening", "train"] == 80 and cells["middlegame", "test"] == 10
    assert {r.category: r.available for r in target_report({"t": records}, targets).collect()} == {"opening": 2400, "middlegame": 1600}


def test_a_surplus_is_spread_by_share():
    targets = [Target("a", Fraction(1, 2), 0), Target("b", Fraction(3, 10), 0), Target("c", Fraction(1, 5), 0)]
    for seed in range(40):
        q = quotas({("a", "x"): 100, ("b", "x"): 500, ("c", "x"): 900}, targets, 333, str(seed))
        assert sum(q.values()) == 333 and q["a", "x"] == 100
        assert abs(q["b", "x"] - 0.6 * 233) <= 2 and abs(q["c", "x"] - 0.4 * 233) <= 2
    q = quotas({("a", "x"): 100, ("b", "x"): 110, ("c", "x"): 900}, targets, 333, "s")  # b runs dry as well
    assert q == {("a", "x"): 100, ("b", "x"): 110, ("c", "x"): 123}


def test_categories_outrank_margins_where_both_cannot_hold():
    targets = [Target("a", Fraction(1, 2), 0), Target("b", Fraction(1, 2), 0)]
    cells = {("a", "x"): 900, ("a", "y"): 0, ("b", "x"): 10, ("b", "y"): 90}  # x is the greater part, but only a has much of it
    for seed in range(20):
        q = quotas(cells, targets, 100, str(seed))
        assert q["a", "x"] == 50 and q["b", "x"] + q["b", "y"] == 50 and q["b", "x"] == 5


def test_records_of_two_categories_serve_where_they_are_needed(spark):
    targets = [Target("a", Fraction(1, 2), 0), Target("b", Fraction(1, 2), 0)]
    got = cell_quotas({(("a",), "x"): 5, (("a", "b"), "x"): 30, (("b",), "x"): 0}, targets, 30, "s")
    by = Counter()
    for (_, _, c), q in got.items():
        by[c] += q
    assert by == {"a": 15, "b": 15} and got[("a", "b"), "x", "b"] == 15
    rows = [(i, "a") for i in range(35)] + [(i, "b") for i in range(5, 35)]
    records = category_records(spark.createDataFrame(rows, "id int, c string"), ["id"], F.col("c"))
    plan = spark.createDataFrame([("s", "t", "f", c, 0.5, 0, 40, 1) for c in "ab"], TARGETS)
    drawn = draw_samples({"t": records}, plan)
    assert drawn.select("record").distinct().count() == drawn.count() == 35
    report = {r.category: (r.needed, r.drawn, r.shortfall) for r in draw_report(drawn, plan).collect()}
    # 35 records cannot fill 40 places
    assert all(need == 20 and lack == need - got for need, got, lack in report.values()) and sum(lack for *_, lack in report.values()) == 5
