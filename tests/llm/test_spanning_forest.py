import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from plyforge.llm.spanning_forest import deal_splits, extend_forest, game_edges, link_code, load_forest, recorded_splits, save_forest, spanning_forest, split_name, split_records, star_edges, torn_games


def components(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("kind", ["random", "path", "star", "cycle"])
def test_forest_spans_each_component(spark, kind):
    rng = random.Random(2)
    edges = {
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(260)],
        "path": [(i, i + 1) for i in range(120)],
        "star": [(0, i) for i in range(1, 1500)],
        "cycle": [(i, (i + 1) % 40) for i in range(40)],
    }[kind]
    df = spark.createDataFrame(edges + [(5, None), (None, None), (3, 3)] + edges[:5], "u bigint, v bigint").withColumn("root", F.lit(1))
    forest, roots = spanning_forest(df)
    want = components([e for e in edges if e[0] != e[1]])
    assert {r.id: r.root for r in roots.collect()} == want
    picked = [(r.u, r.v) for r in forest.collect()]
    assert len(picked) == len(want) - len(set(want.values()))  # a forest: no edge too many
    assert components(picked) == want and set(map(frozenset, picked)) <= set(map(frozenset, edges))


def test_a_saved_forest_is_read_back_and_extended(spark, tmp_path):
    rng = random.Random(4)
    old, new = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)], [(rng.randrange(120), rng.randrange(120)) for _ in range(50)] + [(3, 3), (None, 4)]
    frame = lambda rows: spark.createDataFrame(rows, "u bigint, v bigint")
    forest, _ = spanning_forest(frame(old))
    save_forest(forest, str(tmp_path / "forest"))
    loaded = load_forest(spark, str(tmp_path / "forest"))
    assert sorted(loaded.collect()) == sorted(forest.collect())
    wider, roots = extend_forest(loaded, frame(new))
    want = components([e for e in old + new if None not in e and e[0] != e[1]])
    assert {r.id: r.root for r in roots.collect()} == want
    assert wider.count() == len(want) - len(set(want.values()))
    same, roots = extend_forest(wider, frame(new[:0]))
    assert {r.id: r.root for r in roots.collect()} == want and same.count() == wider.count()


def test_no_edges_no_roots(spark):
    forest, roots = spanning_forest(spark.createDataFrame([], "u bigint, v bigint"))
    assert forest.count() == roots.count() == 0


def test_stars_stay_linear_in_a_hot_group(spark):
    df = spark.range(5000).select("id", F.lit("hot").alias("k")).unionByName(spark.createDataFrame([(9001, "a"), (9002, "a"), (9003, None), (9004, "alone")], "id bigint, k string"))
    assert star_edges(df, "id", "k").count() == 4999 + 1
    assert star_edges(df, "id", "k", F.col("id") == 9002).count() == 1


def test_links(spark):
    cases = {"https://games.example/AbCd1234": "AbCd1234", "HTTPS://Games.Example/AbCd1234": "AbCd1234", " games.example/AbCd1234/ ": "AbCd1234", "https://www.games.example/game/AbCd1234/white#5": "AbCd1234", "https://games.example/AbCd1234?pov=white": "AbCd1234", "?": None, "": None, "https://games.example/abc": None, "https://games.example/AbCd12345": None}
    rows = spark.createDataFrame(list(cases.items()), "s string, want string").withColumn("got", link_code(F.col("s"))).collect()
    assert all(r.got == r.want for r in rows), [r for r in rows if r.got != r.want]


GAMES = "game_id bigint, site string, white_name string, black_name string, utc_date string, uci string, root bigint, split string"


def test_ids_of_one_game_and_torn_splits(spark):
    link = "https://games.example/"
    rows = [
        (1, link + "AAAAAAAA", "ann", "bob", "2025-01-01", "e2e4 e7e5"),
        (2, link + "AAAAAAAA/black", "x", "y", "2025-01-02", "d2d4"),  # same code
        (3, "?", "Ann ", "BOB", "2025-01-01", "e2e4  e7e5"),  # no link, same game as 1
        (4, link + "BBBBBBBB", "ann", "bob", "2025-01-01", "e2e4 e7e5"),  # tied to 3, so to 1 and 2
        (5, link + "CCCCCCCC", "u", "w", "2025-01-05", "c2c4"),
        (6, link + "DDDDDDDD", "u", "w", "2025-01-05", "c2c4"),  # equal games with links of their own are two
        (7, None, None, "w", "2025-01-05", "c2c4"),
        (8, "", None, "w", "2025-01-05", "c2c4"),  # unknown players agree with nobody
        (9, link + "aaaaaaaa", "q", "r", "2025-01-09", "a2a3"),  # case counts
    ]
    games = spark.createDataFrame([(*r, 7, "val") for r in rows], GAMES)
    _, roots = spanning_forest(game_edges(games))
    assert {r.id: r.root for r in roots.collect()} == {1: 1, 2: 1, 3: 1, 4: 1}
    labels = spark.createDataFrame([(1, "train"), (2, "TRN"), (5, "dev"), (5, "val "), (9, "x"), (None, "test"), (50, "train"), (50, "tst"), (3, None)], "game_id bigint, split string")
    puzzles = spark.createDataFrame([(4, "Test"), (6, "train")], "game_id bigint, split string")
    torn = sorted(r.game_id for r in torn_games(recorded_splits(labels, puzzles), roots).collect())
    assert torn == [1, 2, 4, 50]  # 3 has no readable split of its own
    dealt = split_records(labels, puzzles, roots, {"train": "0.8", "val": "0.1", "test": "0.1"}).collect()
    assert {r.game_id for r in dealt} == {1, 2, 3, 4, 5, 6, 9, 50}
    assert len({r.split for r in dealt if r.root == 1}) == 1 and {r.size for r in dealt if r.root == 1} == {4}


def test_deal_keeps_proportions_in_bands_and_whole(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([1, 1, 1, 2, 3, 9, 40]), "x") for i in range(4000)] + [(9999, 5000, "x")]
    shares = {"train": "0.8", "val": "0.1", "test": "0.1"}
    got = deal_splits(spark.createDataFrame(rows, "root bigint, size bigint, extra string"), shares).collect()
    assert len(got) == 4001
    whole, bands = Counter(r.split for r in got), defaultdict(Counter)
    for r in got:
        bands[r.band][r.split] += 1
    for counts in [whole, *bands.values()]:
        n = sum(counts.values())
        assert all(abs(counts[s] - float(p) * n) <= 2 for s, p in shares.items()), counts
    again = deal_splits(spark.createDataFrame(rows[::-1], "root bigint, size bigint, extra string").repartition(5), shares).collect()
    assert {(r.root, r.split) for r in got} == {(r.root, r.split) for r in again}
    assert deal_splits(spark.createDataFrame(rows, "root bigint, size bigint, extra string").limit(0), shares).count() == 0
    with pytest.raises(ValueError):
        deal_splits(spark.createDataFrame(rows, "root bigint, size bigint, extra string"), {"a": "0.5"})


def test_split_spellings(spark):
    df = spark.createDataFrame([(x,) for x in ("Train", "TRAINING", "trn", "valid", "VAL ", "dev", "tst", "", None, "other")], "s string")
    assert [r.x for r in df.select(split_name(F.col("s")).alias("x")).collect()] == ["train"] * 3 + ["val"] * 3 + ["test"] + [None] * 3


def test_records_without_a_game_are_given_splits(spark):
    labels = spark.createDataFrame([(1, 10, "train"), (2, 10, "val"), (3, 11, "val"), (4, None, "test"), (5, None, "test")], "label_id bigint, game_id bigint, split string")
    rows = [("a", 11), ("b", None), ("b", None), ("B", None), ("c", None), ("c", 10), ("d", None), *((f"x{i}", None) for i in range(100))]
    puzzles = spark.createDataFrame([(*r, "val") for r in rows], "puzzle_id string, game_id bigint, split string")
    roots = spark.createDataFrame([(10, 10), (11, 10)], "id bigint, root bigint")
    got = split_records(labels, puzzles, roots, {"train": "0.8", "val": "0.1", "test": "0.1"}).collect()
    assert Counter((r.kind, r.record) for r in got) == Counter([("label", str(i)) for i in range(1, 6)] + [("puzzle", k) for k, _ in rows])
    assert {(r.size, r.split) for r in got if r.root == 10} == {(6, next(r.split for r in got if r.root == 10))}
    assert {r.root for r in got if (r.kind, r.record) == ("puzzle", "c")} == {10}
    assert {(r.record, r.size) for r in got if r.root is None and r.record in "bBd"} == {("b", 2), ("B", 1), ("d", 1)}
    assert len({r.split for r in got if r.record == "b"}) == 1 and all(r.split for r in got)
    assert 75 <= sum(r.split == "train" for r in got if r.root is None) <= 95
