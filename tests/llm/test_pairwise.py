import itertools
import random

import numpy as np
import pytest

from plyforge.llm.pairwise import NotConverged, rank_items, readable_games, scale_local, win_matrix

GAME = "match_id bigint, game_index int, stage_a string, stage_b string, a_white boolean, result string, score double, recorded_at timestamp, strength string"


def plain_sinkhorn(names, games, prior=0.1, sweeps=20000):
    """Strengths by a dense Sinkhorn scaling of the smoothed win matrix, one cell after the other."""
    n = len(names)
    at = {x: i for i, x in enumerate(names)}
    m = np.zeros((n + 1, n + 1))
    for a, b, s in games:
        m[at[a], at[b]] += s
        m[at[b], at[a]] += 1 - s
    m[:n, n] = m[n, :n] = prior / 2
    m += np.diag(m.sum(0) + m.sum(1))
    rows, columns = np.ones(n + 1), np.ones(n + 1)
    for _ in range(sweeps):
        rows = (m / columns).sum(1)
        columns = (m.T / rows).sum(1)
    scaled = m / np.outer(rows, columns)
    assert np.allclose(scaled.sum(0), 1) and np.allclose(scaled.sum(1), 1)
    s = (rows / columns)[:n]
    return dict(zip(names, s / np.exp(np.log(s).mean())))


def uneven_games(seed=4):
    rng, names = random.Random(seed), list("abcdef")
    true = {n: 2.0 ** (i / 1.5) for i, n in enumerate(names)}
    games = []
    for a, b in itertools.combinations(names, 2):
        for _ in range(rng.choice([0, 3, 40, 900])):
            p = true[a] / (true[a] + true[b])
            games.append((a, b, 0.5 if rng.random() < 0.2 else float(rng.random() < p)))
    return names, games


def test_strengths_are_those_of_a_plain_sinkhorn_scaling(spark):
    names, games = uneven_games()
    want = plain_sinkhorn(names, games)
    df = spark.createDataFrame(games, "item_a string, item_b string, score double")
    items = spark.createDataFrame([(n, 1) for n in names], "stage string, games int")
    got = rank_items(df, items, "stage").collect()
    assert [r.stage for r in sorted(got, key=lambda r: r.place)] == sorted(names, key=lambda n: -want[n])
    assert all(r.strength == pytest.approx(want[r.stage], rel=1e-7) and r.strength == pytest.approx(r.offence / r.defence) for r in got)
    assert sum(r.games for r in got) == 2 * len(games) and all(r.sweeps > 1 for r in got)


def test_true_strengths_come_out_however_uneven_the_schedule():
    """Expected wins of known strengths are scaled to just these strengths."""
    rng, n = np.random.default_rng(1), 12
    true = np.exp(rng.normal(0, 1.5, n))
    true /= np.exp(np.log(true).mean())
    i, j = (x.ravel() for x in np.meshgrid(range(n), range(n)))
    met = rng.choice([0, 20_000, 100_000, 900_000], n * n).reshape(n, n)
    met = np.triu(met, 1)
    met[np.arange(n - 1), np.arange(1, n)] += 10_000
    met = met + met.T
    wins = met[i, j] * true[i] / (true[i] + true[j])
    o, d, _ = scale_local(i, j, wins, n)
    assert np.allclose(o / d, true, rtol=0.02)


def test_joins_give_the_same_ranking(spark):
    names, games = uneven_games(11)
    df = spark.createDataFrame(games, "item_a string, item_b string, score double").repartition(2)
    items = spark.createDataFrame([(n,) for n in [*names, "unmet"]], "stage string")
    local, joined = (rank_items(df, items, "stage", prior=5, tolerance=0.02, local_items=k).orderBy("place").collect() for k in (100, 0))
    assert [(r.place, r.stage, r.games, r.sweeps) for r in local] == [(r.place, r.stage, r.games, r.sweeps) for r in joined]
    assert all(a.strength == pytest.approx(b.strength, rel=1e-9) and a.offence == pytest.approx(b.offence, rel=1e-9) for a, b in zip(local, joined))


def test_running_out_of_sweeps_is_an_error(spark):
    names, games = uneven_games(11)
    df = spark.createDataFrame(games, "item_a string, item_b string, score double")
    items = spark.createDataFrame([(n,) for n in names], "stage string")
    for k in (100, 0):
        with pytest.raises(NotConverged):
            rank_items(df, items, "stage", sweeps=2, local_items=k)


def test_sweeps_unmet_items_and_ties_are_finite(spark):
    df = spark.createDataFrame([("a", "b", 1.0)] * 5 + [("a", None, 1.0), ("a", "a", 1.0), ("a", "x", 0.0), ("b", "a", None)], "item_a string, item_b string, score double")
    items = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), (None,)], "stage string")
    got = rank_items(df, items, "stage").collect()
    assert [r.stage for r in got] == ["a", "c", "d", "b"] and [r.place for r in got] == [1, 2, 3, 4]
    assert all(np.isfinite(r.strength) for r in got)
    assert rank_items(df.limit(0), items, "stage").count() == 4
    assert rank_items(df, items.limit(0), "stage").count() == 0
    assert all(len(x) == 0 for x in scale_local(np.array([], int), np.array([], int), np.array([]), 0)[:2])


def test_outcomes_are_read_once_a_game(spark):
    import datetime as dt

    t = dt.datetime(2025, 1, 1)
    rows = [
        (1, 1, "IBEX-90M", "runs/checkpoints/lynx-90m/best.pt", True, "White wins", None, t, "x"),
        (1, 1, "IBEX-90M", "lynx-90m", None, None, None, t + dt.timedelta(1), "x"),  # a later delivery without outcome
        (1, 2, "ibex_90m-20250101-010203", "lynx-90m", False, "1–0", None, t, "x"),
        (1, 3, "ibex-90m", "lynx-90m", None, "½-½", None, t, "x"),
        (1, 4, "ibex-90m", "lynx-90m", None, "1-0", None, t, "x"),  # whose win is not known
        (1, 5, "ibex-90m", "lynx-90m", None, None, 0.5, t, "x"),
        (1, 6, "ibex-90m", "lynx-90m", True, "1-0", 0.0, t, "x"),  # contradiction
        (1, 7, "ibex-90m", "lynx-90m", True, "*", 0.5, t, "x"),  # unfinished
        (None, 8, "ibex-90m", "lynx-90m", True, "0 : 1", None, None, "x"),
        (None, 8, "ibex-90m", "lynx-90m", True, "0 : 1", None, None, "x"),
    ]
    got = sorted((r.item_a, r.item_b, r.score) for r in readable_games(spark.createDataFrame(rows, GAME)).collect())
    assert got == sorted([("ibex-90m", "lynx-90m", s) for s in (1.0, 0.0, 0.5, 0.5, 0.0, 0.0)])
