import datetime as dt
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from plyforge.llm import consensus as C

SCHEMA = "line_id bigint, fen string, line string, move string, depth int, knodes int, cp int, mate int, fetched_at timestamp_ntz, position string, weight double"
A = "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq"


def rows_of(seed, n, fens, hot=None):
    rng, out = random.Random(seed), []
    moves = ["e7e5", "c7c5", "E7E5", "e7e6 "]
    for i in range(n):
        fen = hot if hot and i % 3 else rng.choice(fens)
        line = rng.choice([None, "", "e7e5 g1f3 b8c6", "e7e5 g1f3", "c7c5 g1f3 d7d6 d2d4", "e7e5 f1c4"])
        move = rng.choice([None, *moves]) if not line else None if rng.random() < 0.3 else line.split()[0]
        out.append((i, fen, line, move, rng.choice([None, 0, 300, 10, 20, 20, 30]), rng.choice([None, 5, 5, 9]), rng.choice([None, 10, -20]), None if rng.random() < 0.8 else 3, None if rng.random() < 0.2 else dt.datetime(2025, 1, rng.randint(1, 3)), "clash", 1.0))
    return out


def brute(rows):
    """The survivors' rule, by plain sorting."""
    groups = defaultdict(list)
    for r in rows:
        fen, line, move = r[1], (r[2] or "").lower().strip(), (r[3] or "").lower().strip().replace("=", "")
        first = move or line.split(" ")[0]
        if not fen or not first:
            continue
        f = fen.split()
        key = (f[0], f[1], "".join(c for c in "KQkq" if c in f[2]) or "-", first)
        groups[key].append(r)
    out = {}
    for key, rs in groups.items():
        able = [r for r in rs if (r[6] is not None or r[7] is not None) and r[4] is not None and 1 <= r[4] <= 245]
        if able:
            best = max(able, key=lambda r: (r[4], -1 if r[5] is None else r[5], r[8] or dt.datetime.min, -r[0]))
            out[best[0]] = len(rs)
    return out


FENS = [A + " -", A + " e3", A.replace("KQkq", "qkQK") + " - 0 1", "8/6kp/8/8/1R6/6K1/3r3p/8 b - -", None, ""]


def test_survivors_follow_the_order_of_trust(spark):
    rows = rows_of(1, 700, FENS)
    got = {r.line_id: r.n_rows for r in C.best_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)
    assert C.best_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def voted(rows):
    """(consensus, closest line) of a group's rows, by alignment of the distinct lines, heaviest first."""
    ballots = Counter()
    for r in rows:
        line = (r[2] or "").lower().strip()
        if line:
            ballots[line] += r[4] ** 2 if r[4] and 1 <= r[4] <= 245 else 1
    if not ballots:
        return None, None
    order = sorted(ballots, key=lambda t: (-ballots[t], t))
    won = C.vote(C.align([([{x: float(ballots[t])} for x in t.split()], float(ballots[t])) for t in order])[0])
    return " ".join(won), min(ballots, key=lambda t: (C.token_distance(t.split(), won), -ballots[t], t))


def test_lines_follow_the_vote_in_groups_of_any_size(spark, monkeypatch):
    rows = rows_of(2, 1500, FENS[:1] + ["8/6kp/8/8/1R6/6K1/3r3p/8 b - -"], hot=A + " -")
    groups = defaultdict(list)
    for r in rows:
        first = (r[3] or "").lower().strip() or (r[2] or "").split(" ")[0]
        if first:
            groups[r[1], first].append(r)
    owner = {r[0]: k for k, rs in groups.items() for r in rs}
    df = spark.createDataFrame(rows, SCHEMA)
    whole = sorted(C.best_lines(df).collect())
    assert {r.line_id: r.n_rows for r in whole} == brute(rows) and any(r.n_rows > 300 for r in whole)
    assert {r.line_id: (r.consensus_line, r.line) for r in whole} == {r.line_id: voted(groups[owner[r.line_id]]) for r in whole}
    # neither other rows nor the way of joining change a group's result
    monkeypatch.setattr(C, "FEW_GROUPS", 0)
    more = [(10_000 + i, f"{'8/' * 7}k6{chr(75)} w - - {i}", "a1a2 b1b2", "a1a2", 9, 1, 5, None, None, "x", 1.0) for i in range(300)]
    again = [r for r in sorted(C.best_lines(spark.createDataFrame(rows + more, SCHEMA).repartition(5)).collect()) if r.line_id < 10_000]
    assert whole == again


def test_the_vote_and_not_the_survivor_gives_the_line(spark):
    fen, day = "8/6kp/8/8/1R6/6K1/3r3p/8 b - -", dt.datetime(2025, 1, 1)
    rows = [(1, fen, "g7f6 a1a2", "g7f6", 30, 9, 5, None, day)] + [(i, fen, "g7f6 b4b6 f6e5", "g7f6", 29, 7, 5, None, day) for i in (2, 3)]
    r = C.best_lines(spark.createDataFrame([(*x, "p", 1.0) for x in rows], SCHEMA)).collect()
    assert [(x.line_id, x.consensus_line, x.line) for x in r] == [(1, "g7f6 b4b6 f6e5", "g7f6 b4b6 f6e5")]


def test_silent_fields_are_filled_by_the_vote(spark):
    fen, d1, d2 = "8/6kp/8/8/1R6/6K1/3r3p/8 b - -", dt.datetime(2025, 1, 1), dt.datetime(2025, 2, 1)
    rows = [
        (1, fen, None, "g7f6", 40, None, 5, None, None), (2, fen, None, "g7f6", 30, 7, 5, None, d1), (3, fen, None, "g7f6", 30, 8, 5, None, d2), (4, fen, None, "g7f6", None, 8, None, None, d2),
        (5, fen, None, "h7h6", 40, 3, None, 2, d1), (6, fen, None, "h7h5", 9, None, 1, None, None), (7, fen, None, "g7g6", None, 3, 1, None, None),
    ]
    got = {r.line_id: r for r in C.built_lines(spark.createDataFrame([(*x, "p", 1.0) for x in rows], SCHEMA)).collect()}
    assert set(got) == {1, 5, 6}
    assert (got[1].knodes, got[1].fetched_at, got[1].filled) == (8, d2, ["knodes", "fetched_at"])
    assert (got[5].knodes, got[5].mate, got[5].cp, got[5].filled) == (3, 2, None, [])
    assert (got[6].knodes, got[6].fetched_at, got[6].filled) == (None, None, [])
    assert C.built_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_variants_are_aligned_as_a_tree(spark):
    rng = random.Random(3)
    true = "a b c d e f".split()
    texts = Counter()
    while len(texts) < 300:
        t = [x if rng.random() < 0.85 else rng.choice("xyz") for x in true]
        if rng.random() < 0.4:
            del t[rng.randrange(len(t))]
        texts[" ".join(t)] += 1
    df = spark.createDataFrame([(bytearray(b"g"), t, float(n)) for t, n in texts.items()], "group_id binary, tokens string, weight double")
    got = C.consensus(df, block=8).collect()
    assert len(got) == 1 and got[0].consensus == "a b c d e f"


def test_votes_where_the_most_trusted_row_is_silent(spark):
    fen = "8/6kp/8/8/1R6/6K1/3r3p/8 b - -"
    day = dt.datetime(2025, 1, 1)
    rows = [(1, fen, None, "g7f6", 40, None, 5, None, day), (2, fen, "g7f6 b4b6 f6e5", "g7f6", 30, 7, 5, None, day), (3, fen, "g7f6 b4b6 f6e5", None, 29, 8, 6, None, day), (4, fen, "g7f6 g3h2", None, 29, 8, 6, None, day)]
    r = C.best_lines(spark.createDataFrame([(*x, "p", 1.0) for x in rows], SCHEMA)).collect()
    assert len(r) == 1 and r[0].line_id == 1 and r[0].depth == 40 and r[0].knodes is None
    assert r[0].line == r[0].consensus_line == "g7f6 b4b6 f6e5"


def test_alignment_and_votes():
    texts = {"a b c": 1.0, "a c": 0.9, "a b c d": 0.8}
    assert C.vote(C.align([([{x: w} for x in t.split()], w) for t, w in texts.items()])[0]) == ["a", "b", "c"]
    profile, weight = C.align([([{"a": 1.0}, {"b": 1.0}], 1.0), ([{"b": 1.0}], 1.0), ([{"a": 1.0}, {"c": 1.0}, {"b": 1.0}], 1.0)])
    assert weight == 3.0 and C.vote(profile) == ["a", "b"]
    assert C.token_distance(["a", "b"], ["b"]) == 1 and C.token_distance([], ["x"]) == 1


def test_positions_and_moves_in_one_spelling(spark):
    cases = {
        A + " e3": A + " -",
        "  " + A.replace(" ", "  ") + "\t- 3 9": A + " -",
        A.replace("KQkq", "qkQK") + " -": A + " -",
        "rnbqkbnr/1ppp1ppp/p7/3pP3/8/8/PPPP1PPP/RNBQKBNR w KQkq d6": "rnbqkbnr/1ppp1ppp/p7/3pP3/8/8/PPPP1PPP/RNBQKBNR w KQkq d6",
        "8/8/8/K2pP2r/8/8/8/7k w - d6": "8/8/8/K2pP2r/8/8/8/7k w - -",  # pinned
        "": None,
    }
    rows = spark.createDataFrame(list(cases.items()), "fen string, want string").transform(lambda df: C.with_position(df, name="got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]
    moves = spark.createDataFrame([("E2E4 ",), ("a7a8=Q",), ("a7a8q",), ("",), (None,)], "m string").select(C.move_key(F.col("m")).alias("x")).collect()
    assert [r.x for r in moves] == ["e2e4", "a7a8q", "a7a8q", None, None]
    castle = spark.createDataFrame([("e1h1", "x w KQkq -"), ("e1h1", "x w Qkq -"), ("e8a8", "x b q -"), ("e1h1", "x b KQ -")], "m string, p string").select(C.castling_key(F.col("m"), F.col("p")).alias("x")).collect()
    assert [r.x for r in castle] == ["e1g1", "e1h1", "e8c8", "e1h1"]
