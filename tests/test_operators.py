"""Small hand-made cases of the core operators."""

import zlib

import pytest
from pyspark.sql import functions as F

from plyforge.functions import ids, positions, scoring, text, vocab
from plyforge.functions.bpe import apply_merge, encode_words, merge_pairs
from plyforge.operators.ordering import bottom_k, grouped_rank, running_sum, salted_hash
from plyforge.operators.skew import salted_lookup


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_ranks_and_sums_equal_plain_windows(spark):
    n = 3000
    df = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, None).otherwise(F.when(F.col("id") < 2500, "hot").otherwise("cold")).alias("g"), (F.col("id") % 7).alias("v")).withColumn("h", salted_hash("s", F.col("id")))
    rows = df.collect()
    want, total = {}, {}
    for g in (None, "hot", "cold"):
        run = 0
        for i, r in enumerate(sorted((r for r in rows if r.g == g), key=lambda r: (r.h, r.id)), 1):
            run += r.v
            want[r.id], total[r.id] = i, run
    got = grouped_rank(df, ["g"], "h", ["id"], digits=2).collect()
    assert {r.id: r["rank"] for r in got} == want
    assert {r.id for r in bottom_k(df, ["g"], "h", F.expr("group_size div 4"), ["id"], digits=1).collect()} == {r.id for r in got if r["rank"] <= r.rank_total // 4}
    summed = running_sum(df.withColumn("b", F.substring("h", 1, 2)), ["g"], "b", ["h", "id"], "v", name="s").collect()
    assert {r.id: r.s for r in summed} == total
    assert grouped_rank(df.limit(0), ["g"], "h").count() == 0


def test_salted_lookup_equals_a_join_on_hot_and_null_keys(spark):
    rows = spark.range(6000).select("id", F.when(F.col("id") % 10 == 0, None).otherwise(F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id") % 50)).alias("k"))
    table = spark.range(0, 50, 3).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("left", "inner"):
        got = salted_lookup(rows, table, ["k"], how=how).select("id", "k", "v")
        want = rows.join(table, "k", how).select("id", "k", "v")
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_ids_and_splits_match_plain_python(spark):
    import hashlib

    for t in ("https://games.example/abcdefgh", "", "ñ"):
        assert one(spark, ids.text_id(F.lit(t))) == int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "little", signed=True)
        assert one(spark, ids.stable_u64(F.lit(t))) == f"{int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), 'little'):016x}"
    for key in (0, 7, -(2**63), 2**63 - 1):
        side = "val" if zlib.crc32(f"42:{key}".encode()) % 1_000_000 / 1_000_000 < 0.1 else "train"
        assert one(spark, ids.entity_split(F.lit(key), 42, 0.1)) == side
        assert one(spark, ids.row_key(42, F.lit(key), F.lit(3))) == zlib.crc32(f"42:{key}:3".encode())
    assert one(spark, ids.item_id(F.lit("r:1"), F.lit(1800))) == "r:1" and one(spark, ids.item_id(F.lit("r:1"), F.lit(2600))) == "r:1:e2600"
    assert ids.config_sha({"b": 1, "a": 2}) == ids.config_sha({"a": 2, "b": 1})


def test_scores(spark):
    white = lambda cp, mate: one(spark, scoring.white_score(F.lit(cp).cast("int"), F.lit(mate).cast("int")))
    assert [white(5, None), white(None, 3), white(None, -3), white(None, None)] == [5, 9997, -9997, None]
    assert [one(spark, scoring.value_bucket(F.lit(v))) for v in (-201, -200, -50, 49, 50, 200)] == [0, 1, 2, 2, 3, 4]
    assert one(spark, scoring.elo_difference(F.lit(1.0))) == 1200 and one(spark, scoring.elo_difference(F.lit(0.5))) == 0
    assert one(spark, scoring.games_for_edge(F.lit(0.0))) == 0 and 900 < one(spark, scoring.games_for_edge(F.lit(20.0))) < 1300
    assert one(spark, scoring.recode(F.lit("0-1"), scoring.RESULT_CLASS, "tinyint")) == 2 and one(spark, scoring.recode(F.lit("?"), scoring.RESULT_CLASS, "tinyint")) is None


def test_texts(spark):
    assert one(spark, text.clean_movetext(F.lit("1. e4 {a (b)} e5 (1... c5 (1... e6) 2. d4) 2. Nf3 $1 1-0"))) == "e4 e5 Nf3"
    assert [one(spark, text.safe_int(F.lit(t))) for t in ("3", " -4 ", "3.7", "1e2", "", "x", None)] == [3, -4, None, None, None, None, None]
    assert one(spark, text.base_time(F.lit("600+5"))) == 600 and one(spark, text.base_time(F.lit("-"))) is None
    assert str(one(spark, text.parse_date(F.lit("2025.01.31")))) == "2025-01-31" and one(spark, text.parse_date(F.lit("2025.??.??"))) is None
    assert one(spark, text.parse_date(F.lit("2025.02.31"))) is None
    ids_ = F.sequence(F.lit(0), F.lit(9))
    assert one(spark, text.crop_ids(ids_, 6)) == [0, 1, 2, 7, 8, 9] and one(spark, text.crop_ids(ids_, 2)) == [0, 1] and one(spark, text.crop_ids(ids_, 10)) == list(range(10))
    assert one(spark, text.index_spec(F.lit("0,2, 5-7,6"))) == [0, 2, 5, 6, 7]
    assert one(spark, text.percent(F.lit(0.5443))) == "54.4 %" and one(spark, text.percent(F.lit(None).cast("double"))) == "n/a"


def test_position_sequences_round_trip(spark):
    fens = ["rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq e3", "8/6kp/8/8/1R6/6K1/3r3p/8 b - -", "r3k2r/8/8/3pP3/8/8/8/R3K2R w Kq d6"]
    df = spark.createDataFrame([(f,) for f in fens], "fen string").withColumn("t", positions.position_tokens(F.col("fen"))).withColumn("back", positions.tokens_to_fen(F.col("t")))
    for r in df.collect():
        assert len(r.t) == 69 and r.back == r.fen
    king = df.first().t
    assert positions.SQUARE_VOCAB[king[1 + 4 * 8 + 0]] == "K" and positions.SQUARE_VOCAB[king[1 + 4 * 8 + 3]] == "P"  # e1, e4
    assert one(spark, positions.position_tokens(F.lit("no fen"))) is None
    assert len(positions.SQUARE_VOCAB) == 4 + 12 + 2 + 16 + 9 + 4


def test_vocabularies(spark):
    v = vocab.vocabulary()
    assert len(v) == len(set(v)) == 2030 and v[62] == "a1a2" and len(vocab.SAN_ALPHABET) == 32
    game = spark.createDataFrame([("e2e4 zzzz e7e8q", 1850, 599, "1-0"), ("e2e4", None, 1, "1-0")], "uci string, white_elo int, black_elo int, result string")
    a, b = vocab.encode_games(game).select("ids").collect()
    assert a.ids == [1, v.index("<w1800>"), v.index("<b0600>"), v.index("e2e4"), 4, v.index("e7e8q"), 5, 2] and b.ids is None
    assert one(spark, vocab.decode_ids(F.array(F.lit(1), F.lit(62)))) == ["<bos>", "a1a2"]
    assert one(spark, vocab.encode_characters(F.lit("1.e4"))) == [1] + [3 + vocab.SAN_ALPHABET.index(c) for c in "1.e4"] + [2]
    assert one(spark, vocab.encode_characters(F.lit("ü"))) is None
    assert one(spark, vocab.pad_ids(F.array(F.lit(1)), 3)) == [1, 0, 0]


def test_byte_pairs(spark):
    merges = merge_pairs({"e2e4": 10, "e7e5": 5, "e2e3": 3}, 3)
    assert merges[0] == ("e", "2") or merges[0] == ("2", "e")
    assert apply_merge(list("aaa"), ("a", "a")) == ["aa", "a"]
    df = spark.createDataFrame([("e2e4 e7e5",), (None,)], "t string")
    pieces = [r.x for r in df.select(encode_words(F.col("t"), merges).alias("x")).collect()]
    assert "".join(pieces[0]) == "e2e4e7e5" and pieces[1] is None


def test_frame_kernels_take_nulls(spark):
    from plyforge.chess import frames
    from plyforge.chess.board import START

    df = spark.createDataFrame([(START, "e2e4"), (START, "e2e5"), (None, "e2e4"), ("bad", "e2e4"), (START, None)], "fen string, mv string")
    assert [r.x for r in df.select(frames.is_legal(F.col("fen"), F.col("mv")).alias("x")).collect()] == [True, False, None, None, None]
    assert len(df.select(frames.legal_moves(F.col("fen")).alias("x")).first().x) == 20
    walked = frames.walk_positions(spark.createDataFrame([(1, "e2e4 e7e5", "1-0"), (2, "e2e4", None), (3, None, None)], "game_id bigint, uci string, result string"))
    assert walked.count() == 3
    first = frames.distinct_positions(walked).filter("ply = 1").first()
    assert first.n_seen == 2 and first.game_id == 1


def test_ratings_recover_a_known_strength(spark):
    import numpy as np

    from plyforge.stats import ratings

    rng = np.random.default_rng(3)
    rows = [("a", float(o), float(rng.random() < 1 / (1 + 10 ** ((o - 1500) / 400)))) for o in range(800, 2001, 200) for _ in range(200)]
    rows += [("won", 1500.0, 1.0)] * 5 + [("lost", 1500.0, 0.0)] * 5
    got = {r.who: r for r in ratings.estimate(spark.createDataFrame(rows, "who string, opponent_elo double, score double"), "who").collect()}
    assert abs(got["a"].elo - 1500) < 60 and got["a"].ci_low < 1500 < got["a"].ci_high
    assert got["won"].elo_lower is not None and got["won"].ci_low is None and got["lost"].elo_upper is not None


def test_metrics_on_hand_made_cases(spark):
    from plyforge.stats import metrics

    df = spark.createDataFrame(list(zip([1, 1, 1, 0, 0, 0], [1, 1, 0, 1, 0, 0])), "t int, p int")
    r = metrics.confusion(df, "t", "p").first()
    assert r.precision == r.recall == r.f1 == r.accuracy == pytest.approx(2 / 3)
    ranks = metrics.average_ranks(spark.createDataFrame([(0, 3), (1, 1), (2, 1), (3, 2)], "i int, v int"), "v").orderBy("i").collect()
    assert [x["rank"] for x in ranks] == [4, 1.5, 1.5, 3]
    assert metrics.roc_auc(df, "p", "t").first()[0] == pytest.approx(2 / 3)
    flat = spark.createDataFrame([(1, 1.0), (1, 1.0)], "g int, r double")
    assert [x.advantage for x in metrics.group_advantages(flat, "g", "r").collect()] == [0, 0]
    assert metrics.entropy_bits(flat, "g").first()[0] == 0
    assert metrics.roc_auc(df.limit(0), "p", "t").first()[0] is None


def test_deep_variations_are_cleaned(spark):
    deep = "1. e4 " + "".join(f"(1. d{i} " for i in range(12)) + ")" * 12 + " e5 (1... c5) 2. Nf3 *"
    assert one(spark, text.clean_movetext(F.lit(deep))) == "e4 e5 Nf3"
    assert one(spark, text.clean_movetext(F.lit("1. e4 ((1. d4) e5"))) == "e4 ( e5" and one(spark, text.clean_movetext(F.lit(None).cast("string"))) is None


def test_whole_texts_and_sequences(spark, tmp_path):
    from plyforge.plans import sequences

    docs = [(1, "pgn_dump", "1. e4 e5"), (2, "PGN_Dump ", "1. d4"), (3, "forum", "hello"), (4, "PGN-dump", "1. c4")]
    spark.createDataFrame(docs, "doc_id bigint, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    games = [(1, 1, " ".join(["e2e4"] * 450)), (2, 1, "e2e4 a7a8q"), (3, 1, None), (4, 2, "e2e4")]
    spark.createDataFrame(games, "game_id bigint, batch_no int, uci string").write.parquet(f"{tmp_path}/games.parquet")
    d = str(tmp_path)
    assert {r.doc_id: r.tokens for r in sequences.clean_text(spark, d).collect()} == {1: 2, 2: 1, 4: 1}
    assert {r.doc_id for r in sequences.char_tokenize(spark, d).collect()} == {1, 2, 4}
    got = {r.game_id: (r.padded.split(" "), r.real) for r in sequences.padded_batches(spark, d).collect()}
    assert {k: (len(v), n) for k, (v, n) in got.items()} == {1: (450, 450), 2: (450, 2), 4: (1, 1)} and got[2][0][2:4] == ["0", "0"] and int(got[2][0][1]) >= 1854
    windows = {(r.game_id, r.window): r.y.split(" ") for r in sequences.shifted_window(spark, d).collect()}
    assert sorted(windows) == [(1, 0), (1, 1), (1, 2), (2, 0), (4, 0)] and all(len(y) == 200 for y in windows.values())
    assert sum(t != "<pad>" for k, y in windows.items() for t in y if k[0] == 1) == 449 and windows[2, 0][:2] == ["a7a8q", "<pad>"]


def test_the_corpus_filter_keeps_one_of_six(spark):
    from plyforge.plans.filters import corpus_rows

    rows = [
        (1, 2000, 2100, "300+3", "Normal", "Rated Blitz"), (2, 1700, 2100, "300+3", "Normal", "Rated Blitz"), (3, 2000, 2100, "-", "Normal", "Rated"), (4, 2000, 2100, "300", "Abandoned", "Rated"),
        (5, 2000, 2100, "300", "Normal", "Rated VARIANT cup"), (6, 2000, 2100, "300", "Normal", None), (7, None, 2100, "300", "Normal", "Rated"), (8, 2000, 2100, None, None, "Rated"),
    ]
    games = spark.createDataFrame(rows, "id int, white_elo int, black_elo int, time_control string, termination string, event string")
    keep = lambda **more: sorted(r.id for r in corpus_rows(games, **more).collect())
    assert keep(terminations=("Normal", "Time forfeit"), without_event="variant") == [1]
    assert keep() == [1, 4, 5, 6] and keep(max_elo=2050) == []


def test_rating_bands_and_cells(spark):
    from plyforge.functions import scoring

    rows = spark.createDataFrame([(x,) for x in (None, 0, 1799, 1800, 1999, 2000, 2599, 2600, 3400)], "e int").select(scoring.rating_band(F.col("e")).alias("b")).collect()
    assert [r.b for r in rows] == [None, "<1800", "<1800", "1800-2000", "1800-2000", "2000-2200", "2400-2600", "2600+", "2600+"]
    cell = lambda v, unit: one(spark, text.unit_cell(F.lit(v).cast("double"), F.lit(unit)))
    assert [cell(0.1234, "percent"), cell(-12.4, "elo"), cell(1.5, "bits"), cell(None, "elo")] == ["12.3 %", "-12", "1.5000 bits", "n/a"]
    assert one(spark, text.name_prefixes(F.lit("a-b-c"))) == ["a", "a-b"] and one(spark, text.name_prefixes(F.lit("a"))) == ["a"]


def test_file_numbers_are_checked_against_the_files(spark):
    assert one(spark, text.index_spec(F.lit(" 5-7, 0,,6"), 8)) == [0, 5, 6, 7]
    with pytest.raises(Exception, match="file numbers go from 0 to 6"):
        one(spark, text.index_spec(F.lit("5-7"), 7))


def test_ranks_and_previous_rows_by_ranges(spark):
    import random

    from plyforge.operators.ordering import previous_row, range_rank

    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 1, 2, 3])) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, g string, v int")
    for group in sorted({r[1] for r in rows}, key=str):
        mine = sorted((r for r in rows if r[1] == group), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        got = range_rank(df, ["g"], ["v", "id"], name="k").filter(F.col("g").eqNullSafe(group)).orderBy("k").collect()
        assert [r.id for r in got] == [r[0] for r in mine] and [r.k for r in got] == list(range(1, len(mine) + 1))
        got = {r.id: r.before for r in previous_row(df, ["g"], ["v", "id"], "v", name="before").filter(F.col("g").eqNullSafe(group)).collect()}
        assert got == {r[0]: (mine[i - 1][2] if i else None) for i, r in enumerate(mine)}
    assert range_rank(df.limit(0), ["g"], ["v"]).count() == previous_row(df.limit(0), ["g"], ["v"], "id").count() == 0


def test_a_detector_without_two_full_halves_is_measured_on_all_rows(spark):
    from plyforge.stats import metrics

    rows = [(i, float(i % 7), int(i % 3 == 0), int(i % 2), i < 20) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, s double, t int, rule int, tune boolean")
    whole = metrics.detector_summary(df, "s", "t", "rule", "tune", 3.0).first()
    assert not whole.degenerate and (whole.tune_items, whole.score_items, whole["items"]) == (20, 20, 40)
    torn = metrics.detector_summary(df.filter("not tune or t = 0"), "s", "t", "rule", "tune", 3.0).first()
    assert torn.degenerate and torn.tune_items == torn.score_items == torn["items"]
    none = metrics.detector_summary(df.limit(0), "s", "t", "rule", "tune", 3.0).first()
    assert none.degenerate and none["items"] == 0 and none.roc_auc is None and none.f1 == 0


def test_discordant_pairs_equal_a_count_of_all_pairs(spark):
    import random

    from plyforge.stats import metrics

    rng = random.Random(8)
    rows = [(rng.choice([None, *range(12)]), rng.choice([None, *range(9)]), "x") for _ in range(150)]
    kept = [r for r in rows if None not in r]
    want = sum((x[0] - y[0]) * (x[1] - y[1]) < 0 for i, x in enumerate(kept) for y in kept[:i])
    df = spark.createDataFrame(rows, "a int, b int, pairs string")
    assert metrics.discordant_pairs(df, "a", "b").first().pairs == want
    assert metrics.discordant_pairs(df.limit(0), "a", "b").first().pairs == 0
