import random

import pytest

from plyforge.chess import games as G
from plyforge.chess.board import START, Board, Illegal, perft, uci

KIWIPETE = "r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq - 0 1"


@pytest.mark.parametrize(
    "fen, counts",
    [
        (START, [20, 400, 8902]),
        (KIWIPETE, [48, 2039]),
        ("8/2p5/3p4/KP5r/1R3p1k/8/4P1P1/8 w - - 0 1", [14, 191, 2812]),
        ("r3k2r/Pppp1ppp/1b3nbN/nP6/BBP1P3/q4N2/Pp1P2PP/R2Q1RK1 w kq - 0 1", [6, 264, 9467]),
    ],
)
def test_published_move_counts(fen, counts):
    assert [perft(Board(fen), i + 1) for i in range(len(counts))] == counts


def test_random_games_round_trip_through_san_and_fen():
    rng = random.Random(5)
    for _ in range(15):
        board, moves = Board(), []
        for _ in range(80):
            legal = board.legal_moves()
            if not legal:
                break
            move = rng.choice(legal)
            assert board.parse_san(board.san(move)) == move
            board.push(move)
            moves.append(uci(move))
            assert Board(board.fen()).key() == board.key()
        text = " ".join(moves)
        assert G.replayed(G.numbered_san(text)) == text.split() and len(moves) == len(text.split())
        assert "".join(G.split_moves(text.replace(" ", ""))) == text.replace(" ", "")


def test_en_passant_is_written_only_if_it_can_be_taken():
    board = Board()
    for token in "e2e4 a7a6 e4e5 d7d5".split():
        board.push(board.parse_uci(token))
    assert board.fen4().endswith(" d6")
    board = Board()
    board.push(board.parse_uci("e2e4"))
    assert board.fen4().endswith(" -")
    # the pawn is pinned along the rank: the capture would uncover the king
    assert not Board("8/8/8/K2pP2r/8/8/8/7k w - d6 0 1").legal_ep()


@pytest.mark.parametrize("fen", ["", "x", "8/8/8/8/8/8/8/8 w - - 0 1", "9/8/8/8/8/8/8/K6k w - -", "K6k w"])
def test_bad_positions_raise(fen):
    with pytest.raises(Illegal):
        Board(fen)


def test_movetext_with_comments_variations_and_marks():
    text = "1. e4 {good (really)} e5 (1... c5 (1... e6 2. d4) 2. Nf3) 2. Nf3!? $1 Nc6 3. Bb5?! a6 1-0"
    assert G.mainline_moves(text) == ["e4", "e5", "Nf3", "Nc6", "Bb5", "a6"]
    assert G.replayed(text) == "e2e4 e7e5 g1f3 b8c6 f1b5 a7a6".split()
    assert G.replayed("1. e4 e5 2. Ke3") is None


def test_conversion_reasons():
    assert G.conversion("1. e4 e5", "1-0", 1, 10)[0] == "kept"
    assert G.conversion("1. e4 e5", "1-0", 3, 10)[0] == "short"
    assert G.conversion("1. e4 e5 2. d4", "1-0", 1, 2)[0] == "long"
    assert G.conversion("1. e5", "1-0", 1, 2)[0] == G.conversion("1. e4", "*", 1, 2)[0] == G.conversion(None, "1-0", 1, 2)[0] == "illegal"


def test_prefix_reasons_and_endings():
    fen = Board("rnbqkbnr/pppp1ppp/8/4p3/4P3/8/PPPP1PPP/RNBQKBNR w KQkq - 0 2").fen()
    assert G.rebuild_prefix("1. e4 e5 2. Nf3", fen) == ("ok", "e2e4 e7e5", 2)
    assert G.rebuild_prefix("1. d4 d5", fen)[0] == "no_match"
    assert G.rebuild_prefix("1. e4 Ke3", fen)[0] == "illegal"
    assert G.rebuild_prefix(None, fen)[0] == "missing_game"
    assert G.rebuild_prefix("1. e4", "nonsense")[0] == "bad_fen"
    assert G.game_over("f2f3 e7e5 g2g4 d8h4") == "checkmate"
    assert G.game_over("g1f3 g8f6 f3g1 f6g8 g1f3 g8f6 f3g1 f6g8") == "repetition"
    assert G.game_over("e2e4") is None


def test_answers_rewards_and_blunders():
    assert [G.answer_outcome(START, a) for a in ("1.e4!", "e5", "N", "", None, "Nf3 and wins")] == ["legal", "illegal", "unparseable", "empty", "empty", "legal"]
    two = "4k3/8/8/8/8/8/8/N3K1N1 w - - 0 1"
    assert G.answer_outcome("4k3/8/8/8/2N3N1/8/8/4K3 w - - 0 1", "Ne5") == "ambiguous" and G.legal_moves(two)
    assert G.reward("f2f3 e7e5 g2g4", "d8h4", 0.5)["mate"] > 0
    assert G.reward("", "e2e5", 0.5)["total"] == -1.0
    assert G.blunder_verdict("4k3/8/8/3q4/8/8/8/3QK3 w - - 0 1", "d1d4") is True
    assert G.random_opening(6, "1:2") == G.random_opening(6, "1:2") != G.random_opening(6, "1:3")


def test_every_engine_line_is_judged(spark, tmp_path):
    from plyforge.plans import chess as plans

    start, ahead = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1", "8/P6k/8/8/8/8/8/K7 w - - 0 1"
    rows = [(1, start, "e2e4", None), (2, start, " E2-E4 ", None), (3, ahead, "a7a8=Q", None), (4, start, None, " E2E4 e7e5"), (5, start, "", "e2e5"), (6, start, None, None), (7, start, " ", " "), (8, None, "e2e4", None)]
    spark.createDataFrame(rows, "line_id bigint, fen string, move string, line string").write.parquet(f"{tmp_path}/engine_lines.parquet")
    assert {r.line_id: r.legal for r in plans.legal_moves(spark, str(tmp_path)).collect()} == {1: True, 2: True, 3: True, 4: True, 5: False, 6: None, 7: None, 8: None}
    assert {r.blunder: r.n for r in plans.blunder_heuristic(spark, str(tmp_path)).collect()} == {False: 4, None: 4}


def test_main_line_of_odd_movetexts():
    assert G.mainline("1. e4 {a (b)} e5 (1... c5 (1... e6) 2. d4) 2.Nf3$1 1-0") == ["e4", "e5", "Nf3"]
    assert G.mainline("1. e4 ((1. d4) e5") == ["e4", "(", "e5"] and G.mainline("1. e4 ) e5 *") == ["e4", ")", "e5"]
    assert G.mainline("") == [] and G.mainline("1/2-1/2") == [] and G.mainline("(" * 2000 + ")" * 2000) == []
