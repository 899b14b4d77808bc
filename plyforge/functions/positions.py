"""Positions as text: fields, phases, material, token sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PIECES = "PNBRQKpnbrqk"
#: The tokens of a position sequence, in id order.
SQUARE_VOCAB = (
    ["<pad>", "<mask>", "<cls>", "<empty>"] + list(PIECES) + ["turn:w", "turn:b"]
    + ["castle:" + ("".join(c for i, c in enumerate("KQkq") if m >> i & 1) or "-") for m in range(16)]
    + ["ep:none"] + [f"ep:{f}" for f in "abcdefgh"] + [f"clock:{i}" for i in range(4)]
)
SEQUENCE = 69
#: First half-move of each clock bucket but the first.
CLOCK_EDGES = (6, 25, 50)
#: Last ply of the opening, fewest pieces of a middlegame.
OPENING_PLY, MIDDLEGAME_PIECES = 10, 14
#: Piece values.
VALUES = {"p": 1, "n": 3, "b": 3, "r": 5, "q": 9}


def four_fields(fen: Column) -> Column:
    return F.substring_index(fen, " ", 4)


def count_of(text: Column, symbol: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(symbol), F.lit("")))


def material(placement: Column) -> Column:
    """White's material less Black's."""
    out = F.lit(0)
    for piece, value in VALUES.items():
        out = out + value * (count_of(placement, piece.upper()) - count_of(placement, piece))
    return out


def n_pieces(placement: Column) -> Column:
    return F.length(F.regexp_replace(placement, "[^A-Za-z]", ""))


def phase(ply: Column, pieces: Column) -> Column:
    """Opening up to ply 10; then middlegame with 14 pieces or more, else endgame."""
    return F.when(ply <= OPENING_PLY, "opening").when(pieces >= MIDDLEGAME_PIECES, "middlegame").otherwise("endgame")


def castling(field: Column) -> Column:
    """Castling letters in the order KQkq, ``-`` for none."""
    text = F.concat(*[F.when(field.contains(c), c).otherwise("") for c in "KQkq"])
    return F.when(text == "", "-").otherwise(text)


def clock_bucket(half: Column) -> Column:
    return sum(((half >= edge).cast("int") for edge in CLOCK_EDGES), F.lit(0))


def expanded(placement: Column) -> Column:
    """64 characters, rank 8 first, empty squares as dots."""
    out = F.replace(placement, F.lit("/"), F.lit(""))
    for n in range(8, 0, -1):
        out = F.replace(out, F.lit(str(n)), F.lit("." * n))
    return out


def position_tokens(fen: Column) -> Column:
    """The 69 ids of a position: cls, 64 squares file by file, turn, castling, en passant, clock.

    Null where the text is no FEN of four fields or more.
    """
    part = lambda i: F.split_part(fen, F.lit(" "), F.lit(i))
    board = expanded(part(1))
    # the board is bound as a lambda variable, so it is expanded once and not for every square
    at_square = lambda b, i: F.substring(b, (7 - i % 8) * 8 + F.floor(i / 8).cast("int") + 1, F.lit(1))
    ids = F.get(F.transform(F.array(board), lambda b: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.instr(F.lit("." + PIECES), at_square(b, i)) + 2)), F.lit(0))
    first = SQUARE_VOCAB.index
    mask = sum((F.when(part(3).contains(c), 1 << i).otherwise(0) for i, c in enumerate("KQkq")), F.lit(0))
    ep = F.when(part(4) == "-", 0).otherwise(F.ascii(part(4)) - 96)
    half = F.coalesce(F.when(part(5) != "", part(5)).try_cast("int"), F.lit(0))
    tail = F.array(F.when(part(2) == "w", first("turn:w")).otherwise(first("turn:b")), first("castle:-") + mask, first("ep:none") + ep, first("clock:0") + clock_bucket(half))
    good = part(1).rlike(r"^([pnbrqkPNBRQK1-8]+/){7}[pnbrqkPNBRQK1-8]+$") & (F.length(board) == 64) & part(2).isin("w", "b") & part(3).rlike("^(-|[KQkq]+)$") & part(4).rlike("^(-|[a-h][36])$")
    return F.when(good, F.concat(F.array(F.lit(2)), ids, tail))


def tokens_to_fen(ids: Column) -> Column:
    """The four FEN fields of a position sequence."""
    vocab = F.array(*[F.lit(t) for t in SQUARE_VOCAB])
    name = lambda i: F.element_at(vocab, i.cast("int") + 1)
    row = lambda r: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda f: F.when(F.get(ids, 1 + f * 8 + r) == 3, ".").otherwise(name(F.get(ids, 1 + f * 8 + r)))), "")
    board = F.array_join(F.transform(F.sequence(F.lit(7), F.lit(0), F.lit(-1)), row), "/")
    for n in range(8, 0, -1):
        board = F.replace(board, F.lit("." * n), F.lit(str(n)))
    turn = F.substring(name(F.get(ids, F.lit(65))), 6, 1)
    rights = F.substring(name(F.get(ids, F.lit(66))), 8, 4)
    ep = F.substring(name(F.get(ids, F.lit(67))), 4, 4)
    square = F.when(ep == "none", "-").otherwise(F.concat(ep, F.when(turn == "w", "6").otherwise("3")))
    return F.when(F.size(ids) == SEQUENCE, F.concat_ws(" ", board, turn, rights, square))
