"""Move and character vocabularies, and encoding with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "abcdefgh"
#: Special tokens, ids 0 to 7.
SPECIALS = ["<pad>", "<bos>", "<eos>", "<mask>", "<unk>", "<1-0>", "<0-1>", "<1/2>"]
#: Rating bins.
ELO_MIN, ELO_MAX, ELO_STEP = 600, 3200, 100
PROMOTIONS = "qrbn"
#: The characters of numbered SAN, after three specials.
SAN_ALPHABET = " #+-.0123456789=BKNOQRabcdefghx/"


def reaches(df: int, dr: int) -> bool:
    """Whether a queen or a knight goes that far."""
    return (df, dr) != (0, 0) and (0 in (df, dr) or abs(df) == abs(dr) or {abs(df), abs(dr)} == {1, 2})


def move_tokens() -> list[str]:
    """Every from-to of a queen or a knight, then every promotion; squares file by file."""
    squares = [(f, r) for f in range(8) for r in range(8)]
    plain = [f"{FILES[a]}{b + 1}{FILES[c]}{d + 1}" for a, b in squares for c, d in squares if reaches(c - a, d - b)]
    return plain + [f"{FILES[a]}{x}{FILES[c]}{y}{p}" for x, y in ((7, 8), (2, 1)) for a in range(8) for c in range(8) if abs(a - c) < 2 for p in PROMOTIONS]


def vocabulary() -> list[str]:
    """The 2,030 tokens in id order."""
    bins = [f"<{side}{elo:04d}>" for side in "wb" for elo in range(ELO_MIN, ELO_MAX + 1, ELO_STEP)]
    return SPECIALS + bins + move_tokens()


def vocabulary_table(spark: SparkSession) -> DataFrame:
    """(token, id)"""
    return spark.createDataFrame(list(zip(vocabulary(), range(2030))), "token string, id int")


def elo_bin(elo: Column) -> Column:
    return (F.floor(F.least(F.greatest(elo.cast("int"), F.lit(ELO_MIN)), F.lit(ELO_MAX + ELO_STEP - 1)) / ELO_STEP) * ELO_STEP).cast("int")


def elo_token(elo: Column, side: str) -> Column:
    return F.concat(F.lit(f"<{side}"), F.lpad(elo_bin(elo).cast("string"), 4, "0"), F.lit(">"))


#: Ids of the first rating tokens, of the first plain move and of the first promotion.
FIRST_WHITE, FIRST_BLACK, FIRST_MOVE, FIRST_PROMOTION = 8, 35, 62, 1854


def move_id(move: Column) -> Column:
    """Vocabulary id of a move, null for a text that is none.

    The first square picks one of 64 short constant lists, in which the second is
    looked for; promotions have a list of their own.  No lookup runs over the
    whole vocabulary.
    """
    squares = [(f, r) for f in range(8) for r in range(8)]
    targets = [[f"{FILES[c]}{d + 1}" for c, d in squares if reaches(c - a, d - b)] for a, b in squares]
    starts = [sum(map(len, targets[:i])) for i in range(64)]
    constant = lambda names: "array(" + ",".join(f"'{n}'" for n in names) + ")"
    # one parsed expression: thousands of calls for single literals would take seconds
    lists, bases = F.expr("array(" + ",".join(map(constant, targets)) + ")"), F.expr(f"array({','.join(map(str, starts))})")
    rank = F.ascii(F.substring(move, 2, 1)) - 49
    # outside of 0..63 there is no list, so no place
    index = F.when(rank.between(0, 7), (F.ascii(F.substring(move, 1, 1)) - 97) * 8 + rank)
    place = F.array_position(F.get(lists, index), F.substring(move, 3, 2))
    plain = F.when((F.length(move) == 4) & (place > 0), F.get(bases, index) + place + (FIRST_MOVE - 1))
    promotions = F.expr(constant(move_tokens()[FIRST_PROMOTION - FIRST_MOVE :]))
    promoted = F.array_position(promotions, move)
    return F.when(F.length(move) == 5, F.when(promoted > 0, promoted + (FIRST_PROMOTION - 1))).otherwise(plain).cast("int")


def encode_games(games: DataFrame, *, max_len: int = 200, vocab: DataFrame | None = None) -> DataFrame:
    """Adds ``ids``: bos, both ratings, the moves, the result, eos, cut at ``max_len``.

    Unknown moves become unk; rows without ratings or a known result have null ids.
    """
    moves = F.transform(F.filter(F.split("uci", " "), lambda m: m != ""), lambda m: F.coalesce(move_id(m), F.lit(4)))
    result = F.when(F.col("result") == "1-0", 5).when(F.col("result") == "0-1", 6).when(F.col("result") == "1/2-1/2", 7)
    head = F.array(F.lit(1), ((elo_bin(F.col("white_elo")) - ELO_MIN) / ELO_STEP).cast("int") + FIRST_WHITE, ((elo_bin(F.col("black_elo")) - ELO_MIN) / ELO_STEP).cast("int") + FIRST_BLACK)
    good = F.col("white_elo").isNotNull() & F.col("black_elo").isNotNull() & result.isNotNull() & F.col("uci").isNotNull()
    return games.withColumn("ids", F.when(good, F.slice(F.concat(head, moves, F.array(result, F.lit(2))), 1, max_len)))


def decode_ids(ids: Column) -> Column:
    names = F.array(*[F.lit(t) for t in vocabulary()])
    return F.transform(ids, lambda i: F.element_at(names, i.cast("int") + 1))


def encode_characters(text: Column) -> Column:
    """bos, one id a character, eos; null if a character is foreign."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    ids = F.transform(chars, lambda c: F.instr(F.lit(SAN_ALPHABET), c) + 2)
    return F.when(~F.exists(ids, lambda i: i == 2), F.concat(F.array(F.lit(1)), ids, F.array(F.lit(2))))


def pad_ids(ids: Column, width: Column | int, pad: int = 0) -> Column:
    width = width if isinstance(width, Column) else F.lit(width)
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(width - F.size(ids), F.lit(0))))
