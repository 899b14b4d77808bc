"""Whole games: conversion, replay, prefixes, texts, rewards.  Pure Python, one game at a time."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

from plyforge.chess.board import RESULTS, Board, Illegal, uci

#: Last ply of the opening, fewest pieces of a middlegame.
OPENING_PLY, MIDDLEGAME_PIECES = 10, 14
PIECE_VALUES = {"p": 1, "n": 3, "b": 3, "r": 5, "q": 9, "k": 0}


#: A comment, a parenthesis, a numeric glyph, or a run of anything else up to one of these.
_LEXEME = re.compile(r"\{[^}]*\}|[()]|\$\d+|[^\s(){}$]+|[{}$]")
_MOVE_NUMBER = re.compile(r"\b\d+\.(?:\.\.)?")


def mainline(movetext: str) -> list[str]:
    """The words of the main line: no comments, variations, glyphs, move numbers or final result.

    One pass: an opening parenthesis remembers how much had been read, and its
    closing one takes back what came since.  A parenthesis without a partner
    stays as a word, which is no move.
    """
    words: list[str] = []
    opened: list[int] = []
    for lexeme in _LEXEME.findall(movetext):
        if lexeme == "(":
            opened.append(len(words))
            words.append(lexeme)
        elif lexeme == ")" and opened:
            del words[opened.pop() :]
        elif lexeme[0] not in "{$" or len(lexeme) == 1:
            words.extend(_MOVE_NUMBER.sub(" ", lexeme).split())
    if words and words[-1] in (*RESULTS, "*"):
        words.pop()
    return words


def mainline_moves(movetext: str) -> list[str]:
    """The words of the main line without ``!`` and ``?`` at their ends."""
    return list(filter(None, (word.rstrip("!?") for word in mainline(movetext))))


def replayed(movetext: str) -> list[str] | None:
    """The main line in coordinates; None if a move of it cannot be played."""
    board, played = Board(), []
    for word in mainline_moves(movetext):
        try:
            move = board.parse_san(word)
        except Illegal:
            return None
        board.push(move)
        played.append(uci(move))
    return played


def conversion(text: str | None, result: str | None, least: int, most: int) -> tuple[str, str | None, int | None]:
    """(reason, moves, plies); reason is kept, illegal, short or long.

    A result that is none of the three counts as illegal.
    """
    if text is None or result not in RESULTS:
        return "illegal", None, None
    played = replayed(text)
    if played is None:
        return "illegal", None, None
    plies = len(played)
    return "short" if plies < least else "long" if plies > most else "kept", " ".join(played), plies


def phase(ply: int, pieces: int) -> str:
    return "opening" if ply <= OPENING_PLY else "middlegame" if pieces >= MIDDLEGAME_PIECES else "endgame"


def walk(moves: str | None) -> Iterator[tuple[int, str, str, str]]:
    """(ply, fen4, last move, phase) after each move, up to the first illegal one."""
    board = Board()
    for ply, token in enumerate((moves or "").split(), 1):
        try:
            board.push(board.parse_uci(token))
        except Illegal:
            return
        yield ply, board.fen4(), token, phase(ply, board.n_pieces())


def rebuild_prefix(text: str | None, fen: str | None) -> tuple[str, str | None, int | None]:
    """(reason, moves, plies): the moves of the game up to the position.

    Reasons: ok, bad_fen, missing_game, illegal (before the position), no_match.
    """
    try:
        target = Board(fen or "").fen4()
    except Illegal:
        return "bad_fen", None, None
    if not text:
        return "missing_game", None, None
    board, moves = Board(), []
    if board.fen4() == target:
        return "ok", "", 0
    for token in mainline_moves(text):
        try:
            move = board.parse_san(token)
        except Illegal:
            return "illegal", None, None
        board.push(move)
        moves.append(uci(move))
        if board.fen4() == target:
            return "ok", " ".join(moves), len(moves)
    return "no_match", None, None


def prefix_to(moves: str | None, fen: str | None) -> int | None:
    """The ply of a UCI game at which the position stands; None if it never does."""
    try:
        target = Board(fen or "").fen4()
    except Illegal:
        return None
    if Board().fen4() == target:
        return 0
    return next((ply for ply, found, _, _ in walk(moves) if found == target), None)


def position_after(moves: str | None, move: str | None = None) -> tuple[str, str] | None:
    """(FEN, colour of the last mover) after a prefix and a move; None if unplayable."""
    board = Board()
    try:
        for token in [*(moves or "").split(), *([move] if move else [])]:
            board.push(board.parse_uci(token))
    except Illegal:
        return None
    return board.fen(), "black" if board.turn == "w" else "white"


def legal_moves(fen: str | None) -> list[str] | None:
    """Sorted legal moves; None for a bad position."""
    try:
        return sorted(uci(m) for m in Board(fen or "").legal_moves())
    except Illegal:
        return None


def is_legal(fen: str | None, move: str | None) -> bool | None:
    """Whether the move is legal there; None for a bad position or no move."""
    if fen is None or move is None:
        return None
    try:
        board = Board(fen)
    except Illegal:
        return None
    try:
        board.parse_uci(move)
    except Illegal:
        return False
    return True


def numbered_san(moves: str | None, cap: int | None = None) -> str | None:
    """``1.e4 e5 2.Nf3`` of a UCI game; None if it is illegal."""
    board, out = Board(), []
    try:
        for token in (moves or "").split()[:cap]:
            move = board.parse_uci(token)
            out.append((f"{board.full}." if board.turn == "w" else "") + board.san(move))
            board.push(move)
    except Illegal:
        return None
    return " ".join(out)


def game_text(moves: str | None, result: str, white_elo: int | None, black_elo: int | None) -> str | None:
    """Headers and movetext of a game; missing ratings are ``?``."""
    san = numbered_san(moves)
    if san is None:
        return None
    return f'[WhiteElo "{"?" if white_elo is None else white_elo}"]\n[BlackElo "{"?" if black_elo is None else black_elo}"]\n[Result "{result}"]\n\n{san} {result}'.rstrip()


def answer_outcome(fen: str | None, answer: str | None) -> str:
    """legal, illegal, ambiguous, unparseable or empty: what a SAN answer amounts to."""
    token = re.sub(r"[!?]+$", "", re.sub(r"^\d+\.+", "", (answer or "").strip().split(" ")[0]))
    if not token:
        return "empty"
    try:
        board = Board(fen or "")
        board.parse_san(token)
    except Illegal as e:
        text = str(e)
        return "ambiguous" if text.startswith("ambiguous") else "unparseable" if text.startswith("not a move") else "illegal"
    return "legal"


def material(board: Board, colour: str) -> int:
    """Material of the colour less that of the other side."""
    total = 0
    for c in board.cells:
        if c != ".":
            total += PIECE_VALUES[c.lower()] * (1 if c.isupper() == (colour == "w") else -1)
    return total


def mobility(fen: str) -> int:
    return len(Board(fen).legal_moves())


def worst_reply(board: Board) -> int:
    """The mover's opponent's material after the reply that costs it most, seen from the side not to move."""
    mine = "b" if board.turn == "w" else "w"
    worst = material(board, mine)
    for move in board.legal_moves():
        after = board.copy()
        after.push(move)
        worst = min(worst, material(after, mine))
    return worst


def blunder_verdict(fen: str | None, move: str | None, threshold: int = 2) -> bool | None:
    """Whether a move lets one reply win ``threshold`` more pawns of material than stood before."""
    try:
        board = Board(fen or "")
        mine = board.turn
        before = material(board, mine)
        board.push(board.parse_uci(move or ""))
    except Illegal:
        return None
    return before - worst_reply(board) >= threshold


def repetitions(moves: str) -> int:
    """How often the last position of a game has stood in it."""
    board, seen = Board(), {}
    seen[board.key()] = 1
    for token in moves.split():
        board.push(board.parse_uci(token))
        seen[board.key()] = seen.get(board.key(), 0) + 1
    return seen[board.key()]


def game_over(moves: str | None) -> str | None:
    """checkmate, stalemate, material, fifty or repetition (claims included); None if play goes on."""
    board, seen = Board(), {}
    seen[board.key()] = 1
    for token in (moves or "").split():
        board.push(board.parse_uci(token))
        seen[board.key()] = seen.get(board.key(), 0) + 1
    if not board.has_legal_move():
        return "checkmate" if board.in_check() else "stalemate"
    if board.insufficient():
        return "material"
    if board.half >= 100:
        return "fifty"
    return "repetition" if seen[board.key()] >= 3 else None


def reward(moves: str, move: str, delta: float, *, mate_bonus: float = 0.5, repetition_penalty: float = 0.25, illegal: float = -1.0) -> dict[str, float]:
    """Parts and total of the reward of a move after a prefix.

    ``delta`` is its normalised quality in 0..1; an illegal move gets the floor.
    """
    board = Board()
    for token in moves.split():
        board.push(board.parse_uci(token))
    try:
        board.push(board.parse_uci(move))
    except Illegal:
        return {"legal": 0.0, "quality": 0.0, "mate": 0.0, "repetition": 0.0, "total": illegal}
    mate = mate_bonus if board.in_check() and not board.has_legal_move() else 0.0
    again = -repetition_penalty if repetitions(f"{moves} {move}".strip()) > 1 else 0.0
    return {"legal": 1.0, "quality": delta, "mate": mate, "repetition": again, "total": delta + mate + again}


def random_opening(plies: int, seed: str) -> str:
    """A random legal opening; the same for the same seed."""
    rng, board, out = random.Random(seed), Board(), []
    while len(out) < plies:
        moves = sorted(board.legal_moves())
        if not moves:
            break
        move = rng.choice(moves)
        board.push(move)
        out.append(uci(move))
    return " ".join(out)


def split_moves(text: str) -> list[str]:
    """Moves of a game written without blanks; a letter after a move to the last rank is its promotion if the game goes on legally."""
    board, out, i = Board(), [], 0
    while i < len(text):
        plain, promoted = text[i : i + 4], text[i : i + 5]
        for token in (promoted, plain) if len(promoted) == 5 and promoted[4] in "nbrq" else (plain,):
            try:
                move = board.parse_uci(token)
            except Illegal:
                continue
            board.push(move)
            out.append(token)
            i += len(token)
            break
        else:
            raise Illegal(f"no move at {i}: {text[i : i + 5]!r}")
    return out


