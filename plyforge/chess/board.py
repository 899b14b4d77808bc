"""A small mailbox board: FEN, legal moves, UCI and SAN.

Squares are 0..63, a1 = 0, b1 = 1, ... h8 = 63.  A move is ``(from, to,
promotion)`` with promotion ``""`` or one of ``nbrq``.
"""

from __future__ import annotations

import re

START = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"
NAMES = [f + r for r in "12345678" for f in "abcdefgh"]
INDEX = {n: i for i, n in enumerate(NAMES)}
RESULTS = ("1-0", "0-1", "1/2-1/2")

_ROOK, _BISHOP = ((1, 0), (-1, 0), (0, 1), (0, -1)), ((1, 1), (1, -1), (-1, 1), (-1, -1))
_KNIGHT = tuple((a, b) for a in (-2, -1, 1, 2) for b in (-2, -1, 1, 2) if abs(a) != abs(b))


def _rays(directions):
    table = []
    for s in range(64):
        x, y, rays = s % 8, s // 8, []
        for dx, dy in directions:
            ray, a, b = [], x + dx, y + dy
            while 0 <= a < 8 and 0 <= b < 8:
                ray.append(a + 8 * b)
                a, b = a + dx, b + dy
            if ray:
                rays.append(tuple(ray))
        table.append(tuple(rays))
    return tuple(table)


def _steps(offsets):
    return tuple(tuple(s % 8 + a + 8 * (s // 8 + b) for a, b in offsets if 0 <= s % 8 + a < 8 and 0 <= s // 8 + b < 8) for s in range(64))


ROOK_RAYS, BISHOP_RAYS = _rays(_ROOK), _rays(_BISHOP)
QUEEN_RAYS = tuple(r + b for r, b in zip(ROOK_RAYS, BISHOP_RAYS))
KNIGHT_STEPS, KING_STEPS = _steps(_KNIGHT), _steps(_ROOK + _BISHOP)
#: squares from which a pawn of the colour attacks the square
PAWN_FROM = {"w": _steps(((-1, -1), (1, -1))), "b": _steps(((-1, 1), (1, 1)))}
#: castling letter -> (colour, king from, king to, rook from, rook to, must be empty, must be safe)
CASTLING = {
    "K": ("w", 4, 6, 7, 5, (5, 6), (4, 5, 6)),
    "Q": ("w", 4, 2, 0, 3, (1, 2, 3), (4, 3, 2)),
    "k": ("b", 60, 62, 63, 61, (61, 62), (60, 61, 62)),
    "q": ("b", 60, 58, 56, 59, (57, 58, 59), (60, 59, 58)),
}
_RIGHTS_LOST = {4: "KQ", 0: "Q", 7: "K", 60: "kq", 56: "q", 63: "k"}


class Illegal(ValueError):
    """A move or position that the rules do not allow."""


class Board:
    __slots__ = ("cells", "turn", "rights", "ep", "half", "full", "kings")

    def __init__(self, fen: str = START):
        fields = fen.split()
        if not 2 <= len(fields) <= 6:
            raise Illegal(f"FEN needs two to six fields: {fen!r}")
        rows = fields[0].split("/")
        if len(rows) != 8:
            raise Illegal(f"FEN needs eight ranks: {fen!r}")
        cells = ["."] * 64
        for r, row in enumerate(rows):
            x = 0
            for c in row:
                if c in "12345678":
                    x += int(c)
                elif c in "pnbrqkPNBRQK" and x < 8:
                    cells[(7 - r) * 8 + x] = c
                    x += 1
                else:
                    raise Illegal(f"bad rank {row!r}")
            if x != 8:
                raise Illegal(f"bad rank {row!r}")
        if fields[1] not in ("w", "b") or cells.count("K") != 1 or cells.count("k") != 1:
            raise Illegal(f"bad turn or kings: {fen!r}")
        self.cells, self.turn = cells, fields[1]
        given = fields[2] if len(fields) > 2 else "-"
        self.rights = "".join(c for c in "KQkq" if c in given)
        ep = fields[3] if len(fields) > 3 else "-"
        self.ep = INDEX.get(ep.lower(), -1)
        self.half = int(fields[4]) if len(fields) > 4 and fields[4].isdigit() else 0
        self.full = int(fields[5]) if len(fields) > 5 and fields[5].isdigit() else 1
        self.kings = {"w": cells.index("K"), "b": cells.index("k")}

    def copy(self) -> "Board":
        other = object.__new__(Board)
        other.cells, other.turn, other.rights = self.cells[:], self.turn, self.rights
        other.ep, other.half, other.full, other.kings = self.ep, self.half, self.full, dict(self.kings)
        return other

    # ---- attacks and legality -------------------------------------------------

    def attacked(self, square: int, by: str) -> bool:
        """Whether a piece of colour ``by`` attacks the square."""
        cells = self.cells
        pawn, knight, king, diagonal, straight = ("P", "N", "K", "BQ", "RQ") if by == "w" else ("p", "n", "k", "bq", "rq")
        if any(cells[s] == pawn for s in PAWN_FROM[by][square]):
            return True
        if any(cells[s] == knight for s in KNIGHT_STEPS[square]) or any(cells[s] == king for s in KING_STEPS[square]):
            return True
        for rays, pieces in ((BISHOP_RAYS[square], diagonal), (ROOK_RAYS[square], straight)):
            for ray in rays:
                for s in ray:
                    c = cells[s]
                    if c != ".":
                        if c in pieces:
                            return True
                        break
        return False

    def in_check(self, colour: str | None = None) -> bool:
        colour = colour or self.turn
        return self.attacked(self.kings[colour], "b" if colour == "w" else "w")

    def _safe(self, move: tuple[int, int, str]) -> bool:
        """Whether the mover's king is safe after the (pseudo-legal) move."""
        a, b, _ = move
        cells, colour = self.cells, self.turn
        piece, taken = cells[a], cells[b]
        passed = (b - 8 if colour == "w" else b + 8) if piece in "Pp" and b == self.ep and taken == "." and (a - b) % 8 else -1
        cells[b], cells[a] = piece, "."
        if passed >= 0:
            captured, cells[passed] = cells[passed], "."
        king = b if piece in "Kk" else self.kings[colour]
        safe = not self.attacked(king, "b" if colour == "w" else "w")
        cells[a], cells[b] = piece, taken
        if passed >= 0:
            cells[passed] = captured
        return safe

    def pseudo_moves(self, only: str | None = None):
        """Moves that ignore the safety of the king; ``only`` restricts to one kind of piece (upper case)."""
        cells, white = self.cells, self.turn == "w"
        own = "PNBRQK" if white else "pnbrqk"
        for a, piece in enumerate(cells):
            if piece not in own:
                continue
            kind = piece.upper()
            if only and kind != only:
                continue
            if kind == "P":
                step = 8 if white else -8
                last, home = (7, 1) if white else (0, 6)
                targets = []
                if cells[a + step] == ".":
                    targets.append(a + step)
                    if a // 8 == home and cells[a + 2 * step] == ".":
                        targets.append(a + 2 * step)
                for dx in (-1, 1):
                    if 0 <= a % 8 + dx < 8:
                        b = a + step + dx
                        if (cells[b] != "." and cells[b] not in own) or (b == self.ep and b // 8 == (5 if white else 2) and cells[b - step] == ("p" if white else "P")):
                            targets.append(b)
                for b in targets:
                    if b // 8 == last:
                        for p in "qrbn":
                            yield (a, b, p)
                    else:
                        yield (a, b, "")
            elif kind in "NK":
                for b in (KNIGHT_STEPS if kind == "N" else KING_STEPS)[a]:
                    if cells[b] not in own:
                        yield (a, b, "")
            else:
                for ray in (ROOK_RAYS if kind == "R" else BISHOP_RAYS if kind == "B" else QUEEN_RAYS)[a]:
                    for b in ray:
                        c = cells[b]
                        if c in own:
                            break
                        yield (a, b, "")
                        if c != ".":
                            break

    def _castling_moves(self):
        enemy = "b" if self.turn == "w" else "w"
        for letter in self.rights:
            colour, a, b, rook, _, empty, safe = CASTLING[letter]
            if colour == self.turn and self.cells[a] in "Kk" and self.cells[rook] == ("R" if colour == "w" else "r"):
                if all(self.cells[s] == "." for s in empty) and not any(self.attacked(s, enemy) for s in safe):
                    yield (a, b, "")

    def legal_moves(self) -> list[tuple[int, int, str]]:
        return [m for m in self.pseudo_moves() if self._safe(m)] + list(self._castling_moves())

    def is_legal(self, move: tuple[int, int, str]) -> bool:
        piece = self.cells[move[0]]
        if piece == "." or piece.isupper() != (self.turn == "w"):
            return False
        if any(m == move for m in self.pseudo_moves(piece.upper())):
            return self._safe(move)
        return piece in "Kk" and any(m == move for m in self._castling_moves())

    def has_legal_move(self) -> bool:
        return any(self._safe(m) for m in self.pseudo_moves()) or any(True for _ in self._castling_moves())

    # ---- making moves ------------------------------------------------------------

    def push(self, move: tuple[int, int, str]) -> None:
        """Makes a legal move."""
        a, b, promotion = move
        cells, white = self.cells, self.turn == "w"
        piece, taken = cells[a], cells[b]
        pawn = piece in "Pp"
        if pawn and b == self.ep and taken == "." and (a - b) % 8:
            cells[b - 8 if white else b + 8] = "."
        cells[a], cells[b] = ".", piece
        if promotion:
            cells[b] = promotion.upper() if white else promotion
        if piece in "Kk":
            self.kings[self.turn] = b
            if abs(a - b) == 2:
                _, _, _, rook, to, _, _ = CASTLING[("K" if b > a else "Q") if white else ("k" if b > a else "q")]
                cells[to], cells[rook] = cells[rook], "."
        if self.rights:
            for s in (a, b):
                for letter in _RIGHTS_LOST.get(s, ""):
                    self.rights = self.rights.replace(letter, "")
        self.ep = (a + b) // 2 if pawn and abs(a - b) == 16 else -1
        self.half = 0 if pawn or taken != "." else self.half + 1
        self.full += not white
        self.turn = "b" if white else "w"

    def parse_uci(self, text: str) -> tuple[int, int, str]:
        if not re.fullmatch(r"[a-h][1-8][a-h][1-8][nbrq]?", text):
            raise Illegal(f"not a move: {text!r}")
        move = (INDEX[text[:2]], INDEX[text[2:4]], text[4:])
        if not self.is_legal(move):
            raise Illegal(f"illegal: {text}")
        return move

    _SAN = re.compile(r"([NBRQK])?([a-h])?([1-8])?x?([a-h][1-8])(?:=?([NBRQ]))?[+#]?")

    def parse_san(self, text: str) -> tuple[int, int, str]:
        if re.fullmatch(r"[O0]-[O0](-[O0])?[+#]?", text):
            a = self.kings[self.turn]
            move = (a, a + (-2 if text.count("-") == 2 else 2), "")
            if move in list(self._castling_moves()):
                return move
            raise Illegal(f"illegal: {text}")
        m = self._SAN.fullmatch(text)
        if not m:
            raise Illegal(f"not a move: {text!r}")
        kind, file, rank, to, promotion = m.groups()
        target, found = INDEX[to], []
        for move in self.pseudo_moves(kind or "P"):
            a, b, p = move
            if b == target and p == (promotion or "").lower() and (not file or NAMES[a][0] == file) and (not rank or NAMES[a][1] == rank) and self._safe(move):
                found.append(move)
        if len(found) != 1:
            raise Illegal(f"{'ambiguous' if found else 'illegal'}: {text}")
        return found[0]

    def san(self, move: tuple[int, int, str]) -> str:
        """SAN of a legal move, with its check or mate sign."""
        a, b, promotion = move
        piece = self.cells[a]
        kind = piece.upper()
        if kind == "K" and abs(a - b) == 2:
            text = "O-O" if b > a else "O-O-O"
        else:
            takes = self.cells[b] != "." or (kind == "P" and b == self.ep and (a - b) % 8 != 0)
            if kind == "P":
                text = (NAMES[a][0] + "x" if takes else "") + NAMES[b] + ("=" + promotion.upper() if promotion else "")
            else:
                others = [m[0] for m in self.pseudo_moves(kind) if m[1] == b and m[0] != a and self._safe(m)]
                mark = ""
                if others:
                    if all(s % 8 != a % 8 for s in others):
                        mark = NAMES[a][0]
                    elif all(s // 8 != a // 8 for s in others):
                        mark = NAMES[a][1]
                    else:
                        mark = NAMES[a]
                text = kind + mark + ("x" if takes else "") + NAMES[b]
        after = self.copy()
        after.push(move)
        if after.in_check():
            text += "+" if after.has_legal_move() else "#"
        return text

    # ---- text forms ---------------------------------------------------------------

    def placement(self) -> str:
        rows = []
        for r in range(7, -1, -1):
            row, gap = "", 0
            for c in self.cells[8 * r : 8 * r + 8]:
                if c == ".":
                    gap += 1
                else:
                    row += (str(gap) if gap else "") + c
                    gap = 0
            rows.append(row + (str(gap) if gap else ""))
        return "/".join(rows)

    def legal_ep(self) -> bool:
        """Whether a pawn of the side to move can legally capture en passant."""
        if self.ep < 0:
            return False
        return any(self.cells[a] == ("P" if self.turn == "w" else "p") and self.is_legal((a, self.ep, "")) for a in PAWN_FROM[self.turn][self.ep])

    def fen4(self) -> str:
        """Placement, turn, castling and the en-passant square, the last only if a capture there is legal."""
        return f"{self.placement()} {self.turn} {self.rights or '-'} {NAMES[self.ep] if self.legal_ep() else '-'}"

    def fen(self) -> str:
        return f"{self.fen4()} {self.half} {self.full}"

    def n_pieces(self) -> int:
        return 64 - self.cells.count(".")

    def key(self) -> tuple:
        return ("".join(self.cells), self.turn, self.rights, self.ep if self.legal_ep() else -1)

    def insufficient(self) -> bool:
        """Whether neither side can mate: bare kings, one minor piece, or bishops of one square colour."""
        left = [(c, i) for i, c in enumerate(self.cells) if c not in ".Kk"]
        if len(left) <= 1:
            return not left or left[0][0] in "nbNB"
        return all(c in "bB" for c, _ in left) and len({(i % 8 + i // 8) % 2 for _, i in left}) == 1


def uci(move: tuple[int, int, str]) -> str:
    return NAMES[move[0]] + NAMES[move[1]] + move[2]


def perft(board: Board, depth: int) -> int:
    """Number of legal move sequences of the given length."""
    moves = board.legal_moves()
    if depth <= 1:
        return len(moves) if depth else 1
    total = 0
    for move in moves:
        after = board.copy()
        after.push(move)
        total += perft(after, depth - 1)
    return total
