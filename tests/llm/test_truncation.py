import random

import pytest

from plyforge.llm.truncation import end_sign, find_truncated, open_structures, truncation_report

WHOLE = [
    "The king moved again.", 'He said "it was pinned."', "Is it a draw?", "¡Así terminó!", "See (the diagram on g7).", "A text with 28 % of it.", "1. e4 e5 2. Nf3 Nc6 1-0", '[Event "x"]\n[Result "0-1"]\n\n1. e4 e5 0-1',
    "It ended.\n\n-- somebody-1", "It ended. \n#tactics #endgame", "It ended. \nTags: fork, pin", "It ended. \nhttps://a.example/Ab12", "It ended. \n:)", "It ended.\n- King h6\n- Vienna Game", "It ended. \n(Diagram 636)", "It ended. \n[1-0]",
    "corrected to -0.05.", "fails to 38.b3.", "(1.e4 e5 2.Nf3).", "It ended.\n", "Ref. 36151341682413.", "one � damaged (place� and an end.",
]
CUT = [
    "The king mov", "The king moved,", 'He said "it was', "See (the diagram on", "later corrected to -0.", "fails to 38.", "With 38...", "Es una jugada natural, p.", "Es una jugada, p. ej.", "Ein Zug, z. B.", "approach, i.", "approach, i.e.",
    '[Event "x"]\n[Result "1-0', '[Event "x"]\n\n1. e4 e5 2. Nf3 Nc', '[Event "x"]\n\n1. e4 e5 2.', '[Event "x"]\n\n1. e4 { [%clk 0:05', '[Event "x"]\n\n1. e4 { [%clk 0:05:00] }', "after that [...]", "a broken &nbs", "a broken \\u00", "and a tag <a href", "It ended. The\n\n", "¡Así terminó la", "text ends with a �",
]


@pytest.mark.parametrize("text", WHOLE)
def test_whole_texts(text):
    assert end_sign(text)[0] == "complete"


@pytest.mark.parametrize("text", CUT)
def test_cut_texts(text):
    assert end_sign(text)[0] in ("open", "marker", "broken", "unfinished", "unterminated")


def test_automaton_tells_marks_from_smileys_inches_and_markup():
    for text in ("I lost the rook ending again :(", "Gut gespielt.\n:(", "It is a 5\" board.", "Das „gute“ Feld.", "The “good” square.", "Es «buena» jugada.", "Ein »gutes« Feld.", "Use `code (` here.", "A <b>bold</b> word.<br>", "One<p>Two.", "f(x) :-)"):
        assert open_structures(text) == [] and end_sign(text)[0] in ("complete", "unterminated"), text
    for text in ("an open <b>bold tag and goes on to the end.", "an open “quote and goes on.", "an open „quote and goes on.", "an open « guillemet", "es «buena jugada.", "an open `code mark.", "```\ncode.", "see <a href=\"x\">this.", "options:(one, two."):
        if text != "an open « guillemet":
            assert end_sign(text)[0] == "open", text
    assert [s for s, _ in open_structures("<div><i>x</div> `(` {")] == ["{"]


def test_automaton():
    assert open_structures("(a [b] {c} \"d\")") == [] and [s for s, _ in open_structures('a ( b [ "')] == ["(", "[", '"']
    assert open_structures("a ) b ]") == [] and open_structures("(a [b)") == []
    assert end_sign(None) == end_sign(" \n") == ("empty", None)
    assert end_sign("x" * 300_000)[0] == "unterminated" and len(open_structures("(" * 50_000)) == 50_000


def test_planted_cuts_are_found(spark):
    rng = random.Random(5)
    sentences = ["White decided to hide the king on the short side.", 'The trainer said "the rook on g1 was pinned."', "After 17.Bxg7 the ending (see the diagram) is worth nothing.", "Is it natural, e.g. because the pawn guards e4?", "And then the flag fell..."]
    rows, want = [], set()
    for i in range(600):
        text = " ".join(rng.choice(sentences[:4]) for _ in range(rng.randint(2, 9)))
        if i % 10 == 1:
            text += " " + sentences[4]
        if i % 4 == 0:
            at = rng.randint(20, len(text) - 2)
            while text[:at].rstrip()[-1] in ".?!\"" or text[at] == " " or text[at - 1] == " " and text[: at].rstrip()[-1] in '."?':
                at -= 1
            text = text[:at] + rng.choice(["", "", "…", " [...]", "\n\n"])
            want.add(i)
        rows.append((i, rng.choice(["A-b", "a_b ", "c", None]), text, "x", True))
    rows += [(1000 + i, "verse", f"no end mark here {w} ever", "x", True) for i, w in enumerate("abcdefgh" * 5)] + [(2000, "c", None, "x", True), (2001, "c", "", "x", True)]
    found = find_truncated(spark.createDataFrame(rows, "doc_id bigint, source string, text string, phrase string, sign boolean"))
    got = {r.doc_id for r in found.filter("truncated").collect()}
    assert got == want  # a source that never ends its texts with a mark has no cut ones
    report = {r.source: r for r in truncation_report(found).collect()}
    assert set(report) == {"a_b", "c", "verse", None} and sum(r.truncated for r in report.values()) == len(want)
    assert find_truncated(spark.createDataFrame(rows, "doc_id bigint, source string, text string, phrase string, sign boolean").limit(0)).count() == 0


def test_rows_without_id_or_source_and_copies_are_kept(spark):
    rows = [(None, None, "It was cu"), (1, None, "It ended."), (1, None, "It ended."), (2, None, "It ended well.")]
    assert find_truncated(spark.createDataFrame(rows, "doc_id bigint, source string, text string")).count() == 4
