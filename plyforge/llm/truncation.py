"""Texts that were cut off, by a structural completeness check.

A stack automaton reads the whole text: brackets, braces, quotes of all kinds,
guillemets, code marks and markup tags push and pop; smileys and inch marks are
told apart by what stands around them.  Whatever is still open at the end, a
broken character, entity or escape there, or a mark that a cutter leaves, shows
a cut.  Otherwise the end is read: an end mark that ends a sentence (and not an
abbreviation, a number or a move), a game result, or a closing line such as a
signature, a list, tags, a link.  A text that has none of these lacks its
terminator, which counts as a cut where the texts of its source usually have one.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plyforge.llm.mixing import source_name
from plyforge.operators.skew import salted_lookup
from plyforge.session import cut_lineage

#: Abbreviations that do not end a sentence (English, Spanish, German).
ABBREVIATIONS = frozenset("e.g. i.e. p.ej. z.b. d.h. u.a. cf. vs. ref. no. nr. num. núm. fig. vol. ca. bzw. vgl. usw ej. dr. mr. mrs. ms. sr. sra. st. etc.,".split())
RESULTS = ("1-0", "0-1", "1/2-1/2", "*")
#: A source's missing terminators count if at least so many of its unbroken texts have one.
BASELINE = 0.5
#: An ending in dots is a phrase of its own if this part of all such endings, and two texts, have it.
PHRASE_SHARE = 0.04

#: A mark, a code fence or a whole tag; one set of first characters lets the search skip from mark to mark.
_STRUCTURE = re.compile(r"""[()\[\]{}"`“”„«»�<](?:(?<=`)``|(?<=<)/?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>)?""")
_CLOSES = {")": "(", "]": "[", "}": "{"}
_FACE = re.compile(r"(?:^|\s)[:;=]['’]?-?$")
_MOUTHS = "()[]DPpOo/|"
#: Tags of markup that need no closing tag.
_UNPAIRED = frozenset("area base br col embed hr img input link meta source track wbr p li dt dd tr td th thead tbody tfoot option".split())
_HEADER = re.compile(r'\s*\[[A-Z]\w* "')
_TRAILER = re.compile(
    r"""(?:--|—|~)\s?\S+            # signature
    |PS:\s.*\S                      # postscript
    |(?:\#\w+\s*)+                  # tags
    |\w+:\s\S.*                     # key: value
    |\(\w+\s\d+\)                   # reference to a figure
    |https?://\S+                   # link
    |\[(?:1-0|0-1|1/2-1/2|\*)\]     # result
    |[-*•]\s\S.*                    # list""",
    re.VERBOSE,
)
_MOVETEXT_END = re.compile(r"(?:\d+\.+)?(?:[KQRBN]?[a-h]?[1-8]?x?[a-h]?[1-8]?(?:=[QRBN]?)?|O(?:-O?){0,2})[+#]?|.*[}\]]|\d+")
_SCHEMA = T.StructType([T.StructField("sign", T.StringType()), T.StructField("phrase", T.StringType())])


def smiley(text: str, mouth: int) -> bool:
    """Whether the character at ``mouth`` ends a smiley that stands by itself."""
    if not text[mouth + 1 : mouth + 2].strip() and text[mouth - 1 : mouth] in tuple(":;='’-"):
        return bool(_FACE.search(text[max(0, mouth - 4) : mouth]))
    return False


def open_structures(text: str) -> list[tuple[str, int]]:
    """What the automaton still holds at the end: (symbol, position).

    A closer pops its opener and what was opened inside it; closers without an
    opener are ignored.  Straight quotes and code marks toggle, but a straight
    quote after a letter or digit closes only (``5"``); within code nothing but
    its end counts.  A guillemet opens if it stands before a word and after a
    blank, in either direction; ``“`` closes ``„`` and opens otherwise.  Tags
    push and pop by name.  A bracket that is a smiley's mouth opens nothing.
    A damaged character after an opener may have been its closer, so it frees
    the innermost.
    """
    stack: list[tuple[str, int]] = []

    def pop(*symbols: str) -> bool:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in symbols:
                del stack[i:]
                return True
        return False

    for m in _STRUCTURE.finditer(text):
        c, at = m.group(), m.start()
        if c == "�":
            if stack:
                stack.pop()
            continue
        if stack and stack[-1][0] in ("`", "```"):
            if c == stack[-1][0]:
                stack.pop()
            continue
        before, after = text[at - 1 : at], text[m.end() : m.end() + 1]
        if c in _CLOSES:
            pop(_CLOSES[c])
        elif c == '"':
            if not pop(c) and not before.isalnum():
                stack.append((c, at))
        elif c == "”":
            pop("“", "„")
        elif c == "“":
            if not pop("„"):
                stack.append((c, at))
        elif c in "«»":
            if (not before or before.isspace() or before in "([{\"“„") and after and not after.isspace():
                stack.append((c, at))
            else:
                pop("»" if c == "«" else "«")
        elif c == "<":
            continue
        elif c[0] == "<":
            name = re.match(r"</?(\w+)", c).group(1).lower()
            if c[1] == "/":
                pop(f"<{name}>")
            elif name not in _UNPAIRED and not c.endswith("/>"):
                stack.append((f"<{name}>", at))
        elif not smiley(text, at):
            stack.append((c, at))
    return stack


def end_sign(text: str | None) -> tuple[str, str | None]:
    """(sign, phrase) of one text.

    Signs: ``complete``, ``empty``, ``open`` (a structure is not closed),
    ``marker`` (a cutter's mark), ``broken`` (part of a character, entity or
    escape), ``unfinished`` (an abbreviation, number, move or comma at the
    end), ``unterminated`` (no end mark), ``dots`` (ends in dots, with the last
    sentence as phrase).
    """
    whole = (text or "").rstrip()
    if not whole:
        return "empty", None
    if whole.endswith(("[...]", "[…]", "(...)", "[truncated]", "[cut]")):
        return "marker", None
    if re.search(r"(?:&#?\w{1,8}|\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?|\\|%[0-9A-F]|<[A-Za-z/!][^<>]*|[\ud800-\udbff]|�)$", whole):
        return "broken", None
    last = whole.rsplit("\n", 1)[-1].strip()
    game = bool(_HEADER.match(whole)) or bool(re.match(r"1\. ?\S+ \S+ 2\. ?\S", whole))
    held = open_structures(whole)
    if held:
        return "open", None
    if whole.rsplit(None, 1)[-1] in RESULTS:
        return "complete", None
    if not game and whole[-1] in _MOUTHS and smiley(whole, len(whole) - 1):
        return "complete", None
    if game and _MOVETEXT_END.fullmatch(whole.rsplit(None, 1)[-1]):
        return "unfinished", None
    if whole.endswith(("…", "...")):
        if re.search(r"\d\.\.\.$", whole):  # a move number
            return "unfinished", None
        return "dots", re.split(r"(?<=[.!?])[\"”»)\]]*\s+|\n", whole)[-1]
    if "\n" in whole and _TRAILER.fullmatch(last):
        return "complete", None
    bare = whole.rstrip("\"'”»’)]}")
    if bare.endswith(("!", "?")):
        return "complete", None
    if bare.endswith("."):
        words = bare.split()
        word, before = words[-1].lower(), words[-2] if len(words) > 1 else ""
        if word.lstrip("(\"'[¿¡") in ABBREVIATIONS or re.fullmatch(r"[(\"'\[]*[^\W\d]\.", word) or (word == "p." or before.lower() in ("p.", "z.")) and word in ("p.", "ej.", "b."):
            return "unfinished", None
        if re.search(r"(?:^|[\s(\[])[+-]?\d{1,3}\.$", bare) and not before.endswith(".") or re.search(r"[+-]\d+\.$", bare):
            return "unfinished", None
        return "complete", None
    if whole[-1] in ",;:-–—/+=&":
        return "unfinished", None
    return "unterminated", None


@F.pandas_udf(_SCHEMA)
def _signs(texts: pd.Series) -> pd.DataFrame:
    out = [end_sign(t) for t in texts]
    return pd.DataFrame({"sign": [x[0] for x in out], "phrase": [x[1] for x in out]})


def find_truncated(documents: DataFrame, *, baseline: float = BASELINE, phrase_share: float = PHRASE_SHARE) -> DataFrame:
    """(doc_id, source, sign, truncated BOOLEAN) of every row of ``documents``.

    ``source`` is in plain form and may be null (a source of its own).  A cut is
    certain for the signs open, marker, broken and unfinished.  ``unterminated``
    is a cut if at least ``baseline`` of the source's texts that are not
    certainly cut have a terminator.  ``dots`` is complete if the closing phrase
    has two words or more and belongs to at least two different texts and ``phrase_share`` of all that end
    in dots (so at most ``1 / phrase_share`` phrases exist, a list small enough
    to broadcast), and a cut otherwise.  Null and empty texts are not cut: there
    is nothing that ended early.  Whole texts are read; statistics are over all
    rows; extra columns are ignored.
    """
    read = documents.select("doc_id", source_name(F.col("source")).alias("source"), _signs(F.col("text")).alias("x"), F.xxhash64("text").alias("t"))
    read = read.select("doc_id", "source", "x.sign", "x.phrase", "t")
    read = cut_lineage(read)
    dots = read.filter("sign = 'dots'")
    every = dots.agg(F.count(F.lit(1)).alias("every"))  # one row
    common = dots.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("t").alias("texts")).crossJoin(F.broadcast(every)).filter((F.col("n") >= F.col("every") * phrase_share) & (F.col("texts") >= 2) & F.col("phrase").contains(" ")).select("phrase", F.lit(True).alias("natural"))
    named = read.join(F.broadcast(common), "phrase", "left")
    ends = F.col("sign").isin("complete") | F.coalesce("natural", F.lit(False))
    unsure = F.col("sign").isin("complete", "unterminated", "dots")
    sources = named.groupBy("source").agg((F.sum(ends.cast("double")) / F.sum(unsure.cast("double"))).alias("usual"))
    keyed = named.withColumn("k", F.coalesce("source", F.lit("\u0000")))
    judged = salted_lookup(keyed, sources.select(F.coalesce("source", F.lit("\u0000")).alias("k"), "usual"), ["k"], spread="doc_id")
    cut = F.col("sign").isin("open", "marker", "broken", "unfinished") | ((F.col("sign") == "unterminated") & (F.coalesce("usual", F.lit(1.0)) >= baseline)) | ((F.col("sign") == "dots") & F.col("natural").isNull())
    return judged.select("doc_id", "source", "sign", cut.alias("truncated"))


def truncation_report(found: DataFrame) -> DataFrame:
    """(source, documents, truncated, share) of each source, null among them."""
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("truncated").cast("bigint")).alias("truncated"), F.round(F.avg(F.col("truncated").cast("double")), 6).alias("share"))
