"""Movetext, headers, names and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_movetext(text: Column) -> Column:
    """Movetext without comments, variations (however deep), NAGs, result and move numbers."""
    out = F.regexp_replace(text, r"\{[^}]*\}", " ")
    # each round takes the innermost variations; there are no more levels than opening parentheses
    levels = F.array_repeat(F.lit(0), F.length(out) - F.length(F.replace(out, F.lit("("), F.lit(""))))
    out = F.reduce(levels, out, lambda x, _: F.when(x.contains("("), F.regexp_replace(x, r"\([^()]*\)", " ")).otherwise(x))
    out = F.regexp_replace(out, r"\$\d+", " ")
    out = F.regexp_replace(out, r"(?:1-0|0-1|1/2-1/2|\*)\s*$", " ")
    out = F.regexp_replace(out, r"\b\d+\.(?:\.\.)?", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def plain_move(move: Column, line: Column) -> Column:
    """The move in plain lower-case coordinates, or else the first of the line; null if neither has any."""
    plain = lambda c: F.nullif(F.translate(F.lower(c), "=- \t\r\n", ""), F.lit(""))
    return F.coalesce(plain(move), plain(F.regexp_extract(line, r"^\s*(\S+)", 1)))


def san_tokens(text: Column) -> Column:
    """The moves of a cleaned movetext, without ``!`` and ``?``."""
    return F.filter(F.transform(F.split(text, r"\s+"), lambda t: F.regexp_replace(t, "[!?]+$", "")), lambda t: t != "")


def first_token(text: Column, delimiter: str = " ") -> Column:
    return F.split_part(text, F.lit(delimiter), F.lit(1))


def safe_int(text: Column) -> Column:
    """The whole number a text holds, else null; the same on any engine."""
    return F.when(text.rlike(r"^\s*[+-]?\d{1,9}\s*$"), F.trim(text)).try_cast("int")


def base_time(control: Column) -> Column:
    """Seconds before the ``+`` of a time control; null for ``-`` and the like."""
    return safe_int(F.split_part(control, F.lit("+"), F.lit(1)))


def parse_date(text: Column) -> Column:
    """``yyyy.MM.dd`` or ``yyyy-MM-dd``; anything else is null."""
    plain = F.replace(text, F.lit("."), F.lit("-"))
    return F.when(plain.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(plain, "yyyy-MM-dd"))


def prefix(sequence: Column, n: Column) -> Column:
    """The first n tokens of a space-joined sequence."""
    return F.array_join(F.slice(F.split(sequence, " "), F.lit(1), n), " ")


def crop_ids(ids: Column, block: int, header: int = 3) -> Column:
    """At most ``block`` ids: the header and the end of what follows."""
    short = F.slice(ids, 1, block)
    if block <= header:
        return F.when(F.size(ids) <= block, ids).otherwise(short)
    keep = block - header
    return F.when(F.size(ids) <= block, ids).otherwise(F.concat(F.slice(ids, 1, header), F.slice(ids, -keep, keep)))


def metric_name(*parts: Column) -> Column:
    """Parts joined with ``/``, other characters than letters, digits, ``_ . - /`` and blank replaced by ``_``."""
    return F.concat_ws("/", *[F.regexp_replace(p, r"[^A-Za-z0-9_.\- ]", "_") for p in parts])


def toggle_suffix(name: Column, suffix: str) -> Column:
    """``name`` with the suffix removed if it has it, else added."""
    n = len(suffix)
    return F.when(name.endswith(suffix), F.substring(name, F.lit(1), F.length(name) - n)).otherwise(F.concat(name, F.lit(suffix)))


def answer_move(answer: Column) -> Column:
    """First token of an answer without move number and ``!?``; empty for none."""
    token = F.split_part(F.trim(answer), F.lit(" "), F.lit(1))
    return F.regexp_replace(F.regexp_replace(token, r"^\d+\.+", ""), r"[!?]+$", "")


def headers(white_elo: Column, black_elo: Column, result: Column) -> Column:
    return F.format_string('[WhiteElo "%s"]\n[BlackElo "%s"]\n[Result "%s"]', white_elo.cast("string"), black_elo.cast("string"), result)


def percent(value: Column, digits: int = 1) -> Column:
    """``12.3 %``; null is ``n/a``."""
    return F.when(value.isNull(), "n/a").otherwise(F.concat(F.format_string(f"%.{digits}f", F.round(value * 100, digits)), F.lit(" %")))


def unit_cell(value: Column, unit: Column) -> Column:
    """``12.3 %`` of a share, whole Elo points, or ``1.2345 bits``, by the unit's name; null is ``n/a``."""
    elo, bits = F.format_string("%.0f", F.round(value, 0)), F.format_string("%.4f bits", F.round(value, 4))
    return F.when(value.isNull(), "n/a").when(unit == "percent", percent(value)).when(unit == "elo", elo).otherwise(bits)


def name_prefixes(name: Column) -> Column:
    """The shorter names of ``a-b-c``: ``a-b`` and ``a``."""
    parts = F.split(name, "-")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "-"))


def index_spec(spec: Column, n_files: int | None = None) -> Column:
    """``0,2,5-7`` as a sorted array of distinct numbers; empty parts count for nothing.

    With ``n_files`` a number outside of 0 .. n_files - 1 is an error.
    """
    parts = F.filter(F.split(F.regexp_replace(spec, r"\s+", ""), ","), lambda r: r != "")
    ranges = F.transform(parts, lambda r: F.sequence(F.split_part(r, F.lit("-"), F.lit(1)).cast("int"), F.split_part(r, F.lit("-"), F.lit(-1)).cast("int")))
    found = F.array_sort(F.array_distinct(F.flatten(ranges)))
    if n_files is None:
        return found
    outside = F.exists(found, lambda i: (i < 0) | (i >= n_files))
    return F.when(outside, F.raise_error(F.concat(F.lit(f"file numbers go from 0 to {n_files - 1}: "), spec)).cast("array<int>")).otherwise(found)
