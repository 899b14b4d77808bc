"""PGN archives: text files and zipped ones, to rows of tags and movetext."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.operators.ordering import range_rank

TAG = re.compile(r'^\[(\w+)\s+"(.*)"\]\s*$')
#: tag -> column
COLUMNS = {"Site": "Site", "White": "White", "Black": "Black", "Result": "Result", "UTCDate": "UTCDate", "Date": "Date", "WhiteElo": "WhiteElo", "BlackElo": "BlackElo", "ECO": "ECO", "TimeControl": "TimeControl", "Event": "Event", "Termination": "Termination"}
SCHEMA = "path string, game_no bigint, " + ", ".join(f"{c} string" for c in COLUMNS.values()) + ", movetext string"


def games(lines: Iterable[str]) -> Iterator[tuple[dict[str, str], str]]:
    """(tags, movetext) of each game; a header after moves, or a tag that repeats, begins a new one.

    Headers without moves are dropped and do not leak into the next game; lines
    that begin with ``[`` and are no tag are skipped, as are ``%`` lines.
    """
    tags: dict[str, str] = {}
    moves: list[str] = []
    for raw in lines:
        line = raw.strip()
        tag = TAG.match(line)
        if tag:
            if moves:
                yield tags, " ".join(moves)
                tags, moves = {}, []
            elif tag[1] in tags:
                tags = {}
            tags[tag[1]] = tag[2]
        elif line and line[0] not in "%[":
            moves.append(line)
    if moves:
        yield tags, " ".join(moves)


def members(path: str, content: bytes) -> bytes:
    """The PGN in a file: itself, or the only ``.pgn`` of a zip."""
    if not path.endswith(".zip"):
        return content
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = [n for n in archive.namelist() if n.lower().endswith(".pgn")]
        if len(names) != 1:
            raise ValueError(f"{path}: {len(names)} PGN members")
        return archive.read(names[0])


#: Where a text is cut into records; the first tag of a game by the PGN standard.
_FIRST_TAG = "\n[Event "


def _game_rows(name: str, text: str) -> list[dict]:
    return [{"path": name, "at": i, **{c: tags.get(t) for t, c in COLUMNS.items()}, "movetext": moves} for i, (tags, moves) in enumerate(games(text.splitlines()))]


def read_pgn(spark: SparkSession, path: str) -> DataFrame:
    """One row a game of all PGN and zip files under ``path``, numbered from 0 in each file.

    Text files are cut into records at the first tag of each game, so a file of
    any size is read by as many tasks as it has blocks.  A zip cannot be cut: it
    is one task and may have 2 GB.
    """
    columns = ["path", "at", *COLUMNS.values(), "movetext"]
    schema = SCHEMA.replace("game_no bigint", "at bigint")

    def from_text(batches):
        for df in batches:
            rows = []
            for name, block, order, value in df[["path", "block", "order", "value"]].itertuples(index=False):
                # a record has lost its first tag's beginning, but the first of the file
                text = value if value.lstrip("\ufeff \r\n").startswith("[") or not value.startswith('"') else "[Event " + value
                rows += [{**r, "block": block, "order": order} for r in _game_rows(name, text)]
            yield pd.DataFrame(rows, columns=[*columns, "block", "order"])

    def from_zip(batches):
        for df in batches:
            for name, content in df[["path", "content"]].itertuples(index=False):
                rows = _game_rows(name, members(name, bytes(content)).decode("utf-8", errors="replace"))
                yield pd.DataFrame([{**r, "block": 0, "order": 0} for r in rows], columns=[*columns, "block", "order"])

    here = spark.read.option("recursiveFileLookup", "true")
    lines = here.option("pathGlobFilter", "*.pgn").option("lineSep", _FIRST_TAG).text(path)
    cut = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("order"), "value")
    zips = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)
    found = cut.mapInPandas(from_text, schema + ", block bigint, order bigint").unionByName(zips.select("path", "content").mapInPandas(from_zip, schema + ", block bigint, order bigint"))
    numbered = range_rank(found, ["path"], ["block", "order", "at"], name="game_no").withColumn("game_no", F.col("game_no") - 1)
    return numbered.select("path", "game_no", *COLUMNS.values(), "movetext")


def strict(converted: DataFrame) -> DataFrame:
    """The rows of a conversion, failing at the first whose game is illegal."""
    return converted.withColumn("reason", F.when(F.col("reason") == "illegal", F.raise_error(F.lit("illegal game"))).otherwise(F.col("reason")))
