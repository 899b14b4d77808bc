"""Hashes and identifiers."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_id(text: Column) -> Column:
    """Signed 64 bits: the first eight bytes of sha256, least first."""
    digest = F.sha2(text, 256)
    return F.conv(F.concat(*[F.substring(digest, i, 2) for i in range(15, 0, -2)]), 16, -10).cast("bigint")


def text_or_fallback_id(text: Column, month: Column, index: Column) -> Column:
    """The id of a link, or of ``month:index`` where there is none."""
    return text_id(F.coalesce(F.nullif(F.trim(text), F.lit("")), F.concat_ws(":", month, index.cast("string"))))


def entity_split(key: Column, seed: int, fraction: float) -> Column:
    """val or train by crc32 of ``seed:key``: one entity, one side, in any run."""
    return F.when(F.crc32(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary")) % 1_000_000 / 1_000_000 < fraction, "val").otherwise("train")


def row_key(seed: int, *parts: Column) -> Column:
    """A stable order of rows: crc32 of ``seed:part:part``."""
    return F.crc32(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary"))


def half(key: Column, seed: int) -> Column:
    """0 or 1 by crc32 of ``seed:threshold:key``."""
    return (row_key(seed, F.lit("threshold"), key) % 2).cast("int")


@F.pandas_udf(T.StringType())
def _blake(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else hashlib.blake2b(t.encode(), digest_size=8).digest()[::-1].hex())


def stable_u64(text: Column) -> Column:
    """blake2b-8 read as an unsigned number, in 16 hex digits, whose text order is its order."""
    return _blake(text)


def config_sha(settings: dict) -> str:
    """sha256 of the canonical JSON of settings."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def item_id(base: Column, elo: Column, default: int = 1800) -> Column:
    """``base``, with ``:e<elo>`` unless the rating asked for is the default."""
    return F.when(elo == default, base).otherwise(F.concat(base, F.lit(":e"), elo.cast("string")))
