"""Byte-pair merges for a corpus's own move alphabet: training and encoding."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def merge_pairs(words: dict[str, int], merges: int) -> list[tuple[str, str]]:
    """The most frequent adjacent pair, again and again; ties to the smaller pair."""
    pieces = {w: list(w) for w in words}
    pairs: Counter = Counter()
    where: dict[tuple[str, str], set[str]] = {}
    for w, n in words.items():
        for p in zip(pieces[w], pieces[w][1:]):
            pairs[p] += n
            where.setdefault(p, set()).add(w)
    out = []
    while len(out) < merges:
        best = min(pairs, key=lambda p: (-pairs[p], p), default=None)
        if best is None or pairs[best] < 1:
            break
        out.append(best)
        for w in list(where.pop(best, ())):
            old, n = pieces[w], words[w]
            for p in zip(old, old[1:]):
                pairs[p] -= n
            new = apply_merge(old, best)
            pieces[w] = new
            for p in zip(new, new[1:]):
                pairs[p] += n
                where.setdefault(p, set()).add(w)
        pairs.pop(best, None)
    return out


def apply_merge(pieces: list[str], pair: tuple[str, str]) -> list[str]:
    out, i = [], 0
    while i < len(pieces):
        if i + 1 < len(pieces) and (pieces[i], pieces[i + 1]) == pair:
            out.append(pieces[i] + pieces[i + 1])
            i += 2
        else:
            out.append(pieces[i])
            i += 1
    return out


#: Distinct words that training takes to the driver at most (moves have a few thousand).
MAX_WORDS = 2_000_000


def train_bpe(df: DataFrame, word: str, merges: int) -> list[tuple[str, str]]:
    """Merges from the counts of distinct words: the corpus is counted by Spark, words are few."""
    counts = df.filter(F.length(word) > 0).groupBy(word).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.limit(MAX_WORDS + 1).collect()
    if len(rows) > MAX_WORDS:
        raise ValueError(f"more than {MAX_WORDS} distinct words")
    return merge_pairs({r[word]: r.n for r in rows}, merges)


def encode_words(text: Column, merges: list[tuple[str, str]]) -> Column:
    """Pieces of the words of a text."""
    order = {p: i for i, p in enumerate(merges)}

    def encode(word: str) -> list[str]:
        pieces = list(word)
        while len(pieces) > 1:
            best = min(zip(pieces, pieces[1:]), key=lambda p: order.get(p, 1 << 30))
            if best not in order:
                break
            pieces = apply_merge(pieces, best)
        return pieces

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        known: dict[str, list[str]] = {}
        return texts.map(lambda t: None if t is None else [p for w in t.split() for p in known.setdefault(w, encode(w))])

    return run(text)
