"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vocabulary of ranks for tiktoken; another path may be given to every operator.
DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"
#: How the byte-level vocabulary cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


#: Tokenizers of this Python worker, by path.
_LOADED: dict = {}


def load_encoding(path: str, content: Callable[[], bytes] | None = None):
    """The tokenizer of a vocabulary file, once a Python worker; ``content`` gives the file's bytes where it is not at hand."""
    if path not in _LOADED:
        import tiktoken

        if content is None:
            with open(path, "rb") as file:
                lines = file.read().splitlines()
        else:
            lines = content().splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line)}
        _LOADED[path] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def token_count(text: Column, vocabulary: str = DEFAULT_VOCABULARY) -> Column:
    """Tokens of the whole text; null and empty texts have none.

    The strings of special tokens are ordinary text.  The vocabulary is read on
    the driver and broadcast (a megabyte or two), so executors need no such file.
    """
    path = vocabulary_path(vocabulary)
    with open(path, "rb") as file:
        content = SparkSession.getActiveSession().sparkContext.broadcast(file.read())

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        encode = load_encoding(path, lambda: content.value).encode_ordinary
        return texts.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    return count(text)
