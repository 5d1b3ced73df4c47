"""Model tokens: exact counts and positions where a tokenizer's file is at hand, else words times a ratio.

A specification reads ``backend[name]``. Files come from the caller, who reads them once; their bytes travel with the
function to the workers, which need no file of their own.
"""

from __future__ import annotations

import base64
import bisect
import itertools
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phrasemill.functions import text

SPEC = r"^\s*([A-Za-z_]+)\s*\[\s*(.*?)\s*\]\s*$"
#: Fixed value: the pattern by which the rank files' tokenizers cut a text.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def backend(spec: str | Column) -> Column:
    """The backend of ``backend[name]``, null if it isn't one."""
    return F.nullif(F.regexp_extract(spec, SPEC, 1), F.lit(""))


def inner(spec: str | Column) -> Column:
    """The name inside."""
    return F.nullif(F.regexp_extract(spec, SPEC, 2), F.lit(""))


@lru_cache(maxsize=8)
def _encoder(kind: str, data: bytes) -> Callable[[str], tuple[int, list[int], list[int], bool]]:
    """A function from a text to ``n, ends, places, in bytes``: the ends of its tokens in rising order and their places from 1."""
    if kind == "transformers":
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(data.decode())

        def encode(value: str) -> tuple[int, list[int], list[int], bool]:
            encoding = tokenizer.encode(value)
            # Special tokens take a place but cover no text.
            covering = [(end, i + 1) for i, (start, end) in enumerate(encoding.offsets) if end > start]
            ends = list(itertools.accumulate((end for end, _ in covering), max))
            return len(encoding.ids), ends, [place for _, place in covering], False

    elif kind == "tiktoken":
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        encoding = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

        def encode(value: str) -> tuple[int, list[int], list[int], bool]:
            ids = encoding.encode_ordinary(value)
            ends = list(itertools.accumulate(len(piece) for piece in encoding.decode_tokens_bytes(ids)))
            return len(ids), ends, list(range(1, len(ids) + 1)), True

    else:
        raise ValueError(f"no exact tokenizer of kind {kind}")
    return encode


_COUNTED = T.StructType().add("n_tokens", T.IntegerType()).add("positions", T.ArrayType(T.IntegerType()))


def exact(kind: str, data: bytes, texts: str | Column, offsets: str | Column) -> Column:
    """``struct<n_tokens, positions>``: tokens of a text, and for each of ``offsets`` (ends of phrases, in characters) the
    place of the token that holds the character before it: what a model must have read."""

    @F.pandas_udf(_COUNTED)
    def run(texts: pd.Series, offsets: pd.Series) -> pd.DataFrame:
        encode, rows = _encoder(kind, data), []
        for value, wanted in zip(texts, offsets, strict=True):
            n, ends, places, in_bytes = encode(value or "")
            found = []
            for at in wanted if wanted is not None else ():
                at = len((value or "")[:at].encode()) if in_bytes else at
                found.append(places[min(bisect.bisect_left(ends, at), len(ends) - 1)] if ends else n)
            rows.append((n, found))
        return pd.DataFrame(rows, columns=["n_tokens", "positions"])

    return run(F.col(texts) if isinstance(texts, str) else texts, F.col(offsets) if isinstance(offsets, str) else offsets)


def approximate(kind: str, n_words: Column, words_before: Column) -> Column:
    """The same from word counts: ``words_before`` holds, for each offset, the words that begin before it."""
    return F.struct(text.approximate_tokens(n_words, kind).alias("n_tokens"), F.transform(words_before, lambda w: text.approximate_tokens(w, kind)).alias("positions"))
