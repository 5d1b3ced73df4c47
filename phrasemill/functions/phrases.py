"""Sections and phrases as tokens and stems: Arrow functions for the steps that no built-in expression has (NFKC, marks
and CJK, offsets, stems). What is decided with their results (classes, duplicates, flags, matches) is left to expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phrasemill.functions import stem as stems
from phrasemill.functions import text
from phrasemill.operators.matching import multilingual_hits

_STRINGS = T.ArrayType(T.StringType())
_SECTIONS = T.StructType().add("sections", T.ArrayType(_STRINGS)).add("stream", _STRINGS).add("ends", T.ArrayType(T.IntegerType()))
_PHRASE = T.StructType().add("kp", T.StringType()).add("surface", T.StringType()).add("words", _STRINGS).add("stems", _STRINGS).add("marked", _STRINGS)
_HITS = T.ArrayType(T.StructType().add("rank", T.IntegerType()).add("gold", T.IntegerType()))
#: Fixed value: what stands between two sections of a document's text.
SECTION_JOIN = "\n\n"


def _located(content: str) -> list[tuple[str, int]]:
    """Tokens with sentinels of one section and where each ends in the section as it is written."""
    normal, at = text.normal_offsets(text.repaired(content))
    return [(token, at[end]) for token, end in text.token_spans(normal)]


@F.pandas_udf(_SECTIONS)
def analysed_sections(contents: pd.Series) -> pd.DataFrame:
    """Of the sections of a document: their tokens, all tokens with a sentinel between sections, and the end offset of every word."""
    rows = []
    for sections in contents:
        each, stream, ends, base = [], [], [], 0
        for i, content in enumerate(sections if sections is not None else ()):
            found = _located(content or "")
            each.append([t for t, _ in found])
            stream += [text.SENTINEL] * (i > 0) + each[-1]
            ends += [base + end for t, end in found if t != text.SENTINEL]
            base += len(content or "") + len(SECTION_JOIN)
        rows.append((each, stream, ends))
    return pd.DataFrame(rows, columns=["sections", "stream", "ends"])


@lru_cache(maxsize=200_000)
def analysed(phrase: str, lang: str) -> tuple[str, str, tuple[str, ...], tuple[str, ...], tuple[str, ...]]:
    """``normal, surface, words, stems, marked``: marked stems keep the phrase's own separating marks, if it has some."""
    surface = " ".join(text.repaired(phrase).split())
    normal = " ".join(text.normal(phrase).split())
    tokens = text.token_list(normal)
    words = tuple(t for t in tokens if t != text.SENTINEL)
    stemmed = [stems.stem(t) if lang == "en" else t for t in tokens]
    return normal, surface, words, tuple(t for t in stemmed if t != text.SENTINEL), tuple(stemmed) if len(words) < len(tokens) else ()


def _short(lang: str | None) -> str:
    return (lang or "en")[:2]


@F.pandas_udf(T.ArrayType(T.ArrayType(_PHRASE)))
def analysed_phrases(phrases: pd.Series, langs: pd.Series) -> pd.Series:
    """Each alternative of each phrase (an array of arrays), in the language of the row."""
    return pd.Series([[[dict(zip(("kp", "surface", "words", "stems", "marked"), analysed(v, _short(lang)), strict=True)) for v in variants] for variants in (ps if ps is not None else ())] for ps, lang in zip(phrases, langs, strict=True)])


@F.pandas_udf(_STRINGS)
def phrase_stems(phrases: pd.Series, langs: pd.Series) -> pd.Series:
    """The stems of each phrase, joined by spaces; empty for a phrase without words."""
    return pd.Series([None if ps is None else [" ".join(analysed(p or "", _short(lang))[3]) for p in ps] for ps, lang in zip(phrases, langs, strict=True)])


def _multilingual(phrases: Sequence[str], primary: str, langs: Sequence[str], gold: Sequence[Sequence[str]]) -> list[tuple[int, int]]:
    first = dict.fromkeys(s for s in (" ".join(analysed(p or "", primary)[3]) for p in phrases) if s)
    source = {}
    for p in phrases:
        source.setdefault(" ".join(analysed(p or "", primary)[3]), p)
    ranked = [{lang: " ".join(analysed(source[s] or "", lang)[3]) for lang in set(langs)} for s in first]
    return multilingual_hits(ranked, list(zip(langs, gold, strict=True)))


@F.pandas_udf(_HITS)
def multilingual_matches(phrases: pd.Series, primary: pd.Series, langs: pd.Series, gold: pd.Series) -> pd.Series:
    """Hits of ranked phrases on gold of several languages: ranks by the primary language, each gold phrase compared in its own."""
    return pd.Series([
        None if gs is None else [{"rank": r, "gold": g} for r, g in _multilingual(list(ps), _short(first), [_short(x) for x in ls], [list(v) for v in gs])]
        for ps, first, ls, gs in zip(phrases, primary, langs, gold, strict=True)
    ])
