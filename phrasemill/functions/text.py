"""Text functions as column expressions; Arrow functions only where no built-in expression is exact.

Fixed values that decide results (stop words, character classes, thresholds) are stated as text below.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stands for a separating mark; no contiguous match crosses it.
SENTINEL = "\x01"
#: Fixed value: Chinese and Japanese ranges, one token per character.
CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿"
WORD = r"[\p{L}\p{N}]+"

#: Stop words by language.
STOP_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he this are or his from at which but have an they you were her she we there been their has will its",
    "fr": "le la les de des du un une et en dans que qui pour sur pas au aux ce cette ces par plus avec ne se sont est été nous vous ils elle mais ou où donc car si leur",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando",
    "it": "di che e la il un a per in una sono mi si lo ma le ci con non del più questo al come da dei nel alla",
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua",
    "nl": "de en van het een in is dat op te zijn voor met die niet aan er om ook als bij door wordt worden maar dan of uit naar deze kan zij tot",
    "ru": "и в не на что с по как это из за от для к о но же его а то все так было он мы она они при бы также или",
    "ar": "في من على إلى أن عن مع هذا هذه التي الذي كان التى ما لا هو هي ثم أو قد كل بين بعد عند إن لم ذلك تلك منذ حتى كما أيضا وفي ومن",
    "sv": "och att det som en på är av för med till den har de inte om ett han men var jag sig från vi så kan man när år",
    "tr": "ve bir bu da de için ile olarak çok daha gibi olan ama en kadar sonra ne her mi göre ise ya veya şu",
    "pl": "i w na z się nie do to że jest o jak ale po co tak za od przez przy dla jego oraz lub są być",
}
#: The least share of stop words that names a language; a declared language contradicts below
#: this part of the best share; words a section and an annotation need for a vote.
VOTE_FLOOR, CONTRADICTION, SECTION_WORDS, ANNOTATION_WORDS = 0.08, 0.5, 5, 6
#: Tokens per word where a tokenizer's files are missing.
TOKENS_PER_WORD = {"transformers": 1.30, "tiktoken": 1.25}
OTHER_TOKENS_PER_WORD = 1.30


@lru_cache(maxsize=1)
def _repairs() -> tuple[str, str]:
    """Control characters and what each becomes: C1 its cp1252 character, others a space."""
    source = [c for c in [*range(0x20), *range(0x7F, 0xA0)] if c not in (9, 10, 13)]
    target = []
    for c in source:
        try:
            target.append(bytes([c]).decode("cp1252") if c >= 0x80 else " ")
        except UnicodeDecodeError:
            target.append(" ")
    return "".join(map(chr, source)), "".join(target)


def repaired(text: str) -> str:
    """``fix_text`` of one string."""
    return text.translate(str.maketrans(*_repairs()))


def normal(text: str) -> str:
    """``norm_text`` of one string."""
    return unicodedata.normalize("NFKC", repaired(text)).lower()


def fix_text(text: str | Column) -> Column:
    """Repaired control characters, length preserved; null becomes empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.translate(F.coalesce(text, F.lit("")), *_repairs())


@F.pandas_udf(T.StringType())
def _nfkc_lower(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).lower())


def norm_text(text: str | Column) -> Column:
    """Repaired, NFKC, lower case (not case-folded): the engine's only text normal form."""
    return _nfkc_lower(fix_text(text))


def norm_ascii(text: str | Column) -> Column:
    """``norm_text`` for ASCII texts, without leaving the JVM."""
    return F.lower(fix_text(text))


def normalised(text: str | Column) -> Column:
    """``norm_text`` of any text: ASCII values stay in the JVM, only the others go through the Arrow function."""
    text = F.col(text) if isinstance(text, str) else text
    plain = ~F.coalesce(text, F.lit("")).rlike(r"[^\x00-\x7F]")
    return F.when(plain, norm_ascii(text)).otherwise(_nfkc_lower(F.when(~plain, fix_text(text))))


def norm_phrase(normal: Column) -> Column:
    """A normalised text's words by single spaces."""
    return F.trim(F.regexp_replace(normal, r"[\s\u0085   -     　]+", " "))


def variants(phrase: str | Column) -> Column:
    """Alternatives joined by a lone ``+``; ``C++`` and ``A+ grade`` stay whole, an empty split gives the phrase."""
    phrase = F.coalesce(F.col(phrase) if isinstance(phrase, str) else phrase, F.lit(""))
    parts = F.filter(F.transform(F.split(phrase, r"(?<=[^+\s])\+(?=[^+\s])"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.contains(phrase, F.lit("+")) & (F.size(parts) > 0), parts).otherwise(F.array(phrase))


def words(normal: str | Column) -> Column:
    """Words of a normalised text without combining marks or CJK characters."""
    return F.regexp_extract_all(normal, F.lit(WORD), F.lit(0))


# ``_`` counts as a word character for separators and as none for tokens, as in Python's classes.
_PUNCT = r"[^\p{L}\p{N}_\s\x01]+"
_SEPARATOR = rf"(?:\s|^){_PUNCT}|{_PUNCT}(?:\s|$)"


def tokens_with_sentinels(normal: str | Column) -> Column:
    """Words, and a sentinel for every mark with white space or a text end beside it; same limits as ``words``."""
    marked = F.regexp_replace(normal, _SEPARATOR.replace("^", r"\A").replace(r"[\A", "[^").replace("$", r"\z"), f" {SENTINEL} ")
    return F.regexp_extract_all(marked, F.lit(rf"\x01|{WORD}"), F.lit(0))


class _Kinds(dict):
    """One letter for the kind of each character, decided when it is first met.

    ``c`` a CJK character, ``w`` a letter, number or combining mark of any plane, ``u`` the underscore, ``s`` white
    space, ``x`` the sentinel, ``p`` any other mark.
    """

    def __missing__(self, code: int) -> str:
        char = chr(code)
        if char == SENTINEL:
            kind = "x"
        elif any(low <= char <= high for low, high in _CJK_RANGES):
            kind = "c"
        elif unicodedata.category(char)[0] in "LNM":
            kind = "w"
        else:
            kind = "u" if char == "_" else "s" if char.isspace() else "p"
        self[code] = kind
        return kind


_CJK_RANGES = [tuple(r.split("-")) for r in re.findall(".-.", CJK)]
_KINDS = _Kinds()
# Over kinds: marks with white space, a text end or a CJK character beside them separate.
_SEPARATING = re.compile(r"(?:s|\A)p+|p+(?:s|\Z)|p+(?=c)|(?<=c)p+")
_UNITS = re.compile("x|c|w+")


def token_spans(normal: str) -> list[tuple[str, int]]:
    """Tokens with sentinels and the offset at which each ends."""
    kinds = _SEPARATING.sub(lambda m: "x" + "s" * (len(m[0]) - 1), normal.translate(_KINDS))
    return [(SENTINEL if m[0] == "x" else normal[m.start() : m.end()], m.end()) for m in _UNITS.finditer(kinds)]


def token_list(normal: str) -> list[str]:
    """Tokens with sentinels of any normalised text."""
    return [token for token, _ in token_spans(normal)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def general_tokens(normal: pd.Series) -> pd.Series:
    """``token_list`` for columns: combining marks belong to words, CJK characters are tokens."""
    return normal.map(token_list)


@F.pandas_udf(T.ArrayType(T.StructType().add("token", T.StringType()).add("stop", T.IntegerType())))
def general_token_spans(normal: pd.Series) -> pd.Series:
    return normal.map(lambda t: [{"token": w, "stop": e} for w, e in token_spans(t)])


def normal_offsets(text: str) -> tuple[str, Sequence[int]]:
    """Normalised text and, for every offset in it, the offset in ``text`` where its cluster of characters began.

    Clusters start at characters that neither combine nor compose with what stands before; each is normalised on
    its own, so that offsets are exact whatever a cluster expands or shrinks to.
    """
    if text.isascii():
        return text.lower(), range(len(text) + 1)
    out, at, start = [], [], 0
    while start < len(text):
        stop = start + 1
        while stop < len(text) and (unicodedata.combining(text[stop]) or unicodedata.normalize("NFKC", text[start : stop + 1]) != unicodedata.normalize("NFKC", text[start:stop]) + unicodedata.normalize("NFKC", text[stop])):
            stop += 1
        piece = unicodedata.normalize("NFKC", text[start:stop]).lower()
        out.append(piece)
        at += [start] * len(piece)
        start = stop
    return "".join(out), [*at, len(text)]


def _stop_words(df: DataFrame, languages: Sequence[str]) -> DataFrame:
    """``word`` and a 0/1 column for each language: some hundred rows whatever the input."""
    listed = {g: set(STOP_WORDS[g].split()) for g in languages}
    rows = [(w, *(int(w in own) for own in listed.values())) for w in sorted(set().union(*listed.values()))]
    return df.sparkSession.createDataFrame(rows, "__word string, " + ", ".join(f"`__{g}` int" for g in languages))


def stop_word_shares(df: DataFrame, key: Sequence[str], tokens: str, languages: Sequence[str] = tuple(STOP_WORDS)) -> DataFrame:
    """``key, shares`` (a map from language to the part of the row's tokens that are its stop words; 0 without tokens).

    ``key`` identifies a row. Tokens meet the broadcast list and are counted where they are; one partial row a text is shuffled.
    """
    each = df.select(*key, F.explode_outer(tokens).alias("__word")).join(F.broadcast(_stop_words(df, languages)), "__word", "left")
    sums = each.groupBy(*key).agg(F.count("__word").alias("__n"), *[F.coalesce(F.sum(f"__{g}"), F.lit(0)).alias(f"__{g}") for g in languages])
    share = [x for g in languages for x in (F.lit(g), F.coalesce(F.try_divide(f"__{g}", "__n"), F.lit(0.0)))]
    return sums.select(*key, F.create_map(*share).alias("shares"))


def language_vote(shares: str | Column, languages: Sequence[str] = tuple(STOP_WORDS)) -> tuple[Column, Column]:
    """The best language of a map of shares (ties: first in the list; null below the floor) and its share."""
    shares = F.col(shares) if isinstance(shares, str) else shares
    best = F.greatest(*[shares[g] for g in languages]) if len(languages) > 1 else shares[languages[0]]
    named = F.coalesce(*[F.when(shares[g] == best, g) for g in languages])
    return F.when(best >= VOTE_FLOOR, named), best


def contradicts(shares: str | Column, declared: Column, languages: Sequence[str] = tuple(STOP_WORDS)) -> Column:
    """Whether the vote contradicts all ``declared`` languages (an array): none of them is the best one or comes near it.

    Without a declared language, or one that has a stop-word list, nothing is contradicted.
    """
    shares = F.col(shares) if isinstance(shares, str) else shares
    best, share = language_vote(shares, languages)
    short = F.transform(declared, lambda x: F.substring(x, 1, 2))
    listed = F.array_intersect(short, F.array(*map(F.lit, languages)))
    own = F.array_max(F.transform(listed, lambda x: shares[x]))
    return F.coalesce(best.isNotNull() & (F.size(listed) > 0) & ~F.array_contains(short, best) & (own < F.lit(CONTRADICTION) * share), F.lit(False))


def approximate_tokens(n_words: Column, backend: str = "transformers") -> Column:
    """Model tokens from words where the tokenizer's files are missing; half to even."""
    return F.bround(n_words * F.lit(TOKENS_PER_WORD.get(backend, OTHER_TOKENS_PER_WORD)), 0).cast("int")


def padded(tokens: str | Column) -> Column:
    """Tokens by single spaces, one at each end: what ``prmu`` searches, built once for a document."""
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``value``, evaluated once, as ``name``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def prmu_sql(alternatives: str, pad: str) -> str:
    """SQL: ``struct<class, end_word>`` of a phrase's alternatives (arrays of stems) in a document's ``padded`` stems.

    P: one occurs contiguously (the earliest end counts; sentinels block); R: all of one's stems occur; M: some; U:
    none. The best class over the alternatives stands; empty alternatives are passed over.
    """
    words = f"array_distinct(filter(v, w -> w <> '{SENTINEL}'))"
    head = "length(head) - length(replace(head, ' ', '')) - 1" + f" - (length(head) - length(replace(head, '{SENTINEL}', '')))"
    end = _let("nd", "concat(' ', array_join(v, ' '), ' ')", _let("p", f"instr({pad}, nd)", f"CASE WHEN p > 0 THEN {_let('head', f'substr({pad}, 1, p + length(nd) - 2)', head)} ELSE -1 END"))
    each = f"transform(filter({alternatives}, v -> size(v) > 0), v -> named_struct('end', {end}, 'all', size({words}), 'found', size(filter({words}, w -> instr({pad}, concat(' ', w, ' ')) > 0))))"
    return _let(
        "e", each,
        "CASE WHEN exists(e, x -> x.end >= 0) THEN named_struct('class', 'P', 'end_word', array_min(filter(transform(e, x -> x.end), n -> n >= 0))) "
        "WHEN exists(e, x -> x.found = x.all) THEN named_struct('class', 'R', 'end_word', -1) "
        "WHEN exists(e, x -> x.found > 0) THEN named_struct('class', 'M', 'end_word', -1) ELSE named_struct('class', 'U', 'end_word', -1) END",
    )


def prmu(alternatives: str, pad: str) -> Column:
    return F.expr(prmu_sql(alternatives, pad))


def present_spans(normal: str, phrases: Sequence[Sequence[str]]) -> list[tuple[int, int]]:
    """Character spans of all contiguous occurrences of token sequences, merged where they touch or overlap."""
    spans = token_spans(normal)
    own = [w for w, _ in spans]
    found = sorted(
        (spans[i][1] - len(own[i]), spans[i + len(p) - 1][1])
        for p in phrases if p for i in range(len(own) - len(p) + 1) if own[i : i + len(p)] == list(p)
    )
    merged: list[tuple[int, int]] = []
    for a, b in found:
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged
