"""English stemmer after the published Porter2 (Snowball "english") description; other languages stay as they are.

``stemmed`` applies it to arrays of tokens and remembers words.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: Fixed values of the published algorithm.
WHOLE = {
    "skis": "ski", "skies": "sky", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes", "dying": "die", "lying": "lie", "tying": "tie",
}
AFTER_1A = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP_2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al",
    "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")

_R = re.compile(f"[{VOWELS}][^{VOWELS}]")


def _regions(w: str) -> tuple[int, int]:
    """Where R1 and R2 begin."""
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    if r1 is None:
        m = _R.search(w)
        r1 = m.end() if m else len(w)
    m = _R.search(w, r1)
    return r1, m.end() if m else len(w)


def _short_end(w: str) -> bool:
    """Whether a word ends in a short syllable."""
    if len(w) == 2:
        return w[0] in VOWELS and w[1] not in VOWELS
    return len(w) > 2 and w[-3] not in VOWELS and w[-2] in VOWELS and w[-1] not in VOWELS + "wxY"


def stem(word: str) -> str:
    """The stem of a lower-case English word."""
    if len(word) <= 2:
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = word.replace("’", "'").lstrip("'")
    w = re.sub(rf"^y|(?<=[{VOWELS}])y", "Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{VOWELS}]", w[:-2]):
        w = w[:-1]
    if w in AFTER_1A:
        return w
    w = _step_1b(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    w = _replace(w, r1, STEP_2, {"ogi": ("l", "og"), "li": ("cdeghkmnrt", "")})
    w = _replace(w, r1, STEP_3, {})
    if w.endswith("ative") and len(w) - 5 >= r2:
        w = w[:-5]
    for s in (*STEP_4, "ion"):
        if w.endswith(s) and not any(w.endswith(o) and len(o) > len(s) for o in STEP_4):
            if len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(s)]
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def _step_1b(w: str, r1: int) -> str:
    for s in ("eedly", "eed"):
        if w.endswith(s):
            return w[: -len(s)] + "ee" if len(w) - len(s) >= r1 else w
    for s in ("ingly", "edly", "ing", "ed"):
        if w.endswith(s):
            head = w[: -len(s)]
            if not re.search(f"[{VOWELS}]", head):
                return w
            if head.endswith(("at", "bl", "iz")):
                return head + "e"
            if head.endswith(DOUBLES):
                return head[:-1]
            return head + "e" if len(head) <= r1 and _short_end(head) else head
    return w


def _replace(w: str, r1: int, table: dict[str, str], guarded: dict[str, tuple[str, str]]) -> str:
    """The longest suffix of the table, if it lies in R1; guarded suffixes need one of the letters before them."""
    found = max((s for s in (*table, *guarded) if w.endswith(s)), key=len, default="")
    if not found or len(w) - len(found) < r1:
        return w
    if found in guarded:
        before, new = guarded[found]
        return w[: -len(found)] + new if w[-len(found) - 1 : -len(found)] in tuple(before) else w
    return w[: -len(found)] + table[found]


@lru_cache(maxsize=200_000)
def _known(word: str) -> str:
    return stem(word)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stems(tokens: pd.Series, langs: pd.Series) -> pd.Series:
    return pd.Series([None if ws is None else list(map(_known, ws)) if (g or "en")[:2] == "en" else list(ws) for ws, g in zip(tokens, langs, strict=True)])


def stemmed(tokens: str | Column, lang: str | Column) -> Column:
    """The stems of an array of tokens, in order; languages without a stemmer keep their words, null counts as English.

    Each worker remembers the words it has met, so that nothing is shuffled and no frequent word is a hot key.
    """
    return _stems(F.col(tokens) if isinstance(tokens, str) else tokens, F.col(lang) if isinstance(lang, str) else lang)


def has_stemmer(lang: str | Column) -> Column:
    """Whether rows of a language are stemmed, for flags beside results that other languages would change."""
    lang = F.col(lang) if isinstance(lang, str) else lang
    return F.substring(F.coalesce(lang, F.lit("en")), 1, 2) == "en"
