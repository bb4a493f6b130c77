"""Index terms of the full-text index: folded to lower case without diacritics, suffixes stripped by Porter's algorithm."""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The suffix tables of Porter (1980), steps 2 to 4.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
LONGEST = 20


def _shape(stem: str) -> str:
    """v and c for vowels and consonants; y is a vowel after a consonant."""
    out = ""
    for ch in stem:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _short(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _replaced(word: str, table, least: int) -> str:
    """The longest suffix of the table decides, whether or not what precedes it is long enough."""
    suffix = max((s for s in table if word.endswith(s)), key=len, default=None)
    if suffix is None:
        return word
    stem = word[: -len(suffix)]
    if _measure(stem) <= least or (suffix == "ion" and stem[-1:] not in ("s", "t")):
        return word
    return stem + (table[suffix] if isinstance(table, dict) else "")


@functools.lru_cache(maxsize=200_000)
def porter(word: str) -> str:
    """The stem of a lower-case word; words of other letters, of one or two letters or over LONGEST bytes stay."""
    if not 2 < len(word) <= LONGEST or not (word.isascii() and word.isalpha()):
        return word
    w = word
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((w[: -len(s)] for s in ("ed", "ing") if w.endswith(s) and "v" in _shape(w[: -len(s)])), None)
        if cut is not None:
            double = len(cut) > 1 and cut[-1] == cut[-2] and _shape(cut)[-1] == "c" and cut[-1] not in "lsz"
            w = cut + "e" if cut.endswith(("at", "bl", "iz")) or (_measure(cut) == 1 and _short(cut)) else cut[:-1] if double else cut
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table, least in ((STEP_2, 0), (STEP_3, 0), (STEP_4, 1)):
        w = _replaced(w, table, least)
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


@functools.lru_cache(maxsize=200_000)
def index_term(token: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFD", token.lower()) if not unicodedata.combining(c))
    return porter(plain)


def index_terms(tokens: Column) -> Column:
    """Terms of an array of tokens, in order. Workers remember what they have stemmed, so distinct words cost."""

    @F.pandas_udf("array<string>")
    def stems(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda a: None if a is None else [None if t is None else index_term(t) for t in a])

    return stems(tokens)
