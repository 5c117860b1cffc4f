"""The Porter stemmer, as a function on ASCII lower-case words and on columns of word lists.

Fixed values: the suffix lists are those of Porter, "An algorithm for suffix
stripping" (Program 14, 1980), with the two departures of his own later code
(``bli`` to ``ble`` and ``logi`` to ``log``), which full-text indexes use.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """``c`` or ``v`` for each letter; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or ch == "y" and out[-1:] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c", _shape(stem)))


def _short_end(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _swap(word: str, table: dict[str, str]) -> str:
    for n in range(min(7, len(word)), 2, -1):  # the longest suffix that is listed decides
        if (new := table.get(word[-n:])) is not None:
            return word[:-n] + new if _measure(word[:-n]) > 0 else word
    return word


@lru_cache(1 << 17)
def stem(word: str) -> str:
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    w = word
    if len(w) > 4 and w.endswith("sses") or len(w) > 3 and w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if len(w) > 3 and w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((w[: -len(x)] for x in ("ed", "ing") if w.endswith(x)), None)
        if cut is not None and "v" in _shape(cut):
            w = cut
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short_end(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, STEP2), STEP3)
    end = max((x for x in STEP4 if w.endswith(x)), key=len, default="")
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _short_end(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def stems(terms: Column) -> Column:
    """The stems of a list of terms, in its order."""

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda words: None if words is None else [stem(w) for w in words])

    return run(terms)
