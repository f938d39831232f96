"""English stemmer after the published description of the second Porter algorithm, as one Arrow call a batch."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Fixed values of the published algorithm.
_VOWEL = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI = "cdeghkmnrt"
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
    "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful",
    "lessli": "less",
}
_STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()

_REGION = re.compile(r"[aeiouy][^aeiouy]")
_SHORT_END = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_HAS_VOWEL = re.compile(r"[aeiouy]")


def _regions(word: str) -> tuple[int, int]:
    first = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    if first is None:
        found = _REGION.search(word)
        first = found.end() if found else len(word)
    found = _REGION.search(word, first)
    return first, found.end() if found else len(word)


def _longest(word: str, endings) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """Stem of one lower-case token; tokens of two characters or less stay as they are."""
    if len(word) <= 2:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    word = word.removeprefix("'")
    word = re.sub(r"(^|(?<=[aeiouy]))y", "Y", word)
    r1, r2 = _regions(word)

    word = word[: len(word) - len(_longest(word, ("'", "'s", "'s'")))]
    ending = _longest(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if ending == "sses":
        word = word[:-2]
    elif ending in ("ied", "ies"):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif ending == "s" and _HAS_VOWEL.search(word[:-2]):
        word = word[:-1]
    if word in _AFTER_1A:
        return word

    ending = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if ending in ("eed", "eedly"):
        if len(word) - len(ending) >= r1:
            word = word[: -len(ending)] + "ee"
    elif ending and _HAS_VOWEL.search(word[: -len(ending)]):
        word = word[: -len(ending)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(_DOUBLE):
            word = word[:-1]
        elif r1 >= len(word) and _SHORT_END.search(word):
            word += "e"

    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWEL:
        word = word[:-1] + "i"

    ending = _longest(word, (*_STEP_2, "ogi", "li"))
    if ending and len(word) - len(ending) >= r1:
        base = word[: -len(ending)]
        if ending == "ogi":
            word = word[:-1] if base.endswith("l") else word
        elif ending == "li":
            word = base if base[-1:] in tuple(_LI) else word
        else:
            word = base + _STEP_2[ending]

    ending = _longest(word, (*_STEP_3, "ative"))
    if ending and len(word) - len(ending) >= r1:
        if ending == "ative":
            word = word[:-5] if len(word) - 5 >= r2 else word
        else:
            word = word[: -len(ending)] + _STEP_3[ending]

    ending = _longest(word, (*_STEP_4, "ion"))
    if ending and len(word) - len(ending) >= r2 and (ending != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(ending)]

    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _SHORT_END.search(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


@F.pandas_udf(ArrayType(StringType()))
def _stem_arrays(lists: pd.Series) -> pd.Series:
    return lists.map(lambda words: None if words is None else [stem(w) for w in words])


def stem_tokens(words: Column) -> Column:
    """Stem every token of an array column. Null stays null."""
    return _stem_arrays(words)
