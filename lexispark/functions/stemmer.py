"""The Porter stemmer of 1980, and its use on a vocabulary.

Words are stemmed once each: `stem_terms` works on the distinct terms and joins them back, so the Python part grows with
the vocabulary and not with the text.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.functions.text import may_stem
from lexispark.session import ready

# The suffix rules of the published algorithm, in its order.
STEP2 = (
    ("ational", "ate"),
    ("tional", "tion"),
    ("enci", "ence"),
    ("anci", "ance"),
    ("izer", "ize"),
    ("abli", "able"),
    ("alli", "al"),
    ("entli", "ent"),
    ("eli", "e"),
    ("ousli", "ous"),
    ("ization", "ize"),
    ("ation", "ate"),
    ("ator", "ate"),
    ("alism", "al"),
    ("iveness", "ive"),
    ("fulness", "ful"),
    ("ousness", "ous"),
    ("aliti", "al"),
    ("iviti", "ive"),
    ("biliti", "ble"),
)
STEP3 = (
    ("icate", "ic"),
    ("ative", ""),
    ("alize", "al"),
    ("iciti", "ic"),
    ("ical", "ic"),
    ("ful", ""),
    ("ness", ""),
)
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_LETTERS = re.compile("[A-Za-z]{3,}")
_RUNS = re.compile("V+C")


def _shape(word: str) -> str:
    """The word in C and V: y is a vowel after a consonant."""
    out: list[str] = []
    for ch in word:
        out.append("V" if ch in "aeiou" or (ch == "y" and out and out[-1] == "C") else "C")
    return "".join(out)


def _measure(stem: str) -> int:
    return len(_RUNS.findall(_shape(stem)))


def _ends_double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "C"


def _ends_cvc(word: str) -> bool:
    return len(word) > 2 and _shape(word)[-3:] == "CVC" and word[-1] not in "wxy"


def _first_rule(word: str, rules: tuple[tuple[str, str], ...], least: int) -> str:
    """The first suffix that matches decides, even if its stem is too short to be changed."""
    for suffix, to in rules:
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return stem + to if _measure(stem) > least else word
    return word


def _plural(w: str) -> str:
    if w.endswith("sses") or w.endswith("ies"):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    for suffix in ("ed", "ing"):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if "V" not in _shape(stem):
                return w
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _ends_double(stem) and stem[-1] not in "lsz":
                return stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _ends_cvc(stem) else stem
    return w


def _derived(w: str) -> str:
    for suffix in STEP4:
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            ok = _measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t"))
            return stem if ok else w
    return w


def _final(w: str) -> str:
    if w.endswith("e"):
        stem = w[:-1]
        m = _measure(stem)
        if m > 1 or (m == 1 and not _ends_cvc(stem)):
            w = stem
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """Words of two letters, and those with anything but ASCII letters, stay as they are."""
    if not _LETTERS.fullmatch(word):
        return word
    w = _past(_plural(word.lower()))
    if w.endswith("y") and "V" in _shape(w[:-1]):
        w = w[:-1] + "i"
    return _final(_derived(_first_rule(_first_rule(w, STEP2, 0), STEP3, 0)))


def stem_column(spark):
    """An Arrow UDF over terms."""
    ready(spark)

    @F.pandas_udf("string")
    def stems(terms: pd.Series) -> pd.Series:
        return terms.map(stem)

    return stems


def stem_terms(df: DataFrame, term: str = "term") -> DataFrame:
    """`df` with `term` replaced by its stem."""
    stems = stem_column(df.sparkSession)
    vocabulary = df.select(term).distinct().where(may_stem(F.col(term)))
    pairs = vocabulary.select(F.col(term), stems(term).alias("_stem"))
    return df.join(pairs, term, "left").withColumn(term, F.coalesce("_stem", F.col(term))).drop("_stem")
