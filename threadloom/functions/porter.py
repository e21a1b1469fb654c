"""Porter's stemmer, from the published algorithm."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _shape(w: str) -> str:
    """c or v for each letter: y is a vowel after a consonant."""
    out, last = [], "v"
    for c in w:
        last = "v" if c in "aeiou" or c == "y" and out and last == "c" else "c"
        out.append(last)
    return "".join(out)


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _cvc(w: str) -> bool:
    return len(w) > 2 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


# The suffix tables of steps 2, 3 and 4.
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _swap(w: str, table: list[tuple[str, str]]) -> str:
    for suffix, to in sorted(table, key=lambda x: -len(x[0])):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            return stem + to if _measure(stem) > 0 else w
    return w


def stem(w: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    again = False
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and _vowel(w[:-2]):
        w, again = w[:-2], True
    elif w.endswith("ing") and _vowel(w[:-3]):
        w, again = w[:-3], True
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, STEP2), STEP3)
    for suffix in sorted(STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            s = w[: -len(suffix)]
            if _measure(s) > 1 and (suffix != "ion" or s.endswith(("s", "t"))):
                w = s
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _cvc(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def stems(word: Column) -> Column:
    """string: stems of a column of words."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield p.map(stem, na_action="ignore")

    return F.pandas_udf(run, "string")(word)
