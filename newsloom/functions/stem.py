"""Stemmers as Arrow functions: Porter's for English (Porter 1980) and a Danish one after the published Snowball definition."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _vowel(w: str, i: int) -> bool:
    return w[i] in "aeiou" or (w[i] == "y" and i > 0 and not _vowel(w, i - 1))


def _measure(stem: str) -> int:
    kinds = [_vowel(stem, i) for i in range(len(stem))]
    return sum(a and not b for a, b in zip(kinds, kinds[1:], strict=False))


def _has_vowel(stem: str) -> bool:
    return any(_vowel(stem, i) for i in range(len(stem)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and not _vowel(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and not _vowel(w, n - 3) and _vowel(w, n - 2) and not _vowel(w, n - 1) and w[-1] not in "wxy"


# The suffix tables of the algorithm's steps 2, 3 and 4.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate",
    "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _replace(w: str, table: dict[str, str]) -> str:
    for s in sorted((s for s in table if w.endswith(s)), key=len, reverse=True)[:1]:
        if _measure(w[: -len(s)]) > 0:
            return w[: -len(s)] + table[s]
    return w


def porter(w: str) -> str:
    if len(w) <= 2:
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for s in ("ed", "ing"):
            if w.endswith(s) and _has_vowel(w[: -len(s)]):
                w = w[: -len(s)]
                if w.endswith(("at", "bl", "iz")) or (_measure(w) == 1 and _cvc(w)):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(_replace(w, STEP2), STEP3)
    for s in sorted((s for s in STEP4 if w.endswith(s)), key=len, reverse=True)[:1]:
        stem = w[: -len(s)]
        if _measure(stem) > 1 and (s != "ion" or stem[-1:] in ("s", "t")):
            w = stem
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    return w[:-1] if _measure(w) > 1 and w.endswith("ll") else w


# The suffixes and s-endings of the published Danish definition.
DANISH = "hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret".split()
S_ENDING = set("abcdfghjklmnoprtvyzå")


def _region(w: str, vowels: str) -> int:
    for i in range(1, len(w)):
        if w[i] not in vowels and w[i - 1] in vowels:
            return max(3, i + 1)
    return len(w)


def danish(w: str) -> str:
    r1 = _region(w, "aeiouyæøå")

    def undouble(x: str) -> str:
        return x[:-1] if len(x) - 2 >= r1 and x.endswith(("gd", "dt", "gt", "kt")) else x

    fit = max((s for s in DANISH if w.endswith(s) and len(w) - len(s) >= r1), key=len, default="")
    if fit:
        w = w[: -len(fit)]
    elif len(w) - 1 >= r1 and w.endswith("s") and w[-2:-1] in S_ENDING:
        w = w[:-1]
    w = undouble(w)
    if w.endswith("igst"):
        w = w[:-2]
    fit = max((s for s in ("ig", "lig", "elig", "els", "løst") if w.endswith(s) and len(w) - len(s) >= r1), key=len, default="")
    if fit == "løst":
        w = w[:-1]
    elif fit:
        w = undouble(w[: -len(fit)])
    if len(w) - 1 >= r1 and len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeiouyæøå":
        w = w[:-1]
    return w


STEMMERS = {"en": porter, "da": danish}


def stemmed(words: Column, language: str) -> Column:
    """The stems of an array of lower-case words; each distinct word of a batch is stemmed once."""
    stem = STEMMERS[language]

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        known: dict[str, str] = {}
        return lists.map(lambda ws: None if ws is None else [known[w] if w in known else known.setdefault(w, stem(w)) for w in ws])

    return run(words)
