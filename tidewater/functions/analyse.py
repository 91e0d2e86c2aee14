"""English text analysis: tokens, stop words, Porter stems, sentences, chunks.

The stemmer is M. F. Porter's published algorithm (1980); the reference's engine
stems by a later revision, so single stems may differ.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words.
STOP_WORDS = (
    "a about above after again all am an and any are as at be because been before being below between both but by can did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with you your"
).split()


def _cons(w: str, i: int) -> bool:
    return w[i] not in "aeiou" and not (w[i] == "y" and i > 0 and _cons(w, i - 1))


def _measure(w: str) -> int:
    kinds = [_cons(w, i) for i in range(len(w))]
    return sum(not a and b for a, b in zip(kinds, kinds[1:]))


def _vowel(w: str) -> bool:
    return any(not _cons(w, i) for i in range(len(w)))


def _cvc(w: str) -> bool:
    return len(w) > 2 and _cons(w, len(w) - 1) and not _cons(w, len(w) - 2) and _cons(w, len(w) - 3) and w[-1] not in "wxy"


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _cons(w, len(w) - 1)


# The suffix tables of the published algorithm.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


@lru_cache(100_000)
def stem(w: str) -> str:
    """The Porter stem of a lower-case word."""
    if len(w) <= 2 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end in sorted(table, key=len, reverse=True):
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + table[end]
                break
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            rest = w[: -len(end)]
            if _measure(rest) > 1 and (end != "ion" or rest.endswith(("s", "t"))):
                w = rest
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def stems(words: Column) -> Column:
    """Stems of arrays of lower-case words."""

    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda ws: None if ws is None else [stem(w) for w in ws])

    run.__annotations__ = {"rows": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<string>")(words)


def tokens(text: Column) -> Column:
    """Lower-case words without stop words; mask labels like [EMAIL] are no words."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"\[[A-Z_]+\]", " ")
    return F.filter(F.split(F.lower(plain), r"[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(STOP_WORDS))


def lexemes(text: Column, stemmed: bool = True) -> Column:
    """``tokens``, stemmed by Porter's algorithm if asked for."""
    return stems(tokens(text)) if stemmed else tokens(text)


def sentences(text: Column) -> Column:
    """Parts after each . ! or ? that white space follows."""
    return F.split(text, r"(?<=[.!?])\s+")


def chunks(text: Column, size: int = 220, overlap: int = 40) -> Column:
    """Windows of ``size`` words that share ``overlap``, as structs (ordinal, content); a text of ``size`` words or fewer stays as it is."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the window")
    step = size - overlap
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    last = F.ceil(F.greatest(F.size(words) - size, F.lit(0)) / step).cast("int")
    window = lambda i: F.struct(i.cast("bigint").alias("ordinal"), F.array_join(F.slice(words, i * step + 1, size), " ").alias("content"))
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("ordinal"), text.alias("content")))
    return F.when(F.size(words) <= size, whole).otherwise(F.transform(F.sequence(F.lit(0), last), window))
