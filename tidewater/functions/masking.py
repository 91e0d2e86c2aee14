"""Masking of personal data: known terms and patterns, with counts and a leak check.

Passes run in the order e-mail, phone, name; within a pass known terms come
first, the longest that fits, then the pattern.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels and patterns of the masking policy.
LABELS = {"email": "[EMAIL]", "phone": "[PHONE]", "name": "[CUSTOMER_NAME]"}
PATTERNS = {"email": r"[\w\.\-\+]+@[\w\-]+\.\w{2,}", "phone": r"\+?\d{1,3}[-\s]?\(?\d{2,4}\)?[-\s]?\d{3,4}[-\s]?\d{3,4}"}


def in_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def folded(text: str) -> tuple[str, list[int] | None]:
    """A text case-folded, and the sign of the text that each folded character is of; None where they are one to one."""
    whole = text.casefold()
    if len(whole) == len(text):
        return whole, None
    signs = [c.casefold() for c in text]
    return "".join(signs), [i for i, s in enumerate(signs) for _ in s]


class Terms:
    """Known terms as a tree of case-folded characters, so that a text is read once however many terms there are."""

    def __init__(self, terms: list[str]) -> None:
        self.root: dict = {}
        for term in terms:
            if term.strip():
                node = self.root
                for c in term.casefold():
                    node = node.setdefault(c, {})
                node[""] = True

    def replaced(self, text: str, label: str) -> tuple[str, int]:
        """``text`` with the longest term at each place that isn't inside a word replaced, whatever its case; how many were."""
        low, sign = folded(text)
        at = (lambda i: sign[i] if i < len(low) else len(text)) if sign else (lambda i: i)
        out, done, i, n = [], 0, 0, 0
        while i < len(low):
            node, end = self.root.get(low[i]), -1
            begin = at(i)
            # a term begins and ends with whole signs of the text
            if node is not None and (begin == 0 or not in_word(text[begin - 1])) and (i == 0 or at(i - 1) != begin):
                j = i + 1
                while node is not None:
                    if "" in node and at(j) != at(j - 1) and (at(j) == len(text) or not in_word(text[at(j)])):
                        end = j
                    node = node.get(low[j]) if j < len(low) else None
                    j += 1
            if end < 0:
                i += 1
                continue
            out += [text[done:begin], label]
            done, i = at(end), end
            n += 1
        return "".join([*out, text[done:]]), n


def mask_patterns(text: Column) -> Column:
    """E-mail addresses and phone numbers masked by their patterns alone, without Python."""
    for kind in ("email", "phone"):
        text = F.regexp_replace(text, PATTERNS[kind], LABELS[kind])
    return text


class Masker:
    """A policy of known terms by kind (email, phone, name), compiled once for each Python process."""

    def __init__(self, terms: dict[str, list[str]]) -> None:
        self.known = {kind: Terms(terms.get(kind, [])) for kind in LABELS}
        self.shapes = {kind: re.compile(shape, re.IGNORECASE) for kind, shape in PATTERNS.items()}
        self.terms = sorted({t.casefold() for ts in terms.values() for t in ts if t.strip()})

    def mask(self, text: str | None) -> tuple[str | None, dict[str, int]]:
        """The masked text and how often each kind was masked."""
        counts = dict.fromkeys(LABELS, 0)
        for kind, label in LABELS.items() if text else ():
            text, counts[kind] = self.known[kind].replaced(text, label)
            if kind in self.shapes:
                text, found = self.shapes[kind].subn(label, text)
                counts[kind] += found
        return text, counts

    def leaks(self, text: str | None) -> list[str]:
        low = (text or "").casefold()
        return [t for t in self.terms if t in low]

    def apply(self, df: DataFrame, text_col: str) -> DataFrame:
        """``df`` with ``masked``, a count for each kind and ``leaked`` terms."""

        @F.pandas_udf("masked string, email int, phone int, name int, leaked array<string>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                rows = [self.mask(t) for t in texts]
                yield pd.DataFrame([{"masked": m, **c, "leaked": self.leaks(m)} for m, c in rows], columns=["masked", "email", "phone", "name", "leaked"])

        return df.withColumn("_m", run(F.col(text_col))).select(*df.columns, "_m.*")


def require_no_leaks(df: DataFrame) -> DataFrame:
    """The gate before indexing: raises if any known term is left."""
    bad = df.where(F.size("leaked") > 0).limit(1).count()
    if bad:
        raise ValueError("known personal terms remain after masking")
    return df
