"""Column helpers: normalising, safe casts, hashes, keys, ratios, calendar, vectors."""

from __future__ import annotations

import base64
import re
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for NULL in a record hash: no text of a source can hold it by chance.
NULL_MARK = r"\x1FNULL"


def normalise(c: Column) -> Column:
    """Text without outer spaces; empty becomes null."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


# Spark reads '2026' as a date and '12:30' as today; the captured feeds must not.
_GUARDS = {"date": r"^\d{4}-\d{1,2}-\d{1,2}$", "timestamp": r"^\d{4}-\d{1,2}-\d{1,2}([ T].*)?$"}


def safe_cast(c: Column, kind: str) -> Column:
    """The normalised value as ``kind``, or null if it is none. Integers must be written as such ('3.7' and '1e2' are null)."""
    text = normalise(c)
    guard = _GUARDS.get(kind.partition("(")[0])
    return F.when(text.rlike(guard), text.try_cast(kind)) if guard else text.try_cast(kind)


def record_hash(*cols: Column) -> Column:
    """SHA-256 of the columns as text: field borders and the place of nulls count."""
    return F.sha2(F.concat_ws(chr(31), *[F.coalesce(c.cast("string"), F.lit(NULL_MARK)) for c in cols]), 256)


def surrogate_key(*cols: Column) -> Column:
    """MD5 of the columns as text, joined by a pipe, nulls spelt out."""
    return F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("<null>")) for c in cols]))


def percent(num: Column, den: Column, digits: int = 2) -> Column:
    """100 * num / den, rounded; null, never 0, where the denominator is 0 or null."""
    return F.when(den > 0, F.round(F.lit(100.0) * num.cast("double") / den.cast("double"), digits))


def ratio(num: Column, den: Column, digits: int = 2) -> Column:
    return F.when(den > 0, F.round(num.cast("double") / den.cast("double"), digits))


def money(c: Column) -> Column:
    """Exact cents, so that a sum doesn't depend on its order."""
    return c.cast("decimal(18,2)")


def hours_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(3.6e9)


def months_since(first: Column, later: Column) -> Column:
    """Whole months between two month starts."""
    return F.months_between(later, first).cast("bigint")


def date_key(d: Column) -> Column:
    return F.date_format(d, "yyyyMMdd").cast("bigint")


def next_id(ids: Column, prefix: str = "T", width: int = 6) -> Column:
    """Aggregate: the id after the largest of ``ids`` (prefix and zero-padded number)."""
    return F.concat(F.lit(prefix), F.lpad((F.max(F.substring(ids, len(prefix) + 1, 18).cast("bigint")) + 1).cast("string"), width, "0"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays of numbers, in doubles."""
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def identifiers(text: Column, letter: str, digits: int) -> Column:
    """All ids of a letter and so many digits in a text."""
    return F.regexp_extract_all(text, F.lit(rf"\b({re.escape(letter)}\d{{{digits}}})\b"), 1)


def cursor(ts: Column, key: Column) -> Column:
    """An opaque page cursor."""
    return F.base64(F.concat_ws("|", ts.cast("string"), key.cast("string")).cast("binary"))


def position_of(page_cursor: str) -> tuple[str, str]:
    """The (time, key) that ``cursor`` made a cursor of; anything else is refused."""
    try:
        ts, bar, key = base64.b64decode("".join(page_cursor.split()), validate=True).decode().partition("|")
        datetime.fromisoformat(ts)
    except ValueError as e:
        raise ValueError("malformed cursor: pass back one that a page gave") from e
    if not bar:
        raise ValueError("malformed cursor: pass back one that a page gave")
    return ts, key


def iso_millis(text: Column) -> Column:
    """Milliseconds since 1970 of an ISO-8601 time, with or without a zone (then the session's); null for anything else."""
    return F.unix_millis(F.try_to_timestamp(text))
