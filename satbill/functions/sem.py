"""Rules decided once for the whole library: blanks, NULL keys, time arguments."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
BYTES = "decimal(18,2)"
KB = "decimal(20,5)"


def c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def blank_null(col: Column | str) -> Column:
    """Trimmed text, blanks as NULL (the source database cannot hold an empty string)."""
    return F.nullif(F.trim(c(col)), F.lit(""))


def money(col: Column | str) -> Column:
    return c(col).cast(MONEY)


def nz(col: Column | str) -> Column:
    return F.coalesce(c(col), F.lit(0))


def sum_when(cond: Column, value: Column | str) -> Column:
    """Sum of ``value`` over the rows that meet ``cond``, zero elsewhere."""
    return F.sum(F.when(cond, c(value)).otherwise(F.lit(0)))


def spread_nulls(key: Column | str, *by: Column | str) -> Column:
    """Join key in which NULLs are spread over the shuffle instead of meeting in one task.

    The stand-in starts with a NUL character, so it never equals a real key and the row
    stays unmatched, as a NULL key must.
    """
    return F.coalesce(c(key), F.concat(F.lit("\x00"), F.xxhash64(*[c(b) for b in by]).cast("string")))


def moment(as_of: dt.date | dt.datetime | str) -> Column:
    """The explicit stand-in for the source system's wall clock."""
    if isinstance(as_of, (dt.date, dt.datetime)):
        as_of = as_of.isoformat(sep=" ") if isinstance(as_of, dt.datetime) else as_of.isoformat()
    return F.lit(as_of).cast("timestamp")


def as_datetime(as_of: dt.date | dt.datetime | str) -> dt.datetime:
    if isinstance(as_of, dt.datetime):
        return as_of
    if isinstance(as_of, dt.date):
        return dt.datetime(as_of.year, as_of.month, as_of.day)
    return dt.datetime.fromisoformat(as_of)


def month_index(when: dt.date) -> int:
    return when.year * 12 + when.month - 1


def month_key(index: int, dash: bool = False) -> str:
    return f"{index // 12:04d}{'-' if dash else ''}{index % 12 + 1:02d}"


def add_months(when: dt.datetime, k: int) -> dt.datetime:
    """Same day k months on, held to the month's last day."""
    idx = month_index(when) + k
    year, month = idx // 12, idx % 12 + 1
    last = (dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(days=1)).day
    return when.replace(year=year, month=month, day=min(when.day, last))
