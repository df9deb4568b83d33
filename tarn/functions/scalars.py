"""Scalar clean-up rules shared by the clean models."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The mark an empty target starts from, and the balance tiers.
EPOCH_MARK = dt.datetime(1900, 1, 1)
HIGH_BALANCE = 1000
MID_BALANCE = 100


def normalize_email(col: Column | str, all_whitespace: bool = False) -> Column:
    """Lower-case and strip blanks; ``all_whitespace`` also strips tabs and newlines."""
    col = F.col(col) if isinstance(col, str) else col
    stripped = F.regexp_replace(col, r"^\s+|\s+$", "") if all_whitespace else F.trim(col)
    return F.lower(stripped)


def email_domain(col: Column | str) -> Column:
    """Part after the first ``@`` ('' when there is none)."""
    return F.split_part(normalize_email(col), F.lit("@"), F.lit(2))


def tier_of(col: Column | str) -> Column:
    """high / mid / low by balance; a NULL balance is low."""
    col = F.col(col) if isinstance(col, str) else col
    return (
        F.when(col >= HIGH_BALANCE, "high").when(col >= MID_BALANCE, "mid").otherwise("low")
    )


def to_utc(col: Column | str) -> Column:
    """Zone-less timestamp read as UTC (the session zone is UTC)."""
    col = F.col(col) if isinstance(col, str) else col
    return col.cast("timestamp")


def age_in_days(col: Column | str, as_of: dt.date | str) -> Column:
    """Calendar-day boundaries between ``col`` and ``as_of``."""
    return F.datediff(F.lit(str(as_of)).cast("date"), col).cast("bigint")


def round_money(col: Column | str, digits: int = 2) -> Column:
    """Round half up on the decimal value, not on its binary approximation."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col.cast("decimal(28,8)"), digits).cast("double")


def bucket_of(col: Column | str, buckets: int, hashed: bool = False) -> Column:
    """Bucket number 0..buckets-1, from the value itself or from its hash."""
    col = F.col(col) if isinstance(col, str) else col
    return F.pmod(F.xxhash64(col) if hashed else col.cast("bigint"), F.lit(buckets))


def add_days(timestamp: Column | str, days: Column | str) -> Column:
    """Timestamp plus a whole number of days taken from a column."""
    return F.timestamp_add("DAY", days, timestamp)


def path_basename(col: Column | str) -> Column:
    """Last component of a path."""
    return F.regexp_extract(col, r"([^/]+)$", 1)


def watermark_or(col: Column | str, default: dt.datetime = EPOCH_MARK) -> Column:
    """Aggregate: highest cursor value, or ``default`` over an empty table."""
    return F.coalesce(F.max(col), F.lit(default.isoformat(sep=" ")).cast("timestamp_ntz"))


def beyond(df: DataFrame, cursor: str, mark: object) -> Column:
    """``cursor > mark``, with the mark in the cursor's own type so the scan can use it."""
    if isinstance(mark, (dt.datetime, dt.date)):
        literal = F.lit(mark.isoformat(sep=" ") if isinstance(mark, dt.datetime) else str(mark))
        return F.col(cursor) > literal.cast(df.schema[cursor].dataType)
    return F.col(cursor) > F.lit(mark)
