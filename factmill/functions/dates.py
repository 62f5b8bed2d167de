"""Year and month expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def month_start(year: Column, month: Column) -> Column:
    """First day of the month; null for a null or impossible part."""
    one, zero = F.lit(1), F.lit(0)
    stamp = F.try_make_timestamp_ntz(
        year.try_cast("int"), month.try_cast("int"), one, zero, zero, F.lit(0).cast("decimal(8,6)")
    )
    return stamp.cast("date")


def month_key(year: Column, month: Column) -> Column:
    """``YYYY-MM`` text; null if either part is null."""
    return F.concat(
        year.cast("string"), F.lit("-"), F.lpad(month.cast("string"), 2, "0")
    )


def month_sin(month: Column) -> Column:
    return F.sin(F.lit(2 * math.pi) * month / F.lit(12.0))


def month_cos(month: Column) -> Column:
    return F.cos(F.lit(2 * math.pi) * month / F.lit(12.0))


def iso_day(stamp: Column) -> Column:
    """The part of an ISO stamp before the ``T``."""
    return F.substring_index(stamp, "T", 1)


def span_label(low: Column, high: Column) -> Column:
    """``2008-2016``, or one value where both ends are equal."""
    return F.when(low == high, low.cast("string")).otherwise(
        F.concat(low.cast("string"), F.lit("-"), high.cast("string"))
    )
