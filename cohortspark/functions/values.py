"""Missing values, numbers and dates as expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_blank(c: Column) -> Column:
    """Null or nothing but white space."""
    return c.isNull() | (F.trim(c.cast("string")) == "")


def to_number(c: Column) -> Column:
    """A double, or null where the value is no number; NaN counts as null."""
    n = F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(n), n)


def to_date(y: Column, m: Column, d: Column) -> Column:
    """A date, or null where the parts name none."""
    return F.try_make_timestamp(y, m, d, F.lit(0), F.lit(0), F.lit(0)).cast("date")


def without_codes(c: Column, codes: list[float], keep: list[float] = ()) -> Column:
    """Null where the value equals one of the codes as a number, unless it is one to keep."""
    codes = [x for x in codes if x not in set(keep)]
    if not codes:
        return c
    return F.when(F.coalesce(to_number(c).isin([float(x) for x in codes]), F.lit(False)), F.lit(None)).otherwise(c)


def recode_binary(c: Column) -> Column:
    """0 and 2 become 0, 1 stays 1, all else null."""
    n = to_number(c)
    return F.when(n.isin(0.0, 2.0), 0).when(n == 1.0, 1)


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0; null counts as not."""
    return F.when(condition, 1).otherwise(0)
