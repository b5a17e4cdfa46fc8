"""Null-safe scalar expressions, all JVM-side built-ins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(c: Column, low: Column | float | None, high: Column | float | None) -> Column:
    """Clamp to [low, high]. ``least``/``greatest`` skip nulls, so a null input is kept by hand."""
    out = c
    if high is not None:
        out = F.least(out, _col(high))
    if low is not None:
        out = F.greatest(out, _col(low))
    return F.when(c.isNotNull(), out)


def finite_or_null(c: Column) -> Column:
    """NaN and infinities become null. Spark orders NaN above every number, hence the explicit test."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def ratio(num: Column, den: Column, default: float | None = None) -> Column:
    """num / den, with null (or ``default``) instead of a division by zero."""
    out = F.try_divide(num, den)
    return out if default is None else F.coalesce(out, F.lit(default))


def rounded(c: Column, digits: int) -> Column:
    """``F.round`` of a double, with 0 for -0. ``F.round`` goes through a decimal text of each value; where the shifted
    value is clearly nearer to one integer than to the next, that integer, shifted back, is the same double."""
    unit = F.lit(float(10 ** digits))
    shifted, slow = c * unit, F.round(c, digits)
    clear = (F.abs(shifted) < float(1 << 42)) & (F.abs(shifted - F.rint(shifted)) < 0.496)
    return F.when(clear, F.rint(shifted) / unit + F.lit(0.0)).otherwise(F.when(slow == 0, F.lit(0.0)).otherwise(slow))


def month_key(c: Column) -> Column:
    """Month of a date as 'YYYY-MM', which sorts as text."""
    return F.date_format(c, "yyyy-MM")


# Fixed value: what counts as a number in a text column.
NUMBER = r"^\s*([+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf|infinity)))\s*$"


def numeric(c: Column, is_text: bool) -> Column:
    """Text to double; anything that is not a plain number becomes null, and so does NaN.

    The pattern keeps out Java literals such as '12d', which a cast accepts. The
    input is referenced once, so a pushed-down filter does not parse it twice.
    """
    if is_text:
        return F.regexp_extract(c, NUMBER, 1).try_cast("double")
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def hash_order(keys: list[str], seed: int | str) -> Column:
    """A pseudo-random sort key that depends on the row's key only, never on partitioning."""
    parts = [F.col(k).cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _col(v: Column | float) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))
