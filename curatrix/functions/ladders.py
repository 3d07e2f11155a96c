"""Piecewise arithmetic on columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def below(value: Column, steps: Sequence[tuple[float, object]], otherwise: object) -> Column:
    """The value of the first step whose bound lies above `value`; null gives null."""
    out = None
    for bound, then in steps:
        test = value < F.lit(bound)
        out = F.when(test, F.lit(then)) if out is None else out.when(test, F.lit(then))
    return F.when(value.isNull(), F.lit(None)).otherwise(out.otherwise(F.lit(otherwise)))


def at_least(value: Column, steps: Sequence[tuple[float, object]], otherwise: object) -> Column:
    """The value of the first step whose bound `value` reaches; null gives null."""
    out = None
    for bound, then in steps:
        test = value >= F.lit(bound)
        out = F.when(test, F.lit(then)) if out is None else out.when(test, F.lit(then))
    return F.when(value.isNull(), F.lit(None)).otherwise(out.otherwise(F.lit(otherwise)))


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def whole(value: Column) -> Column:
    """Towards zero, as an integer."""
    return F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)).cast("long")


def uniform(key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone: the first 8 hex digits of the MD5 of its text."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
