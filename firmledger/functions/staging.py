"""Keeping big expressions from being copied."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_stage(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once, whatever later steps filter on.

    The optimiser pushes filters below projections and copies the projected expressions into them; rule ladders that
    build on each other then grow with every step. A one-element outer explode ends that: filters on its output stay
    above it, the row count does not change, and nothing is shuffled.
    """
    return rows.withColumn(name, F.explode_outer(F.array(value)))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and in whatever lambda the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unless(value: Column, *texts: str) -> Column:
    """The value, or null where it is one of the texts; computed once.

    ``nullif`` names its first argument twice where it stands in a branch, so four nested ones work out a value sixteen times and
    the generated code outgrows what can be compiled.
    """
    return F.get(F.filter(F.array(value), lambda item: ~item.isin(*texts)), F.lit(0))
