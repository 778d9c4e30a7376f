"""Places on a ladder of sorted numbers, with DataFrame functions only: cuts of a column at quantiles that the driver knows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numbers(values: Sequence[float]) -> Column:
    """A constant array, short in the plan's text however many values it has."""
    kind = "array<long>" if all(isinstance(v, int) for v in values) else "array<double>"
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(kind)


def quantiles(rows: DataFrame, column: str, parts: int, accuracy: int) -> list[int]:
    """The ``parts`` - 1 inner quantiles of a long column, repeated where they fall on one value; none for an empty table."""
    if parts < 2:
        return []
    shares = numbers([k / parts for k in range(1, parts)])
    return rows.agg(F.percentile_approx(column, shares, accuracy)).first()[0] or []


def rung(column: Column, edges: list[int]) -> Column:
    """How many of the sorted ``edges`` are at most the value, by binary search; 0 for null."""
    if not edges:
        return F.lit(0)
    ladder, steps = numbers(edges), F.array(*[F.lit(1 << p) for p in range(len(edges).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(ladder, at + step - 1) <= column, at + step).otherwise(at))
