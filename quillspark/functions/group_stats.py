"""Aggregates of a value by group, brought back to every row of the group.

NaN values count as missing.  Groups with a null key give null.  Mean, deviation, extremes, sum and range skip
missing values; the size counts them; median and quartiles of a group that has one are null.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Aggregate = Callable[[Column], Column]

#: In the order that a random choice draws from.
AGGREGATES: dict[str, Aggregate] = {
    "mean": F.avg,
    "std": F.stddev_pop,
    "max": F.max,
    "min": F.min,
    "sum": F.sum,
    "mode": lambda x: F.mode(x, True),
    "len": lambda x: F.count(F.lit(1)),
    "range": lambda x: F.max(x) - F.min(x),
    "median": F.median,
    "p25": lambda x: F.percentile(x, 0.25),
    "p75": lambda x: F.percentile(x, 0.75),
}
#: Null where a value of the group is missing.
WHOLE_ONLY = {"median", "p25", "p75"}


def register(name: str, aggregate: Aggregate) -> None:
    AGGREGATES[name] = aggregate


def random_aggregate(seed: int) -> str:
    return str(np.random.RandomState(seed).choice(list(AGGREGATES)))


def group_feature(df: DataFrame, key: str, value: str, how: str, out: str) -> DataFrame:
    """Adds ``out`` by way of a join with the grouped table.

    Sums are formed map-side before the shuffle and the group table is joined back, so a key with a large
    part of all rows costs one row of it, not a window over them."""
    x = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    result = AGGREGATES[how](x)
    if how == "sum":
        result = F.coalesce(result, F.lit(0.0))
    if how in WHOLE_ONLY:
        result = F.when(F.count(x) == F.count(F.lit(1)), result)
    groups = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(result.alias(out))
    return df.join(groups, F.col(key) == F.col("__key"), "left").drop("__key")


def group_feature_windowed(df: DataFrame, key: str, value: str, how: str, out: str) -> DataFrame:
    """The same by a window over the whole partition: one shuffle of the rows, for keys without heavy ones."""
    x = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    over = Window.partitionBy(key)
    if how == "range":
        result = F.max(x).over(over) - F.min(x).over(over)
    else:
        result = AGGREGATES[how](x).over(over)
    if how == "sum":
        result = F.coalesce(result, F.lit(0.0))
    if how in WHOLE_ONLY:
        result = F.when(F.count(x).over(over) == F.count(F.lit(1)).over(over), result)
    return df.withColumn(out, F.when(F.col(key).isNotNull(), result))
