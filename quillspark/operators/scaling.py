"""Scaling, encoding and column preparation.  A fitted scale is one aggregate over the table."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, NumericType, StringType
from pyspark.sql.window import Window

from ..sources.scratch import scratch_dir


def finite_or_null(column: Column) -> Column:
    """As double, NaN as NULL."""
    return F.nanvl(column.cast("double"), F.lit(None).cast("double"))


@dataclass(frozen=True)
class Scale:
    """(x - offset) / factor by column; a factor of 0 counts as 1, so a constant column becomes 0."""

    columns: tuple[str, ...]
    offsets: tuple[float, ...]
    factors: tuple[float, ...]

    def of(self) -> list[Column]:
        return [(finite_or_null(F.col(f"`{c}`")) - F.lit(o)) / F.lit(f or 1.0) for c, o, f in zip(self.columns, self.offsets, self.factors, strict=True)]


def fit_min_max(df: DataFrame, columns: list[str]) -> Scale:
    values = [finite_or_null(F.col(f"`{c}`")) for c in columns]
    found = df.agg(*[F.min(v).alias(f"low{i}") for i, v in enumerate(values)], *[F.max(v).alias(f"high{i}") for i, v in enumerate(values)]).first()
    low = [0.0 if found[f"low{i}"] is None else found[f"low{i}"] for i in range(len(columns))]
    high = [0.0 if found[f"high{i}"] is None else found[f"high{i}"] for i in range(len(columns))]
    return Scale(tuple(columns), tuple(low), tuple(h - b for b, h in zip(low, high, strict=True)))


def fit_standard(df: DataFrame, columns: list[str]) -> Scale:
    values = [finite_or_null(F.col(f"`{c}`")) for c in columns]
    found = df.agg(*[F.avg(v).alias(f"mean{i}") for i, v in enumerate(values)], *[F.stddev_pop(v).alias(f"std{i}") for i, v in enumerate(values)]).first()
    return Scale(tuple(columns), tuple(found[f"mean{i}"] or 0.0 for i in range(len(columns))), tuple(found[f"std{i}"] or 0.0 for i in range(len(columns))))


def min_max_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, low, high)."""
    wide = df.agg(*[F.min(c).cast("double").alias(f"low_{c}") for c in columns], *[F.max(c).cast("double").alias(f"high_{c}") for c in columns])
    pairs = ", ".join(f"'{c}', low_{c}, high_{c}" for c in columns)
    return wide.selectExpr(f"stack({len(columns)}, {pairs}) as (feature, low, high)")


def label_codes(df: DataFrame, column: str, small: int = 100_000) -> DataFrame:
    """(value, code): the different values in sorted order, from 0.

    Up to ``small`` values are ranked in one task.  More are sorted by ranges, written, and numbered by their place in their
    range and the sizes of the ranges before it; only those sizes come to the driver."""
    values = df.select(F.col(column).alias("value")).where(F.col(column).isNotNull()).distinct()
    if values.count() <= small:
        return values.select("value", (F.dense_rank().over(Window.orderBy("value")) - 1).alias("code"))
    path = f"{scratch_dir(df.sparkSession)}/codes-{uuid.uuid4().hex}"
    values.sort("value").withColumn("at", F.monotonically_increasing_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path).select("value", F.shiftright("at", 33).cast("int").alias("range"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
    sizes = sorted((r["range"], r["count"]) for r in rows.groupBy("range").count().collect())
    starts = list(accumulate((n for _, n in sizes), initial=0))
    offsets = df.sparkSession.createDataFrame([(k, start) for (k, _), start in zip(sizes, starts, strict=False)], "range int, start long")
    return rows.join(F.broadcast(offsets), "range").select("value", (F.col("place") + F.col("start")).cast("int").alias("code"))


def label_encode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replaces each column by its codes; null stays null."""
    for c in columns:
        codes = label_codes(df, c).withColumnRenamed("value", "__value").withColumnRenamed("code", "__code")
        df = df.join(codes, df[c] == codes["__value"], "left").select(*[F.col("__code").alias(c) if x == c else F.col(x) for x in df.columns])
    return df


def columns_of(df: DataFrame, kind: type[DataType], but: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kind) and f.name not in but]


def text_columns(df: DataFrame) -> DataFrame:
    return df.select(*columns_of(df, StringType))


def number_columns(df: DataFrame, target: str) -> DataFrame:
    return df.select(*columns_of(df, NumericType, (target,)))


def fill_missing(df: DataFrame, columns: list[str], value: float = 0.0) -> DataFrame:
    """NULL and, in floating columns, NaN."""
    floating = set(columns_of(df, DoubleType))
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c), F.lit(None).cast("double")) if c in floating else F.col(c), F.lit(value)) for c in columns})


def is_class(column: Column, wanted: object) -> Column:
    return (column == F.lit(wanted)).cast("int")
