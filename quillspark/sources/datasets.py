"""The catalogue of modelling tables by task, over the parquet tables and generated ones."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..operators.sampling import first_rows
from ..operators.scaling import columns_of, finite_or_null, is_class
from . import synthetic
from .readers import read_csv, read_table

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@dataclass(frozen=True)
class Dataset:
    """``load`` gives the features and the target ``y``."""

    name: str
    task: str
    features: tuple[str, ...]
    load: Callable[[SparkSession, str], DataFrame]

    def table(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.load(spark, folder).select(*[F.col(f"`{c}`") for c in self.features], "y")


def line(target: Column) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: read_table(spark, folder, "lineitem").withColumn("y", target)


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "embeddings")
    return rows.select(*[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(64)], F.col("label").alias("y"))


def generated(make: Callable, **options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: make(spark, **options)


def numbered(n: int, prefix: str = "x") -> tuple[str, ...]:
    return tuple(f"{prefix}{i}" for i in range(n))


def catalogue() -> dict[str, list[Dataset]]:
    planted = (F.col("l_quantity") * F.col("l_discount") > 1.0).cast("int")
    price = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")), 4)
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return {
        "classification": [
            Dataset("synthetic_classes", "classification", numbered(20), generated(synthetic.classes)),
            Dataset("line_product", "classification", tuple(LINE), line(planted)),
            Dataset("line_flag", "classification", tuple(LINE), line(flag)),
            Dataset("vector_label", "classification", numbered(64, "e"), vectors),
        ],
        "regression": [
            Dataset("synthetic_linear", "regression", numbered(20), generated(synthetic.linear)),
            Dataset("line_price", "regression", tuple(LINE), line(price)),
            Dataset("line_planted", "regression", tuple(LINE), line(F.round(F.col("l_quantity") * F.col("l_discount"), 6))),
            Dataset("friedman1", "regression", numbered(10), generated(synthetic.friedman1)),
            Dataset("friedman2", "regression", numbered(4), generated(synthetic.friedman2)),
        ],
    }


@dataclass(frozen=True)
class External:
    """A published table that users bring as <name>.csv or <name>.parquet (a file or a folder) in a folder of theirs.

    ``targets``: names that the target may have.  ``first``: only that many first rows in the order of all columns.  ``positive``: this value of
    the target against all others.  Only numeric features are taken, missing ones as 0; text targets are encoded by the fit."""

    task: str
    targets: tuple[str, ...] = ("target", "class", "Class", "label", "y", "defects")
    first: int | None = None
    positive: object = None


#: The published tables of the comparison, by task, and those with a text or numeric class column that come as CSV files.
EXTERNAL = {
    "breast_cancer": External("classification"), "iris": External("classification"), "digits": External("classification"), "wine": External("classification"),
    "covertype": External("classification", ("target", "Cover_Type", "class"), 10_000, 1),
    "diabetes": External("regression"), "california_housing": External("regression", ("target", "MedHouseVal", "median_house_value")), "ames_housing": External("regression", ("SalePrice", "target")),
    **{name: External("classification") for name in ("shuttle", "blood-transfusion-service-center", "credit-g", "kc1", "nomao", "eeg_eye_state", "gina", "sonar", "arcene", "madelon")},
}


def external(spark: SparkSession, folder: str, name: str) -> Dataset:
    """One of ``EXTERNAL`` from the user's folder, with its numeric columns as features."""
    known = EXTERNAL[name]
    try:
        table = read_table(spark, folder, name)
    except AnalysisException:
        table = read_csv(spark, f"{folder}/{name}.csv")
    target = next((t for t in known.targets if t in table.columns), None)
    if target is None:
        raise ValueError(f"{name} has none of the target columns {known.targets}")
    if known.first is not None:
        table = first_rows(table, known.first, *[F.col(f"`{c}`") for c in table.columns])
    features = columns_of(table, NumericType, (target,))
    y = F.col(f"`{target}`") if known.positive is None else is_class(F.col(f"`{target}`"), known.positive)
    filled = [F.coalesce(finite_or_null(F.col(f"`{c}`")), F.lit(0.0)).alias(c) for c in features]
    rows = table.select(*filled, y.alias("y"))
    return Dataset(name, known.task, tuple(features), lambda spark, folder: rows)


def externals(spark: SparkSession, folder: str) -> list[Dataset]:
    """Those of ``EXTERNAL`` that the folder holds."""
    jvm = spark._jvm.org.apache.hadoop.fs
    there = lambda name: any((path := jvm.Path(f"{folder}/{name}.{end}")).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) for end in ("parquet", "csv"))
    return [external(spark, folder, name) for name in EXTERNAL if there(name)]


def dataset(name: str) -> Dataset:
    for group in catalogue().values():
        for d in group:
            if d.name == name:
                return d
    raise KeyError(name)
