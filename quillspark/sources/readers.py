"""Readers of the engine's inputs and the recipe that prepares a table for modelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructType

from ..operators.sampling import row_hash, split, split_rows
from ..operators.scaling import columns_of, label_encode


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """With a header; without a schema the types are inferred, which reads the file twice."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def prepare(df: DataFrame, target: str, hashed: list[str] | None = None) -> DataFrame:
    """Text columns encoded, the target renamed to ``label``, and ``split``: a fifth of the rows is "test", by a hash of the columns
    ``hashed``, or of all columns and each row's place among its copies."""
    marked = split(df, row_hash(hashed), 5) if hashed else split_rows(df)
    texts = [c for c in columns_of(df, StringType) if c != target]
    return label_encode(marked, texts).withColumnRenamed(target, "label")
