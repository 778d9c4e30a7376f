"""Columns by their exact names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField


def exactly(name: str) -> Column:
    """The column of that name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(names: list[str]) -> list[Column]:
    """Those columns under plain names; a function over Arrow batches takes its input's columns by names that are parsed."""
    return [exactly(name).alias(f"c{i}") for i, name in enumerate(names)]


def apart(names: list[str], taken: list[str]) -> list[str]:
    """``names`` but those that Spark, which tells no case apart, would take for one of ``taken``."""
    low = {t.lower() for t in taken}
    return [n for n in names if n.lower() not in low]


def fields(table: DataFrame, names: list[str]) -> list[StructField]:
    return [f for f in table.schema.fields if f.name in names]
