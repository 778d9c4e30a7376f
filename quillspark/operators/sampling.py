"""Deterministic samples, splits and folds from a hash of the row.

Equal rows have equal hashes.  Where rows may repeat, ``numbered`` tells copies apart first, so that each is drawn, split or folded on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

#: Bits by which a sample's edge is narrowed at a time, and rows at the edge that one task may rank.
SLICE_BITS, RANKED = 16, 50_000
#: Copies of a row that one task numbers at most; larger groups are dealt in parts of as many.
COPIES = 1000
#: Rows of a dealt table in one partition, about, when there are more than the cores take.
PART_ROWS = 1_000_000
#: Rows of a partition, about, below which more partitions cost more than they save.
FEW_ROWS = 2500


def row_hash(columns: list[str], seed: int | None = None) -> Column:
    """md5 over the columns' texts; without a seed and with one column, that column's own md5."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]
    text = F.concat_ws("\x1f", *parts) if seed is None else F.concat_ws("\x1f", F.lit(str(seed)), *parts)
    return F.md5(text.cast("binary"))


def row_key(columns: list[str], seed: int = 0) -> Column:
    """A 64-bit hash of the columns' values, cheaper than ``row_hash``; nulls count by their place."""
    return F.xxhash64(F.lit(seed), *[x for c in columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())])


def long_of(df: DataFrame, hash_: Column) -> Column:
    """A long in the order of the hash: the first 60 bits of a hexadecimal text, a long as it is."""
    if df.select(hash_).schema[0].dataType == StringType():
        return F.conv(F.substring(hash_, 1, 15), 16, 10).cast("long")
    return hash_.cast("long")


def count_copies(df: DataFrame, number: str = "__copy") -> DataFrame:
    """The different rows of ``df`` and in ``number`` how many there are of each; sums map-side, so a group of many copies is one row."""
    return df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias(number))


def each_copy(counted: DataFrame, number: str = "__copy") -> DataFrame:
    """All rows again from ``count_copies``, with their place among equal ones, from 0, in ``number``.

    A hash over all columns then tells copies apart, wherever they are stored.  Large groups go to all cores in parts."""
    columns = [F.col(f"`{c}`") for c in counted.columns if c != number]

    def placed(first: Column, end: Column) -> list[Column]:
        return [*columns, F.explode(F.sequence(first, end - 1)).alias(number)]

    few = counted.where(F.col(number) <= COPIES).select(*placed(F.lit(0).cast("long"), F.col(number)))
    parts = counted.where(F.col(number) > COPIES).select(*columns, F.col(number).alias("__end"), F.explode(F.sequence(F.lit(0).cast("long"), F.col(number) - 1, F.lit(COPIES).cast("long"))).alias("__first"))
    dealt = parts.repartition(counted.sparkSession.sparkContext.defaultParallelism, *columns, F.col("__first"))
    return few.unionByName(dealt.select(*placed(F.col("__first"), F.least(F.col("__first") + COPIES, F.col("__end")))))


def numbered(df: DataFrame, number: str = "__copy") -> DataFrame:
    """``df`` with each row's place among equal ones, from 0, in ``number``."""
    return each_copy(count_copies(df, number), number)


def bucket(hash_: Column, n: int) -> Column:
    """0 to n - 1, from the first 32 bits."""
    return F.conv(F.substring(hash_, 1, 8), 16, 10).cast("long") % n


def exact_sample(df: DataFrame, k: int, hash_: Column) -> DataFrame:
    """The k rows of smallest hash (ties by chance), without sorting the table.

    Counts by the hash's first bits find the slice in which the k-th row lies; while that slice has more than ``RANKED`` rows, its next bits narrow it.  Rows of earlier slices
    pass a filter and only the last slice's rows are ranked.  A hash that tells equal rows apart keeps that slice small whatever the rows are."""
    if k <= 0:
        return df.limit(0)
    rows = df.withColumn("__key", long_of(df, hash_))
    shift, below, edge, rest = 64, F.lit(False), None, k
    while shift > 0 and (edge is None or size > RANKED):
        within = F.lit(True) if edge is None else F.shiftright("__key", shift) == edge
        shift -= SLICE_BITS
        counts = rows.where(within).groupBy(F.shiftright("__key", shift).alias("slice")).count().orderBy("slice").collect()  # at most 2 ** SLICE_BITS rows
        found = None
        for c in counts:
            if c["count"] >= rest:
                found, size = c["slice"], c["count"]
                break
            rest -= c["count"]
        if found is None:
            return df
        edge = found
        below = F.shiftright("__key", shift) < edge
    last = F.shiftright("__key", shift) == edge
    ranked = rows.where(last).withColumn("__rank", F.row_number().over(Window.partitionBy(F.shiftright("__key", shift)).orderBy("__key")))
    return rows.where(below).drop("__key").unionByName(ranked.where(F.col("__rank") <= rest).drop("__key", "__rank"))


def drawn(df: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k rows without replacement, every copy of a row as likely as any other row."""
    every = numbered(df)
    return exact_sample(every, k, row_key(every.columns, seed)).select(*[F.col(f"`{c}`") for c in df.columns])


def dealt(df: DataFrame, rows: int, hash_: Column) -> DataFrame:
    """The ``rows`` rows of ``df`` dealt over the cores, as far as they are worth it, by their hash and in its order, so that partitions and their order do not depend on
    how the table was stored."""
    parts = max(1, min(df.sparkSession.sparkContext.defaultParallelism, -(-rows // FEW_ROWS)), -(-rows // PART_ROWS))
    return df.withColumn("__hash", hash_).repartition(parts, "__hash").sortWithinPartitions("__hash").drop("__hash")


def split(df: DataFrame, hash_: Column, parts: int = 5, test: int = 0) -> DataFrame:
    """Adds ``split``: "test" for about one in ``parts`` rows, else "train"; rows of equal hash go together."""
    return df.withColumn("split", F.when(bucket(hash_, parts) == test, "test").otherwise("train"))


def folds(df: DataFrame, hash_: Column, n: int = 3) -> DataFrame:
    return df.withColumn("fold", bucket(hash_, n).cast("int"))


def split_rows(df: DataFrame, seed: int = 0, parts: int = 5) -> DataFrame:
    """``split`` of every row on its own, copies too."""
    return split_copies(count_copies(df), seed, parts)


def split_copies(counted: DataFrame, seed: int = 0, parts: int = 5) -> DataFrame:
    """``split_rows`` from ``count_copies``, which the caller may keep."""
    every = each_copy(counted)
    part = F.pmod(row_key(every.columns, seed), F.lit(parts))
    return every.select(*[F.col(f"`{c}`") for c in counted.columns[:-1]], F.when(part == 0, "test").otherwise("train").alias("split"))


def fold_rows(df: DataFrame, seed: int = 0, n: int = 3) -> DataFrame:
    """``fold`` (0 to n - 1) of every row on its own, copies too."""
    every = numbered(df)
    return every.select(*[F.col(f"`{c}`") for c in df.columns], F.pmod(row_key(every.columns, seed), F.lit(n)).cast("int").alias("fold"))


def first_rows(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first n rows in an explicit order."""
    return df.orderBy(*order).limit(n)
