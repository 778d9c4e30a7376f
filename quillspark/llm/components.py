"""Connected components of a graph by hooking and pointer jumping.

A first pass replaces the links within each partition by a spanning star forest (union-find over the partition's
own links), which leaves at most one link per node and partition.  All links point from a larger node to a smaller one.  Each
round lets a node keep its smallest end as its pointer, turns its other links into links between the ends, and moves every pointer
on to where its end points.  It ends when nothing moves; then every node points to the smallest of its component.

A node that very many others point to is a hot key only in the join that moves pointers; its sides are plain
written tables with one row per node on the other side, so Spark can split such a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Shelf

#: Links that one union-find takes before its forest goes out; bounds a worker's memory.
FOREST_LINKS = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the nodes that are not the smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        for side in (left, right):
            np.minimum.at(new, root[side], low)
        while True:
            short = new[new]
            if (short == new).all():
                break
            new = short
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def local_forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        a = np.concatenate([p.column(0).to_numpy(zero_copy_only=False) for p in parts])
        b = np.concatenate([p.column(1).to_numpy(zero_copy_only=False) for p in parts])
        u, v = forest(a, b)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    kept: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        kept.append(batch)
        size += batch.num_rows
        if size >= FOREST_LINKS:
            yield out(kept)
            kept, size = [], 0
    if kept:
        yield out(kept)


def components(links: DataFrame, a: str, b: str, shelf: Shelf) -> DataFrame:
    """(node, component): every node of a link, with the smallest node it can reach.

    Links may come twice, in both directions or from a node to itself; nulls link nothing.
    An empty table gives an empty result.
    """
    pairs = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null")
    edges = shelf.saved(pairs.mapInArrow(local_forests, "u long, v long").withColumn("moved", F.lit(True)))  # u > v
    while True:
        lowest = edges.groupBy("u").agg(F.min("v").alias("p"), F.max("v").alias("high"))
        pointers = shelf.saved(lowest)
        # the other ends of a node hang together with its smallest
        forks = pointers.where("high > p").select("u", "p")
        rest = edges.join(forks, "u").where("v > p").select(F.col("v").alias("a"), F.col("p").alias("b")).distinct()
        ahead = pointers.select(F.col("u").alias("p"), F.col("p").alias("further"))
        for end in ("a", "b"):
            rest = rest.join(ahead.withColumnRenamed("p", end), end, "left").withColumn(end, F.coalesce("further", end)).drop("further")
        rest = rest.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"), F.lit(True).alias("moved"))
        jumped = pointers.join(ahead, "p", "left").select("u", F.coalesce("further", "p").alias("v"), F.col("further").isNotNull().alias("moved"))
        after = shelf.saved(jumped.union(rest.distinct()))
        finished = after.where("moved").isEmpty()
        shelf.drop(edges, pointers)
        edges = after
        if finished:
            break
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
