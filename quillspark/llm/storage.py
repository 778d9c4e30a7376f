"""Where the operators of this subpackage keep intermediate results.

``Shelf.saved`` writes a DataFrame below the shared scratch folder and reads it again: lineage is cut, and a
lost executor takes nothing with it.  What a result still reads stays there until the folder is emptied.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import scratch_dir


class Shelf:
    """A folder of written tables for one operator call; ``drop`` removes what is not needed any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def saved(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._shelf_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            if path := getattr(frame, "_shelf_path", None):
                jvm = self.spark._jvm
                target = jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
