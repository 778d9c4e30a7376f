"""A fitted model on a stream: its transform is a stateless projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.synthesizer import FeatureModel


def stream_features(model: FeatureModel, stream: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    if not stream.isStreaming:
        raise ValueError("not a stream")
    return model.transform(stream, keep)


def run_available(model: FeatureModel, spark: SparkSession, folder: str, pattern: str, out: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Takes all parquet files of ``folder`` that match ``pattern`` through a stream to parquet files in ``out`` and returns these.

    ``out`` also holds the stream's progress, so that a second call goes on where the first ended."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    features = stream_features(model, stream, keep)
    query = features.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(features.schema).parquet(f"{out}/rows")
