"""Incremental processing: skip what is done, and process new files once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def remaining(todo: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``todo`` whose key is not in ``done``; stronger than a high-water mark, as order does not matter."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def process_new(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> None:
    """Run ``transform`` over parquet files that appeared since the last call, and append the result.

    The streaming checkpoint makes each file count once, also after a failure.
    """
    stream = spark.readStream.schema(schema).parquet(source)
    query = transform(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
