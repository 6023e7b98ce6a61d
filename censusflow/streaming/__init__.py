"""Exports that arrive over time: each micro-batch of files goes through the same batch plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from censusflow.plans.pipeline import Options, run


def follow(spark: SparkSession, folder: str, schema: StructType | str, options: Options, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Start a query that hands the final rows of each micro-batch of raw Parquet rows to sink(df, batch_id).

    First-wins deduplication holds within a micro-batch; across all of time it is a matter for the batch plan.
    """
    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(lambda df, i: sink(run(df, options).final, i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
