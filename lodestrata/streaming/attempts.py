"""Summaries of attempts that are kept up to date while attempts arrive.

The state is one row of aggregates for each task: counts and the best attempt by an order that each attempt carries itself, so
attempts may come in any order and in any batches; the last state is the summary of all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lodestrata.operators import trajectory


def arriving(spark: SparkSession, folder: str, schema: StructType, files: int = 1) -> DataFrame:
    """Attempts from the Parquet files of a folder, ``files`` a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def keep_summaries(attempts: DataFrame, order: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Start a query that, after each batch, overwrites ``path`` with the summary of all attempts so far, one row for each task.

    Tasks' rows are replaced as a whole, so a batch that is run again after a failure changes nothing."""
    summary = trajectory.summarize(attempts, order)
    return summary.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).trigger(availableNow=True).start()
