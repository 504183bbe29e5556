"""Files as they arrive: each is landed once (the stream's own log is the list of those seen)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def land_files(spark: SparkSession, folder: str, schema: str, checkpoint: str, sink: Callable[[DataFrame, int], None]):
    """A query that gives ``sink`` (batch, batch id) the new CSV files of ``folder`` and ends when none is left."""
    rows = spark.readStream.schema(schema).option("header", "true").csv(folder).withColumn("_file", F.col("_metadata.file_path"))
    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
