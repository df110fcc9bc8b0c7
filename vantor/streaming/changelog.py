"""Change logs as streams: appended micro-batch by micro-batch, each once, and read as live rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from vantor.operators.changes import live


def append_changes(changes: DataFrame, log: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Writes a stream of changes to the log's folder. The file sink commits each micro-batch exactly once."""
    writer = changes.writeStream.format("parquet").option("path", log).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def change_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The changes in files that come into a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def live_rows(spark: SparkSession, log: str) -> DataFrame:
    """The log's live rows as of now."""
    return live(spark.read.parquet(log))
