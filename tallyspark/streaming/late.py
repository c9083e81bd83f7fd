"""A log fed by a stream: replayed and late rows are settled by event-time state, and each batch writes files of its own in the days it touches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_stream(events: DataFrame, path: str, checkpoint: str, key: Sequence[str] = ("event_id",), time: str = "ts", late: str = "5 days") -> StreamingQuery:
    """Rows that come more than `late` after the newest of the batches before go, as do rows whose key came within that time. What is left goes to
    `path/day=.../batch=...`: a batch that is run again after a failure writes over its own files only, and nothing is read or rewritten."""
    settled = events.withWatermark(time, late).dropDuplicatesWithinWatermark(list(key))

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumns({"day": F.to_date(time), "batch": F.lit(number)})
        rows.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)

    return settled.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def appended(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of the log, with day and batch."""
    return spark.read.schema(f"{schema}, day date, batch long").parquet(path)
