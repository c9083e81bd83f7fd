"""The log refresh as a stream: each micro-batch replaces whole days of a Parquet table and keeps the latest rows of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyspark.operators.frames import upsert_recent


def upsert_stream(events: DataFrame, path: str, checkpoint: str, n: int = 35) -> StreamingQuery:
    """events: event_id, ts, user_id, value, day. Each version of the table has a folder of its own, so a batch that is run again after a failure
    reads the same old version and overwrites only its own. The two latest versions are kept."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{path}/v={number - 1}") if number else batch.limit(0)
        merged = upsert_recent(old, batch, "day", "user_id", [F.desc("ts"), F.desc("event_id")], n).drop("rn")
        merged.write.mode("overwrite").parquet(f"{path}/v={number}")
        past = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={number - 2}")
        past.getFileSystem(spark._jsc.hadoopConfiguration()).delete(past, True)

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
