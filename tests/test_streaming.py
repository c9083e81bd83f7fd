"""The log refresh as a stream gives what the batch upsert gives, batch by batch."""

import os

from pyspark.sql import functions as F

from tallyspark.streaming.upsert import upsert_stream


def test_upsert_stream(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, user_id long, value double, day date"

    def land(rows):
        df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, value double")
        df.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "value", F.to_date("ts").alias("day")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        events = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        upsert_stream(events, str(tmp_path / "table"), str(tmp_path / "at"), n=2).awaitTermination()
        last = max(os.listdir(tmp_path / "table"), key=lambda v: int(v[2:]))
        return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "table" / last)).select("event_id", "value").collect())

    assert land([(1, "2024-01-01 10:00:00", 1, 1.0), (2, "2024-01-02 10:00:00", 1, 2.0), (3, "2024-01-02 11:00:00", 2, 3.0)]) == [(1, 1.0), (2, 2.0), (3, 3.0)]
    # the second of January is replaced as a whole, and a key keeps its latest two rows
    assert land([(4, "2024-01-02 12:00:00", 1, 4.0), (5, "2024-01-03 12:00:00", 1, 5.0)]) == [(4, 4.0), (5, 5.0)]
    assert land([(6, "2024-01-04 12:00:00", 2, 6.0)]) == [(4, 4.0), (5, 5.0), (6, 6.0)]
    assert sorted(os.listdir(tmp_path / "table")) == ["v=1", "v=2"]
