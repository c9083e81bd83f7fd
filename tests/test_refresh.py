"""The refresh of a table by game day, end to end from landed files, and the log that a stream feeds."""

import datetime
import json

from pyspark.sql import functions as F

from tallyspark.operators import frames, refresh
from tallyspark.sources import stats
from tallyspark.streaming import late


def day(k):
    return datetime.date(2024, 1, k)


def land(folder, games, tracked):
    """A log of games (player, day, points) and tracking files for some days."""
    folder.mkdir(parents=True, exist_ok=True)
    lines = ["PLAYER_ID,GAME_ID,GAME_DATE,PTS,REB,AST,STL,BLK"] + [f"{p},00{k:04},{day(k)},{pts},1,2,,3" for p, k, pts in games]
    (folder / "log.csv").write_text("\n".join(lines) + "\n")
    for m, cols in stats.MEASURES.items():
        for k in tracked:
            at = folder / f"tracking/measure={m}/day={day(k)}"
            at.mkdir(parents=True, exist_ok=True)
            players = sorted({p for p, g, _ in games if g == k and p != 9})
            (at / "x.json").write_text(json.dumps({"resultSets": [{"headers": ["PLAYER_ID", *cols], "rowSet": [[p, *range(1, len(cols) + 1)] for p in players]}]}))


def run(spark, folder, table, as_of, **k):
    return refresh.refresh(spark, str(table), stats.game_log(spark, str(folder / "log.csv")), stats.tracking(spark, str(folder / "tracking")), as_of, **k)


def files(table):
    return {p.relative_to(table).as_posix(): p.stat().st_mtime_ns for p in table.rglob("*.parquet")}


def test_refresh_from_landed_files(spark, tmp_path):
    table, newest = tmp_path / "table", [F.desc("GAME_DATE"), F.desc("GAME_ID")]
    show = lambda n=35: {(r["PLAYER_ID"], r["GAME_ID"]): (r["PTS"], r["PTS+REB+AST"], r["STL+BLK"], r["DRIVES"]) for r in refresh.recent(spark, str(table), "PLAYER_ID", newest, n).collect()}
    games = [(p, k, 10 * p + k) for p in (1, 2) for k in range(1, 11)] + [(9, 3, 5)]
    land(tmp_path / "a", games, range(1, 11))
    assert run(spark, tmp_path / "a", tmp_path / "no", "2024-01-01 10:00:00") == ("up to date", []) and not (tmp_path / "no").exists()
    assert run(spark, tmp_path / "a", table, "2024-01-10 18:00:00", full_days=8) == ("full", [day(k) for k in range(9, 1, -1)])
    first, before = show(), files(table)
    assert first[1, "000005"] == (15.0, 18.0, 3.0, 1.0) and first[9, "000003"] == (5.0, 8.0, 3.0, 0.0) and (1, "000010") not in first and (1, "000001") not in first
    assert sorted({k.split("/")[0] for k in before}) == [f"GAME_DATE={day(k)}" for k in range(2, 10)]
    # four days later: the window holds four whole days, the tenth was missed; all points have changed
    land(tmp_path / "b", [(p, k, pts + 100) for p, k, pts in games] + [(1, 11, 0), (1, 13, 7), (1, 14, 8)], [*range(1, 12), 13, 14])
    assert run(spark, tmp_path / "b", table, "2024-01-14 18:00:00") == ("incremental", [day(k) for k in (13, 11, 10)])
    second, after = show(), files(table)
    assert {k: v for k, v in after.items() if k in before} == before and sorted({k.split("/")[0] for k in set(after) - set(before)}) == [f"GAME_DATE={day(k)}" for k in (10, 11, 13)]
    assert second[1, "000005"][0] == 15.0 and second[1, "000010"][0] == 120.0 and len(show(2)) == 2 + 2 + 1
    # the day before again, with other points: only its files change
    land(tmp_path / "c", [(1, 13, 70)], [13])
    assert run(spark, tmp_path / "c", table, "2024-01-14 18:00:00") == ("incremental", [day(13)])
    third = files(table)
    assert {k: v for k, v in third.items() if "01-13" not in k} == {k: v for k, v in after.items() if "01-13" not in k} and show()[1, "000013"][0] == 70.0
    # no tracking rows for the chosen days: the table stays
    land(tmp_path / "d", [(1, 13, 1), (1, 15, 1)], [])
    assert run(spark, tmp_path / "d", table, "2024-01-16 18:00:00") == ("no tracking", []) and files(table) == third
    # run again, the same files' rows
    was = show()
    run(spark, tmp_path / "c", table, "2024-01-14 18:00:00")
    assert show() == was


def test_days_to_refresh():
    played, at = [day(k) for k in (1, 2, 3, 8, 9, 10, 11, 12)], datetime.datetime(2024, 1, 12, 9)
    assert refresh.days_to_refresh(played, None, at, full_days=3) == [day(11), day(10), day(9)]
    assert refresh.days_to_refresh(played, day(11), at) == [day(11), day(10), day(9), day(8)]
    assert refresh.days_to_refresh(played, day(2), at) == [day(11), day(10), day(9), day(8), day(3)]
    assert refresh.days_to_refresh([*played, day(7)], day(11), datetime.datetime(2024, 1, 12, 0)) == [day(11), day(10), day(9), day(8), day(7)]
    assert refresh.days_to_refresh([], day(11), at) == [] == refresh.days_to_refresh([day(12)], None, at)


def test_same_rows_as_the_upsert_of_a_whole_table(spark, tmp_path):
    rows = spark.range(400).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("user_id"), F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, cast(id * 0.7 as int))").alias("ts"), (F.col("id") * 1.0).alias("value"))
    old = rows.withColumn("day", F.to_date("ts"))
    new = old.where("day >= date '2024-01-08' and day < date '2024-01-11'").withColumn("value", F.col("value") * 2)
    path, order = str(tmp_path / "t"), [F.desc("ts"), F.desc("event_id")]
    refresh.replace_days(old, path, "day")
    refresh.replace_days(new, path, "day")
    said = lambda df: sorted(tuple(r) for r in df.select("event_id", "user_id", "value", "rn").collect())
    assert said(refresh.recent(spark, path, "user_id", order, 10)) == said(frames.upsert_recent(old, new, "day", "user_id", order, 10))


def test_late_and_replayed_rows(spark, tmp_path):
    kind = "event_id long, ts timestamp_ntz, user_id long, value double"

    def land_rows(rows):
        df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, value double")
        df.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "value").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        events = spark.readStream.schema(kind.replace("timestamp_ntz", "timestamp")).parquet(str(tmp_path / "in"))
        late.append_stream(events, str(tmp_path / "log"), str(tmp_path / "at")).awaitTermination()
        return sorted(tuple(r) for r in late.appended(spark, str(tmp_path / "log"), kind.replace("timestamp_ntz", "timestamp")).select("event_id", "value").collect())

    assert land_rows([(1, "2024-01-10 10:00:00", 1, 1.0), (2, "2024-01-09 10:00:00", 1, 2.0)]) == [(1, 1.0), (2, 2.0)]
    before = files(tmp_path / "log")
    # four days late counts; six days late does not; what came before changes nothing
    got = land_rows([(3, "2024-01-06 10:00:00", 1, 3.0), (4, "2024-01-04 09:00:00", 1, 4.0), (1, "2024-01-10 10:00:00", 1, 9.0), (5, "2024-01-11 10:00:00", 2, 5.0)])
    assert got == [(1, 1.0), (2, 2.0), (3, 3.0), (5, 5.0)]
    after = files(tmp_path / "log")
    assert {k: v for k, v in after.items() if k in before} == before and {k.split("/")[0] for k in set(after) - set(before)} == {"day=2024-01-06", "day=2024-01-11"}
    assert land_rows([(3, "2024-01-06 10:00:00", 1, 30.0), (5, "2024-01-11 10:00:00", 2, 50.0)]) == got and files(tmp_path / "log") == after
