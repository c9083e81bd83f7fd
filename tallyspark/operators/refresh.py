"""The log refresh on storage that is partitioned by game day: only the days that are refreshed are read and written."""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators.feed import with_combos
from tallyspark.operators.frames import few_values, latest

#: Days of a full refresh, days that are refreshed again since numbers still change, and games that a player's history shows.
FULL_DAYS, WINDOW_DAYS, GAMES = 25, 5, 35
#: Days of a log that are listed to choose from.
MOST_DAYS = 20_000


class Refreshed(NamedTuple):
    """full, incremental, up to date (no day to refresh) or no tracking (nothing was written), and the days that were written."""

    mode: str
    days: list[datetime.date]


def saved(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored table, or None where there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def days_to_refresh(played: Sequence[datetime.date], last: datetime.date | None, as_of: datetime.datetime, full_days: int = FULL_DAYS, window: int = WINDOW_DAYS) -> list[datetime.date]:
    """Of the days played before the day of `as_of`: without a stored table (`last` is its last day) the newest `full_days`; or else those that
    began within `window` days of `as_of`, and all that are newer than the table."""
    done = sorted((d for d in set(played) if d < as_of.date()), reverse=True)
    if last is None:
        return done[:full_days]
    since = as_of - datetime.timedelta(days=window)
    return [d for d in done if datetime.datetime.combine(d, datetime.time()) >= since or d > last]


def replace_days(new: DataFrame, path: str, day: str) -> None:
    """Write new's days in place of the stored ones; the files of other days are not touched. Written again, it gives the same."""
    new.repartition(day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def recent(spark: SparkSession, path: str, key: str | Sequence[str], order: Sequence[Column], n: int = GAMES) -> DataFrame:
    """The latest n rows of each key in the stored table: the history is bounded when it is read, so that no day is written for it."""
    return latest(spark.read.parquet(path), key, order, n)


def refresh(spark: SparkSession, path: str, log: DataFrame, tracking: DataFrame, as_of: str, day: str = "GAME_DATE", on: Sequence[str] = ("PLAYER_ID", "DATE_STR"), full_days: int = FULL_DAYS, window: int = WINDOW_DAYS) -> Refreshed:
    """Bring the stored table up to `as_of` (an ISO time) from the landed log and its tracking measures (joined by `on`).

    The day of `as_of` itself is never taken, as its games may be unfinished. Without any tracking row for the chosen days the table stays as it is;
    where only some lack them, those days are written with zeros."""
    now = datetime.datetime.fromisoformat(as_of)
    old = saved(spark, path)
    last = None if old is None else old.agg(F.max(F.col(day).cast("date"))).first()[0]
    days = days_to_refresh(few_values(log.where(F.col(day).isNotNull()), day, MOST_DAYS), last, now, full_days, window)
    if not days:
        return Refreshed("up to date", [])
    chosen = log.where(F.col(day).isin(days))
    measures = tracking.join(chosen.select(*on).distinct(), list(on), "left_semi")
    if measures.isEmpty():
        return Refreshed("no tracking", [])
    replace_days(with_combos(chosen.join(measures, list(on), "left").na.fill(0)), path, day)
    return Refreshed("full" if last is None else "incremental", days)
