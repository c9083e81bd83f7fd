"""From landed files to the feed: season table, game log, zones and both books' odds, met by player."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import feed, refresh
from tallyspark.sources import odds, stats

#: The statistics of a document. (The team's code is not one of them: as a number it is always 0.)
DISPLAY = [
    "PLAYER_ID", "MIN", "GP", "PTS", "FGM", "FGA", "FG_PCT", "FG3M", "FG3A", "FG3_PCT", "FTM", "FTA", "FT_PCT", "PLUS_MINUS", "REB", "OREB", "DREB", "AST", "TOV", "STL", "BLK", "PF",
    "POTENTIAL_AST", "DRIVES", "DRIVE_PTS", "REB_CHANCES", "PTS+REB+AST", "PTS+REB", "PTS+AST", "REB+AST", "STL+BLK",
]


def books(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both books' odds rows as feed.build takes them. Rows that name a player alike share a prop_id, and are resolved once; of a statistic and
    book the row that is last by its own columns counts, as landed files have no order."""
    named = a.withColumn("book", F.lit("dk")).unionByName(b.withColumn("book", F.lit("fd")))
    who = F.to_json(F.struct("player", "team", "team_options"), {"ignoreNullFields": "false"})
    return named.withColumns({"prop_id": who, "ord": F.struct("game_date", "game", "prop_type", "line", "over_odds", "under_odds")})


def from_files(spark: SparkSession, root: str, as_of: str, compat: bool = False) -> DataFrame:
    """The feed's documents from a folder with: season/measure=..., log.csv, tracking/measure=.../day=..., shooting.json, assists/team_id=...,
    book_a/prop_type=..., book_b/main.json and book_b/tabs/event_id=.... The log is first brought up to `as_of` in `log` (a table by day). What is
    missing is empty; without a season table there is no document."""
    refresh.refresh(spark, f"{root}/log", stats.game_log(spark, f"{root}/log.csv"), stats.tracking(spark, f"{root}/tracking"), as_of)
    stored = refresh.saved(spark, f"{root}/log")
    log = stats.game_log(spark, f"{root}/log.csv").limit(0) if stored is None else stored
    # of a player in several teams, the last team's row
    season = feed.with_combos(stats.last_of(stats.read_season(spark, f"{root}/season"), ["PLAYER_ID"], "TEAM_ID")).withColumn("ord", F.col("PLAYER_ID"))
    shooting = feed.zone_map(stats.shooting_zones(stats.shooting(spark, f"{root}/shooting.json")))
    assists = feed.zone_map(stats.assist_zones(stats.assists(spark, f"{root}/assists"))).withColumn("ord", F.col("name"))
    day = as_of[:10]
    events = odds.upcoming(odds.read_book_b_main(spark, f"{root}/book_b/main.json"), day)
    priced = books(odds.book_a(odds.read_book_a(spark, f"{root}/book_a"), day), odds.book_b(odds.read_book_b(spark, f"{root}/book_b/tabs"), events, day, compat))
    return feed.build(season, log, shooting, assists, priced, DISPLAY, compat=compat)
