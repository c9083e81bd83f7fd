"""The season's schedule: landed JSON, one row a game."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.sources.tables import json_or_empty

_TEAM = "struct<teamId: bigint, teamName: string, teamCity: string, teamTricode: string, wins: int, losses: int, score: int>"
GAME = (
    f"gameId: string, gameCode: string, gameStatus: int, gameStatusText: string, gameDateTimeUTC: string, gameDateTimeEst: string, arenaName: string, arenaCity: string, arenaState: string, "
    f"pointsLeaders: array<struct<teamTricode: string, firstName: string, lastName: string, points: double>>, homeTeam: {_TEAM}, awayTeam: {_TEAM}"
)
SCHEDULE = f"leagueSchedule struct<gameDates: array<struct<gameDate: string, games: array<struct<{GAME}>>>>>"


def read_schedule(spark: SparkSession, path: str) -> DataFrame:
    """gameDate and a game's columns for each game."""
    days = json_or_empty(spark, path, SCHEDULE).select(F.posexplode("leagueSchedule.gameDates").alias("at", "d"))
    return days.select("at", "d.gameDate", F.explode("d.games").alias("g")).select("at", "gameDate", "g.*")


def on_day(games: DataFrame, day: str) -> DataFrame:
    """Games of the first date object of a day (yyyy-MM-dd); its text is MM/dd/yyyy 00:00:00."""
    text = F.date_format(F.lit(day).cast("date"), "MM/dd/yyyy 00:00:00")
    met = games.where(F.col("gameDate") == text)
    first = met.agg(F.min("at").alias("first"))  # one row
    return met.join(F.broadcast(first), F.col("at") == F.col("first")).drop("first", "at")


def last_where(items: Column, hit) -> Column:
    """The last element for which hit(element) holds; null for none."""
    return F.try_element_at(F.filter(items, hit), F.lit(-1))


def flatten(games: DataFrame) -> DataFrame:
    """A flat row for each game: defaults for what is missing, winner, margin, total and texts. A score that is missing is 0."""
    home, away = F.col("homeTeam.teamTricode"), F.col("awayTeam.teamTricode")
    hs, as_ = F.coalesce("homeTeam.score", F.lit(0)), F.coalesce("awayTeam.score", F.lit(0))
    at = F.try_to_timestamp("gameDateTimeEst", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    status = F.coalesce("gameStatus", F.lit(1))
    arena = [F.coalesce(c, F.lit(d)) for c, d in (("arenaName", "Unknown Arena"), ("arenaCity", "Unknown City"), ("arenaState", "Unknown State"))]
    leaders = F.coalesce("pointsLeaders", F.array().cast("array<struct<teamTricode: string, firstName: string, lastName: string, points: double>>"))
    first, second = last_where(leaders, lambda x: x["teamTricode"].eqNullSafe(home)), last_where(leaders, lambda x: x["teamTricode"].eqNullSafe(away) & ~x["teamTricode"].eqNullSafe(home))
    name = lambda x: F.when(x.isNotNull(), F.trim(F.concat(F.coalesce(x["firstName"], F.lit("")), F.lit(" "), F.coalesce(x["lastName"], F.lit("")))))
    team = lambda t, s: [*(F.col(f"{t}Team.{c}").alias(f"{t}_{n}") for c, n in (("teamId", "team_id"), ("teamName", "team_name"), ("teamCity", "team_city"), ("teamTricode", "team_tricode"), ("wins", "team_wins"), ("losses", "team_losses"))), s.alias(f"{t}_score")]
    said = lambda x: F.coalesce(x.cast("string"), F.lit("None"))
    return games.select(
        F.col("gameId").alias("game_id"), F.col("gameCode").alias("game_code"), *team("home", hs), *team("away", as_), arena[0].alias("arena_name"), arena[1].alias("arena_city"), arena[2].alias("arena_state"), F.concat_ws(", ", *arena).alias("arena_full"),
        F.col("gameDateTimeUTC").alias("game_time_utc"), F.when(at.isNotNull(), F.date_format(at, "hh:mm a 'ET'")).otherwise(F.col("gameDateTimeEst")).alias("game_time_et"), F.date_format(at, "yyyy-MM-dd").alias("game_date"), F.date_format(at, "EEEE").alias("game_weekday"),
        status.alias("game_status"), F.coalesce("gameStatusText", F.lit("")).alias("game_status_text"), (status == 2).alias("is_live"), (status == 3).alias("is_final"), (status == 1).alias("is_scheduled"),
        name(first).alias("home_leader_name"), first["points"].alias("home_leader_points"), name(second).alias("away_leader_name"), second["points"].alias("away_leader_points"),
        F.abs(hs - as_).alias("score_differential"), (hs + as_).alias("total_points"), F.when(hs > as_, "home").when(as_ > hs, "away").otherwise("tie").alias("winning_team"),
        F.concat(said(away), F.lit(" @ "), said(home)).alias("matchup"), F.concat_ws(" ", said(away), as_.cast("string"), F.lit("-"), said(home), hs.cast("string")).alias("display_score"),
    )


def by_time(games: DataFrame) -> DataFrame:
    return games.orderBy(F.try_to_timestamp("game_time_utc"))


def shown(games: DataFrame) -> DataFrame:
    """What a list of games shows: LIVE, Vs or @, then the score or the status text, and the time of games to come."""
    played = F.col("is_live") | F.col("is_final")
    return games.withColumns({
        "badge": F.when(F.col("is_live"), "LIVE").otherwise("@"), "middle": F.when(played, F.concat_ws(" - ", F.col("away_score").cast("string"), F.col("home_score").cast("string"))).otherwise(F.col("game_status_text")), "below": F.when(~played, F.col("game_time_et")),
    })
