"""Small inline tables: team ids, and a panel's sample rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Team codes and ids.
TEAM_IDS = {
    "ATL": 1610612737, "BOS": 1610612738, "BKN": 1610612751, "CHA": 1610612766, "CHI": 1610612741, "CLE": 1610612739, "DAL": 1610612742, "DEN": 1610612743, "DET": 1610612765, "GSW": 1610612744,
    "HOU": 1610612745, "IND": 1610612754, "LAC": 1610612746, "LAL": 1610612747, "MEM": 1610612763, "MIA": 1610612748, "MIL": 1610612749, "MIN": 1610612750, "NOP": 1610612740, "NYK": 1610612752,
    "OKC": 1610612760, "ORL": 1610612753, "PHI": 1610612755, "PHX": 1610612756, "POR": 1610612757, "SAC": 1610612758, "SAS": 1610612759, "TOR": 1610612761, "UTA": 1610612762, "WAS": 1610612764,
}
#: Date, team, player, line, result, difference in percent.
SIMILAR_GAMES = [
    ("Jan 19", "Pacers", "P. Siakam", 23.5, 24.0, 2), ("Jan 12", "Raptors", "S. Barnes", 18.5, 15.0, -19), ("Jan 11", "Raptors", "S. Barnes", 20.5, 31.0, 51), ("Dec 30", "Grizzlies", "J. Jackson Jr.", 19.5, 15.0, -23),
    ("Dec 14", "Hawks", "J. Johnson", 24.5, 12.0, -51), ("Dec 12", "Pacers", "P. Siakam", 23.5, 20.0, -15), ("Nov 30", "Hawks", "J. Johnson", 23.5, 41.0, 74), ("Nov 25", "Magic", "F. Wagner", 25.5, 21.0, -18),
]


def team_ids(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEAM_IDS.items()), "team string, team_id bigint")


def similar_games(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SIMILAR_GAMES, "date string, team string, player string, line double, result double, diff_percent int")


def diff_percent(line: Column, result: Column) -> Column:
    """How far a result is from its line, in whole percents."""
    return F.round((result - line) / line * 100).cast("int")
