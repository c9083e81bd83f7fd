"""Season statistics, game logs, tracking measures and zones from landed files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.scalars import guarded_ratio
from tallyspark.sources.tables import csv_or_empty, json_or_empty, positional, result_set

#: The game log's columns.
LOG = (
    "SEASON_ID string, PLAYER_ID bigint, PLAYER_NAME string, TEAM_ID bigint, TEAM_ABBREVIATION string, TEAM_NAME string, GAME_ID string, GAME_DATE date, MATCHUP string, WL string, MIN double, FGM double, FGA double, FG_PCT double, "
    "FG3M double, FG3A double, FG3_PCT double, FTM double, FTA double, FT_PCT double, OREB double, DREB double, REB double, AST double, STL double, BLK double, TOV double, PF double, PTS double, PLUS_MINUS double, FANTASY_PTS double"
)
#: What each measure of the tracking feed gives.
MEASURES = {"Passing": ["POTENTIAL_AST", "AST_POINTS_CREATED"], "Rebounding": ["REB_CHANCES", "REB_CONTEST_PCT"], "Drives": ["DRIVES", "DRIVE_PTS", "DRIVE_PASSES"]}
#: The shooting feed's columns, by place.
SHOOTING_IDS = ["PLAYER_ID", "PLAYER_NAME", "TEAM_ID", "TEAM_ABBREVIATION", "AGE", "NICKNAME"]
SHOOTING_ZONES = ["RA", "PAINT", "MID", "LC3", "RC3", "AB3", "BC", "C3"]
#: Zones by their names in the result, in the order in which ties are broken.
SIX = {"restricted_area": "RA", "paint": "PAINT", "mid_range": "MID", "left_corner": "LC3", "right_corner": "RC3", "top_key": "AB3"}
FIVE = ["restricted_area", "mid_range", "left_corner", "right_corner", "top_key"]


def game_log(spark: SparkSession, path: str) -> DataFrame:
    """The log with DATE_STR, newest first."""
    return csv_or_empty(spark, path, LOG).withColumn("DATE_STR", F.date_format("GAME_DATE", "MM/dd/yyyy")).orderBy(F.desc("GAME_DATE"), "PLAYER_ID", "GAME_ID")


def tracking(spark: SparkSession, path: str) -> DataFrame:
    """PLAYER_ID and DATE_STR with all measures, from folders `measure=.../day=yyyy-MM-dd`: a full outer join of the measures."""
    parts = [result_set(spark, f"{path}/measure={m}", {"PLAYER_ID": "bigint", **dict.fromkeys(cols, "double")}, "day") for m, cols in MEASURES.items()]
    return reduce(lambda a, b: a.join(b, ["PLAYER_ID", "day"], "full"), parts).withColumn("DATE_STR", F.date_format(F.col("day").try_cast("date"), "MM/dd/yyyy")).drop("day")


def shooting(spark: SparkSession, path: str) -> DataFrame:
    """The shooting feed {resultSets: {headers: [.., {columnNames}], rowSet}}: columns by place, as names repeat. Rows of another width go."""
    docs = json_or_empty(spark, path, "resultSets struct<headers: array<struct<columnNames: array<string>>>, rowSet: array<array<string>>>")
    names = SHOOTING_IDS + [f"{z}_{x}" for z in SHOOTING_ZONES for x in ("FGM", "FGA", "PCT")]
    rows = positional(docs.select(F.explode("resultSets.rowSet").alias("r")), "r", names, {"PLAYER_NAME": "string", "TEAM_ABBREVIATION": "string", "NICKNAME": "string", "PLAYER_ID": "bigint", "TEAM_ID": "bigint"})
    return rows.na.fill(0)


def shooting_zones(rows: DataFrame) -> DataFrame:
    """name and its six zones' attempts and makes (name, zone, ord, n, makes); players without an attempt go, of a repeated name the last row."""
    total = sum((F.col(f"{z}_FGA") for z in SIX.values()), F.lit(0.0))
    zone = F.array(*(F.struct(F.lit(k).alias("zone"), F.lit(i).alias("ord"), F.col(f"{z}_FGA").alias("n"), F.col(f"{z}_FGM").alias("makes")) for i, (k, z) in enumerate(SIX.items())))
    kept = rows.where(total != 0).select(F.col("PLAYER_NAME").alias("name"), F.monotonically_increasing_id().alias("at"), zone.alias("zones"))
    last = kept.groupBy("name").agg(F.max(F.struct("at", "zones"))["zones"].alias("zones"))
    return last.select("name", F.inline("zones"))


def assists(spark: SparkSession, path: str) -> DataFrame:
    """Links of the assist graph, from folders `team_id=...`, with the source's name: its node's, or its id as text."""
    schema = "results struct<nodes: array<struct<id: string, name: string>>, links: array<struct<source: string, value: double, AtRim: double, ShortMidRange: double, LongMidRange: double, Corner3: double, Arc3: double>>>"
    docs = json_or_empty(spark, path, schema, "team_id").select("team_id", "results.*")
    nodes = docs.select("team_id", F.explode("nodes").alias("n")).groupBy("team_id", F.col("n.id").alias("source")).agg(F.max("n.name").alias("name"))
    links = docs.select("team_id", F.explode("links").alias("l")).select("team_id", "l.*")
    return links.join(nodes, ["team_id", "source"], "left").withColumn("name", F.coalesce("name", "source"))


def assist_totals(links: DataFrame) -> DataFrame:
    """Sums by player; of a player in several teams the last team's count (the largest team_id)."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    sums = links.groupBy("name", "team_id").agg(F.sum(zero("AtRim")).alias("rim"), F.sum(zero("ShortMidRange") + zero("LongMidRange")).alias("mid"), F.sum(zero("Corner3")).alias("corner3"), F.sum(zero("Arc3")).alias("arc3"), F.sum(zero("value")).alias("total"))
    return last_of(sums, ["name"], "team_id")


def last_of(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of the rows of a key, the one that is last by `order`."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max(F.struct(order, *(c for c in rest if c != order))).alias("r")).select(*key, *(F.col(f"r.{c}").alias(c) for c in rest))


def halves(rim: Column, mid: Column, corner3: Column, arc3: Column) -> Column:
    """The five zones of assists as (zone, ord, n, makes): corner threes in equal halves, the left one first in ties."""
    values = [rim, mid, corner3 / 2, corner3 / 2, arc3]
    return F.array(*(F.struct(F.lit(z).alias("zone"), F.lit(i).alias("ord"), v.cast("double").alias("n"), v.cast("double").alias("makes")) for i, (z, v) in enumerate(zip(FIVE, values, strict=True))))


def assist_zones(links: DataFrame) -> DataFrame:
    """name and its five zones' makes (name, zone, ord, n, makes) with the links' own total, of which shares are taken."""
    five = halves(*(F.col(c) for c in ("rim", "mid", "corner3", "arc3")))
    return assist_totals(links).select("name", "total", F.inline(five))


#: The season table's columns, and what each tracking feed adds.
SEASON = "PLAYER_ID TEAM_ID PLAYER_NAME TEAM_ABBREVIATION AGE GP MIN PTS REB AST STL BLK TOV FG3M OREB DREB DD2 TD3 FGM FGA FG3A FTM FTA PF PFD PLUS_MINUS FG_PCT FG3_PCT FT_PCT".split()
SEASON_TRACKING = {"Passing": ["POTENTIAL_AST", "PASSES_MADE"], "Drives": ["DRIVES", "DRIVE_PTS"], "Rebounding": ["REB_CHANCES", "REB_CONTEST_PCT"]}


def season(base: DataFrame, tracking: dict[str, DataFrame]) -> DataFrame:
    """The season table: base's columns that are in `SEASON`, the tracking feeds' by player and team, ratios and the additive score. Nulls are 0;
    of a feed that is missing, all its columns are. Without base rows there are none."""
    rows = base.select([c for c in SEASON if c in base.columns])
    keys = ["PLAYER_ID", "TEAM_ID"]
    for feed, cols in SEASON_TRACKING.items():
        found = tracking.get(feed)
        rows = rows.withColumns({c: F.lit(None).cast("double") for c in cols}) if found is None else rows.join(found.select(*keys, *cols), keys, "left")
    rows = rows.na.fill(0)
    zero = lambda c: F.col(c) if c in rows.columns else F.lit(0.0)
    ratios = {"AST_CONVERSION_PCT": guarded_ratio(zero("AST"), zero("POTENTIAL_AST")), "REB_HUSTLE_PCT": guarded_ratio(zero("REB"), zero("REB_CHANCES"))}
    return rows.withColumns(ratios | {"AGGRESSION_SCORE": zero("FGA") + zero("FTA") + zero("DRIVES")})


def read_season(spark: SparkSession, path: str) -> DataFrame:
    """The season table from landed folders `measure=Base`, `measure=Passing` and so on."""
    kinds = {"PLAYER_ID": "bigint", "TEAM_ID": "bigint", "PLAYER_NAME": "string", "TEAM_ABBREVIATION": "string"}
    base = result_set(spark, f"{path}/measure=Base", {c: kinds.get(c, "double") for c in SEASON})
    feeds = {m: result_set(spark, f"{path}/measure={m}", {"PLAYER_ID": "bigint", "TEAM_ID": "bigint", **dict.fromkeys(cols, "double")}) for m, cols in SEASON_TRACKING.items()}
    return season(base, feeds)
