"""The nested feed: a document for each player with statistics, log, zones and props by book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.scalars import number_or_zero
from tallyspark.operators.frames import last_write, latest, resolve, shares_to_hundred

#: A prop's name in the odds rows, and its statistic.
PROP_STATS = {"points": "pts", "rebounds": "reb", "assists": "ast", "threes": "fg3m", "steals": "stl", "blocks": "blk", "turnovers": "tov", "pra": "pts+reb+ast", "pr": "pts+reb", "pa": "pts+ast", "ra": "reb+ast", "stocks": "stl+blk"}
#: Statistics whose props are named otherwise in the rows as they are landed; they keep that name in upper case with `compat`.
LATER = ["turnovers"]
#: Combined statistics, and what they are sums of.
COMBOS = {"PTS+REB+AST": ["PTS", "REB", "AST"], "PTS+REB": ["PTS", "REB"], "PTS+AST": ["PTS", "AST"], "REB+AST": ["REB", "AST"], "STL+BLK": ["STL", "BLK"]}
PRICE = "struct<line: double, over: int, under: int, implied: double>"


def stat_of(prop: Column, compat: bool = False) -> Column:
    """The statistic of a prop, or its own name, in upper case. With `compat`, turnovers is TURNOVERS, which no look-up finds."""
    known = F.create_map(*(F.lit(x) for k, v in PROP_STATS.items() if not (compat and k in LATER) for x in (k, v)))
    return F.upper(F.coalesce(F.try_element_at(known, prop), prop))


def with_combos(rows: DataFrame) -> DataFrame:
    """Combined statistics that a table lacks, or that are null, from their parts (null parts: 0)."""
    def combo(name: str, parts: list[str]) -> Column:
        total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in parts), F.lit(0.0))
        return F.coalesce(F.col(f"`{name}`"), total) if name in rows.columns else total

    return rows.withColumns({k: combo(k, v) for k, v in COMBOS.items() if set(v) <= set(rows.columns)})


def zone_map(zones: DataFrame) -> DataFrame:
    """name and its zones as a map to whole percentages and makes, from (name, zone, ord, n, makes): of the zones' own sum, or of `total`, where
    there is such a column (a name whose total is 0 has no zones)."""
    shares = shares_to_hundred(zones, "name", "zone", F.col("ord"), F.col("n"), F.col("total") if "total" in zones.columns else None).join(zones.select("name", "zone", "makes"), ["name", "zone"])
    said = F.struct(F.concat(F.col("pct").cast("string"), F.lit("%")).alias("percentage"), F.col("makes").cast("long").cast("string").alias("makes"))
    return shares.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("zone", said))).alias("zones"))  # five or six zones a name


def props_map(odds: DataFrame, compat: bool = False) -> DataFrame:
    """player_id and props: statistic to book to price, of odds (player_id, prop_type, book, line, over_odds, under_odds, ord); the last row of a
    statistic and book counts."""
    rows = last_write(odds.withColumn("stat", stat_of(F.col("prop_type"), compat)), ["player_id", "stat", "book"], F.col("ord"))
    price = F.struct(F.col("line"), F.col("over_odds").alias("over"), F.col("under_odds").alias("under"), F.lit(0.0).alias("implied")).cast(PRICE)
    books = rows.groupBy("player_id", "stat").agg(F.map_from_entries(F.collect_list(F.struct("book", price))).alias("books"))
    return books.groupBy("player_id").agg(F.map_from_entries(F.collect_list(F.struct("stat", "books"))).alias("props"))


def price_of(props: Column, stat: str | Column, book: str | Column) -> Column:
    """line, over and under of a statistic in a book; 0 for none."""
    found = F.try_element_at(F.try_element_at(props, F.lit(stat) if isinstance(stat, str) else stat), F.lit(book) if isinstance(book, str) else book)
    return F.struct(*(F.coalesce(found[k], F.lit(0).cast(t)).alias(k) for k, t in (("line", "double"), ("over", "int"), ("under", "int"))))


def build(stats: DataFrame, logs: DataFrame, shooting: DataFrame, assists: DataFrame, odds: DataFrame, display: list[str], games: int = 35, compat: bool = False) -> DataFrame:
    """One row for each player (PLAYER_ID, PLAYER_NAME, TEAM_ABBREVIATION, ord and statistics) with props or games played (GP).

    logs: PLAYER_ID, GAME_DATE and more; the latest `games` stay. shooting (name, zones) is met by the raw name, assists (name, zones, ord) by the
    resolved one, the later name winning. odds: prop_id, player, team, team_options, prop_type, book, line, over_odds, under_odds, ord."""
    known = stats.select(F.col("PLAYER_ID").alias("player_id"), F.col("PLAYER_NAME").alias("name"), F.col("TEAM_ABBREVIATION").alias("team"), "ord")
    values = [number_or_zero(F.col(f"`{c}`").cast("string")) if c in stats.columns else F.lit(0.0) for c in display]
    base = stats.select(F.col("PLAYER_ID").alias("id"), F.col("PLAYER_NAME").alias("name"), F.col("TEAM_ABBREVIATION").alias("team"), F.map_from_arrays(F.array(*map(F.lit, display)), F.array(*values)).alias("stats"), F.coalesce("GP", F.lit(0)).alias("gp"))
    recent = latest(logs, "PLAYER_ID", [F.desc("GAME_DATE"), F.desc("GAME_ID")], games)
    row = F.struct("rn", F.struct(*(f"`{c}`" for c in logs.columns)).alias("game"))
    log = recent.groupBy(F.col("PLAYER_ID").alias("id")).agg(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["game"]).alias("game_log"))
    none = F.array().cast("array<string>")
    named = resolve(assists.select(F.col("name").alias("prop_id"), "name", F.lit("UNK").alias("team"), none.alias("team_options")), known)
    zones = last_write(named.join(assists.withColumnRenamed("name", "prop_id"), "prop_id"), ["player_id"], F.col("ord")).select(F.col("player_id").alias("id"), F.col("zones").alias("assist_zones"))
    priced = resolve(odds.select("prop_id", F.col("player").alias("name"), "team", "team_options"), known).join(odds, "prop_id")
    props = props_map(priced.select("player_id", "prop_type", "book", "line", "over_odds", "under_odds", "ord"), compat).withColumnRenamed("player_id", "id")
    met = base.join(log, "id", "left").join(shooting.select("name", F.col("zones").alias("shooting_zones")), "name", "left").join(zones, "id", "left").join(props, "id", "left")
    props_or_none = F.coalesce("props", F.create_map().cast(f"map<string, map<string, {PRICE}>>"))
    empty_log = F.array().cast(met.schema["game_log"].dataType)
    return met.where("props is not null or gp > 0").select("id", "name", "team", "stats", F.coalesce("game_log", empty_log).alias("game_log"), "shooting_zones", "assist_zones", props_or_none.alias("props"))
