"""Odds rows from two books' landed JSON. Each landed file is one document; folders `prop_type=...` (book A) or `tab=...` (book B) tell the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.sources.tables import json_or_empty

BOOK_A = (
    "events array<struct<id: string, name: string, teamShortName1: string, teamShortName2: string, startEventDate: string>>, markets array<struct<id: string, name: string, eventId: string>>, "
    "selections array<struct<marketId: string, label: string, outcomeType: string, points: double, displayOdds: struct<american: string>>>"
)
BOOK_B_MAIN = "attachments struct<events: map<string, struct<eventId: string, name: string, openDate: string>>>"
BOOK_B_LAYOUT = "layout struct<tabs: map<string, struct<title: string>>>"
BOOK_B_TAB = (
    "attachments struct<markets: map<string, struct<marketName: string, runners: array<struct<result: struct<type: string>, handicap: double, secondaryLogo: string, "
    "winRunnerOdds: struct<americanDisplayOdds: struct<americanOdds: string>>>>>>>"
)

#: Words that end a player's name in a market's name.
STOPS = ["Points", "Rebounds", "Assists", "Threes", "Three", "Pointers", "Pointer", "3-Point", "Steals", "Blocks", "Turnovers", "O/U", "+", "Made"]
#: Tabs that hold no player props.
NO_PROPS = [
    "game-lines", "popular", "odds", "same-game-parlay", "quick-bets", "half", "quarter", "4th-quarter", "1st-quarter", "2nd-quarter", "3rd-quarter", "total-parlays", "team-props",
    "race-to", "margin", "parlays", "teasers", "featured", "live-sgp", "same-game-parlay™",
]
#: What a prop's name contains, in the order in which it is looked for.
PROP_TYPES = {
    "points": "points", "rebounds": "rebounds", "assists": "assists", "made threes": "threes", "3-point": "threes", "steals": "steals", "blocks": "blocks", "turnovers": "turnovers",
    "pts + reb + ast": "pra", "pts + reb": "pr", "pts + ast": "pa", "reb + ast": "ra", "steals + blocks": "stocks",
}
#: What a team's logo contains, in the order in which it is looked for.
TEAMS = {
    "hawks": "ATL", "celtics": "BOS", "nets": "BKN", "hornets": "CHA", "bulls": "CHI", "cavaliers": "CLE", "mavericks": "DAL", "nuggets": "DEN", "pistons": "DET", "warriors": "GSW",
    "rockets": "HOU", "pacers": "IND", "clippers": "LAC", "lakers": "LAL", "grizzlies": "MEM", "heat": "MIA", "bucks": "MIL", "timberwolves": "MIN", "pelicans": "NOP", "knicks": "NYK",
    "thunder": "OKC", "magic": "ORL", "sixers": "PHI", "76ers": "PHI", "suns": "PHX", "blazers": "POR", "trail_blazers": "POR", "kings": "SAC", "spurs": "SAS", "raptors": "TOR",
    "jazz": "UTA", "wizards": "WAS",
}


def longest_first(table: dict[str, str]) -> dict[str, str]:
    """The table with longer keys first, so that none is hidden by a key that it contains."""
    return dict(sorted(table.items(), key=lambda kv: -len(kv[0])))


def team_of(logo: Column, teams: dict[str, str] = TEAMS, compat: bool = False) -> Column:
    """The team whose name is in the last part of a logo's address; UNK for none. With `compat`, names are looked for in the table's order, in
    which nets comes before hornets."""
    teams = teams if compat else longest_first(teams)
    slug = F.lower(F.replace(F.replace(F.element_at(F.split(logo, "/"), -1), F.lit(".png"), F.lit("")), F.lit("_jersey"), F.lit("")))
    return F.coalesce(S.first_contained(slug, teams, F.lit("UNK")), F.lit("UNK"))


def prop_type(said: Column, table: dict[str, str] = PROP_TYPES, compat: bool = False) -> Column:
    """The prop that a market's name contains, or that name. With `compat`, names are looked for in the table's order, in which steals comes before
    steals + blocks."""
    table = table if compat else longest_first(table)
    low = F.lower(F.trim(said))
    return F.when(F.coalesce(said, F.lit("")) == "", F.lit("unknown_prop")).otherwise(S.first_contained(low, table, F.replace(low, F.lit(" "), F.lit("_"))))


def new_york_day(utc: Column, as_of: str) -> Column:
    """The New York day of an ISO time; `as_of` for none or another text. The text's own offset counts, Z for none."""
    plain = F.regexp_replace(utc, r"(Z|[+-]\d\d:\d\d)$", "")
    offset = F.regexp_extract(utc, r"([+-]\d\d:\d\d)$", 1)
    sign, hours, minutes = (F.regexp_extract(offset, r"([+-])(\d\d):(\d\d)", k) for k in (1, 2, 3))
    minutes_off = F.when(offset == "", 0).otherwise((hours.try_cast("int") * 60 + minutes.try_cast("int")) * F.when(sign == "-", -1).otherwise(1))
    at = plain.try_cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), minutes_off)
    return F.coalesce(F.date_format(F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), at), "yyyy-MM-dd"), F.lit(as_of))


def read_book_a(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a folder with a subfolder `prop_type=...` for each category; a missing folder: none."""
    return json_or_empty(spark, path, BOOK_A, "prop_type")


def _last_of_each(docs: DataFrame, name: str, entries: Column) -> DataFrame:
    """docs with `name`, a map from id to the last of a list's entries (id, at, ...) with it. Sorted, an id's last entry is the one before another id."""
    docs = docs.withColumn(name, F.array_sort(entries))
    last = F.filter(name, lambda x, i: (i == F.size(name) - 1) | (F.get(F.col(name), i + 1)["id"] != x["id"]))
    return docs.withColumn(name, F.map_from_entries(F.transform(last, lambda x: F.struct(x["id"], x))))


def book_a(docs: DataFrame, as_of: str) -> DataFrame:
    """Odds rows of book A's documents (with prop_type): markets with an over and an under selection; of several, the last of each counts.

    All of it happens inside the document: its selections and events become maps, in which each market looks up its own, so nothing is shuffled."""
    says = lambda s, word: F.contains(F.lower(F.coalesce(s["label"], F.lit(""))), F.lit(word)) | F.contains(F.lower(F.coalesce(s["outcomeType"], F.lit(""))), F.lit(word))
    side = F.transform("selections", lambda s, i: F.struct(s["marketId"].alias("id"), i.alias("at"), s["points"].alias("line"), s["displayOdds"]["american"].alias("odds"), F.when(says(s, "over"), "over").when(says(s, "under"), "under").alias("side")))
    docs = docs.select("prop_type", "markets", "events", F.filter(side, lambda x: x["id"] != "").alias("sides"))
    for which in ("over", "under"):
        docs = _last_of_each(docs, which, F.filter("sides", lambda x: x["side"] == which))
    docs = _last_of_each(docs, "games", F.transform(F.filter("events", lambda e: e["id"].isNotNull()), lambda e, i: F.struct(e["id"].alias("id"), i.alias("at"), e.alias("e"))))
    both = F.filter("markets", lambda m: F.map_contains_key("over", F.coalesce(m["id"], F.lit(""))) & F.map_contains_key("under", F.coalesce(m["id"], F.lit(""))))
    # asked for its size too, the map of games is made once for the document, not for each market
    game = lambda m: F.when(F.size("games") > 0, F.try_element_at("games", F.coalesce(m["eventId"], F.lit(""))))
    met = F.transform(both, lambda m: F.struct(m["name"].alias("name"), F.try_element_at("over", m["id"]).alias("over"), F.try_element_at("under", m["id"]).alias("under"), game(m)["e"].alias("e")))
    rows = docs.select("prop_type", F.inline(met)).where("over.line is not null")
    team = lambda k: F.coalesce(f"e.teamShortName{k}", F.lit("UNK"))
    return rows.select(
        S.light_name(S.until_stop(F.coalesce("name", F.lit("")), STOPS)).alias("player"), F.lit("Unknown").alias("team"), F.array(team(1), team(2)).alias("team_options"), "prop_type", F.col("over.line").alias("line"),
        S.american_odds(F.col("over.odds")).alias("over_odds"), S.american_odds(F.col("under.odds")).alias("under_odds"), F.coalesce("e.name", F.lit("Unknown")).alias("game"),
        new_york_day(F.col("e.startEventDate"), as_of).alias("game_date"), F.lit("draftkings").alias("sportsbook"),
    )


def read_book_b_main(spark: SparkSession, path: str) -> DataFrame:
    """event_id, game and open_date of the events on the main page."""
    found = json_or_empty(spark, path, BOOK_B_MAIN).select(F.explode("attachments.events").alias("key", "e"))
    return found.select(F.col("e.eventId").alias("event_id"), F.col("e.name").alias("game"), F.col("e.openDate").alias("open_date"))


def upcoming(events: DataFrame, as_of: str) -> DataFrame:
    """Events whose open date is the day `as_of` or the next one."""
    days = F.array(F.lit(as_of), F.date_add(F.lit(as_of).cast("date"), 1).cast("string"))
    return events.where(F.exists(days, lambda day: F.contains("open_date", day)))


def read_book_b_tabs(spark: SparkSession, path: str) -> DataFrame:
    """event_id (a folder), name and title of the tabs with player props."""
    found = json_or_empty(spark, path, BOOK_B_LAYOUT, "event_id").select("event_id", F.explode("layout.tabs").alias("key", "t"))
    name = F.replace(F.lower(F.coalesce("t.title", F.lit(""))), F.lit(" "), F.lit("-"))
    return found.select("event_id", name.alias("name"), F.col("t.title").alias("title")).where(~F.col("name").isin(*NO_PROPS))


def read_book_b(spark: SparkSession, path: str) -> DataFrame:
    """Tab pages of a folder with a subfolder `event_id=...` for each event."""
    return json_or_empty(spark, path, BOOK_B_TAB, "event_id")


def strict_pair(runners: Column) -> tuple[Column, Column]:
    """The first over and the first under of exactly two runners; null otherwise."""
    of = lambda which: F.when(F.size(runners) == 2, F.get(F.filter(runners, lambda r: r["result"]["type"] == which), F.lit(0)))
    return of("OVER"), of("UNDER")


def book_b(pages: DataFrame, events: DataFrame, as_of: str, compat: bool = False) -> DataFrame:
    """Odds rows of book B's tab pages (with event_id): markets of exactly two runners, an over and an under one, named `player - prop`. An odds
    text that is no whole number is null."""
    over, under = strict_pair(F.col("m.runners"))
    markets = pages.select("event_id", F.explode("attachments.markets").alias("key", "m")).where(F.contains("m.marketName", F.lit(" - "))).select("event_id", "m", over.alias("over"), under.alias("under"))
    odds = lambda side: F.col(f"{side}.winRunnerOdds.americanDisplayOdds.americanOdds")
    kept = markets.where(F.col("under").isNotNull() & F.col("over.handicap").isNotNull() & odds("over").isNotNull()).join(events.select("event_id", "game"), "event_id")
    name = F.col("m.marketName")
    return kept.select(
        S.light_name(S.before_last(name, " - ")).alias("player"), team_of(F.col("over.secondaryLogo"), compat=compat).alias("team"), F.lit(None).cast("array<string>").alias("team_options"), prop_type(F.substring_index(name, " - ", -1), compat=compat).alias("prop_type"),
        F.col("over.handicap").alias("line"), odds("over").try_cast("int").alias("over_odds"), odds("under").try_cast("int").alias("under_odds"), "game", F.lit(as_of).alias("game_date"), F.lit("fanduel").alias("sportsbook"),
    )
