"""Queries of landed documents: odds inside a document, values beyond a schema, files written and read back, the season table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.plans.registry import query
from tallyspark.sources import feed_files, landing, odds, stats
from tallyspark.sources.tables import parquet as T
from tallyspark.sources.tables import scratch


@query("""WITH s AS (SELECT user_id, ts::DATE AS day, hour(ts) // 6 AS market, event_id, event_type, value FROM events),
m AS (SELECT user_id, day, market, arg_max(value, event_id) FILTER (event_type = 'click') AS line, count(*) FILTER (event_type = 'view') AS views FROM s GROUP BY ALL)
SELECT user_id::VARCHAR AS prop_type, line, 105 AS over_odds, -110 AS under_odds, CASE market WHEN 0 THEN 'game 0' WHEN 1 THEN 'game 1' ELSE 'Unknown' END AS game FROM m WHERE line IS NOT NULL AND views > 0""")
def odds_in_documents(s, d):
    """A user's day as a document of book A: quarters of the day are markets, clicks are over and views under selections, two quarters have a game."""
    ev = T(s, d, "events").select("user_id", F.to_date("ts").alias("day"), F.floor(F.hour("ts") / 6).cast("string").alias("market"), "event_id", "event_type", "value")
    label = F.when(F.col("event_type") == "click", "Over").when(F.col("event_type") == "view", "Under").otherwise("x")
    price = F.when(F.col("event_type") == "click", "+105").otherwise("−110")
    selection = F.struct(F.col("market").alias("marketId"), label.alias("label"), F.lit(None).cast("string").alias("outcomeType"), F.col("value").alias("points"), F.struct(price.alias("american")).alias("displayOdds"))
    docs = ev.groupBy("user_id", "day").agg(F.sort_array(F.collect_list(F.struct("event_id", selection.alias("s")))).alias("all"), F.collect_set("market").alias("m"))
    markets = F.transform("m", lambda m: F.struct(m.alias("id"), F.lit("A Player Points").alias("name"), F.concat(F.lit("e"), m).alias("eventId")))
    game = lambda k: F.struct(F.lit(f"e{k}").alias("id"), F.lit(f"game {k}").alias("name"), F.lit("AAA").alias("teamShortName1"), F.lit("BBB").alias("teamShortName2"), F.lit(None).cast("string").alias("startEventDate"))
    whole = docs.select(F.col("user_id").cast("string").alias("prop_type"), F.array(game(0), game(1)).alias("events"), markets.alias("markets"), F.transform("all", lambda x: x["s"]).alias("selections"))
    return odds.book_a(whole, "2024-01-01").select("prop_type", "line", "over_odds", "under_odds", "game")


@query("""WITH t AS (SELECT event_type, CASE WHEN event_id % 7 = 0 THEN left(props, length(props) - 1) ELSE props END AS text FROM events)
SELECT event_type, count(*) AS files, count(*) FILTER (json_valid(text)) AS good, count(*) FILTER (NOT json_valid(text)) AS bad, coalesce(sum(CASE WHEN json_valid(text) THEN CAST(json_extract_string(text, '$.k') AS BIGINT) END), 0)::BIGINT AS k FROM t GROUP BY 1""")
def variant_values(s, d):
    """Texts that parse and those that don't, and the sum of a key that no schema names."""
    cut = F.when(F.col("event_id") % 7 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    docs = T(s, d, "events").select("event_type", F.try_parse_json(cut).alias("doc"))
    k = F.sum(landing.value("doc", "$.k", "bigint", 0))
    return docs.groupBy("event_type").agg(F.count("*").alias("files"), F.count("doc").alias("good"), F.sum(F.col("doc").isNull().cast("long")).alias("bad"), k.alias("k"))


@query("SELECT c_custkey AS id, c_name AS name, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS team, n_all, n_live FROM customer, (SELECT count(*) AS n_all, count(*) FILTER (c_acctbal > 0) AS n_live FROM customer)")
def arrays_round_trip(s, d):
    """Documents written as JSON arrays and read back, with what the run that wrote them has counted."""
    who = T(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("team"))
    path = scratch(s, "arrays")
    seen = feed_files.write_arrays(who, path, files=16, totals={"live": F.count("team")})
    return feed_files.read_arrays(s, path, "id bigint, name string, team string").select("*", F.lit(seen["rows"]).cast("long").alias("n_all"), F.lit(seen["live"]).cast("long").alias("n_live"))


@query("""WITH b AS (SELECT l_suppkey AS p, l_linenumber AS t, count(*) AS ast, count(*) FILTER (l_returnflag = 'R') AS reb, count(*) FILTER (l_returnflag = 'A') AS fga FROM lineitem GROUP BY ALL),
q AS (SELECT l_suppkey AS p, l_linenumber AS t, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY ALL)
SELECT p AS "PLAYER_ID", t::BIGINT AS "TEAM_ID", coalesce(n, 0)::DOUBLE AS "POTENTIAL_AST", CASE WHEN n > 0 THEN round(ast / n::DOUBLE, 3) ELSE 0 END AS "AST_CONVERSION_PCT", 0::DOUBLE AS "REB_HUSTLE_PCT", (fga + coalesce(n, 0))::DOUBLE AS "AGGRESSION_SCORE" FROM b LEFT JOIN q USING (p, t)""")
def season_table(s, d):
    """Base rows with two of the three tracking feeds, one of them for some keys only: ratios and the additive score."""
    li = T(s, d, "lineitem").select(F.col("l_suppkey").alias("PLAYER_ID"), F.col("l_linenumber").cast("long").alias("TEAM_ID"), "l_returnflag", "l_quantity")
    flag = lambda x: F.sum(F.when(F.col("l_returnflag") == x, 1.0).otherwise(0.0))
    base = li.groupBy("PLAYER_ID", "TEAM_ID").agg(F.count("*").cast("double").alias("AST"), flag("R").alias("REB"), flag("A").alias("FGA"))
    some = li.where("l_quantity > 45").groupBy("PLAYER_ID", "TEAM_ID").agg(F.count("*").cast("double").alias("n"))
    feeds = {"Passing": some.select("PLAYER_ID", "TEAM_ID", F.col("n").alias("POTENTIAL_AST"), F.col("n").alias("PASSES_MADE")), "Drives": some.select("PLAYER_ID", "TEAM_ID", F.col("n").alias("DRIVES"), F.col("n").alias("DRIVE_PTS"))}
    return stats.season(base, feeds).select("PLAYER_ID", "TEAM_ID", "POTENTIAL_AST", "AST_CONVERSION_PCT", "REB_HUSTLE_PCT", "AGGRESSION_SCORE")
