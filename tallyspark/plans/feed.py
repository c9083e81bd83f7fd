"""Queries of the nested feed: maps of props by statistic and book, zones, and whole documents, flattened again for comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import feed
from tallyspark.operators import frames as O
from tallyspark.plans.registry import query
from tallyspark.sources import stats
from tallyspark.sources.tables import parquet as T

LAST = "(SELECT user_id, event_type, value, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1)"


def odds(s, d):
    """Events as odds: even users' are of book dk, and event types are props."""
    return T(s, d, "events").select(F.col("user_id").alias("player_id"), F.col("event_type").alias("prop_type"), F.when(F.col("event_id") % 2 == 0, "dk").otherwise("fd").alias("book"), F.col("value").alias("line"), F.lit(100).alias("over_odds"), F.lit(-110).alias("under_odds"), F.col("event_id").alias("ord"))


BOOKED = "(SELECT user_id, event_type, event_id % 2 = 0 AS dk, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, event_id % 2 ORDER BY event_id DESC) = 1)"


@query(f"SELECT user_id AS player_id, count(DISTINCT event_type) AS stats, coalesce(max(CASE WHEN event_type = 'click' AND dk THEN value END), 0) AS dk_click, coalesce(max(CASE WHEN event_type = 'view' AND NOT dk THEN value END), 0) AS fd_view, 0::DOUBLE AS none_line, CASE WHEN bool_or(event_type = 'click' AND dk) THEN 100 ELSE 0 END AS over FROM {BOOKED} GROUP BY user_id")
def props_nested(s, d):
    """The nested map, and look-ups of two levels in it with 0 for what is not there."""
    p = F.col("props")
    rows = feed.props_map(odds(s, d))
    dk = feed.price_of(p, "CLICK", "dk")
    return rows.select("player_id", F.size("props").cast("long").alias("stats"), dk["line"].alias("dk_click"), feed.price_of(p, "VIEW", "fd")["line"].alias("fd_view"), feed.price_of(p, "PTS", "dk")["line"].alias("none_line"), dk["over"].alias("over"))


@query(f"SELECT DISTINCT user_id AS c_custkey FROM {LAST} JOIN customer ON c_custkey = user_id WHERE event_type = 'purchase'")
def has_any(s, d):
    """Players of whom any prop is listed (here: of a purchase)."""
    props = feed.props_map(odds(s, d).where("prop_type = 'purchase'"))
    return T(s, d, "customer").select("c_custkey").join(props.withColumnRenamed("player_id", "c_custkey"), "c_custkey").where(F.size("props") > 0).select("c_custkey")


@query("""WITH g AS (SELECT o_custkey, count(*) FILTER (o_orderpriority = '1-URGENT') AS rim, count(*) FILTER (o_orderpriority = '2-HIGH') AS mid, count(*) FILTER (o_orderpriority = '3-MEDIUM') AS c3, count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) AS arc FROM orders GROUP BY 1),
z AS (SELECT o_custkey AS k, unnest([0, 1, 2, 3, 4]) AS o, unnest(['restricted_area', 'mid_range', 'left_corner', 'right_corner', 'top_key']) AS zone, unnest([rim::DOUBLE, mid::DOUBLE, c3 / 2, c3 / 2, arc::DOUBLE]) AS n FROM g),
f AS (SELECT *, n / sum(n) OVER (PARTITION BY k) * 100 AS raw FROM z), i AS (SELECT *, CAST(floor(raw) AS INTEGER) AS ip FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY raw - ip DESC, o) AS rk, 100 - sum(ip) OVER (PARTITION BY k) AS short FROM i)
SELECT k AS o_custkey, zone, CAST(ip + CASE WHEN rk <= short THEN 1 ELSE 0 END AS INTEGER) || '%' AS percentage, CAST(CAST(floor(n) AS BIGINT) AS VARCHAR) AS makes FROM r""")
def zone_halves(s, d):
    """Five zones, corner threes in halves, as whole percentages of 100 and makes cut to whole numbers."""
    count = lambda *kinds: F.sum(F.when(F.col("o_orderpriority").isin(*kinds), 1).otherwise(0))
    sums = T(s, d, "orders").groupBy(F.col("o_custkey").alias("name")).agg(count("1-URGENT").alias("rim"), count("2-HIGH").alias("mid"), count("3-MEDIUM").alias("corner3"), count("4-NOT SPECIFIED", "5-LOW").alias("arc3"))
    zones = sums.select("name", F.inline(stats.halves(*map(F.col, ("rim", "mid", "corner3", "arc3")))))
    return feed.zone_map(zones).select(F.col("name").alias("o_custkey"), F.explode("zones").alias("zone", "z")).select("o_custkey", "zone", "z.percentage", "z.makes")


@query("""WITH g AS (SELECT o_custkey, count(*) FILTER (o_orderpriority = '1-URGENT') AS rim, count(*) FILTER (o_orderpriority = '2-HIGH') AS mid, count(*) FILTER (o_orderpriority = '3-MEDIUM') AS c3, count(*) FILTER (o_orderpriority = '5-LOW') AS arc, count(*) FILTER (o_totalprice > 150000) + o_custkey % 5 AS total FROM orders GROUP BY 1),
z AS (SELECT o_custkey AS k, total, unnest([0, 1, 2, 3, 4]) AS o, unnest(['restricted_area', 'mid_range', 'left_corner', 'right_corner', 'top_key']) AS zone, unnest([rim::DOUBLE, mid::DOUBLE, c3 / 2, c3 / 2, arc::DOUBLE]) AS n FROM g WHERE total <> 0),
f AS (SELECT *, n / total::DOUBLE * 100 AS raw FROM z), i AS (SELECT *, CAST(floor(raw) AS INTEGER) AS ip FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY raw - ip DESC, o) AS rk, 100 - sum(ip) OVER (PARTITION BY k) AS short FROM i)
SELECT k AS o_custkey, zone, CAST(ip + CASE WHEN rk <= short THEN 1 ELSE 0 END AS INTEGER) || '%' AS percentage, CAST(CAST(floor(n) AS BIGINT) AS VARCHAR) AS makes FROM r""")
def assist_shares(s, d):
    """Five zones as percentages of a total of its own, which is over or under their sum."""
    count = lambda *kinds: F.sum(F.when(F.col("o_orderpriority").isin(*kinds), 1).otherwise(0))
    total = F.sum(F.when(F.col("o_totalprice") > 150000, 1).otherwise(0)) + F.first("o_custkey") % 5
    sums = T(s, d, "orders").groupBy(F.col("o_custkey").alias("name")).agg(count("1-URGENT").alias("rim"), count("2-HIGH").alias("mid"), count("3-MEDIUM").alias("corner3"), count("5-LOW").alias("arc3"), total.alias("total"))
    zones = sums.select("name", "total", F.inline(stats.halves(*map(F.col, ("rim", "mid", "corner3", "arc3")))))
    return feed.zone_map(zones).select(F.col("name").alias("o_custkey"), F.explode("zones").alias("zone", "z")).select("o_custkey", "zone", "z.percentage", "z.makes")


@query("""SELECT l_suppkey, ra + pa + mi + lc + rc + ab AS total, ra AS first_zone FROM (SELECT l_suppkey, sum(CASE WHEN l_linenumber = 1 THEN l_quantity ELSE 0 END) AS ra, sum(CASE WHEN l_linenumber = 2 THEN l_quantity ELSE 0 END) AS pa, sum(CASE WHEN l_linenumber = 3 THEN l_quantity ELSE 0 END) AS mi,
sum(CASE WHEN l_linenumber = 4 THEN l_quantity ELSE 0 END) AS lc, sum(CASE WHEN l_linenumber = 5 THEN l_quantity ELSE 0 END) AS rc, sum(CASE WHEN l_linenumber = 6 THEN l_quantity ELSE 0 END) AS ab FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-02-01' AND l_returnflag = 'R' GROUP BY 1) WHERE ra + pa + mi + lc + rc + ab <> 0""")
def zone_totals(s, d):
    """Attempts of six zones added up; rows without any go."""
    attempts = [F.sum(F.when(F.col("l_linenumber") == k, F.col("l_quantity")).otherwise(0.0)).alias(f"{z}_FGA") for k, z in enumerate(stats.SIX.values(), 1)]
    made = T(s, d, "lineitem").where("l_shipdate < timestamp_ntz '1995-02-01 00:00:00' and l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("PLAYER_NAME")).agg(*attempts)
    rows = stats.shooting_zones(made.withColumns({f"{z}_FGM": F.lit(0.0) for z in stats.SIX.values()}))
    return rows.groupBy(F.col("name").alias("l_suppkey")).agg(F.sum("n").alias("total"), F.max(F.when(F.col("ord") == 0, F.col("n"))).alias("first_zone"))


@query("SELECT l_suppkey AS name, l_linenumber AS team_id, round(sum(l_quantity), 2) AS n FROM lineitem GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_linenumber DESC) = 1")
def merge_last_team(s, d):
    """Sums of a name in several teams: the last team's stay."""
    sums = T(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("name"), F.col("l_linenumber").alias("team_id")).agg(F.round(F.sum("l_quantity"), 2).alias("n"))
    return stats.last_of(sums, ["name"], "team_id")


@query("SELECT n_nationkey AS nation, count(*) AS players, string_agg(c_custkey, ',' ORDER BY c_acctbal DESC, c_custkey) AS listed FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def players_under_game(s, d):
    """Each game's players as a list, and their number; games without any go. The list is the document that is asked for: as long as a game's
    players are many."""
    who = T(s, d, "customer").select(F.col("c_nationkey").alias("nation"), F.struct((-F.col("c_acctbal")).alias("by"), "c_custkey").alias("p"))
    games = who.groupBy("nation").agg(F.count("*").alias("players"), F.sort_array(F.collect_list("p")).alias("log"))
    return games.select("nation", "players", F.array_join(F.transform("log", lambda x: x["c_custkey"].cast("string")), ",").alias("listed"))


@query("SELECT user_id, round(avg(value - 40), 3) AS avg_diff, round(avg((value - 40) / 40 * 100), 2) AS avg_pct, round(avg(CASE WHEN value > 40 THEN 1.0::DOUBLE ELSE 0 END), 4) AS rate, count(*) AS n FROM events GROUP BY 1")
def similar_summary(s, d):
    diff = F.col("value") - 40
    rate = F.avg(F.when(diff > 0, 1.0).otherwise(0.0))
    return T(s, d, "events").groupBy("user_id").agg(F.round(F.avg(diff), 3).alias("avg_diff"), F.round(F.avg(diff / 40 * 100), 2).alias("avg_pct"), F.round(rate, 4).alias("rate"), F.count("*").alias("n"))


@query("""WITH log AS (SELECT o_custkey, count(*) AS n, arg_max(o_orderkey, (o_orderdate, o_orderkey::VARCHAR)) AS last FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey::VARCHAR DESC) <= 35) GROUP BY 1),
p AS (SELECT user_id, count(DISTINCT event_type) AS props, max(CASE WHEN event_type = 'click' AND dk THEN value END) AS dk_click FROM """ + BOOKED + """ GROUP BY 1)
SELECT c_custkey AS id, c_acctbal AS bal, coalesce(n, 0) AS games, last AS last_game, coalesce(props, 0) AS props, coalesce(dk_click, 0) AS dk_click FROM customer LEFT JOIN log ON o_custkey = c_custkey LEFT JOIN p ON user_id = c_custkey WHERE props IS NOT NULL OR c_acctbal > 0""")
def feed_documents(s, d):
    """The whole feed as nested documents: statistics, latest 35 games, zones, props of either book; flattened again."""
    who = T(s, d, "customer").select(F.col("c_custkey").alias("PLAYER_ID"), F.col("c_name").alias("PLAYER_NAME"), F.col("c_mktsegment").alias("TEAM_ABBREVIATION"), F.col("c_custkey").alias("ord"), F.col("c_acctbal").alias("GP"), F.col("c_acctbal").alias("BAL"))
    log = T(s, d, "orders").select(F.col("o_custkey").alias("PLAYER_ID"), F.col("o_orderdate").alias("GAME_DATE"), F.col("o_orderkey").cast("string").alias("GAME_ID"))
    no_zones = s.createDataFrame([], "name string, zones map<string, struct<percentage: string, makes: string>>, ord int")
    names = T(s, d, "customer").select(F.col("c_custkey").alias("player_id"), F.col("c_name").alias("player"))
    given = odds(s, d).join(names, "player_id").select(F.col("ord").alias("prop_id"), "player", F.lit("UNK").alias("team"), F.lit(None).cast("array<string>").alias("team_options"), "prop_type", "book", "line", "over_odds", "under_odds", "ord")
    docs = feed.build(who, log, no_zones, no_zones, given, ["BAL", "MISSING"])
    return docs.select("id", F.col("stats")["BAL"].alias("bal"), F.size("game_log").cast("long").alias("games"), F.get("game_log", F.lit(0))["GAME_ID"].cast("long").alias("last_game"), F.size("props").cast("long").alias("props"), feed.price_of(F.col("props"), "CLICK", "dk")["line"].alias("dk_click"))
