"""Queries of the odds scans' parts: names cut from market names, list literals, strict pairs of runners."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.operators.feed import stat_of
from tallyspark.plans.registry import query
from tallyspark.sources.odds import STOPS, prop_type, strict_pair
from tallyspark.sources.tables import parquet as T


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN p_name ELSE p_name || ' ' || p_brand END AS player FROM part")
def take_until_stop(s, d):
    """The tokens before a stop word or a number."""
    k, size = F.col("p_size") % 3, F.col("p_size").cast("string")
    said = F.when(k == 0, F.concat_ws(" ", "p_name", F.lit("Points"), "p_brand", F.lit("O/U"))).when(k == 1, F.concat_ws("  ", "p_name", size, "p_brand")).otherwise(F.concat_ws(" ", "p_name", "p_brand"))
    return T(s, d, "part").select("p_partkey", S.until_stop(said, STOPS).alias("player"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 > 0 THEN p_name || ' - ' || p_type END AS player, CASE WHEN p_size % 4 > 0 THEN p_brand ELSE p_name END AS prop FROM part")
def rsplit_last(s, d):
    said = F.when(F.col("p_size") % 4 > 0, F.concat_ws(" - ", "p_name", "p_type", "p_brand")).otherwise(F.col("p_name"))
    return T(s, d, "part").select("p_partkey", S.before_last(said, " - ").alias("player"), F.substring_index(said, " - ", -1).alias("prop"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 0 ELSE 2 END AS n, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand || '|' || p_type END AS teams FROM part")
def list_literal(s, d):
    text = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).when(F.col("p_size") % 3 == 1, F.concat(F.lit("['"), "p_brand", F.lit("', '"), "p_type", F.lit("']"))).otherwise(F.concat(F.lit('["'), "p_brand", F.lit('", "'), "p_type", F.lit('"]')))
    return T(s, d, "part").select("p_partkey", F.size(S.listed(text)).alias("n"), F.array_join(S.listed(text), "|").alias("teams"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'stocks' WHEN p_size % 4 = 1 THEN 'points' WHEN p_size % 4 = 2 THEN 'unknown_prop' ELSE replace(lower(p_type || ' x'), ' ', '_') END AS prop, CASE WHEN p_size % 4 = 0 THEN 'steals' WHEN p_size % 4 = 1 THEN 'points' WHEN p_size % 4 = 2 THEN 'unknown_prop' ELSE replace(lower(p_type || ' x'), ' ', '_') END AS compat FROM part")
def prop_kind(s, d):
    """The key that a prop's name contains: the longest, or with compat the first in the table's order, so that steals and blocks are steals."""
    k = F.col("p_size") % 4
    said = F.when(k == 0, "Steals + Blocks").when(k == 1, "1st Qtr Points").when(k == 2, "").otherwise(F.concat("p_type", F.lit(" x")))
    return T(s, d, "part").select("p_partkey", prop_type(said).alias("prop"), prop_type(said, compat=True).alias("compat"))


@query("""SELECT user_id, day, max(CASE WHEN event_type = 'click' THEN value END) AS over_value, max(CASE WHEN event_type = 'view' THEN value END) AS under_value FROM (SELECT user_id, ts::DATE AS day, event_type, value FROM events)
GROUP BY user_id, day HAVING count(*) = 2 AND count(*) FILTER (event_type = 'click') = 1 AND count(*) FILTER (event_type = 'view') = 1""")
def market_pairs_strict(s, d):
    """Markets (a user's day) of exactly two runners, an over (click) and an under (view). More than two rows of a day are not gathered."""
    kind = F.when(F.col("event_type") == "click", "OVER").when(F.col("event_type") == "view", "UNDER")
    rows = T(s, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_id", "value", kind.alias("kind"))
    ends = rows.groupBy("user_id", "day").agg(F.count("*").alias("n"), F.min(F.struct("event_id", "value", "kind")).alias("a"), F.max(F.struct("event_id", "value", "kind")).alias("b")).where("n = 2")
    runner = lambda x: F.struct(F.struct(F.col(f"{x}.kind").alias("type")).alias("result"), F.col(f"{x}.value").alias("handicap"))
    over, under = strict_pair(F.array(runner("a"), runner("b")))
    return ends.select("user_id", "day", over["handicap"].alias("over_value"), under["handicap"].alias("under_value")).where("over_value is not null and under_value is not null")


@query("SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'TOV' WHEN 'view' THEN 'PTS' ELSE upper(event_type) END AS stat, CASE event_type WHEN 'click' THEN 'TURNOVERS' WHEN 'view' THEN 'PTS' ELSE upper(event_type) END AS compat FROM events")
def stat_keys(s, d):
    """The statistic of a prop; turnovers keep their own name with compat."""
    kind = F.col("event_type")
    prop = F.when(kind == "click", "turnovers").when(kind == "view", "points").otherwise(kind)
    return T(s, d, "events").select("user_id", "event_id", stat_of(prop).alias("stat"), stat_of(prop, compat=True).alias("compat"))
