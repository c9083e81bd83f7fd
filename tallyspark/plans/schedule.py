"""Queries of the schedule: games as nested rows, flattened; days, windows and points in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.operators import frames as O
from tallyspark.plans.registry import query
from tallyspark.sources import schedule
from tallyspark.sources.tables import parquet as T

DAY = "2024-01-15"


def games(s, d):
    """Each nation at home against the next one, with its customers' number as the score, every third game live and every third final."""
    n = T(s, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").cast("int").alias("score"))
    nation = T(s, d, "nation").select("n_nationkey", "n_name").join(n, "n_nationkey", "left")
    team = lambda x: F.struct(F.col(f"{x}.n_nationkey").cast("bigint").alias("teamId"), F.col(f"{x}.n_name").alias("teamName"), F.lit(None).cast("string").alias("teamCity"), F.col(f"{x}.n_name").alias("teamTricode"), F.lit(0).alias("wins"), F.lit(None).cast("int").alias("losses"), F.col(f"{x}.score").alias("score"))
    h, a = nation.alias("h"), nation.alias("a")
    key = F.col("h.n_nationkey")
    leader = lambda x, who: F.struct(F.col(f"{x}.n_name").alias("teamTricode"), F.lit(who).alias("firstName"), F.col(f"{x}.n_name").alias("lastName"), F.col(f"{x}.score").cast("double").alias("points"))
    return h.join(a, F.col("a.n_nationkey") == (key + 1) % 25).select(
        key.cast("string").alias("gameId"), F.lit("code").alias("gameCode"), (key % 3 + 1).alias("gameStatus"), F.when(key % 2 == 0, "7:00 pm").alias("gameStatusText"), F.lit(f"{DAY}T00:30:00Z").alias("gameDateTimeUTC"),
        F.when(key % 4 == 0, "soon").otherwise(F.concat(F.lit(f"{DAY}T"), F.lpad((key % 24).cast("string"), 2, "0"), F.lit(":30:00Z"))).alias("gameDateTimeEst"), F.when(key % 5 > 0, F.col("h.n_name")).alias("arenaName"),
        F.lit("C").alias("arenaCity"), F.lit(None).cast("string").alias("arenaState"), F.array(leader("h", "A"), leader("a", "B"), leader("h", "C")).alias("pointsLeaders"), team("h").alias("homeTeam"), team("a").alias("awayTeam"),
    )


@query(f"""WITH n AS (SELECT n_nationkey AS k, n_name AS name, CAST(coalesce(c, 0) AS INTEGER) AS score FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) ON c_nationkey = n_nationkey),
g AS (SELECT h.k, h.name AS hn, a.name AS an, h.score AS hs, a.score AS aws, h.k % 3 + 1 AS st FROM n h JOIN n a ON a.k = (h.k + 1) % 25)
SELECT CAST(k AS VARCHAR) AS game_id, hn AS home_team_tricode, an AS away_team_tricode, hs AS home_score, aws AS away_score, CASE WHEN k % 5 > 0 THEN hn ELSE 'Unknown Arena' END || ', C, Unknown State' AS arena_full,
CASE WHEN k % 4 = 0 THEN 'soon' ELSE lpad(CAST((k % 24 + 11) % 12 + 1 AS VARCHAR), 2, '0') || ':30 ' || CASE WHEN k % 24 < 12 THEN 'AM' ELSE 'PM' END || ' ET' END AS game_time_et, CASE WHEN k % 4 > 0 THEN '{DAY}' END AS game_date, CASE WHEN k % 4 > 0 THEN strftime(DATE '{DAY}', '%A') END AS game_weekday,
st = 2 AS is_live, st = 3 AS is_final, st = 1 AS is_scheduled, 'C ' || hn AS home_leader_name, 'B ' || an AS away_leader_name, abs(hs - aws) AS score_differential, hs + aws AS total_points, CASE WHEN hs > aws THEN 'home' WHEN aws > hs THEN 'away' ELSE 'tie' END AS winning_team,
an || ' @ ' || hn AS matchup, an || ' ' || aws || ' - ' || hn || ' ' || hs AS display_score FROM g""")
def matchup_flatten(s, d):
    return schedule.flatten(games(s, d)).select(
        "game_id", "home_team_tricode", "away_team_tricode", "home_score", "away_score", "arena_full", "game_time_et", "game_date", "game_weekday", "is_live", "is_final", "is_scheduled", "home_leader_name", "away_leader_name",
        "score_differential", "total_points", "winning_team", "matchup", "display_score",
    )


@query("""WITH n AS (SELECT n_nationkey AS k, CAST(coalesce(c, 0) AS INTEGER) AS score FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) ON c_nationkey = n_nationkey)
SELECT CAST(h.k AS VARCHAR) AS game_id, CASE WHEN h.k % 3 = 1 THEN 'LIVE' ELSE '@' END AS badge, CASE WHEN h.k % 3 > 0 THEN a.score || ' - ' || h.score WHEN h.k % 2 = 0 THEN '7:00 pm' ELSE '' END AS middle FROM n h JOIN n a ON a.k = (h.k + 1) % 25""")
def status_display(s, d):
    return schedule.shown(schedule.flatten(games(s, d))).select("game_id", "badge", "middle")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS first_id, arg_min(event_id, (ts, event_id)) AS last_id FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 35) WHERE event_type = 'click' GROUP BY user_id")
def array_last_match(s, d):
    """Of each user's log as an array, newest first: the first and the last click."""
    log = O.latest(T(s, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", [F.desc("ts"), F.desc("event_id")], 35)
    rows = log.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("rn", "event_id", "event_type"))).alias("log"))
    click = lambda x: x["event_type"] == "click"
    return rows.select("user_id", F.get(F.filter("log", click), F.lit(0))["event_id"].alias("first_id"), schedule.last_where(F.col("log"), click)["event_id"].alias("last_id")).where("last_id is not null")


@query(f"SELECT event_id, user_id FROM events WHERE ts::DATE = DATE '{DAY}'")
def date_bucket_filter(s, d):
    """Events of one day, as bounds on the column itself, which reach the scan."""
    return T(s, d, "events").where(f"ts >= timestamp_ntz '{DAY} 00:00:00' and ts < timestamp_ntz '{DAY} 00:00:00' + interval 1 day").select("event_id", "user_id")


@query(f"SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE contains(strftime(ts, '%Y-%m-%dT%H:%M:%S'), '{DAY}') OR contains(strftime(ts, '%Y-%m-%dT%H:%M:%S'), '2024-01-16')")
def two_day_window(s, d):
    ev = T(s, d, "events").where(f"ts >= timestamp_ntz '{DAY} 00:00:00' and ts < timestamp_ntz '{DAY} 00:00:00' + interval 2 days")
    return ev.select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 42")
def point_lookup(s, d):
    return T(s, d, "customer").where("c_custkey = 42").select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT event_id, try_strptime(CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN event_id % 3 = 1 THEN strftime(ts, '%m/%d/%Y') ELSE 'soon' END, '%Y-%m-%dT%H:%M:%SZ') IS NOT NULL AS parsed, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%I:%M %p ET') WHEN event_id % 3 = 1 THEN strftime(ts, '%m/%d/%Y') ELSE 'soon' END AS said FROM events")
def parse_or_raw(s, d):
    """A time as text: shown in another form, or as it is where it is none."""
    raw = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "MM/dd/yyyy")).otherwise("soon")
    at = F.try_to_timestamp(raw, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return T(s, d, "events").select("event_id", at.isNotNull().alias("parsed"), F.when(at.isNotNull(), F.date_format(at, "hh:mm a 'ET'")).otherwise(raw).alias("said"))


@query("SELECT p_partkey, CASE WHEN contains(p_name, 'spring') THEN 'SPR' WHEN contains(p_name, 'ring') THEN 'RNG' WHEN contains(p_name, 'bolt') THEN 'BLT' WHEN contains(p_name, 'old') THEN 'OLD' ELSE 'UNK' END AS team, CASE WHEN contains(p_name, 'ring') THEN 'RNG' WHEN contains(p_name, 'bolt') THEN 'BLT' WHEN contains(p_name, 'old') THEN 'OLD' ELSE 'UNK' END AS compat FROM part")
def slug_team(s, d):
    """The longest key, or with compat the first in order, in the last part of an address, whatever its other parts hold."""
    from tallyspark.sources.odds import team_of

    keys = {"ring": "RNG", "bolt": "BLT", "old": "OLD", "spring": "SPR"}
    logo = F.concat(F.lit("https://x/bolt/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_jersey.png"))
    return T(s, d, "part").select("p_partkey", team_of(logo, keys).alias("team"), team_of(logo, keys, compat=True).alias("compat"))


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'PTS' WHEN '2-HIGH' THEN 'PTS+AST' ELSE 'PTS' END AS stat FROM orders")
def tab_stat_key(s, d):
    label = F.when(F.col("o_orderpriority") == "1-URGENT", "Points").when(F.col("o_orderpriority") == "2-HIGH", "Pts+Ast").otherwise("1Q Points")
    return T(s, d, "orders").select("o_orderkey", S.tab_stat(label).alias("stat"))
