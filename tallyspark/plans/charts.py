"""Queries of charts and tickers: series, ticks, differences as text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.operators import feed
from tallyspark.operators import frames as O
from tallyspark.plans.registry import query
from tallyspark.sources import constants
from tallyspark.sources.tables import parquet as T

ORDERS = "(SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders QUALIFY rn <= 30)"


def recent(s, d, n):
    cols = ["o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority"]
    return O.latest(T(s, d, "orders").select(*cols), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], n)


@query(f"SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY rn DESC) AS INTEGER) AS at, o_orderkey, string_split(o_orderpriority, '-')[-1] AS opponent, strftime(o_orderdate, '%b') AS month, strftime(o_orderdate, '%d') AS day, strftime(o_orderdate, '%a') AS weekday FROM {ORDERS}")
def chart_series(s, d):
    """The latest 30, oldest first, by reversing the array of each key's rows."""
    row = F.struct("rn", "o_orderkey", "o_orderdate", "o_orderpriority")
    series = recent(s, d, 30).groupBy("o_custkey").agg(F.reverse(F.sort_array(F.collect_list(row))).alias("log"))
    flat = series.select("o_custkey", F.posexplode("log").alias("pos", "r"))
    date = F.col("r.o_orderdate")
    return flat.select("o_custkey", (F.col("pos") + 1).alias("at"), "r.o_orderkey", F.element_at(F.split("r.o_orderpriority", "-"), -1).alias("opponent"), F.date_format(date, "MMM").alias("month"), F.date_format(date, "dd").alias("day"), F.date_format(date, "EEE").alias("weekday"))


@query(f"SELECT o_custkey, top, CAST(floor(top * 0.75::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS t75, CAST(floor(top * 0.5::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS t50, CAST(floor(top * 0.25::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS t25, floor(least(line / top * 100, 100) * 10000 + 0.5::DOUBLE) / 10000 AS line_pct FROM (SELECT o_custkey, greatest(ceil(max(o_totalprice) / 1000 * 1.1::DOUBLE / 4) * 4, 10)::BIGINT AS top, sum((o_totalprice * 100)::BIGINT)::DOUBLE / count(*) / 100000 AS line FROM {ORDERS} GROUP BY 1)")
def axis_ticks(s, d):
    # the line from whole cents, so that the order of the rows does not matter, and rounded half up once
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    top = F.greatest(F.ceil(F.max("o_totalprice") / 1000 * 1.1 / 4) * 4, F.lit(10)).cast("long").alias("top")
    rows = recent(s, d, 30).groupBy("o_custkey").agg(top, (F.sum(cents).cast("double") / F.count("*") / 100000).alias("line"))
    tick = lambda share: F.floor(F.col("top") * share + 0.5).alias(f"t{round(share * 100)}")
    return rows.select("o_custkey", "top", tick(0.75), tick(0.5), tick(0.25), (F.floor(F.least(F.col("line") / F.col("top") * 100, F.lit(100.0)) * 10000 + 0.5) / 10000).alias("line_pct"))


FORM = "(SELECT user_id, round(avg(CASE WHEN rn <= 5 THEN value END) - avg(value), 3) AS diff FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events QUALIFY rn <= 35) GROUP BY user_id)"


def form(s, d):
    rows = O.latest(T(s, d, "events").select("user_id", "ts", "event_id", "event_type", "value"), "user_id", [F.desc("ts"), F.desc("event_id")], 35)
    return rows.groupBy("user_id").agg(F.round(F.avg(F.when(F.col("rn") <= 5, F.col("value"))) - F.avg("value"), 3).alias("diff"))


@query(f"SELECT user_id, CASE WHEN diff > 0 THEN '+' WHEN diff = 0 THEN '-' ELSE '' END || CASE WHEN diff = 0 THEN '' ELSE CAST(CAST(round(diff, 1) AS DECIMAL(18, 1)) AS VARCHAR) END AS said FROM {FORM}")
def diff_text(s, d):
    return form(s, d).select("user_id", S.signed_diff(F.col("diff")).alias("said"))


TYPES = ["click", "view", "error", "purchase"]


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events QUALIFY rn <= 35), t AS (SELECT unnest(['click', 'view', 'error', 'purchase', 'usage']) AS label), u AS (SELECT DISTINCT user_id FROM r)
SELECT u.user_id, label, round(coalesce(sum(CASE WHEN event_type = label THEN value END), 0), 2) AS season, round(coalesce(sum(CASE WHEN event_type = label AND rn <= 5 THEN value END), 0), 2) AS last5 FROM u CROSS JOIN t JOIN r ON r.user_id = u.user_id GROUP BY ALL""")
def ticker_unpivot(s, d):
    """A row for each user and label; one label is never in the data and stays 0."""
    rows = O.latest(T(s, d, "events").select("user_id", "ts", "event_id", "event_type", "value"), "user_id", [F.desc("ts"), F.desc("event_id")], 35)
    total = lambda kind, last: F.sum(F.when((F.col("event_type") == kind) & (F.col("rn") <= last), F.col("value")).otherwise(0.0))
    wide = rows.groupBy("user_id").agg(*(total(k, n).alias(f"{k}{n}") for k in TYPES for n in (35, 5)))
    items = F.array(*(F.struct(F.lit(k).alias("label"), F.round(F.coalesce(f"{k}35", F.lit(0.0)), 2).alias("season"), F.round(F.coalesce(f"{k}5", F.lit(0.0)), 2).alias("last5")) for k in TYPES), F.struct(F.lit("usage").alias("label"), F.lit(0.0).alias("season"), F.lit(0.0).alias("last5")))
    return wide.select("user_id", F.inline(items))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(coalesce(CASE WHEN l_linenumber % 2 = 0 THEN l_tax END, CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END + l_discount), 4) AS combo, round(l_discount + CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END, 4) AS made FROM lineitem")
def combo_backfill(s, d):
    """Combined statistics that are null, or that the table lacks, from their parts; a null part counts as 0."""
    rows = T(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).alias("PTS"), F.col("l_discount").alias("REB"), F.lit(None).cast("double").alias("AST"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax")).alias("PTS+REB"))
    out = feed.with_combos(rows)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("`PTS+REB`", 4).alias("combo"), F.round("`PTS+REB+AST`", 4).alias("made"))


@query("SELECT n_nationkey AS game, team, team_id FROM (SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'BOS' WHEN 1 THEN 'LAL' ELSE 'XXX' END AS team FROM nation) LEFT JOIN (VALUES ('BOS', 1610612738), ('LAL', 1610612747)) t(code, team_id) ON team = code")
def team_lookup(s, d):
    """The id of each code from the inline table; none for an unknown one."""
    k = F.col("n_nationkey") % 3
    games = T(s, d, "nation").select(F.col("n_nationkey").alias("game"), F.when(k == 0, "BOS").when(k == 1, "LAL").otherwise("XXX").alias("team"))
    return games.join(constants.team_ids(s), "team", "left").select("game", "team", "team_id")


@query("WITH r AS (SELECT event_type, value, floor(max(value) OVER (PARTITION BY user_id) / 2) + 0.5::DOUBLE AS line FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 35)) SELECT event_type AS team, count(*)::INTEGER AS games, count(*) FILTER (value > line)::INTEGER AS over FROM r GROUP BY 1")
def similar_panel(s, d):
    """Games against the line by team: latest 35 of each user against half of their best, by type."""
    rows = O.latest(T(s, d, "events").select("user_id", "ts", "event_id", "event_type", "value"), "user_id", [F.desc("ts"), F.desc("event_id")], 35)
    line = F.floor(F.max("value").over(Window.partitionBy("user_id")) / 2) + 0.5
    over = F.sum(F.when(F.col("value") > F.col("line"), 1).otherwise(0)).cast("int")
    return rows.withColumn("line", line).groupBy(F.col("event_type").alias("team")).agg(F.count("*").cast("int").alias("games"), over.alias("over"))
