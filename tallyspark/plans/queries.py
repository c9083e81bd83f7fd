"""The registered queries: each applies an operator to the star-schema tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.operators import frames as O
from tallyspark.operators.refresh import recent, refresh
from tallyspark.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from tallyspark.sources.tables import parquet as T
from tallyspark.sources.tables import scratch


def day():
    return F.to_date("ts").alias("day")


def newest():
    return [F.desc("ts"), F.desc("event_id")]


AS_OF = "2024-01-30 12:00:00"


def logs(s: SparkSession, d: str, n: int = 35) -> DataFrame:
    return O.latest(T(s, d, "events").select("user_id", "ts", "event_id", "event_type", "value"), "user_id", newest(), n)


LOGS = "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events QUALIFY rn <= 35)"


@query("SELECT p_partkey, p_name, p_size FROM part")
def project_prune(s, d):
    part = T(s, d, "part")
    return part.select([c for c in ("p_partkey", "p_name", "p_size", "p_missing") if c in part.columns])


@query("SELECT p_partkey, coalesce(try_cast(p_name AS DOUBLE), 0.0) AS name_num, coalesce(try_cast(replace(CASE WHEN p_size % 5 = 0 THEN p_name WHEN p_size % 7 > 0 THEN p_size || '%' END, '%', '') AS INTEGER), 0) AS pct FROM part")
def safe_cast(s, d):
    said = F.when(F.col("p_size") % 5 == 0, F.col("p_name")).when(F.col("p_size") % 7 > 0, F.concat(F.col("p_size").cast("string"), F.lit("%")))
    return T(s, d, "part").select("p_partkey", S.number_or_zero(F.col("p_name")).alias("name_num"), F.coalesce(F.replace(said, F.lit("%"), F.lit("")).try_cast("int"), F.lit(0)).alias("pct"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, round(l_quantity + l_tax + l_discount, 4) AS combo3, round(l_quantity + l_tax, 4) AS combo2 FROM lineitem")
def combo_columns(s, d):
    q, t, x = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    return T(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.round(q + t + x, 4).alias("combo3"), F.round(q + t, 4).alias("combo2"))


@query("SELECT s_suppkey, CASE WHEN b > 0 THEN round(a / b, 3) ELSE 0 END AS ratio FROM (SELECT s_suppkey, coalesce(sum(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END), 0) AS a, count(l_orderkey)::DOUBLE AS b FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey GROUP BY s_suppkey)")
def safe_ratio(s, d):
    counts = T(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.sum(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("a"), F.count("*").cast("double").alias("b"))
    return T(s, d, "supplier").select("s_suppkey").join(counts, "s_suppkey", "left").select("s_suppkey", S.guarded_ratio(F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))).alias("ratio"))


@query("""WITH a AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT l_partkey, l_suppkey, n, coalesce(q, 0.0) AS returned FROM a LEFT JOIN r USING (l_partkey, l_suppkey)""")
def left_join_fill(s, d):
    li, keys = T(s, d, "lineitem"), ["l_partkey", "l_suppkey"]
    returned = li.where("l_returnflag = 'R'").groupBy(*keys).agg(F.sum("l_quantity").alias("returned"))
    return li.groupBy(*keys).agg(F.count("*").alias("n")).join(returned, keys, "left").na.fill(0, ["returned"])


@query("""WITH c AS (SELECT user_id, count(*) AS clicks FROM events WHERE event_type = 'click' AND user_id < 100 GROUP BY 1), v AS (SELECT user_id, count(*) AS views FROM events WHERE event_type = 'view' AND user_id > 30 GROUP BY 1), e AS (SELECT user_id, count(*) AS errors FROM events WHERE event_type = 'error' AND user_id % 2 = 0 GROUP BY 1)
SELECT user_id, coalesce(clicks, 0) AS clicks, coalesce(views, 0) AS views, coalesce(errors, 0) AS errors FROM c FULL JOIN v USING (user_id) FULL JOIN e USING (user_id)""")
def full_outer_chain(s, d):
    ev, u = T(s, d, "events"), F.col("user_id")
    count = lambda kind, name, keep: ev.where((F.col("event_type") == kind) & keep).groupBy("user_id").agg(F.count("*").alias(name))
    return count("click", "clicks", u < 100).join(count("view", "views", u > 30), "user_id", "full").join(count("error", "errors", u % 2 == 0), "user_id", "full").na.fill(0)


@query("SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%m/%d/%Y') AS date_str, day_total FROM orders JOIN (SELECT o_custkey, o_orderdate::DATE AS day, round(sum(o_totalprice), 2) AS day_total FROM orders GROUP BY 1, 2) t USING (o_custkey) WHERE o_orderdate::DATE = t.day")
def left_join_two_keys(s, d):
    o = T(s, d, "orders").withColumn("date_str", F.date_format("o_orderdate", "MM/dd/yyyy"))
    day = o.groupBy("o_custkey", "date_str").agg(F.round(F.sum("o_totalprice"), 2).alias("day_total"))
    return o.select("o_orderkey", "o_custkey", "date_str").join(day, ["o_custkey", "date_str"], "left")


def _days(s, d):
    return T(s, d, "events").where("event_type = 'error' and user_id < 5").select(day()).distinct()


@query("SELECT event_id FROM events WHERE ts::DATE IN (SELECT ts::DATE FROM events WHERE event_type = 'error' AND user_id < 5)")
def semi_dates(s, d):
    return T(s, d, "events").select("event_id", day()).join(_days(s, d), "day", "left_semi").select("event_id")


@query("SELECT event_id FROM events WHERE ts::DATE NOT IN (SELECT ts::DATE FROM events WHERE event_type = 'error' AND user_id < 5)")
def anti_dates(s, d):
    return T(s, d, "events").select("event_id", day()).join(_days(s, d), "day", "left_anti").select("event_id")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderstatus <> 'F'")
def union_all(s, d):
    o = T(s, d, "orders")
    return o.where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice").unionByName(o.where("o_orderstatus <> 'F'").select("o_orderkey"), allowMissingColumns=True)


@query(f"""WITH d AS (SELECT DISTINCT ts::DATE AS day FROM events), tgt AS (SELECT day FROM d WHERE day::TIMESTAMP >= TIMESTAMP '{AS_OF}' - INTERVAL 5 DAYS AND day < DATE '{AS_OF[:10]}'),
m AS (SELECT event_id, user_id, ts, CASE WHEN ts::DATE IN (SELECT day FROM tgt) THEN value * 2 ELSE value END AS value FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM m) SELECT event_id, user_id, value, CAST(rn AS INTEGER) AS rn FROM r WHERE rn <= 35""")
def recency_upsert(s, d):
    ev = T(s, d, "events").select("event_id", "user_id", "ts", "value", day())
    low = F.expr(f"timestamp_ntz '{AS_OF}' - interval 5 days")
    new = ev.where((F.col("day").cast("timestamp_ntz") >= low) & (F.col("day") < F.to_date(F.lit(AS_OF[:10])))).withColumn("value", F.col("value") * 2)
    return O.upsert_recent(ev, new, "day", "user_id", newest()).select("event_id", "user_id", "value", "rn")


@query(f"""WITH e AS (SELECT *, ts::DATE AS day FROM events), c AS (SELECT user_id, day, count(*) AS clicks FROM e WHERE event_type = 'click' GROUP BY ALL),
m AS (SELECT event_id, user_id, ts, CASE WHEN day >= DATE '2024-01-20' THEN value * 2 ELSE value END AS value, coalesce(clicks, 0) AS clicks FROM e LEFT JOIN c USING (user_id, day) WHERE day < DATE '{AS_OF[:10]}')
SELECT event_id, user_id, value, clicks, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rn FROM m QUALIFY rn <= 35""")
def refresh_by_day(s, d):
    """A table by day, filled up to one day and brought up to another: missed days and those of the last five are written again, others stay."""
    log = T(s, d, "events").select("event_id", "user_id", "ts", "value", "event_type", day())
    clicks = log.where("event_type = 'click'").groupBy("user_id", "day").agg(F.count("*").alias("clicks"))
    path = scratch(s, "log")
    refresh(s, path, log.where("day < date '2024-01-20'"), clicks, "2024-01-20 12:00:00", "day", ("user_id", "day"))
    refresh(s, path, log.withColumn("value", F.col("value") * 2), clicks, AS_OF, "day", ("user_id", "day"))
    return recent(s, path, "user_id", newest()).select("event_id", "user_id", "value", "clicks", "rn")


@query("SELECT DISTINCT strftime(ts, '%m/%d/%Y') AS date_str FROM events")
def distinct_dates(s, d):
    return T(s, d, "events").select(F.date_format("ts", "MM/dd/yyyy").alias("date_str")).distinct()


@query("SELECT DISTINCT ts::DATE AS day FROM events ORDER BY day DESC LIMIT 25")
def top_n_dates(s, d):
    return T(s, d, "events").select(day()).distinct().orderBy(F.desc("day")).limit(25)


@query(f"""WITH d AS (SELECT DISTINCT ts::DATE AS day FROM events WHERE ts < TIMESTAMP '{AS_OF}'), have AS (SELECT max(ts::DATE) AS last FROM events WHERE ts < TIMESTAMP '2024-01-20')
SELECT day FROM d, have WHERE day < DATE '{AS_OF[:10]}' AND (day::TIMESTAMP >= TIMESTAMP '{AS_OF}' - INTERVAL 5 DAYS OR day > last)""")
def incremental_dates(s, d):
    ev = T(s, d, "events")
    days = ev.where(F.col("ts") < F.expr(f"timestamp_ntz '{AS_OF}'")).select(day()).distinct().where(F.col("day") < F.to_date(F.lit(AS_OF[:10])))
    recent = days.where(F.col("day").cast("timestamp_ntz") >= F.expr(f"timestamp_ntz '{AS_OF}' - interval 5 days"))
    have = ev.where("ts < timestamp_ntz '2024-01-20 00:00:00'").agg(F.max(F.to_date("ts")).alias("last"))
    missed = days.join(F.broadcast(have), F.col("day") > F.col("last")).select("day")  # one row
    return recent.union(missed).distinct()


@query(f"SELECT user_id, event_id, CAST(rn AS INTEGER) AS rn FROM {LOGS}")
def latest_n_per_key(s, d):
    return logs(s, d).select("user_id", "event_id", "rn")


@query("SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY o_orderdate DESC, o_orderkey) AS orders, count(*) AS n FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 35) GROUP BY o_custkey")
def collect_nested(s, d):
    """A customer's log: the latest 35 orders, newest first."""
    recent = O.latest(T(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", [F.desc("o_orderdate"), F.col("o_orderkey")], 35)
    log = F.sort_array(F.collect_list(F.struct("rn", "o_orderkey")))
    return recent.groupBy("o_custkey").agg(F.array_join(F.transform(log, lambda x: x["o_orderkey"].cast("string")), ",").alias("orders"), F.count("*").alias("n"))


@query("SELECT c_custkey, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def nested_left_join(s, d):
    n = T(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    return T(s, d, "customer").select("c_custkey").join(n, "c_custkey", "left").na.fill(0, ["n_orders"])


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def last_write_wins(s, d):
    return O.last_write(T(s, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], F.col("event_id"))


BOOKS = "(SELECT user_id, max(CASE WHEN event_type = 'click' THEN value END) AS dk, max(CASE WHEN event_type = 'view' THEN value END) AS fd FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1) GROUP BY user_id)"


def books(s, d):
    return last_write_wins(s, d).groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.max("value")).withColumnsRenamed({"click": "dk", "view": "fd"})


@query(f"SELECT user_id, dk, fd FROM {BOOKS}")
def book_pivot(s, d):
    return books(s, d)


@query(f"SELECT user_id, dk IS NOT NULL AS has_dk, fd IS NOT NULL AS has_fd, coalesce(dk, fd, 0.0) AS line FROM {BOOKS}")
def coalesce_book(s, d):
    return books(s, d).select("user_id", F.col("dk").isNotNull().alias("has_dk"), F.col("fd").isNotNull().alias("has_fd"), F.coalesce("dk", "fd", F.lit(0.0)).alias("line"))


@query("SELECT o_orderkey, upper(coalesce(CASE o_orderpriority WHEN '1-URGENT' THEN 'pts' WHEN '2-HIGH' THEN 'reb' END, o_orderpriority)) AS stat FROM orders")
def map_lookup_default(s, d):
    known = F.create_map(*(F.lit(x) for x in ("1-URGENT", "pts", "2-HIGH", "reb")))
    return T(s, d, "orders").select("o_orderkey", F.upper(F.coalesce(F.try_element_at(known, "o_orderpriority"), "o_orderpriority")).alias("stat"))


@query(r"""SELECT doc_id, trim(regexp_replace(replace(replace(regexp_replace(strip_accents(lower(trim(text))), '[^\x00-\x7F]', '', 'g'), '.', ''), '''', ''), '\b(jr|sr|ii|iii|iv|v)\b', '', 'g')) AS name FROM documents""")
def name_normalize(s, d):
    return T(s, d, "documents").select("doc_id", S.canonical_name(F.col("text")).alias("name"))


@query("SELECT p_partkey, lower(trim(p_name)) || ' jr' AS name FROM part")
def suffix_strip(s, d):
    """Each suffix once and in order: jr is not at the end when its turn comes, and stays."""
    return T(s, d, "part").select("p_partkey", S.light_name(F.concat("p_name", F.lit(" Jr. III"))).alias("name"))


@query("SELECT p_partkey, upper(p_brand) AS u, lower(p_type) AS l, replace(p_name, ' ', '_') AS r, CASE WHEN contains(lower(p_type), 'brass') THEN 'brass' WHEN contains(lower(p_type), 'steel') THEN 'steel' ELSE replace(lower(p_type), ' ', '_') END AS kind FROM part")
def contains_case(s, d):
    low = F.lower("p_type")
    kind = F.when(F.contains(low, F.lit("brass")), "brass").when(F.contains(low, F.lit("steel")), "steel").otherwise(F.replace(low, F.lit(" "), F.lit("_")))
    return T(s, d, "part").select("p_partkey", F.upper("p_brand").alias("u"), low.alias("l"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("r"), kind.alias("kind"))


@query("SELECT page_id, string_split(url, '/')[-1] AS slug, string_split(url, '.')[-1] AS tail FROM pages")
def slug_lookup(s, d):
    return T(s, d, "pages").select("page_id", F.element_at(F.split("url", "/"), -1).alias("slug"), F.substring_index("url", ".", -1).alias("tail"))


@query("""WITH x AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'EVEN' WHEN event_id % 7 = 1 THEN '+' || CAST(CAST(floor(value) AS INTEGER) AS VARCHAR) WHEN event_id % 7 = 2 THEN chr(8722) || CAST(CAST(floor(value) AS INTEGER) AS VARCHAR) WHEN event_id % 7 = 3 THEN 'abc' WHEN event_id % 7 = 4 THEN NULL ELSE '-110.7' END AS t FROM events),
y AS (SELECT event_id, coalesce(CASE WHEN t = 'EVEN' THEN 100 ELSE CAST(trunc(try_cast(replace(replace(t, chr(8722), '-'), '+', '') AS DOUBLE)) AS INTEGER) END, 0) AS odds FROM x) SELECT event_id, odds, CASE WHEN odds > 0 THEN '+' || odds ELSE CAST(odds AS VARCHAR) END AS said FROM y""")
def odds_parse(s, d):
    k, whole = F.col("event_id") % 7, F.floor("value").cast("int").cast("string")
    text = F.when(k == 0, "EVEN").when(k == 1, F.concat(F.lit("+"), whole)).when(k == 2, F.concat(F.lit("−"), whole)).when(k == 3, "abc").when(k == 4, F.lit(None)).otherwise("-110.7")
    return T(s, d, "events").select("event_id", S.american_odds(text).alias("odds")).withColumn("said", S.signed_odds(F.col("odds")))


@query("""SELECT user_id, day, max(CASE WHEN event_type = 'click' THEN struct_pack(e := event_id, v := value) END).v AS over_value, max(CASE WHEN event_type = 'view' THEN struct_pack(e := event_id, v := value) END).v AS under_value
FROM (SELECT *, ts::DATE AS day FROM events WHERE event_type IN ('click', 'view')) GROUP BY user_id, day HAVING count(DISTINCT event_type) = 2""")
def market_pairs(s, d):
    last = lambda kind: F.max(F.when(F.col("event_type") == kind, F.struct("event_id", "value")))["value"]
    rows = T(s, d, "events").where(F.col("event_type").isin("click", "view")).select("user_id", day(), "event_type", "event_id", "value")
    return rows.groupBy("user_id", "day").agg(last("click").alias("over_value"), last("view").alias("under_value")).where("over_value is not null and under_value is not null")


@query("SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS INTEGER), 0) AS k FROM events")
def json_extract(s, d):
    return T(s, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(0)).alias("k"))


@query("SELECT l_suppkey, coalesce(s_name, CAST(l_suppkey AS VARCHAR)) AS name, round(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END), 2) AS a, round(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END), 2) AS n, round(sum(l_quantity), 2) AS total FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 3 > 0) ON l_suppkey = s_suppkey GROUP BY 1, 2")
def edge_rollup(s, d):
    part = lambda flag: F.round(F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")).otherwise(0.0)), 2)
    sums = T(s, d, "lineitem").groupBy("l_suppkey").agg(part("A").alias("a"), part("N").alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"))
    known = T(s, d, "supplier").where("s_suppkey % 3 > 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return sums.join(known, "l_suppkey", "left").select("l_suppkey", F.coalesce("s_name", F.col("l_suppkey").cast("string")).alias("name"), "a", "n", "total")


REMAINDER = """f AS (SELECT *, n / sum(n) OVER (PARTITION BY k) * 100 AS raw FROM g), i AS (SELECT *, CAST(floor(raw) AS INTEGER) AS ip FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY raw - ip DESC, z) AS rk, 100 - sum(ip) OVER (PARTITION BY k) AS short FROM i)
SELECT k, z, CAST(ip + CASE WHEN rk <= short THEN 1 ELSE 0 END AS INTEGER) AS pct FROM r"""


@query("WITH g AS (SELECT l_suppkey AS k, p_type AS z, CAST(count(*) AS DOUBLE) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), " + REMAINDER)
def largest_remainder_6(s, d):
    g = T(s, d, "lineitem").select("l_partkey", "l_suppkey").join(T(s, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("k"), F.col("p_type").alias("z")).agg(F.count("*").alias("n"))
    return O.shares_to_hundred(g, "k", "z", F.col("z"), F.col("n"))


@query("WITH g AS (SELECT o_custkey AS k, o_orderpriority AS z, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1, 2), " + REMAINDER)
def largest_remainder_5(s, d):
    g = T(s, d, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("z")).agg(F.count("*").alias("n"))
    return O.shares_to_hundred(g, "k", "z", F.col("z"), F.col("n"))


@query("SELECT s_suppkey, t.p_type AS zone, coalesce(n, 0) AS n FROM supplier CROSS JOIN (SELECT DISTINCT p_type FROM part) t LEFT JOIN (SELECT l_suppkey, p_type, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_quantity > 45 GROUP BY 1, 2) c ON c.l_suppkey = s_suppkey AND c.p_type = t.p_type")
def zone_dense_fill(s, d):
    part = T(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("zone"))
    counts = T(s, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").join(part, "l_partkey").groupBy(F.col("l_suppkey").alias("s_suppkey"), "zone").agg(F.count("*").alias("n"))
    zones = O.few_values(part, "zone", 100)
    dense = T(s, d, "supplier").select("s_suppkey", F.explode(F.array(*map(F.lit, zones))).alias("zone"))
    return dense.join(counts, ["s_suppkey", "zone"], "left").na.fill(0, ["n"])


@query("""SELECT o_orderkey, o_orderstatus = 'O' AS is_open, o_orderstatus = 'F' AS is_final, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%b %d') AS label, strftime(o_orderdate, '%A') AS weekday, CAST(o_orderdate - INTERVAL 5 HOURS AS DATE) AS day5,
CAST((o_orderdate AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS local_day FROM orders""")
def date_format(s, d):
    o = F.col("o_orderdate")
    return T(s, d, "orders").select(
        "o_orderkey", (F.col("o_orderstatus") == "O").alias("is_open"), (F.col("o_orderstatus") == "F").alias("is_final"), F.date_format(o, "yyyy-MM-dd").alias("iso"), F.date_format(o, "MMM dd").alias("label"),
        F.date_format(o, "EEEE").alias("weekday"), F.to_date(o - F.expr("interval 5 hours")).alias("day5"), F.to_date(F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), o)).alias("local_day"),
    )


@query("SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(o_totalprice > 100000 AS INTEGER)) AS BIGINT) AS large FROM orders GROUP BY 1")
def status_summary(s, d):
    return T(s, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum((F.col("o_totalprice") > 100000).cast("int")).alias("large"))


@query(f"SELECT user_id, count(*) AS games, CAST(sum(CASE WHEN value >= 50 THEN 1 ELSE 0 END) AS BIGINT) AS hits, round(sum(CASE WHEN value >= 50 THEN 1.0::DOUBLE ELSE 0 END) / count(*), 4) AS rate FROM {LOGS} GROUP BY user_id")
def hit_rate(s, d):
    hits = F.sum(F.when(F.col("value") >= 50, 1).otherwise(0))
    return logs(s, d).groupBy("user_id").agg(F.count("*").alias("games"), hits.alias("hits"), F.round(hits / F.count("*"), 4).alias("rate"))


@query(f"SELECT user_id, round(avg(CASE WHEN rn <= 5 THEN value END), 3) AS last5, round(avg(value), 3) AS season, round(avg(CASE WHEN rn <= 5 THEN value END) - avg(value), 3) AS diff FROM {LOGS} GROUP BY user_id")
def last5_vs_season(s, d):
    five, every = F.avg(F.when(F.col("rn") <= 5, F.col("value"))), F.avg("value")
    return logs(s, d).groupBy("user_id").agg(F.round(five, 3).alias("last5"), F.round(every, 3).alias("season"), F.round(five - every, 3).alias("diff"))


@query(f"SELECT user_id, greatest(ceil(max(value) * 1.1::DOUBLE / 4) * 4, 10)::BIGINT AS top FROM {LOGS} WHERE rn <= 30 GROUP BY user_id")
def axis_scale(s, d):
    return logs(s, d, 30).groupBy("user_id").agg(F.greatest(F.ceil(F.max("value") * 1.1 / 4) * 4, F.lit(10)).cast("long").alias("top"))


GAMES = "(SELECT n_nationkey AS home, (n_nationkey + 1) % 25 AS away FROM nation WHERE n_nationkey % 2 = 0)"


@query(f"SELECT home, away, count(*) AS players FROM {GAMES} JOIN customer ON c_nationkey = home OR c_nationkey = away WHERE contains(lower(c_mktsegment), 'b') GROUP BY home, away")
def theta_or_join(s, d):
    """The OR becomes an equi-join on the two sides of each game, and distinct takes players that are in both."""
    games = T(s, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("home"), ((F.col("n_nationkey") + 1) % 25).cast("int").alias("away"))
    sides = games.select("home", "away", F.explode(F.array_distinct(F.array("home", "away"))).alias("c_nationkey"))
    players = T(s, d, "customer").where(F.contains(F.lower("c_mktsegment"), F.lit("b"))).groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return sides.join(players, "c_nationkey").groupBy("home", "away").agg(F.sum("n").alias("players"))


@query("SELECT event_id, round((value - line) / line * 100, 2) AS diff_pct, value > line AS over FROM events JOIN (SELECT user_id, round(avg(value), 4) AS line FROM events GROUP BY 1) USING (user_id)")
def similar_games(s, d):
    ev = T(s, d, "events").select("event_id", "user_id", "value")
    line = ev.groupBy("user_id").agg(F.round(F.avg("value"), 4).alias("line"))
    return ev.join(line, "user_id").select("event_id", F.round((F.col("value") - F.col("line")) / F.col("line") * 100, 2).alias("diff_pct"), (F.col("value") > F.col("line")).alias("over"))


@query("SELECT o_orderkey, coalesce(c_name, 'Unknown') AS name, coalesce(c_mktsegment, 'UNK') AS team FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON o_custkey = c_custkey")
def lookup_default(s, d):
    some = T(s, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return T(s, d, "orders").select("o_orderkey", "o_custkey").join(some, "o_custkey", "left").select("o_orderkey", F.coalesce("c_name", F.lit("Unknown")).alias("name"), F.coalesce("c_mktsegment", F.lit("UNK")).alias("team"))


@query("SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey WHERE coalesce(n, 0) > 0 OR c_acctbal > 5000")
def active_filter(s, d):
    n = T(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return T(s, d, "customer").select("c_custkey", "c_acctbal").join(n, "c_custkey", "left").na.fill(0, ["n"]).where("n > 0 or c_acctbal > 5000").select("c_custkey", "n")


@query("SELECT k, z, pct, CASE WHEN pct >= 40 THEN 'hot' WHEN pct >= 20 THEN 'warm' WHEN pct >= 5 THEN 'cool' ELSE 'cold' END AS bucket FROM (WITH g AS (SELECT o_custkey AS k, o_orderpriority AS z, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1, 2), " + REMAINDER + ")")
def bucketize(s, d):
    p = F.col("pct")
    return largest_remainder_5(s, d).withColumn("bucket", F.when(p >= 40, "hot").when(p >= 20, "warm").when(p >= 5, "cool").otherwise("cold"))


def _messy(s, d):
    names = T(s, d, "part").select(F.lower("p_name").alias("candidate")).distinct()
    return names.select(F.concat(F.substring("candidate", 1, 1), F.expr("substring(candidate, 3)")).alias("name")), names.withColumn("ord", F.col("candidate"))


LCS = """WITH RECURSIVE c AS (SELECT DISTINCT lower(p_name) AS b FROM part), p AS (SELECT a.b[1:1] || a.b[3:] AS a, c.b AS b FROM c a, c),
l AS (SELECT a, b, 0 AS j, (1::BIGINT << length(a)) - 1 AS s FROM p UNION ALL SELECT a, b, j + 1, ((s + (s & m)) | (s - (s & m))) & ((1::BIGINT << length(a)) - 1) FROM (SELECT *, list_sum(list_transform(range(1, length(a) + 1), lambda i: CASE WHEN a[i] = b[j + 1] THEN 1::BIGINT << (i - 1) ELSE 0 END))::BIGINT AS m FROM l WHERE j < length(b))),
z AS (SELECT a AS name, b AS candidate, round(200.0::DOUBLE * (length(a) - bit_count(s)) / (length(a) + length(b)), 4) AS score FROM l WHERE j = length(b))
SELECT name, candidate, score FROM z WHERE score >= 85 QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, candidate) = 1"""


@query(LCS)
def fuzzy_best_match(s, d):
    messy, known = _messy(s, d)
    return O.best_match(messy, known, 85.0).withColumn("score", F.round("score", 4))


@query(f"""SELECT c_custkey, c_name, games, hits, last5, n_orders FROM customer JOIN (SELECT user_id, count(*) AS games, CAST(sum(CASE WHEN value >= 50 THEN 1 ELSE 0 END) AS BIGINT) AS hits, round(avg(CASE WHEN rn <= 5 THEN value END), 3) AS last5 FROM {LOGS} GROUP BY user_id) ON c_custkey = user_id LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def player_feed(s, d):
    hits = F.sum(F.when(F.col("value") >= 50, 1).otherwise(0)).alias("hits")
    form = logs(s, d).groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("games"), hits, F.round(F.avg(F.when(F.col("rn") <= 5, F.col("value"))), 3).alias("last5"))
    orders = T(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    return T(s, d, "customer").select("c_custkey", "c_name").join(form, "c_custkey").join(orders, "c_custkey", "left")


from tallyspark.plans import charts, feed, landed, matching, odds, schedule  # noqa: E402, F401
