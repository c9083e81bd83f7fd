"""Queries of name resolution: aliases, the loose tier, several players of one name, and all tiers together."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.operators import frames as O
from tallyspark.plans.registry import query
from tallyspark.sources.tables import parquet as T

OTHER_NAMES = {"small ring": "tiny ring", "red widget": "blue widget"}


@query("SELECT p_partkey, CASE lower(p_name) WHEN 'small ring' THEN 'tiny ring' WHEN 'red widget' THEN 'blue widget' ELSE lower(p_name) END AS name FROM part")
def alias_rewrite(s, d):
    return T(s, d, "part").select("p_partkey", S.aliased(S.canonical_name(F.col("p_name")), OTHER_NAMES).alias("name"))


@query("SELECT a.p_partkey, coalesce(b.k, c.k) AS player_id FROM part a LEFT JOIN (SELECT p_name, p_size, min(p_partkey) AS k FROM part GROUP BY ALL) b ON a.p_name = b.p_name AND a.p_size = b.p_size + 1 JOIN (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY ALL) c ON a.p_name = c.p_name")
def disambiguate_first(s, d):
    """Of all parts of a name, the first in the wanted team (here: one size smaller), or else the first."""
    part = T(s, d, "part")
    props = part.select(F.col("p_partkey").alias("prop_id"), F.col("p_name").alias("name"), (F.col("p_size") - 1).cast("string").alias("team"), F.array().cast("array<string>").alias("team_options"))
    players = part.select(F.col("p_partkey").alias("player_id"), F.col("p_name").alias("name"), F.col("p_size").cast("string").alias("team"), F.col("p_partkey").alias("ord"))
    return O.resolve(props, players, {}).select(F.col("prop_id").alias("p_partkey"), "player_id")


#: Longest common subsequences of the pairs (a, b) in `pairs`, in DuckDB: `scored` has their scores.
SCORED = """l AS (SELECT a, b, 0 AS j, (1::BIGINT << length(a)) - 1 AS s FROM pairs UNION ALL SELECT a, b, j + 1, ((s + (s & m)) | (s - (s & m))) & ((1::BIGINT << length(a)) - 1) FROM (SELECT *, list_sum(list_transform(range(1, length(a) + 1), lambda i: CASE WHEN a[i] = b[j + 1] THEN 1::BIGINT << (i - 1) ELSE 0 END))::BIGINT AS m FROM l WHERE j < length(b))),
scored AS (SELECT a, b, 200.0::DOUBLE * (length(a) - bit_count(s)) / (length(a) + length(b)) AS score FROM l WHERE j = length(b))"""
TURNED = "array_reverse(string_split(p_name, ' '))"


def players(s, d):
    """Parts as players: the brand is the team."""
    return T(s, d, "part").select(F.col("p_partkey").alias("player_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("team"), F.col("p_partkey").alias("ord"))


@query(f"""WITH RECURSIVE n AS (SELECT DISTINCT p_name AS name, substr(array_to_string({TURNED}, ' '), 2) AS raw FROM part), k AS (SELECT p_name AS name, min(p_partkey) AS ord FROM part GROUP BY ALL),
t AS (SELECT raw, array_to_string(list_sort(string_split(raw, ' ')), ' ') AS a FROM n), c AS (SELECT name, ord, array_to_string(list_sort(string_split(name, ' ')), ' ') AS b FROM k),
pairs AS (SELECT DISTINCT a, b FROM t, c), {SCORED},
best AS (SELECT raw, name, score FROM t JOIN scored USING (a) JOIN c USING (b) WHERE score >= 70 QUALIFY row_number() OVER (PARTITION BY raw ORDER BY score DESC, ord) = 1)
SELECT raw AS name, best.name AS candidate, round(score, 4) AS score, p_brand AS team, min(p_partkey) AS player_id FROM best JOIN part ON best.name = p_name GROUP BY ALL""")
def fuzzy_team_loose(s, d):
    """Names with turned tokens and without their first letter: the best name by sorted tokens, and its first player in each team."""
    turned = F.array_join(F.reverse(F.split("p_name", " ")), " ")
    names = T(s, d, "part").select(F.substring(turned, F.lit(2), F.length("p_name")).alias("name"))
    known = players(s, d).groupBy(F.col("name").alias("candidate")).agg(F.min("ord").alias("ord"))
    best = O.best_match(names, known, 70.0, by_tokens=True)
    first = players(s, d).groupBy(F.col("name").alias("candidate"), "team").agg(F.min("player_id").alias("player_id"))
    return best.join(first, "candidate").select("name", "candidate", F.round("score", 4).alias("score"), "team", "player_id")


def props(s, d):
    """A prop for each part: its name as it is, without the second letter, or with turned tokens; the team is the brand, or one of two."""
    turned = F.array_join(F.reverse(F.split("p_name", " ")), " ")
    k, cut = F.col("p_partkey") % 3, F.concat(F.substring("p_name", 1, 1), F.expr("substring(p_name, 3)"))
    name = F.when(k == 0, F.initcap("p_name")).when(k == 1, cut).otherwise(turned)
    team = F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise("UNK")
    options = F.when(F.col("p_size") % 2 == 0, F.array("p_brand", F.lit("UNK")))
    return T(s, d, "part").select(F.col("p_partkey").alias("prop_id"), name.alias("name"), team.alias("team"), options.alias("team_options"))


RESOLVED = f"""props AS (SELECT p_partkey AS prop_id, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name[1:1] || substr(p_name, 3) ELSE array_to_string({TURNED}, ' ') END AS name, CASE WHEN p_size > 25 OR p_size % 2 = 0 THEN p_brand END AS wanted FROM part),
k AS (SELECT p_name AS name, min(p_partkey) AS ord FROM part GROUP BY ALL), u AS (SELECT DISTINCT name FROM props WHERE name NOT IN (SELECT name FROM k)), tok AS (SELECT x, array_to_string(list_sort(string_split(x, ' ')), ' ') AS t FROM (SELECT name AS x FROM u UNION SELECT name FROM k)),
pairs AS (SELECT u.name AS a, k.name AS b FROM u, k UNION SELECT x.t, y.t FROM u JOIN tok x ON u.name = x.x, k JOIN tok y ON k.name = y.x), {SCORED},
near AS (SELECT u.name, k.name AS candidate FROM u JOIN scored ON a = u.name JOIN k ON k.name = b WHERE score >= 85 QUALIFY row_number() OVER (PARTITION BY u.name ORDER BY score DESC, ord) = 1),
loose AS (SELECT u.name, k.name AS candidate FROM u JOIN tok x ON u.name = x.x JOIN scored ON a = x.t JOIN tok y ON y.t = b JOIN k ON k.name = y.x WHERE score >= 70 AND u.name NOT IN (SELECT name FROM near) QUALIFY row_number() OVER (PARTITION BY u.name ORDER BY score DESC, ord) = 1),
found AS (SELECT name, name AS candidate, 1 AS tier FROM k UNION ALL SELECT *, 2 FROM near UNION ALL SELECT *, 3 FROM loose),
resolved AS (SELECT prop_id, p_partkey AS player_id, tier FROM props JOIN found USING (name) JOIN part ON p_name = candidate WHERE tier < 3 OR coalesce(p_brand = wanted, false) QUALIFY row_number() OVER (PARTITION BY prop_id ORDER BY coalesce(p_brand = wanted, false) DESC, p_partkey) = 1)"""


@query(f"WITH RECURSIVE {RESOLVED} SELECT prop_id, player_id, tier FROM resolved")
def resolve_tiered(s, d):
    return O.resolve(props(s, d), players(s, d), {})


@query(f"WITH RECURSIVE {RESOLVED} SELECT player_id, p_brand AS team, count(*) AS n_props, round(sum(x.p_retailprice), 2) AS line FROM resolved JOIN part x ON x.p_partkey = prop_id JOIN (SELECT p_partkey, p_brand FROM part) p ON p.p_partkey = player_id GROUP BY ALL".replace("p_brand AS team", "p.p_brand AS team"))
def resolve_and_join(s, d):
    """Props that name no known player go; the others are summed by player."""
    line = T(s, d, "part").select(F.col("p_partkey").alias("prop_id"), "p_retailprice")
    found = O.resolve(props(s, d), players(s, d), {}).join(line, "prop_id")
    return found.join(players(s, d).select("player_id", "team"), "player_id").groupBy("player_id", "team").agg(F.count("*").alias("n_props"), F.round(F.sum("p_retailprice"), 2).alias("line"))
