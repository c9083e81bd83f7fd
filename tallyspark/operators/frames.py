"""Operators on whole frames: latest rows, upserts, overwrite semantics, largest remainders, name resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.scalars import ALIASES, aliased, canonical_name, indel_score, sorted_tokens, teams_wanted
from tallyspark.sources.tables import stored


def latest(df: DataFrame, key: str | Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each key; Spark limits each group before the shuffle."""
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def last_write(df: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    """The last row written for each key."""
    return latest(df, key, [order.desc()], 1).drop("rn")


def few_values(df: DataFrame, column: str, most: int) -> list:
    """The distinct values of a small dimension, in order; more than `most` are an error."""
    found = [r[0] for r in df.select(column).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} values of {column}")
    return sorted(found)


def replace_by(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old without the keys that new has, and new."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_recent(old: DataFrame, new: DataFrame, day: str, key: str, order: Sequence[Column], n: int = 35) -> DataFrame:
    """Replace whole days, then keep the latest n rows of each key."""
    return latest(replace_by(old, new, day), key, order, n)


def shares_to_hundred(df: DataFrame, key: str, part: str, order: Column, n: Column, total: Column | None = None) -> DataFrame:
    """Largest remainders: whole percentages of each key's parts that add up to 100; ties go by `order`.

    Shares are of the parts' own sum, or of `total`, which is one value for each key and need not be that sum: keys whose total is 0 or null go, and
    what the whole percentages lack of 100 goes to the largest remainders, one each. Where they lack more than there are parts, every part gets
    one and the sum stays under 100; where they have more than 100 already, none does."""
    whole = Window.partitionBy(key)
    rows = df if total is None else df.where(F.coalesce(total, F.lit(0)) != 0)
    of = F.sum(n.cast("double")).over(whole) if total is None else total.cast("double")
    rows = rows.withColumn("raw", n.cast("double") / of * 100).withColumn("base", F.col("raw").cast("int"))
    rank = F.row_number().over(whole.orderBy((F.col("raw") - F.col("base")).desc(), order))
    short = 100 - F.sum("base").over(whole)
    return rows.withColumn("pct", (F.col("base") + F.when(rank <= short, 1).otherwise(0)).cast("int")).select(key, part, "pct")


#: The pairs of neighbouring characters of {0} with their places, with a mark at either end.
_PAIRS = "transform(sequence(1, length({0}) + 1), i -> struct(substring(concat('\x02', {0}, '\x03'), i, 2) as gram, i as at))"
#: Two words of 64 bits with a bit for each letter of {0} and how often it came before: bits that only one of two names has are letters that the
#: other lacks (letters that share a bit only make them fewer).
_LETTERS = """aggregate(array_sort(filter(split({0}, ''), c -> c <> '')), struct('' as last, 0 as nth, 0L as x, 0L as y),
    (s, c) -> named_struct('last', c, 'nth', if(c = s.last, s.nth + 1, 0),
        'x', if(ascii(c) % 2 = 0, s.x | shiftleft(1L, cast((ascii(c) div 2 * 5 + if(c = s.last, s.nth + 1, 0) * 13) % 64 as int)), s.x),
        'y', if(ascii(c) % 2 = 1, s.y | shiftleft(1L, cast((ascii(c) div 2 * 5 + if(c = s.last, s.nth + 1, 0) * 13) % 64 as int)), s.y)), s -> struct(s.x as x, s.y as y))"""
#: What x and y can share on one side of the pair, or in the whole: the shorter side, less the letters that the other lacks.
_SHARED = "least(x.{0}.n - bit_count(x.{0}.has.x & ~y.{0}.has.x) - bit_count(x.{0}.has.y & ~y.{0}.has.y), y.{0}.n - bit_count(y.{0}.has.x & ~x.{0}.has.x) - bit_count(y.{0}.has.y & ~x.{0}.has.y))"


def _rarest(rows: DataFrame, form: str, frequency: DataFrame, broken: float) -> DataFrame:
    """A row for each of a name's rarest pairs, one more than `broken` of its length: gram, its rank from 0, n, and of what stands left and right of
    it, and of the whole name, the length and the letters."""
    each = rows.select("*", F.expr(f"inline({_PAIRS.format(form)})")).join(frequency, "gram", "left")
    first = each.groupBy(*rows.columns).agg(F.expr("sort_array(collect_list(struct(coalesce(n, 0) as n, gram, at))) as rare"))
    kept = first.select(*rows.columns, F.expr(f"posexplode(slice(rare, 1, int(floor({broken + 1e-9}D * length({form}))) + 1)) as (rank, p)"))
    side = lambda x, name: F.expr(f"struct(length({x}) as n, {_LETTERS.format(x)} as has) as {name}")
    left, right = f"if(p.at > 2, substring({form}, 1, p.at - 2), '')", f"substring({form}, p.at + 1)"
    return kept.select(*rows.columns, F.length(form).alias("n"), "p.gram", "rank", side(form, "whole"), side(left, "left"), side(right, "right"))


def candidates(names: DataFrame, known: DataFrame, cutoff: float, by_tokens: bool = False) -> DataFrame:
    """name, a, candidate, b and ord of the pairs of names that may score the cutoff (67 or more), by an index of rare pairs of characters.

    Of a name of n characters, a score of c allows d deletions and i insertions with (1 + t) d + (1 - t) i <= 2 t n, t = 1 - c / 100; a deletion
    breaks two pairs of neighbours at most and an insertion one, so all but 4 t / (1 + t) n of its pairs also stand together in the other name. So
    do, seen from there, all but as many of the other's. Put in the order of how many names have them, the first pair that both keep is among the
    rarest ones of either, one more than may break; only these meet, and if L is what the names share, rank r in a name of n characters and the
    other's m leave 3 L <= 2 n + m - r. Where a pair stands in both names, what is left of it can share no more than
    the shorter side has, less the letters that the other side lacks, and so what is right of it: that is asked in the join itself."""
    if cutoff < 67:
        raise ValueError("a cutoff under 67 leaves no pair of characters that both names must have")
    away = 1 - cutoff / 100
    broken = max(4 * away / (1 + away), 2 * away / (1 - away))
    form = sorted_tokens if by_tokens else (lambda x: x)
    left = names.select("name").distinct().select("name", form(F.col("name")).alias("a")).where("length(a) > 0")
    right = known.select("candidate", "ord", form(F.col("candidate")).alias("b")).where("length(b) > 0")
    frequency = right.select(F.expr(f"explode(array_distinct(transform({_PAIRS.format('b')}, p -> p.gram))) as gram")).groupBy("gram").agg(F.count("*").alias("n"))
    x, y = _rarest(left, "a", frequency, broken).alias("x"), _rarest(right, "b", frequency, broken).alias("y")
    own = "length(translate(x.gram, '\x02\x03', ''))"
    sides = f"3 * ({_SHARED.format('left')} + {own} + {_SHARED.format('right')})"
    by_rank = "least(x.n - x.rank, y.n - y.rank) + x.n + y.n"
    enough = F.expr(f"200 * least({sides}, 3 * {_SHARED.format('whole')}, {by_rank}) >= {3 * cutoff - 1e-9}D * (x.n + y.n)")
    return x.join(y, (F.col("x.gram") == F.col("y.gram")) & enough).select("name", "a", "candidate", "b", "ord")


def best_match(names: DataFrame, known: DataFrame, cutoff: float, by_tokens: bool = False) -> DataFrame:
    """For each distinct `name`, the best `candidate` with at least the cutoff (67 or more); ties go to the smaller `ord`."""
    pairs = candidates(names, known, cutoff, by_tokens).distinct()
    scored = pairs.withColumn("score", indel_score(F.col("a"), F.col("b"))).where(F.col("score") >= cutoff)
    return latest(scored, "name", [F.desc("score"), F.col("ord")], 1).select("name", "candidate", "score")


def dictionary(names: DataFrame, known: DataFrame) -> DataFrame:
    """name, candidate and tier of each distinct name that finds a candidate (candidate, ord): 1 the same name, 2 the best of 85 or more, 3 the best
    of 70 or more by sorted tokens. A name that one tier finds never comes to the next.

    The distinct names, and what the second tier finds, are stored on the way: the rows that they come from are read once, and where all names
    are known nothing else is planned."""
    exact = known.select(F.col("candidate").alias("name"), F.lit(True).alias("exact"))
    told = stored(names.select("name").distinct().join(exact, "name", "left"), "names")
    tier = lambda found, k: found.select("name", "candidate", F.lit(k).alias("tier"))
    same = tier(told.where("exact").withColumn("candidate", F.col("name")), 1)
    unknown = told.where("exact is null").select("name")
    if unknown.isEmpty():
        return same
    near = stored(best_match(unknown, known, 85.0), "near")
    loose = best_match(unknown.join(near, "name", "left_anti"), known, 70.0, by_tokens=True)
    return same.union(tier(near, 2)).union(tier(loose, 3))


#: The team of a name's first player in any team: no prop wants it, as empty teams name none.
ANY_TEAM = ""


def first_players(players: DataFrame) -> DataFrame:
    """candidate, team and the first (ord, player_id) of that name in that team; ANY_TEAM has the first of all."""
    first = F.min(F.struct("ord", "player_id")).alias("first")
    in_team = players.groupBy("candidate", "team").agg(first)
    return in_team.where("team <> ''").union(in_team.groupBy("candidate").agg(F.min("first").alias("first")).select("candidate", F.lit(ANY_TEAM).alias("team"), "first"))


def resolve(props: DataFrame, players: DataFrame, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """prop_id, player_id and tier of the props (prop_id, name, team, team_options) that name a player (player_id, name, team, ord).

    Both sides' names are made canonical, and a prop's goes through the aliases. Tier 1 is the exact name, tier 2 the best name of 85 or more,
    tier 3 the best name of 70 or more by sorted tokens, if a player of that name is in a team that the prop names. Of several players of one
    name, those of a named team go first, then the lowest ord.

    Names are looked up in a dictionary of distinct names, and players in one of the first player of each name and team: a prop meets one row for
    each team that it names, and one for any team, however many players have the name."""
    props = props.select("prop_id", aliased(canonical_name(F.col("name")), aliases).alias("name"), teams_wanted(F.col("team"), F.col("team_options")).alias("wanted"))
    players = players.select("player_id", canonical_name(F.col("name")).alias("candidate"), "team", "ord")
    known = stored(players.groupBy("candidate").agg(F.min("ord").alias("ord")), "known")
    named = props.join(dictionary(props, known), "name")
    teams = F.when(F.col("tier") < 3, F.array_append("wanted", F.lit(ANY_TEAM))).otherwise(F.col("wanted"))
    asked = named.select("prop_id", "candidate", "tier", F.explode(teams).alias("team"))
    best = F.min(F.struct((F.col("team") == ANY_TEAM).alias("any"), "first")).alias("best")
    return asked.join(first_players(players), ["candidate", "team"]).groupBy("prop_id", "tier").agg(best).select("prop_id", F.col("best.first.player_id").alias("player_id"), "tier")
