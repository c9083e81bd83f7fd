"""Readers and sinks on small landed files, and name resolution on the usual cases."""

import json

import pytest

from tallyspark.functions import scalars as S
from tallyspark.operators import feed, frames
from tallyspark.sources import constants, odds, schedule, stats, tables


def put(path, doc):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(doc if isinstance(doc, str) else json.dumps(doc))


def rows(df):
    return [tuple(r) for r in df.collect()]


PLAYERS = [(1, "LeBron James", "LAL"), (2, "Jalen Williams", "OKC"), (3, "Jaylin Williams", "OKC"), (4, "Nicolas Claxton", "BKN"), (5, "Alexandre Sarr", "WAS"), (6, "Nikola Jokić", "DEN"), (7, "LeBron James", "CLE")]


@pytest.fixture(scope="module")
def players(spark):
    return spark.createDataFrame([(*p, k) for k, p in enumerate(PLAYERS)], "player_id long, name string, team string, ord int")


def test_resolve(spark, players):
    calls = [
        ("LeBron James", None, None, (1, 1)), ("lebron james", "UNK", [], (1, 1)), ("Nikola Jokic", None, None, (6, 1)), ("Nicolas Claxton", None, None, (4, 1)), ("Nic Claxton", "", None, (4, 1)), ("LeBron James", "LAL", None, (1, 1)),
        ("LeBron James", "CLE", None, (7, 1)), ("LeBron James", None, ["UNK", "CLE"], (7, 1)), ("Jalen Williams", "OKC", None, (2, 1)), ("Jaylin Williams", "OKC", None, (3, 1)), ("LeBron James", "MIA", None, (1, 1)),
        ("LeBron Jame", None, None, (1, 2)), ("James LeBron", "CLE", None, (7, 3)), ("James LeBron", "MIA", None, None), ("", "LAL", None, None), (None, None, None, None), ("Somebody Else", "LAL", None, None),
        # the alias turns the name into one that is 78 like the only candidate: found only with the team
        ("Alexandre Sarr", None, None, None), ("Alex Sarr", "WAS", None, (5, 3)), ("x" * 80, None, None, None),
    ]
    props = spark.createDataFrame([(k, *c[:3]) for k, c in enumerate(calls)], "prop_id int, name string, team string, team_options array<string>")
    df = frames.resolve(props, players)
    got = {r["prop_id"]: (r["player_id"], r["tier"]) for r in df.collect()}
    assert got == {k: c[3] for k, c in enumerate(calls) if c[3]}
    assert "Cartesian" not in df._jdf.queryExecution().toString() and "NestedLoop" not in df._jdf.queryExecution().toString()


def indel(a, b):
    row = [0] * (len(a) + 1)
    for c in b:
        new = [0]
        for j, x in enumerate(a):
            new.append(row[j] + 1 if x == c else max(row[j + 1], new[-1]))
        row = new
    return 200 * row[-1] / (len(a) + len(b)) if a and b else 0.0


@pytest.mark.parametrize("cutoff", [67.0, 70.0, 85.0])
def test_best_match_misses_none(spark, cutoff):
    """The join on pairs of characters leaves out no candidate that reaches the cutoff."""
    import random

    rng = random.Random(int(cutoff))
    name = lambda: "".join(rng.choice("aab c") for _ in range(rng.randrange(1, 12))).strip() or "a"
    known, names = list(dict.fromkeys(name() for _ in range(80))), {name() for _ in range(80)}
    want = {}
    for a in names:
        score, k = max((indel(a, b), -k) for k, b in enumerate(known))
        if score >= cutoff:
            want[a] = (known[-k], pytest.approx(score))
    df = spark.createDataFrame([(b, k) for k, b in enumerate(known)], "candidate string, ord int")
    got = frames.best_match(spark.createDataFrame([(a,) for a in names], "name string"), df, cutoff).collect()
    assert {r["name"]: (r["candidate"], r["score"]) for r in got} == want and len(want) > 10


@pytest.mark.parametrize("cutoff, by_tokens, most", [(85.0, False, 0.005), (70.0, True, 0.065)])
def test_few_candidates_meet(spark, cutoff, by_tokens, most):
    """Of 1,500 generated names on either side (of 38 given names: 1.4 shared pairs of characters for each pair of names), few rows leave the join,
    and a name that is like enough is among them."""
    import random

    rng = random.Random(1)
    given = "james john robert michael william david richard joseph thomas charles daniel matthew anthony steven andrew kenneth george edward brian kevin jason gary mary patricia jennifer linda elizabeth barbara susan jessica sarah karen".split()
    part = lambda: rng.choice("b br c ch d f g gr h j k l m n p r s sch st t tr v w z".split()) + rng.choice("a e i o u ai ee ou".split())
    name = lambda: f"{rng.choice(given)} {''.join(part() for _ in range(rng.choice([1, 2, 2])))}{rng.choice(['n', 'r', 's', 'ck', 'son', 'ton', 'man', 'berg', ''])}"
    known = list(dict.fromkeys(name() for _ in range(1700)))[:1500]
    names = [x[:-1] if k % 2 else x.replace("e", "a", 1) for k, x in enumerate(known[:750])] + [name() for _ in range(750)]
    df = spark.createDataFrame([(b, k) for k, b in enumerate(known)], "candidate string, ord int")
    met = frames.candidates(spark.createDataFrame([(a,) for a in names], "name string"), df, cutoff, by_tokens)
    rows_met = met.count()
    assert rows_met < most * 1500 * 1500
    if not by_tokens:
        pairs = {(r["name"], r["candidate"]) for r in met.select("name", "candidate").distinct().collect()}
        assert all((a, b) in pairs for a, b in zip(names[:750], known[:750]) if indel(a, b) >= cutoff)


def test_many_players_of_one_name(spark):
    """A third of all players and props have one name: every prop meets a row for each team that it names, not every player."""
    from pyspark.sql import functions as F

    n = 6000
    who = F.when(F.col("id") % 3 == 0, "Same Name").otherwise(F.concat(F.lit("Player "), F.hex(F.xxhash64("id"))))
    base = spark.range(n).select(F.col("id"), who.alias("name"), (F.col("id") % 30).cast("string").alias("team"))
    players = base.select(F.col("id").alias("player_id"), "name", "team", F.col("id").alias("ord"))
    props = base.select(F.col("id").alias("prop_id"), "name", F.when(F.col("id") % 2 == 0, F.col("team")).otherwise("ZZZ").alias("team"), F.array(F.lit("UNK"), F.lit(None)).alias("team_options"))
    df = frames.resolve(props, players)
    got = {r["prop_id"]: r["player_id"] for r in df.collect()}
    assert len(got) == n and all(got[k] == (k if k % 3 else k % 30 if k % 2 == 0 else 0) for k in range(n))
    assert frames.first_players(players.withColumnRenamed("name", "candidate")).where("candidate = 'Same Name'").count() == 11


def test_scores_of_any_length(spark):
    names = ["", "a", "ab", "alex sarr", "alexandre sarr", "x" * 61, "x" * 62, "ab" * 40, "abc" * 40, "y" + "x" * 63]
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    from pyspark.sql import functions as F

    for a, b, score in rows(pairs.select("a", "b", S.indel_score(F.col("a"), F.col("b")))):
        assert score == pytest.approx(indel(a, b))


def test_names(spark):
    from pyspark.sql import functions as F

    names = [("O'Neal Jr.", "oneal jr", "oneal"), ("  Kelly Oubre Jr.", "kelly oubre", "kelly oubre"), ("Jokić III", "jokić", "jokic"), ("", "unknown_player", ""), (None, "unknown_player", "")]
    df = spark.createDataFrame([(x,) for x, *_ in names], "n string")
    got = rows(df.select(S.light_name(F.col("n")), S.canonical_name(F.col("n"))))
    assert got == [("oneal", "oneal"), ("kelly oubre", "kelly oubre"), ("jokić", "jokic"), ("unknown_player", ""), ("unknown_player", "")]
    texts = spark.createDataFrame([("['BOS', \"LAL\"]",), ("[]",), ("BOS",), (None,)], "t string")
    assert rows(texts.select(S.listed(F.col("t")))) == [(["BOS", "LAL"],), ([],), ([],), ([],)]


def test_folding_of_all_characters(spark):
    """Every code point, eight in a text, as Python's decomposition has it."""
    import sys
    import unicodedata

    from pyspark.sql import functions as F

    points = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    held = [c for c in points if ord(c) > 127 and any(ord(x) < 128 for x in unicodedata.normalize("NFKD", c))]
    texts = ["".join(points[k : k + 64]) for k in range(0, len(points), 64)] + ["".join(held[k : k + 8]) for k in range(0, len(held), 8)]
    fold = lambda t: "".join(x for x in unicodedata.normalize("NFKD", t) if ord(x) < 128)
    got = dict(rows(spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.ascii_fold(F.col("t")))))
    assert len(held) > 2000 and got == {t: fold(t) for t in texts}
    assert rows(spark.createDataFrame([("ﬁn Ⅷ ½ Łódź 𝔄𝔟 Ĳ",)], "t string").select(S.canonical_name(F.col("t")))) == [("fin viii 12 odz Ab ij",)]  # capitals without a small form come from the decomposition


def test_book_a(spark, tmp_path):
    sel = lambda m, label, points, price: {"marketId": m, "label": label, "outcomeType": label, "points": points, "displayOdds": {"american": price}}
    doc = {
        "events": [{"id": "e1", "name": "A @ B", "teamShortName1": "BOS", "teamShortName2": "LAL", "startEventDate": "2024-01-16T01:30:00Z"}],
        "markets": [{"id": "m1", "name": "LeBron James Points O/U", "eventId": "e1"}, {"id": "m2", "name": "Al 3 Points", "eventId": "no"}, {"id": "m3", "name": "X Y Points", "eventId": "e1"}, {"id": "m4", "name": "No Line Points", "eventId": "e1"}],
        "selections": [sel("m1", "Over", 20.5, "+105"), sel("m1", "Under", 20.5, "−125"), sel("m1", "Over", 21.5, "EVEN"), sel("m2", "over", 1.5, "abc"), sel("m2", "under", 1.5, None), sel("m3", "Over", 3.5, "-110"), sel("m4", "Over", None, "1"), sel("m4", "Under", 2.0, "1"), sel(None, "Over", 1.0, "1")],
    }
    put(tmp_path / "a/prop_type=points/x.json", doc)
    put(tmp_path / "a/prop_type=rebounds/x.json", "not JSON {")
    got = odds.book_a(odds.read_book_a(spark, str(tmp_path / "a")), "2024-01-20").orderBy("player").collect()
    assert [(r["player"], r["team"], r["team_options"], r["prop_type"], r["line"], r["over_odds"], r["under_odds"], r["game"], r["game_date"], r["sportsbook"]) for r in got] == [
        ("al", "Unknown", ["UNK", "UNK"], "points", 1.5, 0, 0, "Unknown", "2024-01-20", "draftkings"), ("lebron james", "Unknown", ["BOS", "LAL"], "points", 21.5, 100, -125, "A @ B", "2024-01-15", "draftkings"),
    ]
    plan = odds.book_a(odds.read_book_a(spark, str(tmp_path / "a")), "2024-01-20")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "monotonically" not in plan
    assert odds.read_book_a(spark, str(tmp_path / "none")).count() == 0


def test_book_a_of_many_documents(spark, tmp_path):
    """Each document's markets, selections and events meet within it: ids that others have too, repeated ids, empty and missing lists."""
    import random

    rng = random.Random(2)
    want = []
    for n in range(12):
        events = [{"id": f"e{rng.randrange(4)}", "name": f"game {n} {k}"} for k in range(rng.randrange(4))]
        markets = [{"id": f"m{rng.randrange(6)}", "name": f"Player {n} {k} Points", "eventId": f"e{rng.randrange(5)}"} for k in range(rng.randrange(8))]
        sels = [{"marketId": rng.choice([f"m{rng.randrange(6)}", None, ""]), "label": rng.choice(["Over", "UNDER", "x", None]), "outcomeType": rng.choice(["over", "Under", "", None]), "points": rng.choice([1.5, 2.5, None])} for _ in range(rng.randrange(70))]
        doc = {"events": events, "markets": markets, "selections": sels}
        put(tmp_path / f"a/prop_type=p{n % 3}/{n}.json", {k: v for k, v in doc.items() if v or n % 2})
        for m in markets:
            over, under = None, None
            for s in sels:
                words = ((s["label"] or "") + " " + (s["outcomeType"] or "")).lower()
                if s["marketId"] == m["id"] and "over" in words:
                    over = s
                elif s["marketId"] == m["id"] and "under" in words:
                    under = s
            if over and under and over["points"] is not None:
                game = [e["name"] for e in events if e["id"] == m["eventId"]][-1:] or ["Unknown"]
                want.append(("player", f"p{n % 3}", over["points"], game[0]))
    got = odds.book_a(odds.read_book_a(spark, str(tmp_path / "a")), "2024-01-20").select("player", "prop_type", "line", "game")
    assert sorted(rows(got)) == sorted(want) and len(want) > 5


def test_book_b(spark, tmp_path):
    put(tmp_path / "main.json", {"attachments": {"events": {"1": {"eventId": "1", "name": "A @ B", "openDate": "2024-01-16T01:00:00Z"}, "2": {"eventId": "2", "name": "C @ D", "openDate": "2024-02-01"}, "3": {"eventId": "3", "name": "E @ F"}}}})
    events = odds.upcoming(odds.read_book_b_main(spark, str(tmp_path / "main.json")), "2024-01-15")
    assert rows(events.select("event_id")) == [("1",)]
    put(tmp_path / "layout/event_id=1/x.json", {"layout": {"tabs": {"a": {"title": "Player Points"}, "b": {"title": "Same Game Parlay"}}}})
    assert rows(odds.read_book_b_tabs(spark, str(tmp_path / "layout"))) == [("1", "player-points", "Player Points")]
    run = lambda kind, handicap, price: {"result": {"type": kind}, "handicap": handicap, "secondaryLogo": "x/teams/charlotte_hornets_jersey.png", "winRunnerOdds": {"americanDisplayOdds": {"americanOdds": price}}}
    markets = {
        "1": {"marketName": "Jo Smith Jr. - x - Made Threes", "runners": [run("OVER", 2.5, "-110"), run("UNDER", 2.5, None)]}, "2": {"marketName": "No dash", "runners": [run("OVER", 1.5, "1"), run("UNDER", 1.5, "1")]},
        "3": {"marketName": "A - Points", "runners": [run("OVER", 1.5, "1"), run("UNDER", 1.5, "1"), run("OVER", 1.5, "1")]}, "4": {"marketName": "A - Points", "runners": [run("OVER", 1.5, "1"), run("OVER", 1.5, "1")]},
    }
    put(tmp_path / "tabs/event_id=1/t.json", {"attachments": {"markets": markets}})
    got = odds.book_b(odds.read_book_b(spark, str(tmp_path / "tabs")), events, "2024-01-15").collect()
    said = lambda rows: [(r["player"], r["team"], r["prop_type"], r["line"], r["over_odds"], r["under_odds"], r["game"]) for r in rows]
    assert said(got) == [("jo smith jr - x", "CHA", "threes", 2.5, -110, None, "A @ B")]
    # nets stands before hornets in the table, and is in the word
    old = odds.book_b(odds.read_book_b(spark, str(tmp_path / "tabs")), events, "2024-01-15", compat=True).collect()
    assert said(old) == [("jo smith jr - x", "BKN", "threes", 2.5, -110, None, "A @ B")]


def test_compat(spark):
    """Names that contain others are told by default; with compat the order of the table counts, as does a statistic's missing name."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("Steals + Blocks", "turnovers", "a/charlotte_hornets.png"), ("Pts + Reb", "points", "a/brooklyn_nets_jersey.png"), ("Steals", "x y", "a/b"), (None, None, None)], "p string, s string, logo string")
    tell = lambda compat: rows(df.select(odds.prop_type(F.col("p"), compat=compat), feed.stat_of(F.col("s"), compat=compat), odds.team_of(F.col("logo"), compat=compat)))
    assert tell(False) == [("stocks", "TOV", "CHA"), ("pr", "PTS", "BKN"), ("steals", "X Y", "UNK"), ("unknown_prop", None, "UNK")]
    assert tell(True) == [("steals", "TURNOVERS", "BKN"), ("pr", "PTS", "BKN"), ("steals", "X Y", "UNK"), ("unknown_prop", None, "UNK")]


def test_schedule(spark, tmp_path):
    team = lambda code, score: {"teamId": 1, "teamName": code.lower(), "teamTricode": code, "score": score}
    game = {"gameId": "001", "gameStatus": 3, "gameDateTimeEst": "2024-01-15T19:30:00Z", "gameDateTimeUTC": "2024-01-16T00:30:00Z", "arenaName": "Dome", "homeTeam": team("BOS", 100), "awayTeam": team("LAL", 90)}
    leaders = [{"teamTricode": "BOS", "firstName": "A", "lastName": "B", "points": 1}, {"teamTricode": "LAL", "firstName": "C", "points": 2}, {"teamTricode": "BOS", "firstName": "D", "lastName": "E", "points": 3}]
    later = {"gameId": "002", "gameDateTimeEst": "soon", "gameDateTimeUTC": "2024-01-15T23:30:00Z", "homeTeam": team("NYK", None), "awayTeam": {}}
    put(tmp_path / "s.json", {"leagueSchedule": {"gameDates": [{"gameDate": "01/15/2024 00:00:00", "games": [game | {"pointsLeaders": leaders}, later]}, {"gameDate": "01/15/2024 00:00:00", "games": [game]}, {"gameDate": "01/16/2024 00:00:00", "games": [game]}]}})
    flat = schedule.by_time(schedule.shown(schedule.flatten(schedule.on_day(schedule.read_schedule(spark, str(tmp_path / "s.json")), "2024-01-15")))).collect()
    assert [r["game_id"] for r in flat] == ["002", "001"]
    a, b = flat[1], flat[0]
    assert (a["home_leader_name"], a["home_leader_points"], a["away_leader_name"], a["winning_team"], a["score_differential"], a["total_points"]) == ("D E", 3.0, "C", "home", 10, 190)
    assert (a["matchup"], a["display_score"], a["arena_full"], a["game_time_et"], a["game_date"], a["game_weekday"], a["middle"], a["below"]) == ("LAL @ BOS", "LAL 90 - BOS 100", "Dome, Unknown City, Unknown State", "07:30 PM ET", "2024-01-15", "Monday", "90 - 100", None)
    assert (b["game_time_et"], b["is_scheduled"], b["home_score"], b["winning_team"], b["badge"], b["below"]) == ("soon", True, 0, "tie", "@", "soon")
    assert schedule.read_schedule(spark, str(tmp_path / "no.json")).count() == 0


def test_stats_files(spark, tmp_path):
    put(tmp_path / "r.json", {"resultSets": [{"headers": ["B", "A"], "rowSet": [[1, "x"], [None, "y"]]}]})
    assert rows(tables.result_set(spark, str(tmp_path / "r.json"), {"A": "string", "B": "int", "C": "double"})) == [("x", 1, None), ("y", None, None)]
    for m, cols in stats.MEASURES.items():
        for k, day in enumerate(("2024-01-01", "2024-01-02")):
            put(tmp_path / f"t/measure={m}/day={day}/x.json", {"resultSets": [{"headers": ["PLAYER_ID", *cols], "rowSet": [[k + (m == "Drives"), *range(len(cols))]]}]})
    got = stats.tracking(spark, str(tmp_path / "t")).orderBy("DATE_STR", "PLAYER_ID").select("PLAYER_ID", "DATE_STR", "POTENTIAL_AST", "DRIVE_PTS")
    assert rows(got) == [(0, "01/01/2024", 0.0, None), (1, "01/01/2024", None, 1.0), (1, "01/02/2024", 0.0, None), (2, "01/02/2024", None, 1.0)]
    log = "PLAYER_ID,GAME_ID,GAME_DATE,PTS,EXTRA\n1,0022,2024-01-01,10,a\n2,0023,2024-01-03,,b\n"
    put(tmp_path / "log.csv", log)
    assert rows(stats.game_log(spark, str(tmp_path / "log.csv")).select("PLAYER_ID", "GAME_ID", "DATE_STR", "PTS", "WL")) == [(2, "0023", "01/03/2024", None, None), (1, "0022", "01/01/2024", 10.0, None)]
    assert tables.csv_or_empty(spark, str(tmp_path / "no.csv"), "a int").count() == 0
    tables.write_csv(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "out"))
    assert rows(tables.csv_or_empty(spark, str(tmp_path / "out"), "b string, a int")) == [("x", 1)]
    tables.write_json_lines(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "j"))
    assert [json.loads(r[0]) for r in rows(spark.read.text(str(tmp_path / "j")))] == [{"a": 1, "b": None}]
    tables.view(spark.range(3).toDF("n"), "some_view")
    assert spark.sql("select sum(n) from some_view").first()[0] == 3


def test_zones(spark, tmp_path):
    made = [43, 58, 59, 1, 54, 17]
    row = lambda name, n: [1, name, 2, "BOS", 20, "n", *[x for v in (*n, 7, 8) for x in (v // 2, v, 0.5)]]
    put(tmp_path / "s.json", {"resultSets": {"headers": [{}, {"columnNames": []}], "rowSet": [row("A", made), row("B", [0] * 6), row("C", [1, 1, 1, 0, 0, 0]), ["short"]]}})
    zones = feed.zone_map(stats.shooting_zones(stats.shooting(spark, str(tmp_path / "s.json"))))
    got = {r["name"]: {k: (v["percentage"], v["makes"]) for k, v in r["zones"].items()} for r in zones.collect()}
    assert set(got) == {"A", "C"} and [got["A"][z][0] for z in stats.SIX] == ["19%", "25%", "25%", "1%", "23%", "7%"] and got["A"]["paint"][1] == "29"
    assert [got["C"][z][0] for z in stats.SIX] == ["34%", "33%", "33%", "0%", "0%", "0%"]
    link = lambda source, value: {"source": source, "value": value, "AtRim": 1, "ShortMidRange": 1, "Corner3": 3}
    for t, links in ((1, [link("7", 5), link("7", 6), link("8", 1)]), (2, [link("7", 9)])):
        put(tmp_path / f"g/team_id={t}/x.json", {"results": {"nodes": [{"id": "7", "name": "Seven"}], "links": links}})
    totals = stats.assist_totals(stats.assists(spark, str(tmp_path / "g"))).orderBy("name")
    assert rows(totals.select("name", "team_id", "rim", "mid", "corner3", "total")) == [("8", "1", 1.0, 1.0, 3.0, 1.0), ("Seven", "2", 1.0, 1.0, 3.0, 9.0)]


def test_shares_of_a_total_of_its_own(spark, tmp_path):
    """The zones of an assist link need not add up to its total: what is short goes to the largest remainders, one each; a total of 0 has no zones."""
    link = lambda source, value, **k: {"source": source, "value": value, **k}
    put(tmp_path / "g/team_id=1/x.json", {"results": {"nodes": [], "links": [link("even", 10, AtRim=5, Corner3=3, Arc3=2), link("short", 100, AtRim=10, Arc3=1), link("over", 4, AtRim=5, Corner3=3), link("none", 0, AtRim=5)]}})
    zones = feed.zone_map(stats.assist_zones(stats.assists(spark, str(tmp_path / "g")))).collect()
    got = {r["name"]: [(r["zones"][z]["percentage"], r["zones"][z]["makes"]) for z in stats.FIVE] for r in zones}
    assert got == {
        "even": [("50%", "5"), ("0%", "0"), ("15%", "1"), ("15%", "1"), ("20%", "2")], "short": [("11%", "10"), ("1%", "0"), ("1%", "0"), ("1%", "0"), ("2%", "1")],
        "over": [("125%", "5"), ("0%", "0"), ("37%", "1"), ("37%", "1"), ("0%", "0")],
    }


def test_season(spark, tmp_path):
    base = {"headers": ["PLAYER_ID", "TEAM_ID", "PLAYER_NAME", "AST", "REB", "FGA", "FTA", "EXTRA"], "rowSet": [[1, 10, "A", 5, 8, 10, 2.5, "x"], [1, 11, "A", 1, None, 3, 1, "x"], [2, 10, "B", 4, 1, None, 2, "x"]]}
    put(tmp_path / "s/measure=Base/x.json", {"resultSets": [base]})
    put(tmp_path / "s/measure=Passing/x.json", {"resultSets": [{"headers": ["PLAYER_ID", "TEAM_ID", "POTENTIAL_AST", "PASSES_MADE"], "rowSet": [[1, 10, 9, 40], [2, 10, 0, 1]]}]})
    put(tmp_path / "s/measure=Rebounding/x.json", {"resultSets": [{"headers": ["PLAYER_ID", "TEAM_ID", "REB_CHANCES", "REB_CONTEST_PCT"], "rowSet": [[1, 10, 12, 0.5]]}]})
    got = stats.read_season(spark, str(tmp_path / "s")).orderBy("PLAYER_ID", "TEAM_ID").select("PLAYER_NAME", "TEAM_ID", "PASSES_MADE", "DRIVES", "AST_CONVERSION_PCT", "REB_HUSTLE_PCT", "AGGRESSION_SCORE")
    assert rows(got) == [("A", 10, 40.0, 0.0, 0.556, 0.667, 12.5), ("A", 11, 0.0, 0.0, 0.0, 0.0, 4.0), ("B", 10, 1.0, 0.0, 0.0, 0.0, 2.0)]
    assert len(stats.read_season(spark, str(tmp_path / "s")).columns) == 38
    assert stats.read_season(spark, str(tmp_path / "none")).count() == 0
    few = stats.season(spark.createDataFrame([(1, 2, 3.0)], "PLAYER_ID long, TEAM_ID long, FGA double"), {})
    assert rows(few.select("FGA", "DRIVES", "AST_CONVERSION_PCT", "AGGRESSION_SCORE")) == [(3.0, 0.0, 0.0, 3.0)]


def test_feed(spark, players):
    season = players.select("player_id", "name", "team", "ord").toDF("PLAYER_ID", "PLAYER_NAME", "TEAM_ABBREVIATION", "ord").selectExpr("*", "if(PLAYER_ID = 5, 0D, 3D) as GP", "'7.5' as PTS")
    logs = spark.createDataFrame([(1, f"2024-01-{k:02}", f"g{k}", k) for k in range(1, 6)], "PLAYER_ID long, GAME_DATE string, GAME_ID string, PTS int")
    kind = "map<string, struct<percentage: string, makes: string>>"
    shooting = spark.createDataFrame([("Nikola Jokić", {"paint": ("100%", "3")}), ("lebron james", {"paint": ("1%", "1")})], f"name string, zones {kind}")
    assists = spark.createDataFrame([("nikola jokic", {"a": ("1%", "1")}, 0), ("Nikola Jokić", {"a": ("2%", "2")}, 1)], f"name string, zones {kind}, ord int")
    odds_rows = [(0, "lebron james", "CLE", None, "points", "dk", 20.5, -110, -110, 0), (1, "lebron james", "CLE", None, "points", "dk", 22.5, 105, -125, 1), (2, "lebron james", "CLE", None, "points", "fd", 21.5, 1, 2, 2), (3, "nobody", "LAL", None, "points", "fd", 1.0, 1, 2, 3)]
    given = spark.createDataFrame(odds_rows, "prop_id int, player string, team string, team_options array<string>, prop_type string, book string, line double, over_odds int, under_odds int, ord int")
    docs = {r["id"]: r for r in feed.build(season, logs, shooting, assists, given, ["PTS", "AST"], games=3).collect()}
    assert set(docs) == {1, 2, 3, 4, 6, 7}  # 5 has no games and no props
    assert [g["GAME_ID"] for g in docs[1]["game_log"]] == ["g5", "g4", "g3"] and docs[2]["game_log"] == [] and docs[1]["stats"] == {"PTS": 7.5, "AST": 0.0}
    assert docs[6]["shooting_zones"]["paint"]["makes"] == "3" and docs[6]["assist_zones"]["a"]["makes"] == "2" and docs[1]["shooting_zones"] is None
    assert {b: (p["line"], p["over"]) for b, p in docs[7]["props"]["PTS"].items()} == {"dk": (22.5, 105), "fd": (21.5, 1)} and docs[1]["props"] == {}
    assert feed.build(season.limit(0), logs, shooting, assists, given, ["PTS"]).count() == 0


def test_inline_tables(spark):
    from pyspark.sql import functions as F

    games = constants.similar_games(spark).withColumn("made", constants.diff_percent(F.col("line"), F.col("result")))
    assert games.count() == 8 and games.where("made <> diff_percent").isEmpty()
    assert constants.team_ids(spark).select("team_id").distinct().count() == 30
