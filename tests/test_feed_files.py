"""The feed from landed files to JSON arrays and back, and what the writing run counts."""

import json

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import assemble
from tallyspark.sources import feed_files, stats


def put(path, doc):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(doc if isinstance(doc, str) else json.dumps(doc))


def land(root):
    season = {"headers": ["PLAYER_ID", "TEAM_ID", "PLAYER_NAME", "TEAM_ABBREVIATION", "GP", "PTS", "REB", "AST"], "rowSet": [[1, 10, "LeBron James", "LAL", 3, 20, 5, 7], [2, 10, "Nikola Jokić", "DEN", 3, 25, 12, 9], [3, 11, "No Games", "BOS", 0, 0, 0, 0], [4, 10, "Two Teams", "LAL", 1, 1, 1, 1], [4, 12, "Two Teams", "MIA", 2, 2, 2, 2]]}
    put(root / "season/measure=Base/x.json", {"resultSets": [season]})
    put(root / "season/measure=Passing/x.json", {"resultSets": [{"headers": ["PLAYER_ID", "TEAM_ID", "POTENTIAL_AST", "PASSES_MADE"], "rowSet": [[1, 10, 9, 40]]}]})
    put(root / "log.csv", "PLAYER_ID,GAME_ID,GAME_DATE,PTS,REB,AST,STL,BLK\n1,0001,2024-01-09,10,1,2,0,0\n1,0002,2024-01-10,30,1,2,0,0\n2,0002,2024-01-10,11,9,9,1,1\n1,0003,2024-01-12,99,1,1,1,1\n")
    for m, cols in stats.MEASURES.items():
        put(root / f"tracking/measure={m}/day=2024-01-10/x.json", {"resultSets": [{"headers": ["PLAYER_ID", *cols], "rowSet": [[1, *range(1, len(cols) + 1)]]}]})
    row = lambda name, n: [1, name, 2, "BOS", 20, "n", *[x for v in (*n, 7, 8) for x in (v // 2, v, 0.5)]]
    put(root / "shooting.json", {"resultSets": {"headers": [{}, {"columnNames": []}], "rowSet": [row("LeBron James", [43, 58, 59, 1, 54, 17])]}})
    put(root / "assists/team_id=1/x.json", {"results": {"nodes": [{"id": "7", "name": "nikola jokic"}], "links": [{"source": "7", "value": 10, "AtRim": 5, "Corner3": 3, "Arc3": 2}]}})
    sel = lambda side, points: {"marketId": "m1", "label": side, "points": points, "displayOdds": {"american": "-110"}}
    put(root / "book_a/prop_type=points/1.json", {"events": [{"id": "e1", "name": "A @ B", "teamShortName1": "LAL", "teamShortName2": "DEN", "startEventDate": "2024-01-13T01:30:00Z"}], "markets": [{"id": "m1", "name": "Lebron James Points O/U", "eventId": "e1"}], "selections": [sel("Over", 22.5), sel("Under", 22.5)]})
    put(root / "book_a/prop_type=points/2.json", "not JSON {")
    put(root / "book_b/main.json", {"attachments": {"events": {"1": {"eventId": "1", "name": "A @ B", "openDate": "2024-01-12T23:00:00Z"}}}})
    run = lambda kind, price: {"result": {"type": kind}, "handicap": 4.5, "secondaryLogo": "x/charlotte_hornets.png", "winRunnerOdds": {"americanDisplayOdds": {"americanOdds": price}}}
    put(root / "book_b/tabs/event_id=1/t.json", {"attachments": {"markets": {"1": {"marketName": "Nikola Jokic - Turnovers", "runners": [run("OVER", "-120"), run("UNDER", "100")]}, "2": {"marketName": "Nobody Known - Points", "runners": [run("OVER", "1"), run("UNDER", "1")]}}}})


@pytest.mark.parametrize("compat", [False, True])
def test_from_landed_files_to_the_feed_and_back(spark, tmp_path, compat):
    land(tmp_path / "in")
    docs = assemble.from_files(spark, str(tmp_path / "in"), "2024-01-12 18:00:00", compat)
    n = feed_files.write_arrays(docs, str(tmp_path / "feed"), files=3, totals={"with_props": F.sum((F.size("props") > 0).cast("int")), "games": F.sum(F.size("game_log"))})
    assert n == {"rows": 3, "with_props": 2, "games": 3}
    told = [d for p in (tmp_path / "feed").glob("*.txt") for d in json.loads(p.read_text())]
    assert sorted(d["id"] for d in told) == [1, 2, 4] and all(d["shooting_zones"] is None for d in told if d["id"] != 1)
    back = {r["id"]: r for r in feed_files.read_arrays(spark, str(tmp_path / "feed")).collect()}
    assert set(back) == {1, 2, 4} and back[4]["team"] == "MIA" and back[1]["stats"]["PTS+REB"] == 25.0 and back[1]["stats"]["POTENTIAL_AST"] == 9.0
    assert [(g["GAME_ID"], g["PTS"], g["PTS+REB+AST"], g["DRIVE_PTS"], str(g["GAME_DATE"])) for g in back[1]["game_log"]] == [("0002", 30.0, 33.0, 2.0, "2024-01-10"), ("0001", 10.0, 13.0, 0.0, "2024-01-09")]
    assert back[1]["props"]["PTS"]["dk"]["line"] == 22.5 and back[2]["props"]["TURNOVERS" if compat else "TOV"]["fd"]["over"] == -120
    assert back[1]["shooting_zones"]["restricted_area"]["percentage"] == "19%" and back[2]["assist_zones"]["restricted_area"]["percentage"] == "50%"
    same = feed_files.read_arrays(spark, str(tmp_path / "feed")).select("id", "name", "team", "stats", "props").collect()
    built = docs.select("id", "name", "team", "stats", "props").collect()
    assert sorted(map(str, same)) == sorted(map(str, built))


def test_a_failed_run_leaves_nothing_and_others_are_empty(spark, tmp_path):
    bad = spark.range(5).select("id", F.when(F.col("id") == 3, F.raise_error(F.lit("no"))).otherwise(F.lit("x")).alias("name"))
    with pytest.raises(Exception, match="no"):
        feed_files.write_arrays(bad, str(tmp_path / "feed"), files=2)
    schema = "id bigint, name string"
    assert feed_files.read_arrays(spark, str(tmp_path / "none"), schema).count() == 0
    (tmp_path / "feed").mkdir(exist_ok=True)
    assert feed_files.read_arrays(spark, str(tmp_path / "feed"), schema).count() == 0
    for k, text in enumerate(['{"id": 1}', "", "[not JSON", '[{"id": 2, "name": null}, {"id": 3, "name": "c"}]', " [] "]):
        put(tmp_path / f"mixed/{k}.txt", text)
    assert sorted(tuple(r) for r in feed_files.read_arrays(spark, str(tmp_path / "mixed"), schema).collect() if r["id"]) == [(2, None), (3, "c")]


def test_counts_come_from_the_run_that_writes(spark, tmp_path):
    from pyspark.sql import SparkSession  # noqa: F401

    df = spark.range(1000).select("id", (F.col("id") % 3 == 0).alias("live"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "counted")
    n = feed_files.write_arrays(df, str(tmp_path / "feed"), files=4, totals={"live": F.sum(F.col("live").cast("int"))})
    jobs = tracker.getJobIdsForGroup("counted")
    spark.sparkContext.setJobGroup("", "")
    assert n == {"rows": 1000, "live": 334} and len(list((tmp_path / "feed").glob("*.txt"))) == 4 and len(jobs) <= 2  # one for the shuffle, one for the files
    assert feed_files.read_arrays(spark, str(tmp_path / "feed"), "id bigint, live boolean").where("live").count() == 334
