"""Landed documents: files that parse and files that don't add up to all; keys beyond the schema can be read."""

import json

from pyspark.sql import functions as F

from tallyspark.sources import landing, odds


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text if isinstance(text, str) else json.dumps(text))


def test_landing(spark, tmp_path):
    doc = {"events": [{"id": "e1", "name": "A @ B"}], "markets": [{"id": "m1", "name": "Al B Points", "eventId": "e1", "tags": ["SGP"]}], "selections": [], "version": {"n": 3, "by": "x"}}
    put(tmp_path / "a/prop_type=points/1.json", json.dumps(doc, indent=2))
    put(tmp_path / "a/prop_type=points/2.json", {"events": "none today", "new": 1})
    put(tmp_path / "a/prop_type=rebounds/3.json", '{"events": [')
    put(tmp_path / "a/prop_type=rebounds/4.json", "")
    put(tmp_path / "a/prop_type=rebounds/5.json", "<html>busy</html>")
    docs = landing.documents(spark, str(tmp_path / "a"), "prop_type")
    n = landing.counts(docs).first()
    assert n["files"] == n["good"] + n["bad"] == docs.count() and (n["good"], n["bad"]) in {(2, 3), (2, 2)}  # an empty file may have no row
    bad = {r["file"].rsplit("/", 1)[1]: (r["length"], r["begins"]) for r in landing.quarantine(docs).collect()}
    assert bad["3.json"] == (12, '{"events": [') and bad["5.json"][1].startswith("<html>")
    rows = {r["file"].rsplit("/", 1)[1]: r for r in landing.good(docs, odds.BOOK_A, "prop_type").withColumn("n", landing.value("doc", "$.version.n", "int", -1)).withColumn("tag", landing.value("doc", "$.markets[0].tags[0]", "string")).drop("doc").collect()}
    assert set(rows) == {"1.json", "2.json"} and rows["1.json"]["prop_type"] == "points"
    assert (rows["1.json"]["n"], rows["1.json"]["tag"], rows["1.json"]["events"][0]["name"]) == (3, "SGP", "A @ B") and (rows["2.json"]["n"], rows["2.json"]["tag"], rows["2.json"]["markets"]) == (-1, None, None)
    assert {r["key"]: r["files"] for r in landing.keys(docs).collect()} == {"events": 2, "markets": 1, "selections": 1, "version": 1, "new": 1}
    none = landing.documents(spark, str(tmp_path / "no"), "prop_type")
    assert none.count() == 0 and landing.good(none, odds.BOOK_A, "prop_type").count() == 0 and landing.quarantine(none).count() == 0


def test_good_documents_give_the_same_odds(spark, tmp_path):
    sel = lambda m, side: {"marketId": m, "label": side, "points": 1.5, "displayOdds": {"american": "-110"}}
    put(tmp_path / "a/prop_type=points/1.json", {"events": [], "markets": [{"id": "m1", "name": "Al B Points", "eventId": "e"}], "selections": [sel("m1", "Over"), sel("m1", "Under")]})
    put(tmp_path / "a/prop_type=points/2.json", "{")
    path = str(tmp_path / "a")
    got = odds.book_a(landing.good(landing.documents(spark, path, "prop_type"), odds.BOOK_A, "prop_type"), "2024-01-01")
    want = odds.book_a(odds.read_book_a(spark, path), "2024-01-01")
    assert got.collect() == want.collect() and got.count() == 1 and got.where(F.col("player") == "al b").count() == 1
