"""The corpus pipeline's stages on a small corpus, against brute force where a stage has no model."""

import collections

import pytest
from test_text_operators import LONG, brute_dedup, brute_join

import corpus_pipeline

PASSAGE = "every morning the keeper of the lighthouse walks down the hundred and nine steps to count the boats that came home in the night and those that did not "


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    words = [f"word{k}" for k in range(300)]
    say = lambda k, n: " ".join(words[(k * 37 + j * (k % 5 + 1)) % 300] for j in range(n))
    rows = [(k, say(k, 40 + k % 50)) for k in range(60)]
    rows += [(100 + k, say(k, 40 + k % 50)) for k in range(5)] + [(110 + k, say(k, 40 + k % 50) + " end") for k in range(5)]
    rows += [(200 + k, say(60 + k, 50) + " " + PASSAGE + say(80 + k, 50)) for k in range(5)]
    rows += [(300, None), (301, ""), (302, " 12 34 "), (303, LONG * 400), (304, "a lone row that is there twice " * 2), (304, "a lone row that is there twice " * 2), (None, "a row without a number of its own " * 3)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    full = [(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), "x", "y") for i, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, place string, n_bytes string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, corpus, tmp_path):
    docs, after = spark.read.parquet(f"{corpus}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()] if name != "language_id" else []
        stage(spark, docs, corpus).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
        texts = collections.Counter((r["doc_id"], r["text"]) for r in after[name]) if name != "packing" else None
        if name == "language_id":
            assert not {300, 301, 302} & {i for i, _ in texts} and len(after[name]) == 79
        if name == "toxicity":
            assert len(after[name]) == 79  # nothing to learn from: all stay
        if name == "jaccard_join":
            groups = collections.defaultdict(set)
            for i, _, c in brute_join(before):
                groups[c].add(i)
            assert sorted((i for i, _ in texts.elements()), key=str) == sorted(groups, key=str) and 100 not in groups and 304 in groups
        if name == "suffix_dedup":
            want = collections.Counter((i, n - gone) for i, n, gone, _, _ in brute_dedup(before).elements())
            assert collections.Counter((r["doc_id"], len(r["text"].encode())) for r in after[name]) == want
            assert sum(PASSAGE.strip() in r["text"] for r in after[name]) == 1 and all(r["n_chars"] == len(r["text"]) for r in after[name])
    pieces = collections.Counter()
    for r in after["packing"]:
        pieces[r["doc_id"]] += r["length"]
        assert r["length"] <= 4096
    assert all(pieces[r["doc_id"]] == r["doc_tokens"] for r in after["packing"])
    whole = collections.Counter((r["doc_id"], r["doc_tokens"]) for r in corpus_pipeline.run(spark, corpus).collect() if r["start"] == 0)
    assert whole == collections.Counter((r["doc_id"], r["doc_tokens"]) for r in after["packing"] if r["start"] == 0)


def test_empty(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, corpus).count() == 0, name


def test_models_in_stages(spark, tmp_path):
    """Two languages and labels: both networks are fitted, no clean document goes, toxic ones do, and a text without a letter has no language."""
    words = {"en": "the old bridge was near where they walked and talked through this night with their friends".split(), "de": "die alte Brücke lag dort wo sie nachts über den Weg gingen und mit ihren Freunden sprachen".split()}
    say = lambda k, lang, n=40: " ".join(words[lang][(k * 7 + j * (k % 5 + 1) + j * j) % 16] for j in range(n))
    rows = [(k, say(k, "en" if k % 2 else "de"), "en" if k % 2 else "de") for k in range(160)]
    rows += [(200 + k, say(k, "en", 15) + " you filthy worthless vermin crawl away " + say(k + 1, "en", 15), "en") for k in range(60)]
    rows += [(300, "12 34", "en"), (301, "the night", "en"), (302, "die Brücke", "de")]
    spark.createDataFrame([(i, t, g, "s", len(t)) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(200 <= i < 300)) for i, _, _ in rows if i < 300], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    known = corpus_pipeline.identify_language(spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in known.collect()} == {i for i, _, _ in rows} - {300}
    clean = corpus_pipeline.drop_toxic(spark, known, str(tmp_path))
    left = {r["doc_id"] for r in clean.collect()}
    assert clean.columns == docs.columns and left >= set(range(160)) and len(left & set(range(200, 260))) <= 3
