"""The text operators against brute force and on odd inputs: nulls, empty and repeated rows, ties, empty tables, other columns."""

import base64
import collections
import hashlib
import random
import struct
import zlib

import pyarrow as pa
import public_tokenizers
import pytest

from tallyspark.llm import byte_bpe, exact_topk, jaccard_join, language_id, license_scan, line_quality, packing, quality_rules, suffix_dedup, toxicity

BPE, WORD = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
LONG = "the quick brown fox jumps over the lazy dog while seven wizards brew strange potions near an old stone bridge at midnight "
ROWS = [
    (1, LONG * 3, "en"), (2, LONG * 3, "en"), (3, LONG * 3 + "and then they left", "en"), (4, None, "en"), (5, "", None), (6, "   \n\t ", "de"), (7, "un deux trois quatre cinq", "fr"),
    (None, "x" * 700, None), (8, "one two", "en"), (8, "one two", "en"), (9, "ÀÉ ß ñ  double  spaces \n\n it's", "fr"), (10, "word " * 3000, "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, g, f"s{k % 3}", 0, True, 0.5) for k, (i, t, g) in enumerate(ROWS)], "doc_id long, text string, lang string, source string, n_chars long, held_out boolean, score double")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 1), (7, 1, 0), (10, 0, 1), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")


def by_count(rows):
    return collections.Counter(tuple(r) for r in rows)


def test_byte_bpe(spark, docs):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda x: hashlib.sha256(x).hexdigest()
    expected = by_count((i, len(k := want.encode_ordinary(t or "")), sha(",".join(map(str, k)).encode()), sha((t or "").encode())) for i, t, _ in ROWS)
    assert by_count(byte_bpe.round_trip(docs, BPE).collect()) == expected
    back = byte_bpe.decode(byte_bpe.encode(docs, BPE), BPE).collect()
    assert by_count((r["doc_id"], bytes(r["bytes"])) for r in back) == by_count((i, (t or "").encode()) for i, t, _ in ROWS)
    assert byte_bpe.round_trip(docs.limit(0), BPE).count() == 0
    # words of any length, and a text of over 2 MiB
    rng = random.Random(3)
    letters = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    texts = ["x" * 255, "x" * 256, "ab" * 150 + " " + "a" * 301, letters(700, "abc"), letters(2500, "etaoinshrdlu"), letters(5000, "etaoin"), " " * 900 + "a", "é" * 400, "!?" * 300, "don't  stop\n\n now. ok, ,x \u3000y", "a\0b c", letters(4096, "ab"), " word " * 3, "word, word. Ünï, 漢字 ٣٤ x1,", LONG * 20_000]
    many = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, ids int, n_tokens string")
    ids = [want.encode_ordinary(t) for t in texts]
    assert by_count(byte_bpe.round_trip(many, BPE).collect()) == by_count((i, len(k), sha(",".join(map(str, k)).encode()), sha(texts[i].encode())) for i, k in enumerate(ids))
    assert {r["doc_id"]: r["ids"] for r in byte_bpe.encode(many.where("doc_id < 14"), BPE).collect()} == dict(enumerate(ids[:14]))


def test_contract_all_is_the_same():
    """Contracting all places of a pair in a turn gives what one place at a time gives."""
    rng = random.Random(4)
    coder = byte_bpe.ByteBpe(BPE, public_tokenizers.PATTERN)
    for of in ("ab", "aab", "etaoinshr", "0", "the qui"):
        words = ["".join(rng.choice(of) for _ in range(n)) for n in (256, 300, 411, 2, 30, 255)]
        size, ids = coder.contract(pa.array(words, pa.large_string()))
        want = [coder.contract_long(w.encode()) for w in words]
        assert size.tolist() == [len(x) for x in want] and ids.tolist() == sum(want, [])


def test_exact_topk(spark):
    vectors = [(i, [float((i * 7 + k * i) % 11) / 8 - 0.5 for k in range(6)]) for i in range(120)] + [(500, None), (501, [None] * 6), (502, [float("nan")] * 6), (503, [0.1, 0.2]), (600, []), (601, []), (3, [float((21 + k * 3) % 11) / 8 - 0.5 for k in range(6)])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    from pyspark.sql import functions as F

    got = [tuple(r) for r in exact_topk.search(df, F.col("vec_id") % 50 == 0, candidates=16, queries=2).collect()]
    whole = {i: [int(256 * x // 1) for x in v] for i, v in vectors if i < 500}
    want = []
    for q in (0, 50, 100):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted(got) == sorted([*want, (600, 1, 601, 0)])
    assert exact_topk.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("size", [1, 1 << 20, 1 << 28, 1 << 29])
def test_exact_topk_repeats_and_large_components(spark, size):
    """A repeated candidate counts each time, and whole numbers of any size are ranked exactly; other columns do not matter."""
    from pyspark.sql import functions as F

    rng = random.Random(size)
    rows = [(i, [float(rng.randrange(-3, 4) * size + rng.randrange(3)) / 256 for _ in range(4)]) for i in range(60)]
    rows += rows[7:10] + rows[:1]
    df = spark.createDataFrame([(*r, 1, 2, 3, "k") for r in rows], "vec_id long, embedding array<double>, copies int, size int, c int, key string")
    whole = [(i, [int(256 * x // 1) for x in v]) for i, v in rows]
    want = []
    for q in (0, 50):
        v = next(v for i, v in whole if i == q)
        best = sorted((-sum(a * b for a, b in zip(v, u)), i) for i, u in whole if i != q)[:5]
        want += [(q, r + 1, i, -x) for r, (x, i) in enumerate(best)]
    got = exact_topk.search(df, F.col("vec_id") % 50 == 0, candidates=16, queries=2)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_exact_topk_components_beyond_a_long(spark):
    """Components of any size keep their value; a score that does not fit a long is an error, and none is clamped."""
    from pyspark.sql import functions as F

    rows = [(0, [1 / 256, 0.0]), (1, [-1e30, 3.0]), (2, [2.0, 1.0]), (3, [3.0, 0.0]), (4, [-1e30, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ask = F.col("vec_id") == 0
    assert [tuple(r) for r in exact_topk.search(df, ask, k=2).collect()] == [(0, 1, 3, 768), (0, 2, 2, 512)]
    with pytest.raises(Exception, match="too (big|large)|out of bounds|Overflow"):
        exact_topk.search(df, ask, k=3).collect()


@pytest.mark.parametrize("window", [64, 4096])
def test_packing(docs, window):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD)
    keyed = docs.where("doc_id is not null and doc_id <> 8")
    pieces = packing.pack(keyed, WORD, window=window).collect()
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t, _ in ROWS}
    of, seq = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        of[p["doc_id"]].append(p)
        seq[p["sequence_id"]].append((p["offset"], p["length"]))
    for i, ps in of.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids[i])
            assert p["ids_crc32"] == zlib.crc32(struct.pack(f"<{p['length']}I", *ids[i][at : at + p["length"]]))
            at += p["length"]
        assert at == len(ids[i])
    assert set(of) == {i for i, _, _ in ROWS if i not in (None, 8)}
    for k, parts in seq.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window or k == max(seq)
    assert packing.pack(docs.limit(0), WORD).count() == 0


def test_runs_together_are_as_runs_alone(monkeypatch):
    """Many runs in one text for the tokenizer have the ids that each has alone."""
    from tokenizers import Tokenizer

    tok, rng = Tokenizer.from_file(WORD), random.Random(9)
    runs = ["|", "a|b", "||", "\u0301x", "é", "e\u0301", "\u3000", "don't", "x1y22", "漢字", "\U0001f600", *("".join(rng.choice("abzé'1|.,-\u0301ß漢") for _ in range(rng.randrange(1, 9))) for _ in range(400))]
    monkeypatch.setattr(packing, "TOGETHER", 7)
    want = [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in tok.encode_batch(runs, add_special_tokens=False)]
    assert packing.encoded(tok, runs) == want


def test_packing_is_deficit_round_robin():
    """The closed form serves the tokens that a queue by queue, token by token round gives: each time the queue goes next whose credit, its
    weight of all that is served, is furthest ahead of what it has had; an empty queue drops out."""
    import numpy as np

    rng = np.random.default_rng(2)
    for weights in ([0.7513, 0.2487], [1.0], *(rng.random(k).tolist() for k in (2, 3, 5, 9, 30))):  # no two tokens are due at one moment
        totals = rng.integers(0, 300, len(weights))
        mixture = packing.Mixture(totals, np.array(weights), 64)
        had, order = [0] * len(weights), []
        for _ in range(totals.sum()):
            due = [((had[k] + 0.5) / weights[k], k) for k in range(len(weights)) if had[k] < totals[k]]
            k = min(due)[1]
            had[k] += 1
            order.append(k)
        want = np.array([np.bincount(order[:n], minlength=len(weights)) for n in range(len(order) + 1)])
        assert (mixture.served(np.arange(len(order) + 1)) == want).all()
        # every window holds its proportions to within a token, while no queue is empty
        whole = min((t / w for t, w in zip(totals, weights)), default=0) * sum(weights)
        for n in range(0, int(whole) - 64, 64):
            part = want[n + 64] - want[n]
            assert (abs(part - 64 * np.array(weights) / sum(weights)) <= 1 + len(weights) / 2).all()


def test_packing_weights_and_queues(spark):
    rows = [(k, "one two three four five six seven eight", f"s{k % 3}") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces = packing.pack(df, WORD, weights={"s0": 0.75}, window=64).collect()
    of = collections.Counter()
    for p in pieces:
        if p["sequence_id"] < 10:
            of[p["doc_id"] % 3] += p["length"]
    assert [of[k] for k in range(3)] == [480, 80, 80]
    with pytest.raises(ValueError, match="nothing for"):
        packing.pack(df, WORD, weights={"s0": 1.0})
    # 300 sources in 256 queues; given weights keep queues of their own
    many = spark.createDataFrame([(k, "a b c", f"s{k}") for k in range(300)], "doc_id long, text string, source string")
    pieces = packing.pack(many, WORD, weights={"s299": 0.5}, window=64).collect()
    assert sorted(p["doc_id"] for p in pieces if p["start"] == 0) == list(range(300))
    assert len({p["queue"] for p in pieces}) == 256 and all((p["queue"] == 0) == (p["doc_id"] == 299) for p in pieces)


def brute_dedup(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            s = b[p : p + 100]
            if s in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(s)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return by_count(out)


@pytest.mark.parametrize("group", [2, 1024])
def test_suffix_dedup(docs, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    assert by_count(suffix_dedup.dedup(docs).collect()) == brute_dedup([(i, t) for i, t, _ in ROWS])
    unique = docs.where("doc_id is not null and doc_id <> 8")
    assert by_count(suffix_dedup.dedup(unique).collect()) == brute_dedup([(i, t) for i, t, _ in ROWS if i not in (None, 8)])
    assert suffix_dedup.dedup(docs.limit(0)).count() == 0
    assert suffix_dedup.dedup(docs, keep_text=True).columns == docs.columns


def test_anchors_find_what_doubling_finds(spark):
    """Ranks of sampled positions give the very starts that prefix doubling over every byte gives."""
    rng = random.Random(8)
    parts = ["".join(rng.choice("ab cd") for _ in range(rng.randrange(20, 260))) for _ in range(12)]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randrange(5)))) for k in range(60)] + [(60, "z" * 500), (61, None)]
    placed = suffix_dedup.places(spark.createDataFrame(rows, "doc_id long, text string"))
    low = 1 << suffix_dedup.START_BITS
    want = {divmod(r["pos"], low) for r in suffix_dedup.starts_by_doubling(placed).collect()}
    got = {(r["place"], k) for r in suffix_dedup.repeated_starts(placed).collect() for k in range(r["first"], r["last"] + 1)}
    assert got == want and len(want) > 1000


def test_suffix_dedup_ids_and_names(spark):
    nulls = [(None, LONG), (None, LONG), (None, "é" + LONG)]
    df = spark.createDataFrame(nulls, "doc_id long, text string")
    left = suffix_dedup.dedup(df).collect()
    assert sum(r["n_removed"] for r in left) == sum(r[2] for r in brute_dedup(nulls).elements()) == 2 * len(LONG)
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "place", "part", "nth", "before", "mono", "ranges", "_place", "found", "first"]
    for rows in ([(5, LONG), (7, "x" + LONG)], [(5, LONG), (5, LONG + "y"), (None, "z")]):
        wide = spark.createDataFrame([(*r, *(f"{c}{k}" for c in names)) for k, r in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
        out = suffix_dedup.dedup(wide, keep_text=True)
        assert out.columns == wide.columns
        assert sorted(tuple(r)[2:] for r in out.collect()) == sorted(tuple(f"{c}{k}" for c in names) for k in range(len(rows)))


def brute_join(rows):
    sets = []
    for i, t in rows:
        w = (t or "").lower().split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    comp = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for a, (_, x) in enumerate(sets):
            for b, (_, y) in enumerate(sets):
                if x and y and comp[a] != comp[b] and 100 * len(x & y) >= 75 * len(x | y):
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    least = {c: min((i for (i, _), k in zip(sets, comp) if k == c and i is not None), default=None) for c in comp}
    return by_count((i, len(x), least[c] if x else i) for (i, x), c in zip(sets, comp))


@pytest.mark.parametrize(("few", "part"), [(64, 4096), (3, 7)])
def test_jaccard_join(spark, docs, monkeypatch, few, part):
    rows = [(i, t) for i, t, _ in ROWS if i != 9]  # brute_join splits at other spaces too
    assert by_count(jaccard_join.join(docs.where("doc_id is null or doc_id <> 9")).collect()) == brute_join(rows)
    words = [f"w{k}" for k in range(90)]
    near = [(k, " ".join(words[:k] + [f"x{k}"] + words[k + 1 :])) for k in range(0, 90, 3)] + [(1000 + k, " ".join(words[k : k + 70])) for k in range(15)]
    # small sets: of 1 to 12 shingles
    near += [(2000 + k, " ".join(f"s{k // 40}-{j}" for j in range(k % 40 % 13 + 4)) + " end" * (k % 3 == 0)) for k in range(120)]
    # many classes of a passage that are not links
    near += [(3000 + k, " ".join([*words[:40], *(f"y{k // 2}-{j}" for j in range(25 + k % 2))])) for k in range(60)]
    monkeypatch.setattr(jaccard_join, "FEW", few)
    monkeypatch.setattr(jaccard_join, "PART", part)
    assert by_count(jaccard_join.join(spark.createDataFrame(near, "doc_id long, text string")).collect()) == brute_join(near)
    assert jaccard_join.join(docs.limit(0)).count() == 0


def test_jaccard_frequent_segments(spark, monkeypatch):
    """With every shingle taken as frequent, all segments are dealt out by class, and none is dropped."""
    import numpy as np

    monkeypatch.setattr(jaccard_join, "frequent_shingles", lambda docs: np.ones(jaccard_join.HOT_BUCKETS, bool))
    rows = [(k, " ".join(f"w{j}" for j in range(k % 7, k % 7 + 30)) + f" {k}") for k in range(40)]
    assert by_count(jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == brute_join(rows)


def test_plausible_pairs_over_batches():
    """Groups of any size, cut into batches anywhere, give the pairs that all rows at once give."""
    import numpy as np

    rng = np.random.default_rng(5)
    sizes = [1, 2, 3, 70, 5, 200, 1, 1, 64, 65]
    n = sum(sizes)
    key = np.repeat(np.arange(len(sizes)), sizes)
    cls, comp, role = rng.permutation(n), rng.integers(0, 9, n), rng.integers(0, 3, n)
    order = np.lexsort((role, key))
    cls, comp, role = cls[order], comp[order], role[order]
    base = rng.integers(0, 256, (4, jaccard_join.FOLD), dtype=np.uint8)
    fold = base[rng.integers(0, 4, n)] ^ (rng.random((n, jaccard_join.FOLD)) < 0.05)
    want = set()
    for i in range(n):
        for j in range(i + 1, n):
            if key[i] == key[j] and comp[i] != comp[j] and role[i] < 2 and role[j] > 0 and np.bitwise_count(fold[i] ^ fold[j]).sum() * 175 <= 200 * 25:
                want.add((min(cls[i], cls[j]), max(cls[i], cls[j])))
    zero = np.zeros(n, np.int32)
    cols = {"key": key, "a": zero, "b": zero, "role": role.astype(np.int8), "cls": cls, "n": np.full(n, 100), "comp": comp, "fold": [x.tobytes() for x in fold]}
    whole = pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in cols.items()})
    assert want
    for step in (1, 3, 50, n):
        got = [(a, b) for out in jaccard_join.plausible(whole.slice(i, step) for i in range(0, n, step)) for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist())]
        assert set(got) == want


def test_one_of_each(spark, docs):
    rows = [(1, LONG), (None, LONG + "x"), (None, LONG + "x"), (None, LONG + "x"), (5, "other text of a few more words"), (5, "yet another one that is not like it at all"), (6, None), (None, ""), (7, LONG), (8, "a b"), (8, "a b")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n long, cls string")
    got = by_count(jaccard_join.one_of_each(df).collect())
    assert got == by_count((i, t, 1, "k") for i, t in [(1, LONG), (5, rows[4][1]), (5, rows[5][1]), (6, None), (None, ""), (8, "a b")])
    assert jaccard_join.one_of_each(docs).columns == docs.columns and jaccard_join.one_of_each(docs.limit(0)).count() == 0


def test_license_scan():
    index = license_scan.build_index(dict.fromkeys(license_scan.VOCABULARY, 1) | {"": 100})
    out = license_scan.scan(pa.array([None, "", "x\nLicensed under CC BY-NC 4.0.", "ALL rights (reserved) all rights reserved", "general publicé license"]), index)
    assert out["n_words"] == [0, 0, 8, 6, 3] and out["n_base"] == [0, 0, 1, 2, 0]
    assert out["first_word"] == [None, None, 3, 0, None] and out["last_word"] == [None, None, 3, 3, None]
    assert out["base_labels"] == ["", "", "cc-by", "reserved", ""] and out["labels"][2] == "cc-by,cc-by-nc-4.0"


def test_license_query_against_plain_python(spark):
    """The base columns of the registered query over a whole table, by a word-by-word search."""
    import re

    folder = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in license_scan.op8_license_scan(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        places = [(k, label) for phrase, label in license_scan.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        r, at = got[doc_id], [k for k, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and {x for _, x in places} <= set(filter(None, r["labels"].split(",")))


def test_all_notices_in_one_text(spark):
    """No notice is lost because others stand in the same text, with any frequencies of the words."""
    text = " ... ".join(text for _, text, _ in license_scan.TEXTS)
    assert all(must in words for _, words, must in license_scan.TEMPLATES)
    want = sorted({label for label, _, _ in license_scan.TEMPLATES} | set(license_scan.BASE.values()))
    df = spark.createDataFrame([(1, text, "a"), (2, None, "b"), (3, "", "c"), (4, text[::-1], "d"), (None, "Permission is hereby granted", "e")], "doc_id long, text string, labels string")
    rows = {r["doc_id"]: r for r in license_scan.scan_licenses(df, license_scan.build_index(license_scan.document_frequency(df))).collect()}
    assert rows[1]["labels"].split(",") == want and rows[1]["score"] == 1.0
    assert len(rows) == 5 and rows[2]["labels"] == rows[3]["labels"] == "" and rows[4]["labels"] == ""
    rng = random.Random(1)
    for _ in range(5):
        index = license_scan.build_index({w: rng.randrange(1, 50) for w in license_scan.VOCABULARY} | {"": 50})
        assert license_scan.scan(pa.array([text]), index)["labels"] == [",".join(want)]
    assert license_scan.scan_licenses(df.limit(0), license_scan.build_index(license_scan.document_frequency(df.limit(0)))).count() == 0


def test_labelled_sample(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tallyspark.llm import common

    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 > 0, F.lit("some text")).alias("text"), F.lit("x").alias("label"))
    labels = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("l"), (F.col("id") % 90).cast("string"))).alias("lang"))
    got = common.labelled_sample(docs, labels, "lang", F.col("doc_id") > 10, 20, 100)
    rows = labels.where("doc_id > 10 and lang is not null and doc_id % 10 > 0").withColumn("h", F.xxhash64("doc_id")).collect()
    want = set()
    for label in {r["lang"] for r in rows}:
        want |= {r["doc_id"] for r in sorted((r for r in rows if r["lang"] == label), key=lambda r: r["h"])[:20]}
    assert set(got["doc_id"]) == want and got["label"].nunique() == 81  # a tenth of the labels has no text
    assert set(common.labelled_sample(docs.repartition(7), labels, "lang", F.col("doc_id") > 10, 20, 100)["doc_id"]) == want
    # of rows that share a doc_id the text of least hash counts, however they are dealt; a label's texts end where their characters do
    twice = docs.select("doc_id", F.explode(F.array(F.lit("one"), F.lit("other"), F.lit("a third"))).alias("text"))
    least = min(((r["h"], r["t"]) for r in spark.sql("SELECT xxhash64(t) h, t FROM VALUES ('one'), ('other'), ('a third') x(t)").collect()))[1]
    for parts in (1, 5):
        assert set(common.labelled_sample(twice.repartition(parts, "text"), labels, "lang", F.col("doc_id") > 5900, 20, 100)["text"]) == {least}
    monkeypatch.setattr(common, "SAMPLE_CHARS", 90 * 9 * 3)
    few = common.labelled_sample(docs, labels, "lang", F.col("doc_id") > 10, 20, 100)
    assert few.groupby("label").size().max() == 3 and few["label"].nunique() == 81 and set(few["doc_id"]) < want
    with pytest.raises(ValueError, match="more than 4096"):
        common.labelled_sample(docs, docs.withColumn("label", F.col("doc_id").cast("string")), "label", F.lit(True), 20, 100)


def test_quality_rules(docs, labels):
    rows = {(r["doc_id"], r["n_words"]): r for r in quality_rules.apply_rules(docs, quality_rules.fit(docs, labels)).collect()}
    assert rows[10, 3000]["base_failed"] and not rows[10, 3000]["kept"] and rows[10, 3000]["n_repeat_words"] == 3000
    m = quality_rules.measure(pa.array(["a b c d a b c\nx\n\nx\n", None, "é# $"]), quality_rules.fit(docs.limit(0), labels))
    assert m["n_words"].tolist() == [9, 0, 2] and m["n_repeat_words"].tolist() == [6, 0, 0] and m["n_dup_lines"].tolist() == [1, 0, 0]
    assert m["word_chars"].tolist() == [9, 0, 3] and m["n_symbols"].tolist() == [0, 0, 2]


def test_quality_verdict_on_labelled_rows(spark):
    """Of the labelled rows that pass the rules, the method keeps the good ones and no other; the ratio is the same whatever a row's id is."""
    folder = "/root/testdata/sf0.01"
    rows = quality_rules.op10_quality_rules(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("not base_failed").collect()
    assert len(rows) > 250 and sum(r["kept"] == (r["quality"] == 1) for r in rows) >= 0.99 * len(rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert quality_rules.fit(docs.limit(0), spark.read.parquet(f"{folder}/labels.parquet")).max() == 0


def test_quality_rules_brute_force(spark, labels):
    """Counts and verdicts as plain Python gives them, over odd texts."""
    import re

    rng = random.Random(6)
    texts = [None, "", " \n ", "a", "x y z " * 40, "# $ é|<>\n" * 3, "ein zwei\nein zwei\n\n\n ein zwei", *(" ".join(rng.choice(["ab", "cd", "é", "f#", "\n", "\t", "gh\ngh"]) for _ in range(rng.randrange(160))) for _ in range(60))]
    df = spark.createDataFrame([(k if k % 9 else None, t) for k, t in enumerate(texts)], "doc_id long, text string")
    model = quality_rules.fit(df.where("doc_id is not null"), labels)
    got = collections.Counter(tuple(r)[1:7] for r in quality_rules.apply_rules(df, model).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = collections.Counter()
    for t in texts:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        lines, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in lines
                lines.add(line)
        count = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + j for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for j in range(3)}
        want[len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)] += 1
    assert got == want


def test_field_against_all_label_sequences():
    """Forward-backward gives what summing over every sequence of labels gives."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    row = np.repeat([0, 1, 2], [4, 1, 6])
    emit, trans = rng.normal(0, 2, len(row)), rng.normal(0, 1, (2, 2))
    good, pair = line_quality.marginals(emit, trans, row)
    want, pairs = np.zeros(len(row)), np.zeros((2, 2))
    for r in range(3):
        at = np.flatnonzero(row == r)
        seqs = [np.array(y) for y in itertools.product((0, 1), repeat=len(at))]
        p = np.exp([emit[at] @ y + trans[y[:-1], y[1:]].sum() for y in seqs])
        p /= p.sum()
        for y, q in zip(seqs, p):
            want[at] += q * y
            np.add.at(pairs, (y[:-1], y[1:]), q)
    assert np.allclose(good, want) and np.allclose(pair, pairs)


def test_recurrent_layer_gradients(monkeypatch):
    """Back-propagation through time against finite differences, with sequences that end early; inference gives the same states."""
    import numpy as np

    from tallyspark.llm import gru

    rng = np.random.default_rng(1)
    steps, n, h = 5, 3, 4
    gates, u, mask = rng.normal(0, 1, (steps, n, 3 * h)), rng.normal(0, 0.5, (h, 3 * h)), np.arange(steps)[:, None] < np.array([5, 3, 0])
    pull = rng.normal(0, 1, (steps, n, h))
    loss = lambda: float((gru.forward(gates.astype(np.float32), u.astype(np.float32), mask.astype(np.float32)) * pull).sum())
    _, cache = gru.forward(gates.astype(np.float32), u.astype(np.float32), mask.astype(np.float32), keep=True)
    d_gates, d_u = gru.backward(pull.astype(np.float32), cache)
    for x, d in ((gates, d_gates), (u, d_u)):
        for i in rng.choice(x.size, 40):
            at, e = np.unravel_index(i, x.shape), 1e-2
            was, x[at] = x[at], x[at] + e
            up = loss()
            x[at] = was - e
            down = loss()
            x[at] = was
            assert abs((up - down) / (2 * e) - d[at]) < 2e-2
    table = gru.held(gates.reshape(-1, 3 * h))
    codes = np.where(mask, np.arange(steps * n).reshape(steps, n), len(table) - 1)
    want = gru.forward(gates.astype(np.float32), u.astype(np.float32), mask.astype(np.float32))
    assert np.allclose(gru.run(table, u.astype(np.float32), codes)[:, :2], want[:, :2], atol=1e-5)


@pytest.mark.parametrize("module", [toxicity, language_id])
def test_network_gradients(monkeypatch, module):
    """The whole networks' gradients, as the first learning step gives them, against finite differences of the loss that they are of."""
    import numpy as np

    from tallyspark.llm import gru

    seen = {}

    class Kept(gru.Adam):
        def step(self, grads):
            seen.setdefault("p", {k: v.copy() for k, v in self.params.items()})
            seen.setdefault("g", grads)

    monkeypatch.setattr(gru, "Adam", Kept)
    if module is language_id:
        texts, labels = ["abc ab", "xyz zy"], ["a", "b"]
        language_id.train(texts, labels, steps=1, runs=2)

        def loss(p):
            tagger = language_id.ByteTagger(["a", "b"], p)
            spans, _ = language_id.cut(*language_id.utf8(pa.array(texts)))
            probs = tagger.position_probs(spans)
            inside = spans.T != language_id.PAD
            return -sum(np.log(probs[:, k, k][inside[:, k]]).sum() for k in (0, 1)) / inside.sum()
    else:
        monkeypatch.setattr(toxicity, "DROPPED", 0.0)
        monkeypatch.setattr(toxicity, "DECAY", 0.0)
        texts = ["aa bb cc", "dd ee ff gg"] * 4
        toxicity.train(texts, [0, 1] * 4, steps=1, batch=2)

        def loss(p):
            logit, _ = toxicity.WindowScorer(p, sorted_frequent([x for k, x in enumerate(texts) if k % 4 < 3])).logits(pa.array(texts[:2]))
            return -(np.log(gru.sigmoid(-logit[0])) + np.log(gru.sigmoid(logit[1]))) / 2

    rng = np.random.default_rng(0)
    for k, g in seen["g"].items():
        p = {n: v.astype(np.float64) for n, v in seen["p"].items()}
        for i in rng.choice(g.size, min(6, g.size), replace=False):
            at, e = np.unravel_index(i, g.shape), 2e-2
            was = p[k][at]
            p[k][at] = was + e
            up = loss(p)
            p[k][at] = was - e
            down = loss(p)
            p[k][at] = was
            assert abs((up - down) / (2 * e) - g[at]) < 2e-3 + 0.05 * abs(g[at]), (k, at)


def sorted_frequent(texts):
    import numpy as np

    code, row, vocab = toxicity.pieces(pa.array(texts))
    held = np.bincount(np.unique(row * len(vocab) + code) % len(vocab), minlength=len(vocab))
    return vocab.filter(pa.array(held >= toxicity.LEAST_DOCS)).to_pylist()


def plain_states(gates, u):
    """A recurrent layer, one state at a time."""
    import numpy as np

    h = len(u)
    state, out = np.zeros(h), []
    for g in gates:
        own = state @ u
        z, r = (1 / (1 + np.exp(-(g[a : a + h] + own[a : a + h]))) for a in (0, h))
        state = z * state + (1 - z) * np.tanh(g[2 * h :] + r * own[2 * h :])
        out.append(state)
    return out


def test_language_inference_brute_force():
    """Each byte's label from the bytes that its layers read, one byte at a time, against the tagger's means."""
    import numpy as np

    rng = np.random.default_rng(5)
    h = language_id.HIDDEN
    p = {k: rng.normal(0, 0.5, s).astype(np.float32) for k, s in (("in_a", (257, 3 * h)), ("in_b", (257, 3 * h)), ("u_a", (h, 3 * h)), ("u_b", (h, 3 * h)), ("w_a", (h, 3)), ("w_b", (h, 3)), ("b", (3,)))}
    texts = ["ab", "", "é" * 40 + LONG, LONG[:64], LONG * 3, LONG[:65], "x"]
    got = language_id.ByteTagger(["a", "b", "c"], p).document_probs(*language_id.utf8(pa.array(texts)), block=2)
    for text, mean in zip(texts, got, strict=True):
        raw, total = text.encode(), np.zeros(3)
        for i in range(len(raw)):
            first = i - i % language_id.SPAN
            left, right = raw[max(0, first - language_id.MARGIN) : i + 1], raw[i : first + language_id.SPAN + language_id.MARGIN]
            assert len(left) > min(i, language_id.MARGIN) and len(right) > min(len(raw) - 1 - i, language_id.MARGIN)
            e = np.exp(plain_states(p["in_a"][list(left)], p["u_a"])[-1] @ p["w_a"] + plain_states(p["in_b"][list(right[::-1])], p["u_b"])[-1] @ p["w_b"] + p["b"])
            total += e / e.sum()
        assert np.allclose(mean, total / max(1, len(raw)), atol=1e-4), text


def test_toxicity_inference_brute_force():
    """Every window's logit, word by word and state by state, against the scorer's; a document's score is its highest window's."""
    import numpy as np

    rng = np.random.default_rng(6)
    c, h, frequent = toxicity.CHAR_HIDDEN, toxicity.HIDDEN, [b"fox", b"the"]
    sizes = {"c_in_a": (257, 3 * c), "c_in_b": (257, 3 * c), "c_u_a": (c, 3 * c), "c_u_b": (c, 3 * c), "mix_a": (2 * c, 3 * h), "mix_b": (2 * c, 3 * h), "word_a": (3, 3 * h), "word_b": (3, 3 * h)}
    sizes |= {"u_a": (h, 3 * h), "u_b": (h, 3 * h), "att": (2 * h,), "out": (2 * h,), "bias": (1,)}
    p = {k: rng.normal(0, 0.4, s).astype(np.float32) for k, s in sizes.items()}
    scorer = toxicity.WindowScorer(p, frequent, (1.5, -0.25))
    texts = ["The fox", None, " \n ", LONG * 2, "ÀB " * 16, "w " * 17, "q" * 70, LONG]
    logit, owner = scorer.logits(pa.array(texts), block=3)
    for k, text in enumerate(texts):
        parts = [w[i : i + 16] for w in (x.encode() for x in (text or "").lower().split()) for i in range(0, len(w), 16)]
        starts = [0] + [s for s in range(8, len(parts), 8) if s + 8 < len(parts)]
        want = []
        for s in starts:
            gates = {"a": [], "b": []}
            for w in parts[s : s + 16]:
                ends = np.concatenate([plain_states(p["c_in_a"][list(w)], p["c_u_a"])[-1], plain_states(p["c_in_b"][list(w[::-1])], p["c_u_b"])[-1]])
                for side in "ab":
                    gates[side].append(ends @ p[f"mix_{side}"] + p[f"word_{side}"][frequent.index(w) + 1 if w in frequent else 0])
            states = [np.concatenate(x) for x in zip(plain_states(gates["a"], p["u_a"]), plain_states(gates["b"][::-1], p["u_b"])[::-1], strict=True)]
            weight = [np.exp(x @ p["att"]) for x in states]
            want.append(sum((w / sum(weight)) * x for w, x in zip(weight, states, strict=True)) @ p["out"] + p["bias"][0] if states else p["bias"][0])
        assert np.allclose(logit[owner == k], want, atol=1e-4), text
        assert abs(scorer.scores(pa.array(texts))[k] - 1 / (1 + np.exp(0.25 - 1.5 * max(want)))) < 1e-4


def test_ratio_verdict_brute_force(spark, docs, labels):
    """The n-gram score and the verdict of every text, in plain Python from both counts."""
    import math

    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1 and r["doc_id"] is not None}
    learned = {i: t for i, t, _ in ROWS if i in good and t and len(t) <= quality_rules.MAX_CHARS}
    gram = lambda t: [(int.from_bytes(b[i : i + 4]) * 2654435761 & 0xFFFFFFFF) >> 16 for b in [(t or "").encode()] for i in range(len(b) - 3)]
    target = collections.Counter(g for t in learned.values() for g in gram(t))
    raw = collections.Counter(g for _, t, _ in ROWS for g in gram(t))
    n, m = sum(target.values()), sum(raw.values())
    assert n and m > n
    ratio = lambda g: math.log((target[g] + 1) / (n + 65536)) - math.log((raw[g] * n / m + 1) / (n + 65536))
    score = {t: sum(map(ratio, gram(t))) / max(1, len(gram(t))) for _, t, _ in ROWS}
    fitted = quality_rules.fit(docs, labels)
    for cut in (quality_rules.THRESHOLD, sorted(score.values())[len(score) // 2] + 1e-9):
        got = quality_rules.apply_rules(docs, fitted, cut).join(docs.select("doc_id", "text").distinct(), "doc_id", "left").collect()
        assert len(got) == len(ROWS)
        for r in got:
            text = r["text"] if r["doc_id"] is not None else "x" * 700
            assert abs(r["score"] - score[text]) < 1e-6 and r["kept"] == (not r["base_failed"] and score[text] >= cut)


def test_scores(docs, labels):
    for module, model in ((toxicity, toxicity.fit(docs, labels)), (line_quality, line_quality.fit(docs, labels)), (toxicity, None), (line_quality, None)):
        rows = module.predict(docs, model).collect()
        assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
        mod, hit = (5, 0) if module is toxicity else (3, 1)
        assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % mod == hit) for r in rows)
    rows = language_id.predict(docs, language_id.fit(docs)).collect()
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (4, 5, 6)} == {"und"} and len(rows) == len(ROWS)
    assert language_id.fit(docs.limit(0)) is None and toxicity.fit(docs.limit(0), labels) is None


def test_language_held_out():
    texts = [" ".join(w) for w in [["the", "of", "and"]] * 20 + [["der", "und", "ist"]] * 20]
    model = language_id.train(texts, ["en"] * 20 + ["de"] * 20, steps=60)
    probs = model.document_probs(*language_id.utf8(pa.array(["and of the", "ist und der"])))
    assert [model.langs[k] for k in probs.argmax(axis=1)] == ["en", "de"]
