"""The filter audit against plain Python: every order and step, odd rows, words of equal hash."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tallyspark.llm import filter_audit

LONG = " ".join(f"w{k}" for k in range(150)) + " " + " ".join(f"v{k}" for k in range(60))
TEXTS = [LONG, LONG, LONG + " UPPER CASE WORDS AND MORE OF THEM", LONG + " #1", None, "", "  \n ", "a b " * 150, LONG, "x" * 5000, LONG + " é ü", "one"]


def failed(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}


def brute(rows, labels):
    """rows: doc_id, text, source."""
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    told = []
    for i, t, s in rows:
        copy = i is not None and any(j is not None and j < i and (u or "") == (t or "") for j, u, _ in rows)
        told.append((i, s or "", failed(t or "") | {"E": copy}))
    out = {}
    for part in {p for _, p, _ in told}:
        own = [(i, f) for i, p, f in told if p == part]
        removed = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone, gone_before = [r for r in left if r[1][x]], [r for r in own if r[1][x] and r not in left]
                left = [r for r in left if not r[1][x]]
                removed[x] += len(gone)
                fails_before = [r for r in own if r[1][x] and any(r[1][y] for y in order[: step - 1])]
                assert len(gone_before) <= len(fails_before)
                out[part, "".join(order), step] = [len(left), len(gone), len(fails_before), sum([y for y in "ABCDE" if f[y]] == [x] for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for order in itertools.permutations("ABCDE"):
            for step, x in enumerate(order, 1):
                out[part, "".join(order), step].append(removed[x])
    return out


def run(spark, rows, labels):
    # clashing names, and columns that do not matter
    docs = spark.createDataFrame([(*r, 1, "m", True, None) for r in rows], "doc_id long, text string, source string, mask int, part string, good boolean, n long")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int") if labels else spark.createDataFrame([], "doc_id long, quality int, toxic int")
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = filter_audit.audit(docs, known).collect()
    got = {(r["part"], r["filter_order"], r["step"]): [r[k] for k in names] for r in found}
    assert len(got) == len(found)
    return got


def test_audit_against_plain_python(spark):
    rng = random.Random(1)
    rows = [(k, t, f"s{k % 3}") for k, t in enumerate(TEXTS)] + [(None, LONG, "s0"), (None, None, None), (3, LONG + " #1", "s0"), (3, LONG, None), (1, LONG, "s1"), (-5, LONG + " #1", ""), (40, "b a " * 150, None)]
    rng.shuffle(rows)
    labels = [(0, 1, 0), (0, 0, 1), (1, None, 1), (2, 1, None), (None, 1, 1), (8, 1, 1), (3, 1, 0), (99, 1, 1)]
    got = run(spark, rows, labels)
    assert got == brute(rows, labels) and set(p for p, _, _ in got) == {"", "s0", "s1", "s2"}
    assert sum(v[1] for k, v in got.items()) > 0 and len(got) == 4 * 600


def test_one_text_in_a_third_of_all_rows_and_no_rows(spark):
    rows = [(k, LONG if k % 3 else f"{LONG} {k}", f"s{k % 2}") for k in range(90)]
    assert run(spark, rows, [(4, 1, 0), (1, 0, 1)]) == brute(rows, [(4, 1, 0), (1, 0, 1)])
    assert run(spark, [], []) == {}


@pytest.mark.parametrize("weak", [False, True])
def test_distinct_words(monkeypatch, weak):
    """Also where all words have one hash, as then the words themselves count, and where words go in many runs."""
    if weak:
        monkeypatch.setattr(filter_audit, "word_hashes", lambda raw, start, end: np.zeros(len(start), np.uint64))
    else:
        monkeypatch.setattr(filter_audit, "RUN", 16)
    rng = random.Random(2)
    even = "a"
    for _ in range(11):  # two words that a polynomial hash modulo 2 ** 64 does not tell apart
        even += even.translate(str.maketrans("ab", "ba"))
    texts = [None, "", "x", " a b\ta ", "é e é", f"{even} {even.translate(str.maketrans('ab', 'ba'))}", "a b a b", "\0 \0\0 \0", *(" ".join(rng.choice(["a", "bb", "abc", "é"]) for _ in range(rng.randrange(40))) for _ in range(30))]
    got = filter_audit.measure(pa.array(texts, pa.string()))
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert got["words"].tolist() == [len(w) for w in split] and got["distinct"].tolist() == [len(set(w)) for w in split]
    assert got["chars"].tolist() == [len(t or "") for t in texts]


def test_digests_are_of_whole_texts(spark):
    rows = filter_audit.scanned(spark.createDataFrame([(1, "aé", None), (2, None, "s")], "doc_id long, text string, source string")).collect()
    assert {r["doc_id"]: bytes(r["digest"]) for r in rows} == {1: hashlib.sha256("aé".encode()).digest(), 2: hashlib.sha256(b"").digest()}
