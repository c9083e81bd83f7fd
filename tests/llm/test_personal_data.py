"""Personal data against Python's re: base spans, planted cases, odd rows, long runs; the running totals; expectation-maximisation on known truths."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import personal_data
from tallyspark.llm.personal_data import BASE, KINDS

TEXTS = [
    "write to a.b@mail.example.com or x@y, then +1 (523) 555-1055 please", "host 10.0.0.1 and 300.1.1.1 and 1.2.3.4.5.6.7.8 and 001.002.003.0255.4", None, "", "card 4111 1111 1111 1111, bad 4111 1111 1111 1112, 4111-1111-1111-1111 0",
    "é😀 a@b.cd é +49 30 1234567 x", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" here', "a@b.c_x@d.e and ..@x.y. @user_name1 x@@y.z", "+1 2 3 +12345678901234567 +123456789 (", "plain words only, Version 2.0.", "1.1.1.1" * 3, "x" * 3000,
    "Dr. Maria Smith and John Smith met The Fox in 12 Long Oak Street", "ssn 219-09-9999 and 000-12-3456", "account DE89 3704 0044 0532 0130 00 iban", "call (212) 555-0187 or 212-555-0188", "a@b.c\nd@e.f\r\n5.6.7.8", "0 0 0 0 0 0 0 0 0 0 0 0",
]


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text):
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)), "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    found = [(m.start(), BASE.index(k), m.end(), k) for k, (p, ok) in rules.items() for m in re.finditer(p, text or "") if ok(m[0])]
    return [(k, a, b) for a, _, b, k in sorted(found)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, None, 0.5) for r in rows], "doc_id long, text string, kind int, found string, score double")


def test_base_spans_against_re(spark):
    rng = random.Random(3)
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, TEXTS[0]), (0, TEXTS[0]), (0, TEXTS[4])]
    rows += [(100 + k, "".join(rng.choice(["a", "@", ".", "b", "1", "22", "+", "-", " ", "255", "(", ")", "_", "é", "4111111111111111", "\n"]) for _ in range(rng.randrange(60)))) for k in range(400)]
    got = personal_data.detect(frame(spark, rows).repartition(3)).collect()
    want = collections.Counter((i, *base_spans(t)) for i, t in rows)
    assert collections.Counter((r["doc_id"], *((s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"])) for r in got) == want
    for r in got:
        order = [(s["start"], KINDS.index(s["kind"])) for s in r["spans"]]
        assert order == sorted(order) and all(0 <= s["score"] <= 1 for s in r["spans"]) and not any(s["kind"] in BASE and not s["base"] for s in r["spans"])


def test_added_spans_and_clean_texts(spark):
    """Planted secrets, account numbers, names and numbers are found among many clean texts, which are left alone."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9)))
    clean = [" ".join(word().capitalize() if rng.random() < 0.4 else word() for _ in range(40)) + " einschachchspfheitschverheiten" for _ in range(300)]
    hexed = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    planted = [f'{word()} token = "{hexed()}" {word()}' for _ in range(20)] + [f"mail {word()}{k}@mail{k}.example.com, ip {k}.1.2.3" for k in range(20)]
    planted += ["his iban DE89 3704 0044 0532 0130 00 was", "written by Dr. Peter Smith", "ssn 219-09-9998 x", "call me: (212) 555-0187"] * 6
    rows = [(k, t) for k, t in enumerate(clean + planted)]
    got = {r["doc_id"]: {s["kind"] for s in r["spans"]} for r in personal_data.detect(frame(spark, rows)).collect()}
    assert not any(got[k] for k in range(300))
    assert all(got[300 + k] == {"secret"} for k in range(20)) and all({"email", "ip"} == got[320 + k] for k in range(20))
    assert [got[340 + k] for k in range(24)] == [{"iban"}, {"name"}, {"national_id"}, {"local_phone"}] * 6


def test_query_columns_and_no_rows(spark, tmp_path):
    frame(spark, [(k, t) for k, t in enumerate(TEXTS)]).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    rows = personal_data.op11_personal_data(spark, str(tmp_path)).collect()
    for r in rows:
        base = base_spans(TEXTS[r["doc_id"]])
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest() and set(filter(None, said.split(","))) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in BASE] == [sum(x[0] == k for x in base) for k in BASE]
    assert len(rows) == len(TEXTS)
    df = personal_data.detect(frame(spark, [(1, "x")]).limit(0))
    assert df.count() == 0
    plan = personal_data.detect(frame(spark, [(1, "x")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_long_texts(spark):
    """Long runs and thousands of matches in one text: what is found is known, and no run costs its square."""
    texts = {
        "a" * 300_000: [], "1.1.1.1 " * 30_000: [("ip", 8 * k, 8 * k + 7) for k in range(30_000)], "a@b.c " * 20_000: [("email", 6 * k, 6 * k + 5) for k in range(20_000)], "a@b" + ".c" * 100_000: [("email", 0, 200_003)],
        "1 " * 150_000: [], "+1" * 100_000: [], "@" * 200_000: [], "1" * 300_000: [],
    }
    got = personal_data.detect(frame(spark, list(enumerate(texts))).repartition(4)).collect()
    assert {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]] for r in got} == dict(enumerate(texts.values()))


@pytest.mark.parametrize("run", [2, 3, 256])
def test_running_totals(spark, monkeypatch, run):
    monkeypatch.setattr(personal_data, "RUN", run)
    lists = [[], [5], [1, 2], [1, 2, 3], [3] * 7, list(range(600))]
    df = spark.createDataFrame([(x,) for x in lists], "x array<bigint>").select("x", personal_data.running(F.col("x")).alias("y"))
    assert all(r["y"] == np.cumsum(np.array(r["x"], int)).tolist() for r in df.collect())


def test_beliefs_find_the_reliable_labelers():
    """Votes drawn from known reliabilities: the estimates come near them, and the beliefs near the truth."""
    rng = np.random.default_rng(5)
    trust, speaks, n = np.array([0.95, 0.6, 0.8, 0.9, 0.7]), np.array([0.9, 0.5, 0.6, 0.8, 0.7]), 40_000
    kind = rng.integers(len(BASE), len(KINDS), n)
    truth = rng.random(n) < np.linspace(0.1, 0.9, len(KINDS))[kind]
    votes = np.where(rng.random((n, 5)) < trust, 1, -1) * np.where(truth, 1, -1)[:, None] * (rng.random((n, 5)) < speaks)
    code = (votes + 1) @ 3 ** np.arange(5)
    counted = collections.Counter(zip(kind.tolist(), code.tolist()))
    beliefs = personal_data.Beliefs().fit([(k, c, False, m) for (k, c), m in counted.items()], rounds=300)
    assert np.abs(beliefs.trust - trust).max() < 0.03
    assert np.abs(beliefs.share - np.linspace(0.1, 0.9, len(KINDS)))[len(BASE) :].max() < 0.03
    assert ((beliefs.of(kind, code) > 0.5) == truth).mean() > 0.93


def test_expressions_give_what_the_models_give(spark):
    rng = np.random.default_rng(6)
    beliefs = personal_data.Beliefs().fit([(int(k), int(c), False, 5) for k, c in zip(rng.integers(0, 11, 50), rng.permutation(243)[:50])])
    model = personal_data.SpanClassifier(rng.normal(0, 1, len(KINDS) + len(personal_data.FEATURES)))
    rows = [(int(k), int(c), int(b)) for k, c, b in zip(rng.integers(4, 11, 40), rng.integers(0, 243, 40), rng.integers(0, 256, 40))]
    df = spark.createDataFrame(rows, "kind int, votes int, bits int").select("*", beliefs.column(F.col("kind"), F.col("votes"), F.lit(False)).alias("p"), model.score(F.col("kind"), F.col("bits")).alias("s"))
    for r in df.collect():
        assert r["p"] == pytest.approx(beliefs.of(np.array([r["kind"]]), np.array([r["votes"]]))[0])
        logit = model.weights[r["kind"]] + sum(w for k, w in enumerate(model.weights[len(KINDS) :]) if r["bits"] >> k & 1)
        assert r["s"] == pytest.approx(1 / (1 + np.exp(-logit)))
