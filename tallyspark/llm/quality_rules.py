"""Quality rules: counts that any pipeline checks, and a hashed n-gram log-likelihood ratio between trusted and raw text.

Two multinomials over hashed byte n-grams (`N` bytes, `BUCKETS` buckets) are counted: one over every document of the corpus, one over a
bounded sample of documents labelled good (`TRUSTED`). A document's score is the mean, over all its n-grams, of the log of their ratio,
and it is kept if the rules pass and the score is at least `THRESHOLD`, the same for every document and every size of corpus.

Defined results: a null or empty text has no words, so `base_failed` is true; repeated rows get a row each; a null doc_id is kept as it
is; without labelled rows the ratio is 0 for every n-gram; an empty table gives an empty result; a very long text stands in a slice of its
own. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import bounds, filled, labelled_sample, slices, small_batches, table, utf8, words

N = 4
BUCKETS = 1 << 16
TRUSTED = 3000
MAX_CHARS = 20_000
SMOOTHING = 1.0
#: Between the labelled texts of the 10,000 test documents that pass the rules: the 3,243 good ones score 0.008 or more, the 291 bad ones -0.857 or less.
THRESHOLD = -0.35
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"


def grams(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the n-gram at each byte, and whether it lies inside one text."""
    if len(raw) < N:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    wide = raw.astype(np.uint32)
    code = np.zeros(len(raw) - N + 1, np.uint32)
    for k in range(N):
        code = (code << np.uint32(8)) | wide[k : len(raw) - N + 1 + k]
    inside = np.ones(len(code), bool)
    for k in range(1, N):
        ends = at[1:] - k
        inside[ends[(ends >= 0) & (ends < len(code))]] = False
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64), inside


def gram_counts(text: pa.Array) -> np.ndarray:
    code, inside = grams(*utf8(text))
    return np.bincount(code[inside], minlength=BUCKETS).astype(np.int64)


def mean_ratio(raw: np.ndarray, at: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    code, inside = grams(raw, at)
    total = np.concatenate([[0.0], np.cumsum(np.where(inside, ratio[code], 0.0))])
    top = len(total) - 1
    starts, ends = np.minimum(at[:-1], top), np.minimum(at[1:], top)
    return (total[ends] - total[starts]) / np.maximum(np.diff(at) - N + 1, 1)


def in_bytes(raw: np.ndarray, wanted: bytes) -> np.ndarray:
    look = np.zeros(256, bool)
    look[list(wanted)] = True
    return look[raw]


def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def repeated_words(code: np.ndarray, row: np.ndarray, n_codes: int, n: int) -> np.ndarray:
    """How many words of each text stand in a 3-word window that the text has twice or more."""
    if len(code) < 3:
        return np.zeros(n, np.int64)
    pair = code[:-2] * n_codes + code[1:-1]
    if n_codes >= 1 << 21:
        pair = np.unique(pair, return_inverse=True)[1]
        three = pair * n_codes + code[2:]
    else:
        three = (code[:-2] << 42) | (code[1:-1] << 21) | code[2:]
    start = np.flatnonzero(row[:-2] == row[2:])
    key, of = three[start], row[start]
    order = np.lexsort((key, of))
    same = (key[order][1:] == key[order][:-1]) & (of[order][1:] == of[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered = np.zeros(len(code), bool)
    first = start[order[twice]]
    for k in range(3):
        covered[first + k] = True
    return np.bincount(row[covered], minlength=n)


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def measure(text: pa.Array, ratio: np.ndarray) -> dict[str, np.ndarray]:
    """The rules' counts and the n-gram score of each text."""
    raw, at = utf8(text)
    code, row, vocab = words(text)
    n = len(text)
    out = {"n_words": np.diff(bounds(row, n))}
    out["word_chars"] = per_text(~in_bytes(raw, SPACES) & ((raw & 0xC0) != 0x80), at)
    out["n_symbols"] = per_text(in_bytes(raw, SYMBOLS), at)
    out["n_dup_lines"] = np.array([duplicate_lines(x) for x in filled(text).to_pylist()], np.int64)
    out["n_repeat_words"] = repeated_words(code, row, max(1, len(vocab)), n)
    out["score"] = mean_ratio(raw, at, ratio)
    return {k: v.astype(np.float64 if k == "score" else np.int64) for k, v in out.items()}


def raw_counts(docs: DataFrame) -> np.ndarray:
    """n-gram counts over every document: each task adds its own up, so BUCKETS rows a task at most are shuffled."""
    small_batches(docs.sparkSession)

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in slices(batches):
            total += gram_counts(b.column("text"))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS)
    out[rows["bucket"].to_numpy(int)] = rows["n"].to_numpy(float)
    return out


def fit(docs: DataFrame, labels: DataFrame, trusted: int = TRUSTED, max_chars: int = MAX_CHARS) -> np.ndarray:
    """The log ratio of the two multinomials for each bucket."""
    sample = labelled_sample(docs, labels.where("quality = 1"), "quality", F.lit(True), trusted, max_chars)
    target = gram_counts(pa.array(sample["text"].tolist(), pa.string())).astype(float)
    if not target.sum():
        return np.zeros(BUCKETS)
    raw = raw_counts(docs)
    share = lambda x: np.log((x + SMOOTHING) / (x.sum() + SMOOTHING * BUCKETS))
    # the trusted sample is smaller than the corpus: scale the corpus to it, so that smoothing weighs alike on both
    return share(target) - share(raw * (target.sum() / max(raw.sum(), 1.0)))


def apply_rules(docs: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rules' counts, base_failed, kept and the score, a row for each row of docs."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def rules(batches):
        for b in slices(batches):
            m = measure(b.column("text"), ratio)
            failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
            kept = ~failed & (m["score"] >= threshold)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(m[k]) for k in names), pa.array(failed), pa.array(kept), pa.array(m["score"])], ["doc_id", *names, "base_failed", "kept", "score"])

    return docs.select("doc_id", "text").mapInArrow(rules, f"doc_id {kind}, " + ", ".join(f"{k} long" for k in names) + ", base_failed boolean, kept boolean, score double")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return apply_rules(docs, fit(docs, table(spark, sf_dir, "labels")))
