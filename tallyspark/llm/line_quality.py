"""Quality classifier: a linear-chain conditional random field labels every line of a text good or bad.

A line's emission weights see its own features and those of the lines before and after it; transition weights tie neighbouring labels.
Forward-backward gives each line's probability of being good; their mean, weighted by the lines' length, goes through a logistic curve to
the document's score. The weights maximise the likelihood of the learning rows' lines (a line's label is its document's) by gradient
ascent in numpy, on a bounded sample of labelled rows (`PER_CLASS` a class).

Defined results: a null or empty text is one empty line and has a score too; repeated rows are scored one by one; a null doc_id is kept and
never held out; without rows of both classes to learn from, all scores are 0; an empty table gives an empty result; a very long text
stands in a slice of its own. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm.common import bounds, bucket, filled, labelled_sample, slices, small_batches, table, utf8, words
from tallyspark.llm.gru import Adam, sigmoid
from tallyspark.llm.quality_rules import in_bytes, per_text

PER_CLASS = 1500
MAX_CHARS = 20_000
FEATURES = 12


def line_features(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """FEATURES numbers for each line, the text of each line, and each line's bytes."""
    lists = pc.split_pattern(filled(text), "\n")
    lines, row = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    raw, at = utf8(lines)
    n, size = len(lines), np.diff(at)
    some = np.maximum(size, 1)
    share = lambda flags: per_text(flags, at) / some
    code, line, vocab = words(lines)
    n_words = np.diff(bounds(line, n))
    most = np.maximum(n_words, 1)
    distinct = np.bincount(np.unique(line * max(1, len(vocab)) + code) // max(1, len(vocab)), minlength=n) if len(code) else np.zeros(n)
    again = np.bincount(line[1:][(line[1:] == line[:-1]) & (code[1:] == code[:-1])], minlength=n) if len(code) > 1 else np.zeros(n)
    upper = share((raw >= 65) & (raw <= 90))
    x = np.stack([
        np.ones(n), upper, upper > 0.3, share(in_bytes(raw, b"0123456789")), share(in_bytes(raw, b"#*$%&<>")), share(in_bytes(raw, b"|")), share(in_bytes(raw, b"!?")),
        share(in_bytes(raw, b".,;:")), np.minimum(size / most / 10, 3), distinct / most, again / most, np.log1p(size) / 8,
    ], axis=1).astype(np.float32)
    return x, row, size


def with_neighbours(x: np.ndarray, row: np.ndarray) -> np.ndarray:
    """A line's features, those of the line before and of the line after in the same text (zeros where there is none)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    same = (row[1:] == row[:-1])[:, None]
    before[1:], after[:-1] = x[:-1] * same, x[1:] * same
    return np.concatenate([x, before, after], axis=1)


def marginals(emit: np.ndarray, trans: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over every text's chain at once: the probability of label 1 for each line, and the expected transitions (2 x 2).
    emit: the score of label 1 against label 0; trans: the scores of each pair of labels. Chains run side by side, longest first."""
    n = len(emit)
    start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if n else np.zeros(0, int)
    length = np.diff(np.append(start, n))
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    t = np.exp(trans - trans.max())
    e = np.stack([np.ones(n), np.exp(np.clip(emit, -30, 30))], axis=1)
    ahead, back = np.empty((n, 2)), np.ones((n, 2))
    steps = int(length[0]) if n else 0
    alive = np.searchsorted(-length, -np.arange(1, steps + 1), side="right")  # chains of at least so many lines
    for k in range(steps):
        at = start[: alive[k]] + k
        a = e[at] if k == 0 else (ahead[at - 1] @ t) * e[at]
        ahead[at] = a / a.sum(axis=1, keepdims=True)
    for k in range(steps - 2, -1, -1):
        at = start[: alive[k + 1]] + k
        b = (back[at + 1] * e[at + 1]) @ t.T
        back[at] = b / b.sum(axis=1, keepdims=True)
    p = ahead * back
    p /= p.sum(axis=1, keepdims=True)
    pair = np.zeros((2, 2))
    inner = np.flatnonzero(row[1:] == row[:-1])
    if len(inner):
        joint = ahead[inner][:, :, None] * t[None] * (back[inner + 1] * e[inner + 1])[:, None, :]
        pair = (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return p[:, 1], pair


@dataclass
class LineField:
    weights: np.ndarray
    trans: np.ndarray
    curve: tuple[float, float] = (8.0, -4.0)

    def line_probs(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of being good, text and bytes of each line."""
        x, row, size = line_features(text)
        return marginals(with_neighbours(x, row) @ self.weights, self.trans, row)[0], row, size

    def good_share(self, text: pa.Array) -> np.ndarray:
        good, row, size = self.line_probs(text)
        weight = size + 1.0
        return np.bincount(row, good * weight, minlength=len(text)) / np.bincount(row, weight, minlength=len(text))

    def scores(self, text: pa.Array) -> np.ndarray:
        return sigmoid(self.curve[0] * self.good_share(text) + self.curve[1]) if len(text) else np.zeros(0)


def train(texts: list[str], labels: list[int], rounds: int = 150) -> LineField:
    text, label = pa.array(texts, pa.string()), np.array(labels)
    x, row, _ = line_features(text)
    x, y = with_neighbours(x, row).astype(float), label[row]
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    inner = row[1:] == row[:-1]
    seen = np.array([[((y[:-1] == a) & (y[1:] == b) & inner).sum() for b in (0, 1)] for a in (0, 1)], float)
    p = {"w": np.zeros(x.shape[1], np.float32), "t": np.zeros((2, 2), np.float32)}
    adam = Adam(p, 0.15)
    for k in range(rounds):
        adam.rate = 0.15 * (1 - k / rounds) + 0.01
        good, pair = marginals(x @ p["w"], p["t"].astype(float), row)
        adam.step({"w": x.T @ (weight * (good - y)) + 1e-4 * p["w"], "t": (pair - seen) / max(1, len(y)) + 3e-2 * p["t"]})
    model = LineField(p["w"].astype(float), p["t"].astype(float))
    z = model.good_share(text)
    a, b = 6.0, -3.0
    w = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum()))
    for _ in range(500):
        d = w * (sigmoid(a * z + b) - label)
        a, b = a - 20 * (d * z).sum() - 0.01 * (a - 6), b - 20 * d.sum()
    model.curve = (a, b)
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> LineField | None:
    """Learns from rows whose crc32(doc_id) mod 3 is not 1; None without both classes."""
    sample = labelled_sample(docs, labels, "quality", bucket("doc_id", 3) != 1, per_class, max_chars)
    return train(sample["text"].tolist(), sample["label"].astype(int).tolist()) if sample["label"].nunique() == 2 else None


def predict(docs: DataFrame, model: LineField | None) -> DataFrame:
    """doc_id, held_out, score and predicted, a row for each row of docs."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches):
        for b in slices(batches):
            s = model.scores(b.column("text")) if model else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s.astype(float)), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", "text", (bucket("doc_id", 3) == 1).alias("held_out"))
    return rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs, table(spark, sf_dir, "labels")))
