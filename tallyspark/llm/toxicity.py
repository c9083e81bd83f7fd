"""Toxicity: a bidirectional gated recurrent network with attention pooling scores every overlapping window of a text.

A word enters as the sum of a word input (a row of its own if it is frequent, else a shared one) and a character input (the end states of two recurrent layers over
the word's bytes). Two more recurrent layers read windows of `WIDTH` words, `STRIDE` apart, so neighbouring windows share half of their
words; attention over the places of a window pools the states into one logit. A document's score comes from its highest window, through
a logistic curve fitted on the same learning rows. Every weight is trained in numpy by back-propagation through time, on a bounded sample
of labelled rows (`PER_CLASS` a class).

Defined results: null, empty and blank texts are one window without words, so they have a score too; repeated rows are scored one by one;
a null doc_id is kept and never held out; without rows of both classes to learn from, all scores are 0; an empty table gives an empty result;
a very long text stands in a slice of its own, and all of its windows are scored. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import gru
from tallyspark.llm.common import bounds, bucket, filled, kept_rows, labelled_sample, slices, small_batches, table, words

WIDTH, STRIDE = 16, 8
CHAR_HIDDEN, HIDDEN = 8, 8
#: Words have a row of their own if so many learning documents hold them; all others share one.
LEAST_DOCS = 4
#: Share of the words whose character input is left out in a learning step, and the decay of the weights.
DROPPED, DECAY = 0.1, 1e-4
#: A word's bytes enter in pieces of at most so many; a longer word is read as several words.
PIECE = 16
PER_CLASS = 1200
MAX_CHARS = 20_000
PAD = 256


def pieces(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """words(), lower-cased, where words of over PIECE bytes are cut into several."""
    code, row, vocab = words(pc.utf8_lower(filled(text)))
    size = pc.binary_length(vocab).to_numpy(zero_copy_only=False) if len(vocab) else np.zeros(0, int)
    if not len(size) or size.max() <= PIECE:
        return code, row, vocab.cast(pa.large_binary())
    raw = [x[i : i + PIECE] for x in vocab.cast(pa.large_binary()).to_pylist() for i in range(0, len(x), PIECE)]
    parts = -(-size // PIECE)
    first, many = np.cumsum(parts) - parts, parts[code]
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    coded = pa.array(raw, pa.large_binary()).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False)[np.repeat(first[code], many) + nth].astype(np.int64), np.repeat(row, many), coded.dictionary


def char_codes(vocab: pa.Array) -> np.ndarray:
    """PIECE x words: each word's bytes, then PAD."""
    raw = b"".join(vocab.to_pylist())
    size = pc.binary_length(vocab).to_numpy(zero_copy_only=False).astype(int)
    out = np.full((len(vocab), PIECE), PAD, np.int16)
    out[np.arange(PIECE) < size[:, None]] = np.frombuffer(raw, np.uint8)
    return np.ascontiguousarray(out.T)


def windows(row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words of each overlapping window (-1 after its end), and the text of each window; at least one for each text."""
    at = bounds(row, n)
    size = np.diff(at)
    many = np.maximum(1, -(-(size - WIDTH) // STRIDE) + 1)
    owner = np.repeat(np.arange(n), many)
    start = at[:-1][owner] + STRIDE * (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many))
    place = start[:, None] + np.arange(WIDTH)
    return np.where(place < at[1:][owner][:, None], place, -1), owner


@dataclass
class WindowScorer:
    p: dict[str, np.ndarray]
    frequent: list[bytes]
    curve: tuple[float, float] = field(default=(1.0, 0.0))

    def word_inputs(self, vocab: pa.Array, rows: np.ndarray, block: int = 8192) -> tuple[np.ndarray, np.ndarray]:
        """What each word gives to the gates of the two layers over words."""
        p, both = self.p, []
        for i in range(0, len(vocab), block):
            codes = char_codes(vocab.slice(i, block))
            ahead = gru.run(gru.held(p["c_in_a"][:PAD]), p["c_u_a"], codes)[-1]
            back = gru.run(gru.held(p["c_in_b"][:PAD]), p["c_u_b"], codes[::-1])[-1]
            both.append(np.concatenate([ahead, back], axis=1))
        chars = np.concatenate(both) if both else np.zeros((0, 2 * CHAR_HIDDEN), np.float32)
        return chars @ p["mix_a"] + p["word_a"][rows], chars @ p["mix_b"] + p["word_b"][rows]

    def logits(self, text: pa.Array, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """The logit of every window, and the text it is of."""
        p = self.p
        code, row, vocab = pieces(text)
        gates_a, gates_b = (gru.held(x) for x in self.word_inputs(vocab, word_rows(vocab, self.frequent)))
        place, owner = windows(row, len(text))
        ids = np.where(place >= 0, np.append(code, 0)[place], len(vocab)).astype(np.int32)
        out = np.empty(len(ids), np.float32)
        for i in range(0, len(ids), block):
            codes = np.ascontiguousarray(ids[i : i + block].T)
            states = np.concatenate([gru.run(gates_a, p["u_a"], codes), gru.run(gates_b, p["u_b"], codes[::-1])[::-1]], axis=2)
            out[i : i + block] = attend(states, codes != len(vocab), p)[0]
        return out, owner

    def highest(self, text: pa.Array) -> np.ndarray:
        """The highest window of each text; every text has one at least."""
        logit, owner = self.logits(text)
        return np.maximum.reduceat(logit, np.searchsorted(owner, np.arange(len(text)))) if len(text) else np.zeros(0)

    def scores(self, text: pa.Array) -> np.ndarray:
        a, b = self.curve
        return gru.sigmoid(a * self.highest(text).astype(float) + b)


def word_rows(vocab: pa.Array, frequent: list[bytes]) -> np.ndarray:
    """Rows of the word tables; 0 is shared."""
    found = pc.index_in(vocab, value_set=pa.array(frequent, pa.large_binary()))
    return pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1


def attend(states: np.ndarray, mask: np.ndarray, p: dict):
    """Attention over the first axis, then the output weights: logits, weights and pooled states."""
    e = np.exp(np.clip(states @ p["att"], -30, 30)) * mask
    weight = e / (e.sum(axis=0) + 1e-9)
    pooled = np.einsum("tn,tnh->nh", weight, states)
    return pooled @ p["out"] + p["bias"][0], weight, pooled


def train(texts: list[str], labels: list[int], steps: int = 450, batch: int = 192, seed: int = 11) -> WindowScorer:
    """Each step draws windows of both classes evenly. At first a window's label is its document's; after a third of the steps, and again
    after two thirds, positives are drawn from the highest windows of each toxic document and half of the negatives from those of the others."""
    rng = np.random.default_rng(seed)
    apart = np.arange(len(labels)) % 4 == 3  # only for the curve: documents that the weights haven't seen
    every, truth = pa.array(texts, pa.string()), np.array(labels)
    if len(set(truth[~apart])) < 2:
        apart[:] = False
    text, label = every.filter(pa.array(~apart)), truth[~apart]
    code, row, vocab = pieces(text)
    held_by = np.bincount(np.unique(row * max(1, len(vocab)) + code) % max(1, len(vocab)), minlength=len(vocab))
    frequent = vocab.filter(pa.array(held_by >= LEAST_DOCS)).to_pylist()
    rows, chars = word_rows(vocab, frequent), char_codes(vocab)
    place, owner = windows(row, len(text))
    of = [np.flatnonzero(label[owner] == k) for k in (0, 1)]
    init = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
    c, h = CHAR_HIDDEN, HIDDEN
    p = {"c_in_a": init(PAD + 1, 3 * c), "c_in_b": init(PAD + 1, 3 * c), "c_u_a": init(c, 3 * c), "c_u_b": init(c, 3 * c)}
    p |= {"mix_a": init(2 * c, 3 * h), "mix_b": init(2 * c, 3 * h), "word_a": 0.1 * init(len(frequent) + 1, 3 * h), "word_b": 0.1 * init(len(frequent) + 1, 3 * h)}
    p |= {"u_a": init(h, 3 * h), "u_b": init(h, 3 * h), "att": init(2 * h), "out": init(2 * h), "bias": np.zeros(1, np.float32)}
    adam = gru.Adam(p, 0.02)
    for step in range(steps):
        adam.rate = 0.02 * (1 - step / steps) + 0.001
        if step and step % (steps // 3 + 1) == 0:
            top = highest_windows(WindowScorer(p, frequent).logits(text)[0], owner)
            of = [np.concatenate([of[0], np.resize(top[label[owner[top]] == 0], len(of[0]))]), top[label[owner[top]] == 1]]
        pick = np.concatenate([rng.choice(x, batch // 2) for x in of])
        at = np.ascontiguousarray(place[pick].T)
        mask = (at >= 0).astype(np.float32)
        used, where = np.unique(np.append(code, 0)[at], return_inverse=True)
        where = where.reshape(at.shape)
        if not len(vocab):
            break
        letters = chars[:, used]
        ahead, back, kept = letters, letters[::-1], []
        ends = []
        for side, codes in (("a", ahead), ("b", back)):
            states, cache = gru.forward(p[f"c_in_{side}"][codes], p[f"c_u_{side}"], (codes != PAD).astype(np.float32), keep=True)
            ends.append(states[-1])
            kept.append((codes, cache))
        dropped = (rng.random((len(used), 1)) >= DROPPED).astype(np.float32)
        char = np.concatenate(ends, axis=1) * dropped
        gates = {s: char @ p[f"mix_{s}"] + p[f"word_{s}"][rows[used]] for s in "ab"}
        s_a, cache_a = gru.forward(gates["a"][where], p["u_a"], mask, keep=True)
        s_b, cache_b = gru.forward(gates["b"][where[::-1]], p["u_b"], mask[::-1], keep=True)
        states = np.concatenate([s_a, s_b[::-1]], axis=2)
        logit, weight, pooled = attend(states, mask, p)
        d = ((gru.sigmoid(logit) - np.repeat([0, 1], batch // 2)) / batch).astype(np.float32)
        g = {"out": pooled.T @ d, "bias": d.sum(keepdims=True)}
        d_pooled = d[:, None] * p["out"]
        d_weight = np.einsum("tnh,nh->tn", states, d_pooled)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["att"] = np.einsum("tn,tnh->h", d_score, states)
        d_states = weight[:, :, None] * d_pooled + d_score[:, :, None] * p["att"]
        d_a, g["u_a"] = gru.backward(np.ascontiguousarray(d_states[:, :, :h]), cache_a)
        d_b, g["u_b"] = gru.backward(np.ascontiguousarray(d_states[::-1, :, h:]), cache_b)
        d_char = np.zeros_like(char)
        for s, dg, w in (("a", d_a, where), ("b", d_b, where[::-1])):
            d_gate = gru.add_rows(w, dg, len(used))
            g[f"mix_{s}"] = char.T @ d_gate
            g[f"word_{s}"] = gru.add_rows(rows[used], d_gate, len(frequent) + 1)
            d_char += d_gate @ p[f"mix_{s}"].T
        for k, (s, (codes, cache)) in enumerate(zip("ab", kept, strict=True)):
            d_end = np.zeros((PIECE, len(used), c), np.float32)
            d_end[-1] = dropped * d_char[:, k * c : (k + 1) * c]
            dg, g[f"c_u_{s}"] = gru.backward(d_end, cache)
            g[f"c_in_{s}"] = gru.add_rows(codes, dg, PAD + 1)
        adam.step({key: d + DECAY * p[key] for key, d in g.items()})
    model = WindowScorer(p, frequent)
    if len(set(truth[apart])) < 2:
        apart[:] = True
    model.curve = logistic(model.highest(every.filter(pa.array(apart))).astype(float), truth[apart])
    return model


def highest_windows(logit: np.ndarray, owner: np.ndarray, many: int = 2) -> np.ndarray:
    """The `many` highest windows of each text."""
    order = np.lexsort((-logit, owner))
    nth = np.arange(len(order)) - np.searchsorted(owner, owner[order])
    return order[nth < many]


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 400) -> tuple[float, float]:
    """Slope and shift of a logistic curve with a weight of 3 in 4 on class 0, by gradient descent on scaled values."""
    mean, spread = x.mean(), x.std() + 1e-6
    z, w = (x - mean) / spread, np.where(y == 1, 0.25 / max(1, (y == 1).sum()), 0.75 / max(1, (y != 1).sum()))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        d = w * (gru.sigmoid(a * z + b) - y)
        a, b = a - 2 * (d * z).sum() - 2e-3 * a, b - 2 * d.sum()
    return a / spread, b - a * mean / spread


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> WindowScorer | None:
    """Learns from rows whose crc32(doc_id) mod 5 is not 0; None without both classes."""
    sample = labelled_sample(docs, labels, "toxic", bucket("doc_id", 5) != 0, per_class, max_chars)
    return train(sample["text"].tolist(), sample["label"].astype(int).tolist()) if sample["label"].nunique() == 2 else None


def predict(docs: DataFrame, model: WindowScorer | None) -> DataFrame:
    """doc_id, held_out, score and predicted, a row for each row of docs."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches):
        for b in slices(batches):
            s = model.scores(b.column("text")) if model else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s.astype(float)), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", "text", (bucket("doc_id", 5) == 0).alias("held_out"))
    return rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that score 0.5 or more."""
    model = fit(docs, labels)
    return kept_rows(docs, lambda b: model.scores(b.column("text")) < 0.5) if model else docs


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs, table(spark, sf_dir, "labels")))
