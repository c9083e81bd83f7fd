"""Language identification: a bidirectional gated recurrent network over bytes labels every position of a text.

Each text's UTF-8 bytes are cut into runs of `SPAN` bytes; two recurrent layers read every run from both ends, and a softmax over
the languages labels each byte. Each layer begins `MARGIN` bytes before its end of the run, in the neighbouring runs of the text, so every byte is
labelled with at least so many bytes of its text on both sides. A document's probabilities are the mean over all its positions, so whole texts count. The network is
trained on the driver by back-propagation through time, on a bounded sample of labelled rows (`PER_LANG` a language).

Defined results: a null text, an empty one and one without a letter get `und` with score 0; repeated rows are predicted one by one;
a null doc_id is kept, and never held out; if there is no row to learn from, every document gets `und`; an empty table gives an empty result; a very
long text stands in a slice of its own, and each of its bytes is labelled. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import gru
from tallyspark.llm.common import bucket, kept_rows, labelled_sample, slices, small_batches, table, utf8

SPAN, MARGIN = 64, 32
HIDDEN = 8
PER_LANG = 500
MAX_CHARS = 20_000
PAD = 256
#: The pipeline rejects documents whose best language is less likely.
LEAST = 0.3


@dataclass
class ByteTagger:
    langs: list[str]
    params: dict[str, np.ndarray]

    def position_probs(self, spans: np.ndarray) -> np.ndarray:
        """spans: byte codes of runs with their margins, a run a row (PAD beyond its text). Returns places x runs x languages; zeros in the margins."""
        p, codes = self.params, np.ascontiguousarray(spans.T)
        own = slice(MARGIN, len(codes) - MARGIN)
        ahead = gru.run(gru.held(p["in_a"][:PAD]), p["u_a"], codes[: own.stop])[MARGIN:]
        back = gru.run(gru.held(p["in_b"][:PAD]), p["u_b"], codes[MARGIN:][::-1])[MARGIN:][::-1]
        e = ahead.reshape(-1, HIDDEN) @ p["w_a"]
        e += np.ascontiguousarray(back).reshape(-1, HIDDEN) @ p["w_b"]
        e += p["b"]
        np.exp(np.clip(e, -80, 80, out=e), out=e)
        e *= ((codes[own] != PAD).ravel() / (e @ np.ones(e.shape[1], np.float32)))[:, None]
        out = np.zeros((*codes.shape, e.shape[1]), np.float32)
        out[own] = e.reshape(-1, codes.shape[1], e.shape[1])
        return out

    def document_probs(self, raw: np.ndarray, at: np.ndarray, block: int = 2048) -> np.ndarray:
        """Mean of the positions' probabilities for each text in `raw` (texts start at `at`); zeros for an empty one."""
        spans, owner = cut(raw, at)
        total = np.zeros((len(at) - 1, len(self.langs)))
        for i in range(0, len(spans), block):
            np.add.at(total, owner[i : i + block], self.position_probs(spans[i : i + block]).sum(axis=0))
        return total / np.maximum(np.diff(at), 1)[:, None]


def cut(raw: np.ndarray, at: np.ndarray, span: int = SPAN, margin: int = MARGIN) -> tuple[np.ndarray, np.ndarray]:
    """Runs of `span` bytes with `margin` bytes on both sides that never cross texts, and the text of each run."""
    size = np.diff(at)
    runs = -(-size // span)
    owner = np.repeat(np.arange(len(size)), runs)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
    place = (at[:-1][owner] + nth * span)[:, None] + np.arange(-margin, span + margin)
    inside = (place >= at[:-1][owner][:, None]) & (place < at[1:][owner][:, None])
    padded = np.append(raw, np.uint8(0)).astype(np.int16)  # PAD does not fit a byte
    return np.where(inside, padded[np.clip(place, 0, len(raw))], np.int16(PAD)), owner


def train(texts: list[str], langs: list[str], steps: int = 300, runs: int = 128, seed: int = 7) -> ByteTagger:
    """Each step labels every byte of `runs` runs, drawn evenly over the languages, and goes back through time over both layers."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    spans, owner = cut(*utf8(pa.array(texts, pa.string())))
    label = np.array([names.index(x) for x in langs])[owner]
    by_lang = [np.flatnonzero(label == k) for k in range(len(names))]
    init = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
    p = {"in_a": init(PAD + 1, 3 * HIDDEN), "in_b": init(PAD + 1, 3 * HIDDEN), "u_a": init(HIDDEN, 3 * HIDDEN), "u_b": init(HIDDEN, 3 * HIDDEN), "w_a": init(HIDDEN, len(names)), "w_b": init(HIDDEN, len(names)), "b": np.zeros(len(names), np.float32)}
    adam = gru.Adam(p, 0.02)
    for step in range(steps):
        adam.rate = 0.02 * (1 - step / steps) + 0.001
        pick = np.concatenate([rng.choice(x, -(-runs // len(names))) for x in by_lang])
        codes = np.ascontiguousarray(spans[pick].T)
        own, before, after = slice(MARGIN, len(codes) - MARGIN), codes[: len(codes) - MARGIN], codes[MARGIN:][::-1]
        mask = (codes[own] != PAD).astype(np.float32)
        ahead, cache_a = gru.forward(p["in_a"][before], p["u_a"], (before != PAD).astype(np.float32), keep=True)
        back_r, cache_b = gru.forward(p["in_b"][after], p["u_b"], (after != PAD).astype(np.float32), keep=True)
        ahead, back = ahead[MARGIN:], back_r[MARGIN:][::-1]
        logits = ahead @ p["w_a"] + back @ p["w_b"] + p["b"]
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        d = e / e.sum(axis=2, keepdims=True)
        d[:, np.arange(len(pick)), label[pick]] -= 1
        d *= (mask / mask.sum())[:, :, None]
        flat = d.reshape(-1, len(names))
        none = np.zeros((MARGIN, len(pick), HIDDEN), np.float32)  # no loss in the margins
        d_a, du_a = gru.backward(np.concatenate([none, d @ p["w_a"].T]), cache_a)
        d_b, du_b = gru.backward(np.concatenate([none, (d @ p["w_b"].T)[::-1]]), cache_b)
        adam.step({"in_a": gru.add_rows(before, d_a, PAD + 1), "in_b": gru.add_rows(after, d_b, PAD + 1), "u_a": du_a, "u_b": du_b, "w_a": ahead.reshape(-1, HIDDEN).T @ flat, "w_b": back.reshape(-1, HIDDEN).T @ flat, "b": flat.sum(axis=0)})
    return ByteTagger(names, p)


def fit(docs: DataFrame, per_lang: int = PER_LANG, max_chars: int = MAX_CHARS) -> ByteTagger | None:
    """Learns from text and lang of rows whose crc32(doc_id) mod 5 is not 0; None if there is no such row."""
    seen = docs.select("doc_id", "lang")
    sample = labelled_sample(docs, seen, "lang", bucket("doc_id", 5) != 0, per_lang, max_chars)
    return train(sample["text"].tolist(), sample["label"].tolist()) if len(sample) else None


def predict(docs: DataFrame, model: ByteTagger | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score; a row for each row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select("doc_id", "text", (bucket("doc_id", 5) == 0).alias("held_out"), lettered.alias("lettered"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def label(batches):
        for b in slices(batches):
            n, ok = b.num_rows, b.column("lettered").to_numpy(zero_copy_only=False).astype(bool)
            if model is None:
                names, score = np.full(n, "und", object), np.zeros(n)
            else:
                probs = model.document_probs(*utf8(b.column("text")))
                best = probs.argmax(axis=1)
                names = np.where(ok, np.array(model.langs, object)[best], "und")
                score = np.where(ok, np.clip(probs[np.arange(n), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(score.astype(float))], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(label, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def drop_unknown(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """docs without the rows that have no letter, or whose best language has a probability under `least`."""
    model, lettered = fit(docs), docs.where(F.col("text").rlike(r"\p{L}"))
    return kept_rows(lettered, lambda b: model.document_probs(*utf8(b.column("text"))).max(axis=1) >= least) if model else lettered


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
