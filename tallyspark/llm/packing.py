"""Mixture-controlled packing: deficit round-robin over source queues fills every window to target token proportions.

Each source is a queue of its documents' tokens. Every window of `WINDOW` tokens gives each queue a quantum in proportion to its weight; what a
queue may not spend, as tokens are whole, is its deficit, which it carries into the next window. Since documents may be cut anywhere, the
packets are single tokens, and the credits after any number of tokens have a closed form: token i of queue s is served at virtual time
(i + 1/2) / weight(s), and a queue that has run empty drops out while the others go on in proportion. So `served()` gives, for any window, how
many tokens of every queue come before it, without going through the windows before: no state passes between tasks, and deficits carry
over across windows and partitions alike. Every task cuts its own documents; only the queues' totals meet.

Target proportions are those of the sources' tokens, or `weights` by source. Sources without a given weight share what the given ones leave of
1, in proportion to their tokens; where nothing is left for them, that is an error. A source with a given weight has a queue of its own, as
have the largest others; where there are more than `MAX_QUEUES`, the rest share one queue, whose weight is the sum of theirs.

Defined results: a null text is an empty one, and a document always has its end id; a null source shares the queue of the empty one; repeated
rows are packed one by one; a null doc_id is kept; an empty table gives no piece; a very long text stands in a slice of its own. Other columns
are ignored.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import Recent, gathered, kept_in_worker, materialize, small_batches, table, words

WINDOW = 4096
MAX_QUEUES = 256
END = 2
#: Entries in a generation of what a worker keeps of what it has tokenized.
CACHE = 400_000
#: Bytes of text whose distinct runs are told together; runs in one text for the tokenizer, and the mark between them.
SLICE, TOGETHER, MARK = 4 << 20, 1000, "|"
#: Rows up to which the starts of the blocks are broadcast (some 50 bytes each); above, they are joined by a shuffle.
BROADCAST_ROWS = 200_000


def tokenizer(path: str) -> tuple:
    """The tokenizer and a dictionary of what it has given, one for each file in a worker."""
    mine = kept_in_worker("packing")
    if path not in mine:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        mine[path] = Tokenizer.from_file(path), Recent(CACHE)
    return mine[path]


def encoded(tok, runs: list[str]) -> list[bytes]:
    """The ids of each run, as bytes. Runs go to the tokenizer `TOGETHER` at a time, with a mark before each; those with the mark in them by
    themselves, and all of a text that does not come back with as many marks."""
    mark = tok.encode(MARK, add_special_tokens=False).ids
    alone = [k for k, x in enumerate(runs) if MARK in x]
    rest = [k for k, x in enumerate(runs) if MARK not in x] if len(mark) == 1 else []
    out: list[bytes] = [b""] * len(runs)
    parts = [rest[i : i + TOGETHER] for i in range(0, len(rest), TOGETHER)]
    for part, e in zip(parts, tok.encode_batch_fast([" ".join(f"{MARK} {runs[k]}" for k in part) for part in parts], add_special_tokens=False), strict=True):
        ids = np.array(e.ids, np.uint32)
        at = np.flatnonzero(ids == mark[0])
        if len(at) != len(part):
            alone += part
            continue
        raw, at = ids.tobytes(), (4 * np.append(at, len(ids))).tolist()
        for k, i, j in zip(part, at[:-1], at[1:], strict=True):
            out[k] = raw[i + 4 : j]
    alone = alone if len(mark) == 1 else range(len(runs))
    for k, e in zip(alone, tok.encode_batch_fast([runs[k] for k in alone], add_special_tokens=False), strict=True):
        out[k] = np.array(e.ids, np.uint32).tobytes()
    return out


def tokenize(text: pa.Array, path: str, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in a row, each text's end id included, and the places where they start (one more at the end). The tokenizer drops
    white space and never merges across it, so each distinct run between ASCII white space is tokenized once."""
    tok, known = tokenizer(path)
    code, row, vocab = words(text, lower=True)  # the tokenizer lower-cases: fewer distinct runs
    said = vocab.to_pylist()
    new, young = known.missing(said), known.young
    for i in range(0, len(new), 20_000):
        part = new[i : i + 20_000]
        young.update(zip(part, encoded(tok, part), strict=True))
    got = [young[x] for x in said]
    flat, size = np.frombuffer(b"".join(got), np.uint32), np.array([len(x) // 4 for x in got], np.int64)
    many = size[code] if len(code) else code
    first = np.cumsum(many) - many
    ids = flat[np.repeat((np.cumsum(size) - size)[code] - first, many) + np.arange(many.sum())] if len(code) else flat
    per = np.bincount(row, many, minlength=len(text)).astype(np.int64) + 1
    at = np.append(0, np.cumsum(per))
    out = np.full(at[-1], end, np.uint32)
    out[np.arange(len(ids)) + np.repeat(row, many)] = ids
    return out, at


def tokenized(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """doc_id, source, part (the task), first (tokens of the same source before it in that task), n and ids of each row."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        part, before = TaskContext.get().partitionId(), {}
        for b in gathered(batches, SLICE, "packing"):
            ids, at = tokenize(b.column("text"), path, end)
            n, first = np.diff(at), []
            for s, k in zip(b.column("source").to_pylist(), n.tolist(), strict=True):
                first.append(before.get(s, 0))
                before[s] = first[-1] + k
            wide = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(at * 4), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(np.full(len(n), part, np.int32)), pa.array(first, pa.int64()), pa.array(n), wide.cast(pa.binary())], ["doc_id", "source", "part", "first", "n", "ids"])

    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, source string, part int, first long, n long, ids binary")


class Mixture:
    """The queues' totals and weights, and the order in which their tokens are served."""

    def __init__(self, totals: np.ndarray, weights: np.ndarray, window: int = WINDOW):
        self.totals, self.window = totals.astype(np.int64), window
        self.weights = np.maximum(weights.astype(float), 1e-12)
        self.all = int(self.totals.sum())
        self.end = float(((self.totals + 1) / self.weights).max(initial=0.0))

    def by(self, time: np.ndarray) -> np.ndarray:
        """Tokens of each queue served by a virtual time."""
        return np.minimum(np.floor(time[:, None] * self.weights + 0.5), self.totals).astype(np.int64)

    def served(self, n: np.ndarray) -> np.ndarray:
        """Of the first n tokens, how many are of each queue (a row for each n). Never falls as n grows."""
        n = np.minimum(n, self.all)
        lo, hi = np.zeros(len(n)), np.full(len(n), self.end)
        while True:
            mid = (lo + hi) / 2
            if not ((mid > lo) & (mid < hi)).any():
                break
            few = self.by(mid).sum(axis=1) <= n
            lo, hi = np.where(few, np.maximum(mid, lo), lo), np.where(few, hi, np.minimum(mid, hi))
        sure = self.by(lo)
        more = self.by(hi) - sure  # all at one moment: in the order of the queues
        left = (n - sure.sum(axis=1))[:, None]
        return sure + np.clip(left - (np.cumsum(more, axis=1) - more), 0, more)

    def window_of(self, queue: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The window in which each queue's token is served."""
        w = self.by((token + 0.5) / self.weights[queue]).sum(axis=1) // self.window
        pick = np.arange(len(w))
        while len(late := np.flatnonzero(self.served(w * self.window)[pick, queue] > token)):
            w[late] -= 1
        while len(early := np.flatnonzero(self.served((w + 1) * self.window)[pick, queue] <= token)):
            w[early] += 1
        return w

    def pieces(self, queue: np.ndarray, start: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
        """Cut the tokens [start, start + n) of each queue into pieces: which, begin (in the queue), length, sequence and offset."""
        if not len(queue):
            return {k: np.zeros(0, np.int64) for k in ("which", "begin", "length", "sequence", "offset")}
        first, last = self.window_of(queue, start), self.window_of(queue, start + n - 1)
        many = last - first + 1
        which = np.repeat(np.arange(len(queue)), many)
        w = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        edges, at = np.unique(np.concatenate([w, w + 1]), return_inverse=True)
        table_ = self.served(edges * self.window)
        low, high = table_[at[: len(w)]], table_[at[len(w) :]]
        q, pick = queue[which], np.arange(len(which))
        begin = np.maximum(start[which], low[pick, q])
        length = np.minimum((start + n)[which], high[pick, q]) - begin
        ahead = np.cumsum(high - low, axis=1)[pick, q] - (high - low)[pick, q]
        out = {"which": which, "begin": begin, "length": length, "sequence": w, "offset": ahead + begin - low[pick, q]}
        return {k: v[length > 0] for k, v in out.items()}


def shares(sources: list[str | None], size: np.ndarray, weights: dict[str, float]) -> np.ndarray:
    """The weight of each queue: as given, or a part of what is left of 1, in proportion to its tokens."""
    free = np.array([s not in weights for s in sources], bool)
    rest = 1 - sum(weights.values())
    if weights and free.any() and rest <= 0:
        raise ValueError("weights leave nothing for: " + ", ".join(str(s) for s, f in zip(sources, free, strict=True) if f))
    out = size * (rest / max(1, size[free].sum()))
    out[~free] = [weights[s] for s, f in zip(sources, free, strict=True) if not f]
    return out


def pack(docs: DataFrame, path: str, weights: dict[str, float] | None = None, window: int = WINDOW, max_queues: int = MAX_QUEUES, end: int = END) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue. `weights`: the target proportions of
    some or all sources; by default each source's share of all tokens, so that every window has the corpus's own mixture to the end."""
    rows = materialize(tokenized(docs, path, end), "tokens")
    blocks = materialize(rows.groupBy("source", "part").agg(F.sum("n").alias("tokens")), "blocks")
    given = weights or {}
    if len(given) >= max_queues or any(not w > 0 for w in given.values()):
        raise ValueError("weights must be over 0, and of fewer sources than there are queues")
    totals = blocks.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    wanted = F.col("source").isin(list(given))
    named_first = totals.where(wanted).orderBy("source").collect() if given else []
    large = named_first + totals.where(~wanted if given else F.lit(True)).orderBy(F.desc("tokens"), "source").limit(max_queues - 1 - len(named_first)).collect()
    every = blocks.agg(F.sum("tokens").alias("n"), F.count("*").alias("blocks")).first()
    left = (every["n"] or 0) - sum(r["tokens"] for r in large)
    size = np.array([r["tokens"] for r in large] + [left] * (left > 0), np.int64)
    share = shares([r["source"] for r in large] + [None] * (left > 0), size, given)
    mixture = Mixture(size, share, window)
    queue_of = docs.sparkSession.createDataFrame([(r["source"], k) for k, r in enumerate(large)], "source string, queue int")
    # at most max_queues rows
    named = blocks.join(F.broadcast(queue_of), "source", "left").withColumn("queue", F.coalesce("queue", F.lit(len(large))))
    before = F.sum("tokens").over(Window.partitionBy("queue").orderBy("part", "source").rowsBetween(Window.unboundedPreceding, -1))
    starts = named.select("source", "part", "queue", F.coalesce(before, F.lit(0)).alias("block_start"))
    starts = F.broadcast(starts) if every["blocks"] <= BROADCAST_ROWS else starts
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            start, n = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "n"))
            p = mixture.pieces(b.column("queue").to_numpy(zero_copy_only=False).astype(np.int64), start, n)
            which = p["which"]
            begin = p["begin"] - start[which]
            ids = [memoryview(x).cast("B") for x in b.column("ids").to_pylist()]
            crc = [zlib.crc32(ids[d][4 * a : 4 * (a + k)]) for d, a, k in zip(which.tolist(), begin.tolist(), p["length"].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pc.take(b.column("doc_id"), pa.array(which)), pa.array(begin), pa.array(p["length"]), pa.array(crc, pa.int64()), pa.array(n[which]), pa.array(p["sequence"]), pa.array(p["offset"]), pc.take(b.column("queue"), pa.array(which))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"],
            )

    placed = rows.join(starts, ["source", "part"]).select("doc_id", (F.col("block_start") + F.col("first")).alias("start"), "n", "queue", "ids")
    return placed.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue int")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
