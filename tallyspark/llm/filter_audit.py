"""Filter interaction audit: what each of five filters removes, in every order in which they can be applied.

Arrow buffers are scanned in numpy: byte classes and their prefix sums count each text's words, capitals and symbols; a rolling hash of every
word, sorted within its document, gives the distinct words, and words of equal hash are compared byte by byte. What a document fails is a mask of
five bits. Spark adds the masks up by part, and since an order's results depend on the masks alone, all 120 orders are told from those sums.

Filters: A few words, B few distinct words, C many capitals, D any symbol, E the text of a smaller doc_id (by SHA-256, over the whole table,
whatever other filters do).

Defined results: a null text is an empty one (fails A; two of them are identical); a null source is the part ''; a null doc_id has no labels, and
is neither smaller nor larger than another, so it neither fails E nor makes others fail; rows that share a doc_id and a text do not fail by each
other; several labels of a doc_id: good or toxic if one of them says so; an empty table has no parts, so no rows; a very long text stands in a
slice of its own. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import filled, mix, slices, small_batches, table, utf8

SPACES, SYMBOLS, CAPITALS = b" \t\n\x0b\x0c\r", b"#$%&*|", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS = "ABCDE"
#: Words that a text must have; percent of its words that must be distinct; percent of its characters that may be capitals.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
#: Parts into which rows without a doc_id are dealt.
SALT = 64
#: Bytes of text whose words are hashed together.
RUN = 1 << 20
#: An odd number, and its inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def in_bytes(raw: np.ndarray, wanted: bytes) -> np.ndarray:
    look = np.zeros(256, bool)
    look[list(wanted)] = True
    return look[raw]


def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags each text has: prefix sums at its end less those at its start."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_places(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end: maximal runs of bytes other than ASCII white space, within a text."""
    inside = np.concatenate([[False], ~in_bytes(raw, SPACES), [False]])
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    start = inside[1:] & (~inside[:-1] | edge)
    end = inside[:-1] & (~inside[1:] | edge)
    return np.flatnonzero(start), np.flatnonzero(end)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word, from prefix sums of its bytes' values times powers of a base, moved back to the word's start. Words go in runs of
    `RUN` bytes, so that a long text needs no more memory."""
    value, out = mix(np.arange(1, 257, dtype=np.uint64)), np.zeros(len(start), np.uint64)
    cuts = np.append(np.flatnonzero(np.diff(start // RUN, prepend=-1)), len(start)).tolist()
    for i, j in itertools.pairwise(cuts):
        first, own = start[i], raw[start[i] : end[j - 1]]
        total = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(value[own] * powers(BASE, len(own)), out=total[1:])
        out[i:j] = (total[end[i:j] - first] - total[start[i:j] - first]) * powers(INVERSE, len(own) + 1)[start[i:j] - first]
    return out


def distinct_words(raw: np.ndarray, at: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Distinct words of each text: hashes sorted within it, and neighbours of equal hash compared. A text with two words of one hash is counted
    by the words themselves."""
    n = len(at) - 1
    doc = np.searchsorted(at, start, side="right") - 1
    order = np.lexsort((hashes, doc))
    first, second = order[:-1], order[1:]
    alike = (doc[first] == doc[second]) & (hashes[first] == hashes[second])
    first, second = first[alike], second[alike]
    size = end[first] - start[first]
    equal = size == end[second] - start[second]
    at_byte = np.cumsum(size[equal]) - size[equal]
    step = np.arange(size[equal].sum()) - np.repeat(at_byte, size[equal])
    differ = raw[np.repeat(start[first[equal]], size[equal]) + step] != raw[np.repeat(start[second[equal]], size[equal]) + step]
    equal[equal] = np.add.reduceat(np.append(differ, False), at_byte)[: len(at_byte)] == 0 if len(at_byte) else True
    out = np.bincount(doc, minlength=n) - np.bincount(doc[first], minlength=n)
    for k in np.unique(doc[first[~equal]]).tolist():
        own = doc == k
        out[k] = len({raw[a:b].tobytes() for a, b in zip(start[own].tolist(), end[own].tolist(), strict=True)})
    return out


def measure(text: pa.Array) -> dict[str, np.ndarray]:
    """Of each text: words, distinct words, characters, capitals, symbols."""
    raw, at = utf8(text)
    start, end = word_places(raw, at)
    words = np.searchsorted(start, at[1:]) - np.searchsorted(start, at[:-1])
    return {
        "words": words, "distinct": distinct_words(raw, at, start, end, word_hashes(raw, start, end)), "chars": per_text((raw & 0xC0) != 0x80, at),
        "capitals": per_text(in_bytes(raw, CAPITALS), at), "symbols": per_text(in_bytes(raw, SYMBOLS), at),
    }


def masks(text: pa.Array) -> np.ndarray:
    """A bit for each of A to D that a text fails."""
    m = measure(text)
    fails = [m["words"] < LEAST_WORDS, 100 * m["distinct"] < LEAST_DISTINCT * m["words"], 100 * m["capitals"] > MOST_CAPITALS * m["chars"], m["symbols"] > 0]
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, part, the mask of A to D and the text's digest, of each row."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in slices(batches, owner="filter_audit"):
            text = filled(b.column("text"))
            digest = [hashlib.sha256(x.as_buffer() or b"").digest() for x in text]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), pa.array(masks(text), pa.int32()), pa.array(digest, pa.binary())], ["doc_id", "part", "mask", "digest"])

    return docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text").mapInArrow(run, f"doc_id {kind}, part string, mask int, digest binary")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (five bits), good, toxic and how many rows have them.

    Copies of a text have one mask, so only the least doc_id of each text, and the number of rows that it has, must be known to tell E: a text's
    rows are added up by part and labels before they meet, and a text that a third of all rows have comes as a few sums."""
    says = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    known = labels.groupBy(F.col("doc_id").alias("id")).agg(says("quality"), says("toxic")).withColumn("part_of", F.lit(0))
    rows = scanned(docs).groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    # rows without a doc_id find no labels, wherever they go: they go everywhere
    rows = rows.withColumn("part_of", F.when(F.col("doc_id").isNull(), F.crc32("digest") % SALT).otherwise(0).cast("int"))
    met = rows.join(known, (rows["doc_id"] == known["id"]) & (rows["part_of"] == known["part_of"]), "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    told = met.select("doc_id", "part", "mask", "digest", "n", flag(F.col("quality")).alias("good"), flag(F.col("toxic")).alias("toxic"))
    nameless = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0))
    sums = told.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), nameless.alias("nameless"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("of_least"))
    first = F.min("least").over(Window.partitionBy("digest"))
    spared = F.when(F.col("least") == F.col("first"), F.col("of_least")).otherwise(0) + F.col("nameless")
    copies = sums.withColumn("first", first).withColumn("spared", F.coalesce(spared, F.col("nameless")))
    split = F.array(F.struct(F.col("mask").alias("mask"), F.col("spared").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("spared")).alias("n")))
    return copies.select("part", "good", "toxic", F.inline(split)).where("n > 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.

    A row that fails k filters is removed by each of them in 120 / k of the 120 orders, which gives the last column."""
    # 128 entries at most for each part
    parts = mask_counts(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("seen"))
    orders = F.split(F.lit(" ".join("".join(p) for p in itertools.permutations(LETTERS))), " ")
    bits = lambda order, hit: sum((F.when(hit(F.instr(order, x)), 1 << k).otherwise(0) for k, x in enumerate(LETTERS)), F.lit(0))
    step = lambda order, k: F.struct(order.alias("filter_order"), k.alias("step"), bits(order, lambda at: at == k).alias("own"), bits(order, lambda at: at < k).alias("before"))
    placed = parts.select("part", "seen", F.inline(F.flatten(F.transform(orders, lambda order: F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: step(order, k))))))

    def total(hit, weight=lambda x: x["n"]) -> Column:
        return F.aggregate("seen", F.lit(0).cast("long"), lambda acc, x: acc + F.when(hit(x), weight(x)).otherwise(0))

    fails = lambda x: x["mask"].bitwiseAND(F.col("own")) != 0
    left = lambda x: x["mask"].bitwiseAND(F.col("before")) == 0
    removed = lambda x: fails(x) & left(x)
    return placed.select(
        "part", "filter_order", "step", total(lambda x: left(x) & ~fails(x)).alias("kept"), total(removed).alias("removed"), total(lambda x: fails(x) & ~left(x)).alias("redundant"),
        total(lambda x: x["mask"] == F.col("own")).alias("unique_fails"), total(lambda x: removed(x) & x["good"]).alias("good_lost"), total(lambda x: removed(x) & x["toxic"]).alias("toxic_lost"),
        total(fails, lambda x: x["n"] * F.floor(F.lit(120) / F.bit_count(x["mask"]))).alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = {
    "op13_filter_audit": """
WITH docs AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), told AS (
    SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS copy,
        EXISTS (FROM labels l WHERE l.doc_id = docs.doc_id AND quality = 1) AS good, EXISTS (FROM labels l WHERE l.doc_id = docs.doc_id AND toxic = 1) AS toxic
    FROM docs
), masks AS (
    SELECT part, good, toxic, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t))::INT
        + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * copy::INT AS mask, count(*) AS n
    FROM told GROUP BY ALL
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
    SELECT filter_order, instr(filter_order, x)::INT AS step, bit AS own, (SELECT coalesce(sum(k.bit), 0)::INT FROM letters k WHERE instr(filter_order, k.x) < instr(filter_order, l.x)) AS before FROM orders, letters l
), sums AS (
    SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (mask & (own | before) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & own > 0 AND mask & before = 0), 0) AS removed,
        coalesce(sum(n) FILTER (mask & own > 0 AND mask & before > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails,
        coalesce(sum(n) FILTER (mask & own > 0 AND mask & before = 0 AND good), 0) AS good_lost, coalesce(sum(n) FILTER (mask & own > 0 AND mask & before = 0 AND toxic), 0) AS toxic_lost
    FROM masks, steps GROUP BY ALL
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
    (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM sums"""
}
