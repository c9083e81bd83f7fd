"""Suffix-array dedup: remove every byte of a 100-byte string that also starts earlier in the corpus.

Prefix doubling ranks positions by ever longer prefixes, drops those whose rank is unique, and ends at the threshold (starts_by_doubling() does
this with every byte). Here the first ranks are those of `GRAM`-byte prefixes, and only of anchors: the position of least hash among the 69 that start a GRAM-byte string inside a 100-byte
string. Equal 100-byte strings have equal anchors, so a start whose anchor's rank is unique is unique itself, and anchors are about one
position in 35. Spark sorts the (rank, position) pairs and drops the unique; the starts of the others get their rank at 100 bytes, from the
ranks (hashes) of their parts at offsets 0, 64 and 96, and are sorted again within their first rank: each but the first of a rank is a repeat.
Ranks are 64-bit hashes.

Hot anchors: within a slice of a task's texts, an anchor with the very surroundings of an earlier one is settled before the shuffle. A rank with
more than `GROUP` anchors is split into groups of so many; what is first in its group meets the other groups' firsts by its 100-byte rank.

Documents are in the order of doc_id (nulls first; rows that share one by their text's hash). Defined results: a null text is an empty one;
repeated rows get a row each, and one of them counts as the earlier; an empty table gives an empty result. A very long text stands in a slice of
its own, with some 130 bytes of arrays for each of its bytes; texts of 2^30 bytes and more are an error. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import filled, materialize, mix, slices, small_batches, table, utf8

LENGTH = 100
GRAM = 32
REACH = LENGTH - GRAM
#: A position is a document's place times 2^START_BITS, and the byte's place in it.
START_BITS = 30
PLACE_BITS = 33
GROUP = 1024
#: Bytes that a task hashes at once: some 130 bytes of arrays for each.
SLICE = 1 << 20

_B = np.uint64(0x9E3779B97F4A7C15)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_B), n, 1 << 64))


def doubled(raw: np.ndarray, longest: int) -> dict[int, np.ndarray]:
    """Polynomial hashes of the strings of 1, 2, 4, ... `longest` bytes at every position, by doubling."""
    out, n = {1: _BYTE[raw]}, 1
    while n < longest and len(out[n]) > n:
        h = out[n]
        out[2 * n] = h[:-n] * _power(n) + h[n:]
        n *= 2
    return out


def hash_at_length(h: dict[int, np.ndarray]) -> np.ndarray:
    """The hash of the LENGTH bytes at every position where they fit."""
    n = len(h[1]) - LENGTH + 1
    return (h[64][:n] * _power(32) + h[32][64 : 64 + n]) * _power(4) + h[4][96 : 96 + n]


def anchors(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of all texts in a row: each anchor's place, its GRAM-byte hash, the first and the last start that it stands for, and a hash of all
    the bytes that these starts cover."""
    none = np.zeros(0, np.int64)
    if len(raw) < LENGTH:
        return none, none.astype(np.uint64), none, none, none.astype(np.uint64)
    h = doubled(raw, 64)
    n = len(raw) - LENGTH + 1
    value = h[GRAM] * np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(32)
    # the position in the low bits, as many in every slice: of equal hashes the leftmost counts, so equal strings have their anchors at equal offsets
    low = np.uint64((1 << START_BITS) - 1)
    least = (value & ~low) | np.arange(len(value), dtype=np.uint64)
    width = 1
    while 2 * width <= REACH + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = REACH + 1 - width
    least = np.minimum(least[: len(least) - rest], least[rest:])[:n]
    place = (least & low).astype(np.int64)
    # starts whose LENGTH bytes cross into the next text stand for nothing
    for e in at[1:-1]:
        place[max(0, e - LENGTH + 1) : e] = -1
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.append(first[1:], n) - 1
    first, last = first[place[first] >= 0], last[place[first] >= 0]
    where = place[first]
    span = last - first + LENGTH
    h64 = h[64]
    cover = mix(mix(h64[first] + span.astype(np.uint64)) + mix(h64[first + (span - 64) // 2]) * _B + h64[first + span - 64])
    return where, h[GRAM][where], first, last, cover


def runs(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted starts, by document, as runs of consecutive ones: document, first and last."""
    if not len(doc):
        return doc, start, start
    cut = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)])
    begin = np.flatnonzero(cut)
    return doc[begin], start[begin], start[np.append(begin[1:], len(doc)) - 1]


def anchor_rows(batches):
    """For each anchor: rank, position of its first start, its number of starts, and how far it lies from the first. `settled` rows repeat
    an earlier one of the slice wholly; they are dealt out by position."""
    for b in slices(batches, limit=SLICE):
        raw, at = utf8(b.column("text"))
        if np.diff(at).max(initial=0) >= 1 << START_BITS:
            raise ValueError(f"a text of {np.diff(at).max()} bytes: positions hold less than 2^{START_BITS}")
        where, gram, first, last, cover = anchors(raw, at)
        doc = np.searchsorted(at, first, side="right") - 1
        pos = (b.column("place").to_numpy(zero_copy_only=False).astype(np.int64)[doc] << START_BITS) + first - at[doc]
        order = np.lexsort((pos, cover))
        settled = np.zeros(len(order), bool)
        settled[order[1:]] = cover[order][1:] == cover[order][:-1]
        rank = np.where(settled, mix(pos.astype(np.uint64)), gram).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(rank), pa.array(pos), pa.array((last - first + 1).astype(np.int16)), pa.array((where - first).astype(np.int16)), pa.array(settled)], ["rank", "pos", "many", "off", "settled"])


def repeated(batches):
    """Of rows sorted by rank, the settled and those whose rank is not unique, these with a group number; `split`: the rank has several groups.
    At most GROUP rows of a rank are held back, until more come or the rank ends."""
    names = ["rank", "pos", "many", "off", "settled"]
    held: list[pa.RecordBatch] = []
    groups = 0  # of the rank that is held, those already sent

    def send(rows: pa.RecordBatch, group, split):
        n = rows.num_rows
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.broadcast_to(np.asarray(group, np.int32), n)), pa.array(np.broadcast_to(np.asarray(split, bool), n))], [*names, "group", "split"])

    for b in batches:
        done = b.column("settled")
        if done.true_count:
            yield send(b.filter(done), 0, False)
            b = b.filter(pc.invert(done))
        if held:
            b = pa.concat_batches([*held, b])
            held = []
        if not b.num_rows:
            continue
        rank = b.column("rank").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]]))
        size = np.diff(np.append(starts, len(rank)))
        nth = np.arange(len(rank)) - np.repeat(starts, size)
        total = np.repeat(size, size)
        base = np.zeros(len(rank), np.int64)
        base[: size[0]] = groups
        keep = (total > 1) | (base > 0)
        tail = len(rank) - starts[-1]
        ended = starts[-1]  # rows before the last rank can go
        if ended:
            m = pa.array(keep[:ended])
            if m.true_count:
                yield send(b.slice(0, ended).filter(m), (base + nth // GROUP)[:ended][keep[:ended]], ((total > GROUP) | (base > 0))[:ended][keep[:ended]])
            groups = 0
        full = (tail - 1) // GROUP  # whole groups of the last rank; there are more rows of it
        if full:
            yield send(b.slice(ended, full * GROUP), groups + np.arange(full * GROUP) // GROUP, True)
            groups += full
        held = [b.slice(ended + full * GROUP)]
    if held and held[0].num_rows and (held[0].num_rows > 1 or groups):
        yield send(held[0], groups, groups > 0)


def with_bytes(batches):
    """For each row of a document's anchors, the bytes that its starts cover."""
    for b in slices(batches, limit=SLICE):
        text = filled(b.column("text")).cast(pa.large_binary()).to_pylist()
        lists = b.column("found")
        row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        s = pc.list_flatten(lists)
        get = {k: s.field(k).to_numpy(zero_copy_only=False) for k in ("pos", "many")}
        begin = get["pos"] & ((1 << START_BITS) - 1)
        said = [text[r][a : a + m + LENGTH - 1] for r, a, m in zip(row.tolist(), begin.tolist(), get["many"].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([s.field("rank"), s.field("group"), s.field("split"), s.field("pos"), pa.array(said, pa.binary())], ["rank", "group", "split", "pos", "bytes"])


def second_rank(batches):
    """Of groups sorted by (rank, group): the starts whose 100-byte rank has an earlier position in the group, as runs (kind 0), and in groups
    that are split the firsts of each 100-byte rank (kind 1)."""
    held: list[pa.RecordBatch] = []

    def done(b: pa.RecordBatch):
        data = b.column("bytes").cast(pa.large_binary())
        raw, at = utf8_binary(data)
        many = np.diff(at) - LENGTH + 1
        owner = np.repeat(np.arange(len(many)), many)
        start = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        long_hash = hash_at_length(doubled(raw, 64))[at[:-1][owner] + start]
        pos = b.column("pos").to_numpy()[owner] + start
        rank, group = b.column("rank").to_numpy(), b.column("group").to_numpy()
        which = np.cumsum(np.concatenate([[0], (rank[1:] != rank[:-1]) | (group[1:] != group[:-1])]))[owner]
        order = np.lexsort((pos, long_hash, which))
        again = np.zeros(len(order), bool)
        again[order[1:]] = (long_hash[order][1:] == long_hash[order][:-1]) & (which[order][1:] == which[order][:-1])
        found = np.sort(pos[again])
        doc, a, z = runs(found >> START_BITS, found & ((1 << START_BITS) - 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(doc), np.int8)), pa.array(doc), pa.array(a), pa.array(z)], ["kind", "place", "first", "last"])
        firsts = ~again & b.column("split").to_numpy(zero_copy_only=False)[owner]
        if firsts.any():
            p = pos[firsts]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(p), np.int8)), pa.array(p), pa.array(long_hash[firsts].view(np.int64)), pa.array(np.zeros(len(p), np.int64))], ["kind", "place", "first", "last"])

    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.nbytes
        if size < SLICE:
            continue
        whole = pa.concat_batches(held)
        rank, group = whole.column("rank").to_numpy(), whole.column("group").to_numpy()
        change = np.flatnonzero((rank[1:] != rank[:-1]) | (group[1:] != group[:-1]))
        if not len(change):
            held = [whole]
            continue
        end = int(change[-1]) + 1
        yield from done(whole.slice(0, end))
        held = [whole.slice(end)]
        size = held[0].nbytes
    if held:
        yield from done(pa.concat_batches(held))


def utf8_binary(data: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    at = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    return np.frombuffer(data.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]


def cut_bytes(text: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left without the bytes of the LENGTH-byte strings that start in the ranges, how many go, and in how many runs."""
    left, at, gone, spans = [], 0, 0, 0
    for first, last in sorted(ranges):
        begin, end = first, last + LENGTH
        if end <= at:
            continue
        if begin > at or not spans:
            left.append(text[at:begin])
            spans += 1
            gone += end - begin
        else:
            gone += end - at
        at = end
    left.append(text[at:])
    return b"".join(left), gone, spans


def places(docs: DataFrame) -> DataFrame:
    """docs with `place`, its number in the order of doc_id; doc_id itself where it is unique and small enough."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    stats = ids.groupBy("doc_id").count().agg(F.count("*").alias("ids"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max("count").alias("most"), F.max(F.col("doc_id").isNull()).alias("nulls")).first()
    if not stats["ids"] or (not stats["nulls"] and stats["most"] == 1 and stats["low"] >= 0 and stats["high"] < 1 << PLACE_BITS):
        return docs.withColumn("place", F.col("doc_id").cast("long"))
    # sort by range, number within each range, and add the sizes of the ranges before
    kept = materialize(docs.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).withColumn("mono", F.monotonically_increasing_id()), "sorted")
    kept = kept.withColumns({"part": F.shiftright("mono", 33), "nth": F.col("mono").bitwiseAND((1 << 33) - 1)})
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = kept.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))  # a row for each task
    return kept.join(sizes, "part").withColumn("place", F.col("before") + F.col("nth")).drop("part", "nth", "before", "mono")


def repeated_starts(docs: DataFrame) -> DataFrame:
    """place, first, last: the runs of starts (of docs with `place`) whose LENGTH bytes also start earlier."""
    texts = docs.select("place", "text")
    rows = texts.mapInArrow(anchor_rows, "rank long, pos long, many short, off short, settled boolean")
    kept = materialize(rows.repartition("rank").sortWithinPartitions("rank").mapInArrow(repeated, "rank long, pos long, many short, off short, settled boolean, group int, split boolean"), "anchors")
    place, low = F.shiftright("pos", START_BITS), F.col("pos").bitwiseAND((1 << START_BITS) - 1)
    settled = kept.where("settled").select(place.alias("place"), low.alias("first"), (low + F.col("many") - 1).alias("last"))
    # as many anchors as a text has at most
    listed = kept.where("not settled").groupBy(place.alias("place")).agg(F.collect_list(F.struct("rank", "group", "split", "pos", "many")).alias("found"))
    said = texts.join(listed.hint("shuffle_hash"), "place").mapInArrow(with_bytes, "rank long, group int, split boolean, pos long, bytes binary")
    ranked = materialize(said.repartition("rank", "group").sortWithinPartitions("rank", "group").mapInArrow(second_rank, "kind byte, place long, first long, last long"), "ranked")
    found = ranked.where("kind = 0").select("place", "first", "last")
    firsts = ranked.where("kind = 1").select(F.col("place").alias("pos"), F.col("first").alias("rank"))
    if not firsts.isEmpty():
        least = firsts.groupBy("rank").agg(F.min("pos").alias("least"))
        later = firsts.join(least, "rank").where("pos > least")
        found = found.union(later.select(place.alias("place"), low.alias("first"), low.alias("last")))
    return found.union(settled)


def byte_rows(batches):
    """For each byte with LENGTH bytes to its right in its text: its position, and its first four bytes as a number."""
    for b in slices(batches, limit=SLICE):
        raw, at = utf8(b.column("text"))
        code = np.zeros(len(raw), np.int64)
        for k in range(4):
            code[: len(raw) - k] |= raw[k:].astype(np.int64) << (24 - 8 * k)
        place = b.column("place").to_numpy(zero_copy_only=False).astype(np.int64)
        size = np.diff(at)
        start = np.arange(len(raw)) - np.repeat(at[:-1], size)
        yield pa.RecordBatch.from_arrays([pa.array((np.repeat(place, size) << START_BITS) + start), pa.array(code), pa.array(np.repeat(size, size) - start)], ["pos", "rank", "left"])


def starts_by_doubling(docs: DataFrame) -> DataFrame:
    """The positions that repeated_starts() finds, of docs with `place`, by prefix doubling over every byte: pairs of ranks at offsets 4, 8, 16, 32
    and then 36, sorted and ranked anew, without the positions whose rank is unique. Each round shuffles each position that is left twice:
    for comparison on small corpora."""
    ranks, length = docs.select("place", "text").mapInArrow(byte_rows, "pos long, rank long, left long"), 4
    while length < LENGTH:
        step = min(length, LENGTH - length)
        ahead = ranks.select((F.col("pos") - step).alias("pos"), F.col("rank").alias("next"))
        met = ranks.where(F.col("left") >= length + step).join(ahead.hint("merge"), "pos").select("pos", F.xxhash64("rank", "next").alias("rank"), "left")
        again = met.groupBy("rank").agg(F.min("pos").alias("least"), F.max("pos").alias("most")).where("least < most").select("rank")
        length += step
        ranks = materialize(met.join(again.hint("merge"), "rank", "left_semi"), "doubled")
    least = ranks.groupBy("rank").agg(F.min("pos").alias("least"))
    return ranks.join(least.hint("merge"), "rank").where("pos > least").select("pos")


def dedup(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; with keep_text also what is left of the text (a cut character goes), and every
    other column of docs under its name."""
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != "text"] if keep_text else ["doc_id"]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    extra = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    # other columns get names that none of those made here has
    placed = places(docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(f"_{c}") for c in rest)))
    listed = repeated_starts(placed).groupBy("place").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    together = placed.select("place", "text", *(f"`_{c}`" for c in rest)).join(listed.hint("shuffle_hash"), "place", "left").drop("place")

    def apply(batches):
        for b in slices(batches):
            out = {k: [] for k in (*extra, "text")}
            for text, ranges in zip(filled(b.column("text")).cast(pa.large_binary()).to_pylist(), b.column("ranges").to_pylist(), strict=True):
                left, gone, spans = cut_bytes(text, [(r["first"], r["last"]) for r in ranges or ()])
                for k, v in zip(extra, (len(text), gone, spans, hashlib.sha256(left).hexdigest()), strict=True):
                    out[k].append(v)
                out["text"].append(left.decode("utf-8", "ignore"))
            cols = [b.column(f"_{c}") for c in rest] + [pa.array(out[k], pa.string() if k == "kept_sha256" else pa.int64()) for k in extra]
            yield pa.RecordBatch.from_arrays([*cols, *([pa.array(out["text"], pa.string())] if keep_text else [])], [*(f"_{c}" for c in rest), *extra, *(["text"] if keep_text else [])])

    schema = ", ".join([*(f"`_{c}` {kinds[c]}" for c in rest), *(f"{k} {'string' if k == 'kept_sha256' else 'long'}" for k in extra), *(["text string"] * keep_text)])
    out = together.mapInArrow(apply, schema)
    if not keep_text:
        return out.withColumnRenamed("_doc_id", "doc_id")
    return out.select(*(F.col(f"`_{c}`").alias(c) if c != "text" else F.col("text") for c in docs.columns))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
