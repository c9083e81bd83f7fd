"""N-gram Jaccard join over parity sketches, and the components of its links.

A document's distinct shingles (`WORDS` consecutive lower-cased words) are hashed to 64 bits, and each flips the bit at its hash in a parity
sketch. Two sketches differ in no more bits than their sets do: the Hamming distance is at most the symmetric difference. The sketch is kept
in two forms. Cut into segments, of which a band of set sizes has a fixed number, it holds for each segment the exclusive or of the positions
of its odd bits; equal segments have equal ones. Folded (positions by their low bits), it is a dense row of bits whose Hamming distance is a
lower bound as well.

A link leaves a smaller document of n shingles at most n / 3 differences, so among its first n / 3 + 1 filled segments, in an order that all
documents share, one is equal to one of the partner's (pigeonhole). Sketches are joined per size band on these segments; bands are a factor of
4 wide, and a document that may be the larger of a pair across a border is in the lower band too. Segments made of shingles that are very
frequent in a sample stand last in the order; this changes which are compared first, and no result.

Documents with the same set are one class, joined once. Of the classes that share a segment, first one is compared with all others (the one
of whose segments most are shared, as in a text that others were made from), then the components are formed; then some `FEW` of the classes
are compared with all others whose component differs, then all with all. So no link between different texts is lost, and copies are not
expanded into pairs. A pair whose folded sketches are too far apart goes at once; for the others the intersection is counted exactly.

A frequent segment's rows are dealt out by class beside the segment, and a segment of many classes is compared in parts of `PART` classes, so
that no task has a whole hot segment.

Defined results: a text with fewer than WORDS words has its whole sequence as one shingle; without words, or null, n_shingles is 0 and the
document is linked with nothing; repeated rows are copies; a null doc_id is a document whose component is the smallest doc_id that is not
null, if there is one; rows that share a doc_id are documents of their own; an empty table gives an empty result; a very long text stands in a
slice of its own (some 60 bytes of arrays for each of its words). Other columns are ignored. Sets are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import bounds, hashed, mark, materialize, mix, release, slices, small_batches, table, words, written

WORDS = 5
#: A link: SCALE * intersection >= SHARE * union.
SHARE, SCALE = 75, 100
#: Sizes (of the smaller document) at which a band begins, and the least number of a sketch's segments.
BANDS = 4 ** np.arange(16)
SEGMENTS = 64
#: The table of frequent shingles: buckets, and documents in the sample that it is made from.
HOT_BUCKETS, HOT_SAMPLE = 1 << 20, 20_000
#: About so many classes of a segment are compared with all others in the second round; a part of a segment has about so many classes.
FEW, PART = 64, 2048
#: Bytes of the folded sketch that goes with a class into every segment.
FOLD = 128

_P = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and the text of each."""
    code, row, vocab = words(text, lower=True)
    word, n = hashed(vocab)[code] if len(code) else np.zeros(0, np.uint64), len(text)
    at = bounds(row, n)
    size = np.diff(at)
    value = np.zeros(max(0, len(word) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        value = value * _P + word[k : k + len(value)]
    start = np.flatnonzero(row[: len(value)] == row[WORDS - 1 :]) if len(value) else np.zeros(0, int)
    found, of = mix(value[start]), row[start]
    few = np.flatnonzero((size > 0) & (size < WORDS))
    if len(few):
        own = np.zeros(len(few), np.uint64)
        for k in range(WORDS - 1):
            more = size[few] > k
            own[more] = own[more] * _P + word[at[few[more]] + k]
        found, of = np.concatenate([found, mix(own + size[few].astype(np.uint64))]), np.concatenate([of, few])
    order = np.lexsort((found, of))
    found, of = found[order], of[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
    return found[new], of[new]


def class_ids(value: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each text's set, and the set's size."""
    at = bounds(row, n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    size = np.diff(at)
    return mix(total[at[1:]] - total[at[:-1]] + size.astype(np.uint64)).view(np.int64), size


def band_of(size: np.ndarray) -> np.ndarray:
    return np.searchsorted(BANDS, np.maximum(size, 1), side="right") - 1


def band_keys(value: np.ndarray, row: np.ndarray, size: np.ndarray, band: np.ndarray, allowed: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """The first allowed + 1 filled segments of each text's sketch in its band: keys, texts, and whether all shingles in the segment are
    frequent. A text with no more filled segments than allowed differences gets its band's common key beside them."""
    cells = BANDS[np.minimum(band + 1, len(BANDS) - 1)]
    cells = np.where(cells > 256, cells // 2, np.maximum(cells, SEGMENTS))[row].astype(np.uint64)
    cell = (value >> np.uint64(20)) % cells
    order = np.lexsort((cell, row))
    cell, of, v = cell[order], row[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (of[1:] != of[:-1])])) if len(cell) else np.zeros(0, int)
    parity, owner = np.bitwise_xor.reduceat(v, first) if len(first) else v, of[first]
    frequent = np.logical_and.reduceat(hot[(v % np.uint64(HOT_BUCKETS)).astype(np.int64)], first) if len(first) else np.zeros(0, bool)
    key = mix(mix(parity) + cell[first] * _P + band[owner].astype(np.uint64))
    order = np.lexsort((key, frequent, owner))
    key, owner, frequent = key[order], owner[order], frequent[order]
    begin = np.searchsorted(owner, owner)
    take = np.arange(len(owner)) - begin <= allowed[owner]
    filled = np.bincount(owner, minlength=len(size))
    sparse = np.flatnonzero((size > 0) & (filled <= allowed))
    return np.concatenate([key[take], mix(band[sparse].astype(np.uint64) + np.uint64(1 << 40))]), np.concatenate([owner[take], sparse]), np.concatenate([frequent[take], np.ones(len(sparse), bool)])


def sketch_keys(text: pa.Array, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """Keys, classes, sizes and `frequent`: what each class among the texts is joined on."""
    value, row = shingles(text)
    cls, size = class_ids(value, row, len(text))
    first = np.zeros(len(text), bool)
    first[np.unique(cls, return_index=True)[1]] = True
    keep = (first & (size > 0))[row]
    value, row = value[keep], row[keep]
    size = np.where(first, size, 0)
    own, lower = band_of(size), band_of(-(-SHARE * size // SCALE))
    out = [band_keys(value, row, size, own, size * (SCALE - SHARE) // SHARE, hot)]
    cross = lower < own
    if cross.any():  # it may be the larger of a pair in the band below
        part = cross[row]
        out.append(band_keys(value[part], row[part], np.where(cross, size, 0), lower, size * 2 * (SCALE - SHARE) // (SCALE + SHARE), hot))
    key, owner, frequent = (np.concatenate(x) for x in zip(*out, strict=True))
    return key.view(np.int64), cls[owner], size[owner], frequent


def frequent_shingles(docs: DataFrame, sample: int = HOT_SAMPLE) -> np.ndarray:
    """Buckets of shingle hashes that far more of the sampled documents have than others; only the order of comparisons depends on it."""
    one_in = max(1, docs.count() // sample)

    def count(batches):
        total = np.zeros(HOT_BUCKETS, np.int64)
        for b in slices(batches):
            total += np.bincount((shingles(b.column("text"))[0] % np.uint64(HOT_BUCKETS)).astype(np.int64), minlength=HOT_BUCKETS)
        at = np.flatnonzero(total > 1)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0).select("text")
    seen = part.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where("n >= 20").toPandas()
    hot = np.zeros(HOT_BUCKETS, bool)
    if len(seen):
        hot[seen["bucket"].to_numpy(int)[seen["n"].to_numpy() >= max(20, 8 * seen["n"].sum() / HOT_BUCKETS)]] = True
    return hot


def shared(batches):
    """Of rows sorted by (key, cls), those of keys that two classes or more have, and all of frequent keys, once each. A key's first row waits
    until a second class comes; nothing else of a key is held."""
    out = lambda *x: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in x], ["key", "cls", "n"])
    last_key = last_cls = first_n = None
    count = 0
    for b in batches:
        key, cls, n, frequent = (b.column(k).to_numpy(zero_copy_only=False) for k in ("key", "cls", "n", "frequent"))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
        if last_key is not None:
            new &= (key != last_key) | (cls != last_cls)
        key, cls, n, frequent = key[new], cls[new], n[new], frequent[new]
        if not len(key):
            continue
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(starts, len(key)))
        total = np.repeat(size, size)
        if last_key is not None and key[0] == last_key:
            if count == 1 and not frequent[0]:
                yield out([last_key], [last_cls], [first_n])
            total[: size[0]] += count
            size[0] += count
        emit = (total > 1) | frequent
        if emit.any():
            yield out(key[emit], cls[emit], n[emit])
        last_key, last_cls, first_n, count = key[-1], cls[-1], n[-1], size[-1]


def bit_sketch(value: np.ndarray, size: int) -> bytes:
    """The sketch folded to a power of two of bits, 4 to 8 for each shingle and 8 * FOLD at least."""
    bits = max(8 * FOLD, 4 << (size - 1).bit_length()) if size else 8 * FOLD
    return np.packbits(np.bincount((value & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8).tobytes()


def folded(sketch: bytes) -> bytes:
    """The sketch folded to FOLD bytes: the parities of its low bits are the sums of the others'."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint8).reshape(-1, FOLD), axis=0).tobytes()


def close(a: np.ndarray, b: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Whether sketches (64-bit words in the last axis) are near enough for a link of sets of `total` elements together."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64) * (SCALE + SHARE) <= total * (SCALE - SHARE)


def plausible(batches):
    """From rows sorted by (key, a, b, role): in each of these groups, pairs of a class of role 0 or 1 and a later one of role 1 or 2, of
    different components, whose sizes and folded sketches allow a link. Only rows of roles 0 and 1 are held, some PART for each group."""
    last, held = None, None
    names = ("cls", "n", "comp", "role")
    for b in slices(batches, "fold", 1 << 20):
        group = [b.column(k).to_numpy(zero_copy_only=False) for k in ("key", "a", "b")]
        cls, n, comp, role = (b.column(k).to_numpy(zero_copy_only=False) for k in names)
        fold = np.frombuffer(b"".join(b.column("fold").to_pylist()), np.uint64).reshape(-1, FOLD // 8)
        starts = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([g[1:] != g[:-1] for g in group])]))
        size = np.diff(np.append(starts, len(cls)))
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def test(x: np.ndarray, y: np.ndarray, found=found, cls=cls, n=n, comp=comp, role=role, fold=fold) -> None:
            ok = (n[x] * SCALE >= n[y] * SHARE) & (n[y] * SCALE >= n[x] * SHARE) & (comp[x] != comp[y]) & (role[x] < 2) & (role[y] > 0)
            x, y = x[ok], y[ok]
            for at in range(0, len(x), 1 << 16):
                i, j = x[at : at + (1 << 16)], y[at : at + (1 << 16)]
                near = close(fold[i], fold[j], n[i] + n[j])
                found.append((cls[i[near]], cls[j[near]]))

        # groups of few rows that begin here: all rows at once, with the next, the next but one, ...
        nth, left = np.arange(len(cls)) - np.repeat(starts, size), np.repeat(size, size)
        few = left <= FEW
        goes_on = last is not None and tuple(g[0] for g in group) == last
        if goes_on:
            few[: size[0]] = False
        at = np.flatnonzero(few)
        for step in range(1, int(size[few[starts]].max(initial=1))):
            at = at[nth[at] + step < left[at]]
            test(at, at + step)
        for i, j in zip(starts.tolist(), (starts + size).tolist(), strict=True):
            if few[i]:
                continue
            if not (goes_on and i == 0):
                held = []
            for k in range(i, j, FEW):  # what stands before in the group, with these rows
                z = min(k + FEW, j)
                for h_cls, h_n, h_comp, h_role, h_fold in held:
                    ok = (h_n[:, None] * SCALE >= n[k:z] * SHARE) & (n[k:z] * SCALE >= h_n[:, None] * SHARE) & (h_comp[:, None] != comp[k:z]) & (role[k:z] > 0)
                    x, y = np.nonzero(ok)
                    if len(x):
                        near = close(h_fold[x], fold[k + y], h_n[x] + n[k + y])
                        found.append((h_cls[x[near]], cls[k + y[near]]))
                x, y = np.triu_indices(z - k, 1)
                test(k + x, k + y)
                if (keep := role[k:z] < 2).any():
                    held.append(tuple(c[k:z][keep].copy() for c in (cls, n, comp, role, fold)))
        # a group of few rows that ends the batch may go on in the next one
        i = int(starts[-1])
        if few[i]:
            held = [tuple(c[i:][role[i:] < 2].copy() for c in (cls, n, comp, role, fold))]
        last = tuple(g[-1] for g in group)
        if found:
            x, y = (np.concatenate(c) for c in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])


def similar_sketches(batches):
    """Of pairs with both sketches, those near enough for a link; the larger is folded to the smaller."""
    for b in slices(batches, "sketch_a", 1 << 20):
        ok = []
        for x, y, n in zip(b.column("sketch_a").to_pylist(), b.column("sketch_b").to_pylist(), b.column("total").to_pylist(), strict=True):
            u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            size = min(len(u), len(v))
            u, v = (np.bitwise_xor.reduce(z.reshape(-1, size), axis=0) for z in (u, v))
            ok.append(bool(close(u, v, n)))
        mask = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask)], ["a", "b"])


def verified(batches):
    """Of pairs (a, text_a, b, text_b), those whose sets are similar enough."""
    for b in pair_slices(batches):
        n = b.num_rows
        va, ra = shingles(b.column("text_a"))
        vb, rb = shingles(b.column("text_b"))
        value, row = np.concatenate([va, vb]), np.concatenate([ra, rb])
        order = np.lexsort((value, row))
        value, row = value[order], row[order]
        both = np.bincount(row[1:][(value[1:] == value[:-1]) & (row[1:] == row[:-1])], minlength=n) if len(value) else np.zeros(n, int)
        union = np.bincount(ra, minlength=n) + np.bincount(rb, minlength=n) - both
        ok = pa.array((SCALE * both >= SHARE * union) & (union > 0))
        yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], ["a", "b"])


def pair_slices(batches):
    for part in slices(batches, "text_a", 2 << 20):
        yield from slices([part], "text_b", 2 << 20)


def components(edges: DataFrame) -> DataFrame:
    """node and comp, the smallest node reachable, of every node that has an edge: labels go along the edges and then jump to their label's
    label, until none changes."""
    spark, since = edges.sparkSession, mark()
    both = edges.union(edges.select("b", "a")).toDF("node", "other")
    labels = materialize(both.groupBy("node").agg(F.min("other").alias("comp")).select("node", F.least("node", "comp").alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "other", "comp": "near"}), "other").groupBy("node").agg(F.min("near").alias("near"))
        hop = materialize(labels.join(near, "node", "left").select("node", F.col("comp").alias("was"), F.least("comp", F.coalesce("near", "comp")).alias("comp")), "hop")
        jump = hop.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        labels_was = materialize(hop.join(jump, "comp", "left").select("node", "was", F.coalesce("root", "comp").alias("comp")), "labels")
        labels = labels_was.select("node", "comp")
        release(spark, written(since), (labels_was,))
        if labels_was.where("was <> comp").isEmpty():
            return labels


def text_key(text: Column | str) -> Column:
    """With doc_id, it names a row: rows that share both are one text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def described(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, text_key, n_shingles, its class, and its sketch in two sizes."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def describe(batches):
        for b in slices(batches):
            value, row = shingles(b.column("text"))
            cls, size = class_ids(value, row, b.num_rows)
            at = bounds(row, b.num_rows)
            sketch = [bit_sketch(value[i:j], j - i) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(size.astype(np.int64)), pa.array(cls), pa.array(sketch, pa.binary()), pa.array(map(folded, sketch), pa.binary())], ["doc_id", "text_key", "n_shingles", "cls", "sketch", "fold"])

    return materialize(docs.select("doc_id", text_key("text").alias("text_key"), "text").mapInArrow(describe, f"doc_id {kind}, text_key long, n_shingles long, cls long, sketch binary, fold binary"), "nodes")


def shared_segments(docs: DataFrame) -> DataFrame:
    """key, cls, n: the segments that two classes or more have."""
    hot = frequent_shingles(docs)

    def keys(batches):
        for b in slices(batches):
            key, cls, size, frequent = sketch_keys(b.column("text"), hot)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(cls), pa.array(size.astype(np.int64)), pa.array(frequent)], ["key", "cls", "n", "frequent"])

    rows = docs.select("text").mapInArrow(keys, "key long, cls long, n long, frequent boolean")
    # a task sends a class once for each slice, so copies are gathered before the shuffle
    dealt = rows.repartition(F.when(F.col("frequent"), F.xxhash64("key", "cls")).otherwise(F.col("key"))).sortWithinPartitions("key", "cls")
    return materialize(dealt.mapInArrow(shared, "key long, cls long, n long"), "shared")


def stars(cells: DataFrame) -> DataFrame:
    """Pairs of each class with the one of its segment of whose own segments the largest share is shared."""
    share = cells.groupBy("cls").agg((F.count("*") / F.min("n")).alias("share"))
    scored = cells.join(share.hint("merge"), "cls")
    centre = materialize(scored.groupBy("key").agg(F.min(F.struct((-F.col("share")).alias("share"), F.col("cls").alias("a"), F.col("n").alias("n_a"))).alias("c")).select("key", "c.a", "c.n_a"), "centres")
    near = (F.col("n_a") * SCALE >= F.col("n") * SHARE) & (F.col("n") * SCALE >= F.col("n_a") * SHARE) & (F.col("a") != F.col("cls"))
    return cells.join(centre.hint("merge"), "key").where(near).select(F.least("a", "cls").alias("a"), F.greatest("a", "cls").alias("b")).distinct()


def within(live: DataFrame, labels: DataFrame, classes: DataFrame, whole: bool) -> DataFrame:
    """Pairs whose folded sketches allow a link, of classes of a segment that are of different components: of some FEW classes with all, or
    (`whole`) of all with all. In the latter, classes outside a segment's largest component are compared with all of it, as any two of different
    components are such a pair. A segment of many classes is dealt in parts: (a, b) has part a of those that are compared with all, and part b
    of all."""
    tagged = live.join(labels.withColumnRenamed("node", "cls").hint("merge"), "cls")
    counts = tagged.groupBy("key", "comp").agg(F.count("*").alias("n_comp")).groupBy("key").agg(F.sum("n_comp").alias("many"), F.max(F.struct("n_comp", "comp")).alias("main"))
    sizes = materialize(counts.select("key", "many", F.col("main.comp").alias("main"), (F.col("many") - F.col("main.n_comp")).alias("outside")), "sizes")
    rows = tagged.join(sizes.hint("merge"), "key").join(classes.select("cls", "fold").hint("merge"), "cls")
    if whole:
        chosen, n_chosen = F.col("comp") != F.col("main"), F.col("outside")
    else:
        chosen, n_chosen = F.pmod(F.xxhash64("cls", "key"), F.ceil(F.col("many") / FEW)) == 0, F.lit(1)
    parts_a, parts_b = (F.greatest(F.ceil(n / PART).cast("int"), F.lit(1)) for n in (n_chosen, F.col("many")))
    own_a, own_b = (F.pmod(F.xxhash64("cls"), n).cast("int") for n in (parts_a, parts_b))
    place = lambda a, b, role: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), F.lit(role).cast("byte").alias("role"))
    all_a, all_b = (F.sequence(F.lit(0), n - 1) for n in (parts_a, parts_b))
    first = F.transform(F.filter(all_b, lambda k: k != own_b), lambda k: place(own_a, k, 0))
    later = F.transform(F.filter(all_a, lambda k: k != own_a), lambda k: place(k, own_b, 2))
    places = F.when(chosen, F.concat(F.array(place(own_a, own_b, 1)), first, later)).otherwise(F.transform(all_a, lambda k: place(k, own_b, 2)))
    dealt = rows.select("key", "cls", "n", "comp", "fold", F.explode(places).alias("p")).select("key", "p.a", "p.b", "p.role", "cls", "n", "comp", "fold")
    return dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "role").mapInArrow(plausible, "a long, b long").distinct()


def links(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b) of classes, those that are links: by their sketches, then by their texts."""
    of = lambda t, x, c: t.select(F.col("cls").alias(x), F.col(c).alias(f"{c}_{x}"), *([F.col("n").alias(f"n_{x}")] if c == "sketch" else []))
    both = pairs.join(of(classes, "a", "sketch").hint("merge"), "a").join(of(classes, "b", "sketch").hint("merge"), "b").withColumn("total", F.col("n_a") + F.col("n_b"))
    # written, so that Spark knows their size
    left = materialize(both.select("a", "b", "sketch_a", "sketch_b", "total").mapInArrow(similar_sketches, "a long, b long"), "pairs")
    needed = left.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    rows = needed.join(classes.select("cls", "row"), "cls").select("cls", F.col("row.doc_id").alias("first_id"), "row.text_key")
    same = F.col("doc_id").eqNullSafe(F.col("first_id")) & (text_key("text") == F.col("text_key"))
    texts = materialize(docs.select("doc_id", "text").join(rows, same).select("cls", "text").dropDuplicates(["cls"]), "texts")
    return materialize(left.join(of(texts, "a", "text"), "a").join(of(texts, "b", "text"), "b").select("a", "text_a", "b", "text_b").mapInArrow(verified, "a long, b long"), "links")


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each document (described()) and of each class that shares a segment (node, comp): its component."""
    spark = docs.sparkSession
    small_batches(spark)
    since = mark()
    nodes = described(docs)
    cells = shared_segments(docs)
    members = cells.select("cls").distinct()
    least = nodes.join(members, "cls", "left_semi").groupBy("cls").agg(F.min(F.struct("doc_id", "text_key")).alias("row"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("fold").alias("fold"))
    classes = materialize(least, "classes")
    alone = classes.select(F.col("cls").alias("node"), F.col("cls").alias("comp"))
    edges, labels, live = None, alone, cells
    for turn in range(3):
        pairs = stars(live) if not turn else within(live, labels, classes, whole=turn == 2)
        found = links(docs, classes, materialize(pairs, "candidates"))
        edges = found if edges is None else edges.union(found)
        if not found.isEmpty():
            of = components(edges)
            labels = materialize(alone.select("node").join(of, "node", "left").select("node", F.coalesce("comp", "node").alias("comp")), "components")
        if turn == 2:
            break
        # segments of two classes are done in the first round, those of some FEW in the second
        tagged = live.join(labels.withColumnRenamed("node", "cls").hint("merge"), "cls")
        mixed = materialize(tagged.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("many")).where(f"x <> y and many > {(2, FEW)[turn]}").select("key"), "mixed")
        live = materialize(live.join(mixed.hint("merge"), "key", "left_semi"), "live")
        if live.isEmpty():
            break
    release(spark, written(since), (nodes, labels))
    return nodes, labels


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id, a row for each row of docs."""
    nodes, labels = linked(docs)
    classes = nodes.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    tagged = classes.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = tagged.groupBy("comp").agg(F.min("least").alias("component_id"))
    of_class = tagged.select("cls", "comp").join(least, "comp").select("cls", "component_id")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return nodes.join(of_class, "cls", "left").select("doc_id", "n_shingles", own.alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: the one of least doc_id (null: last), of those that share it the one of least text_key. Rows
    that repeat doc_id and text are one document; documents without words all stay."""
    nodes, labels = linked(docs)
    comp = F.when(F.col("n_shingles") > 0, F.coalesce("comp", "cls"))
    tagged = nodes.select("doc_id", "text_key", "n_shingles", "cls").join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", comp)
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    with_words = tagged.where("comp is not null").groupBy("comp").agg(F.min(row).alias("row"))
    without = tagged.where("comp is null").select(row.alias("row")).distinct()
    kept = materialize(with_words.select("row").union(without).select(F.col("row.doc_id").alias("kept_id"), F.col("row.text_key").alias("kept_key")), "kept")
    repeats = nodes.groupBy("doc_id", "text_key").count().where("count > 1")
    same = docs["doc_id"].eqNullSafe(kept["kept_id"]) & (text_key(docs["text"]) == kept["kept_key"])
    left = docs.join(kept.hint("shuffle_hash"), same, "left_semi")
    return left if repeats.isEmpty() else left.dropDuplicates(["doc_id", "text"])


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


ORACLE = {
    "op9_jaccard_join": """
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
), t AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), edges AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
    SELECT doc_id AS root, doc_id FROM documents UNION SELECT r.root, e.b FROM reach r JOIN edges e ON r.doc_id = e.a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, (SELECT min(root) FROM reach WHERE reach.doc_id = s.doc_id) AS component_id FROM s
"""
}
