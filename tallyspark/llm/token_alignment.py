"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

The texts of a slice stand in a row; the bytes where a tokenizer's tokens end are a packed bitset. AND of the two sets gives the shared cuts, OR
the cells, each of which is the overlap of one token of A with one of B: a link. Popcounts before each word of a set (rank) map a byte to the
tokens that end before it. Both tokenizers start anew at a space after a character that is no white space, so each distinct segment between such
spaces is tokenized once a slice.

How many documents hold an id pair linked is counted corpus-wide: each slice adds up its own documents, and the sums meet by pair. The counts go
back to the slices' distinct pairs, in blocks of `BLOCK` pairs, not to every document's links.

Defined results: a text that is null or empty, or whose joined tokens are not a space and the text, has no tokens: zeros and ''; repeated rows
count each time and get a row each; a null doc_id is kept; an empty table gives an empty result; a very long text stands in a slice of its own,
and its pairs in many blocks. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import gathered, kept_in_worker, materialize, small_batches, table, utf8

#: Bytes of text whose distinct segments are told together; distinct pairs in a block; segments that go to a tokenizer in one text.
SLICE, BLOCK, TOGETHER = 4 << 20, 1 << 16, 2000
#: First bytes of the UTF-8 forms of all white space beyond ASCII (and of other characters).
MAYBE_SPACE = [0xC2, 0xE1, 0xE2, 0xE3]


def ranges(begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (many[0] of them), then the same of the next, and so on."""
    return np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(many.sum())


def starts(many: np.ndarray) -> np.ndarray:
    """Where runs of these lengths start, and the end of the last."""
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(many, dtype=np.int64)])


class Bits:
    """A packed set of numbers below n. rank() tells how many members are below a number, select() all members."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = starts(np.bitwise_count(words))

    @classmethod
    def of(cls, members: np.ndarray, n: int) -> Bits:
        mark = np.zeros((n // 64 + 1) * 64, bool)
        mark[members] = True
        return cls(np.packbits(mark, bitorder="little").view(np.uint64))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def __or__(self, other: Bits) -> Bits:
        return Bits(self.words | other.words)

    def rank(self, number: np.ndarray) -> np.ndarray:
        word, bit = number >> 6, (number & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def select(self) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


class Vocabulary:
    """The bytes of each token of a tokenizer, and encode(texts), which begins a text with a space."""

    def __init__(self, tokens: list[bytes], encode):
        self.encode, self.size = encode, len(tokens)
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.begin, self.blob = starts(self.length)[:-1], np.frombuffer(b"".join(tokens), np.uint8)
        # "id,", "id|" and "id;" of every id
        self.said = pa.array([f"{k}{mark}" for mark in ",|;" for k in range(len(tokens))], pa.large_string())

    def joined(self, ids: np.ndarray) -> bytes:
        return self.blob[ranges(self.begin[ids], self.length[ids])].tobytes()


def byte_level(path: str) -> Vocabulary:
    """A byte-level BPE: each character of a token stands for a byte."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        known = json.load(f)
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves; the others take the characters from 256 on
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    ids = known["model"]["vocab"] | {t["content"]: t["id"] for t in known["added_tokens"]}
    tokens = [b""] * (max(ids.values()) + 1)
    for token, k in ids.items():
        tokens[k] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else b""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return Vocabulary(tokens, lambda texts: [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)])


def pieces(path: str) -> Vocabulary:
    """A sentencepiece model that puts a space before a text: U+2581 stands for a space, <0xHH> for a byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    tokens = [bytes([int(model.id_to_piece(k)[3:5], 16)]) if model.is_byte(k) else model.id_to_piece(k).replace("▁", " ").encode() for k in range(model.get_piece_size())]
    space = [model.piece_to_id("▁")]
    return Vocabulary(tokens, lambda texts: [ids if t != " " else space for t, ids in zip(texts, model.encode([t[1:] for t in texts], num_threads=1), strict=True)])


def starts_anew(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether both tokenizers start anew at a space in these places (3 or more): surely so after a character that is no white space."""
    one, two, three = (raw[at - k] for k in (1, 2, 3))
    lead = np.where(two >= 0xC0, two, three)
    return ((one > 0x20) & (one < 0x7F)) | ((one >= 0x80) & ~np.isin(lead, MAYBE_SPACE))


class Segments:
    """The ids of a slice's distinct segments: where each segment's begin in `ids`, how many they are, and whether they join to the segment."""

    def __init__(self, vocab: Vocabulary, raw: np.ndarray, at: np.ndarray):
        n = len(at) - 1
        self.begin, self.many, self.fine = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
        self.held, found = 0, []
        size = np.diff(at)
        # what ends in a text's last white space, and short segments, are told one by one
        together = (size >= 3) & starts_anew(np.append(np.zeros(3, np.uint8), raw), at[1:] + 3)
        alone = [np.flatnonzero(~together)]
        some = np.flatnonzero(together)
        for i in range(0, len(some), TOGETHER):
            part = some[i : i + TOGETHER]
            text = raw[ranges(at[part], size[part])]
            ids = np.array(vocab.encode([text.tobytes().decode()])[0], np.int32)
            ends, cuts = starts(vocab.length[ids]), starts(size[part])
            token = np.searchsorted(ends, cuts)
            if ends[-1] != cuts[-1] or (ends[token] != cuts).any() or vocab.joined(ids) != text.tobytes():
                alone.append(part)
                continue
            self.begin[part], self.many[part] = token[:-1] + self.held, np.diff(token)
            found.append(ids)
            self.held += len(ids)
        one = np.concatenate(alone)
        texts = [raw[at[k] : at[k + 1]].tobytes() for k in one.tolist()]
        for i in range(0, len(one), TOGETHER):
            for k, said, ids in zip(one[i : i + TOGETHER].tolist(), texts[i : i + TOGETHER], vocab.encode([t.decode() for t in texts[i : i + TOGETHER]]), strict=True):
                ids = np.array(ids, np.int32)
                self.begin[k], self.many[k], self.fine[k] = self.held, len(ids), vocab.joined(ids) == said
                found.append(ids)
                self.held += len(ids)
        self.ids = np.concatenate([np.zeros(0, np.int32), *found])

    def of(self, code: np.ndarray) -> np.ndarray:
        return self.ids[ranges(self.begin[code], self.many[code])]


class Aligner:
    """Two tokenizers."""

    def __init__(self, a: Vocabulary, b: Vocabulary):
        self.both = a, b

    def tokens(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Which texts have tokens; where their bytes start (with the space before each; one more at the end); ids by A and B, and their numbers
        by text."""
        size = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
        full = np.flatnonzero(size > 0)
        raw, at = utf8(pc.binary_join_element_wise(pa.scalar("", pa.large_string()), text.cast(pa.large_string()).take(pa.array(full)), pa.scalar(" ", pa.large_string())))
        space = np.flatnonzero(raw == 0x20)
        space = space[space >= 3]
        cut = np.union1d(space[starts_anew(raw, space)], at[:-1])
        coded = pa.LargeStringArray.from_buffers(len(cut), pa.py_buffer(np.append(cut, len(raw))), pa.py_buffer(raw)).dictionary_encode()
        code = coded.indices.to_numpy()
        told = [Segments(v, *utf8(coded.dictionary)) for v in self.both]
        first = np.searchsorted(cut, at)  # each text's first segment
        many = [np.diff(starts(t.many[code])[first]) for t in told]
        ids = [t.of(code) for t in told]
        good = np.ones(len(full), bool)
        # a text with a segment that does not join has tokens only if the whole text joins
        odd = np.flatnonzero(~(told[0].fine & told[1].fine)[code])
        for d in np.unique(np.searchsorted(first, odd, side="right") - 1).tolist():
            want = raw[at[d] : at[d + 1]].tobytes()
            good[d] = all(v.joined(i[starts(n)[d] : starts(n)[d + 1]]) == want for v, i, n in zip(self.both, ids, many, strict=True))
        if not good.all():
            ids = [i[np.repeat(good, n)] for i, n in zip(ids, many, strict=True)]
        return full[good], starts(np.diff(at)[good]), ids, [n[good] for n in many]

    def align(self, text: pa.Array) -> Aligned:
        which, at, ids, many = self.tokens(text)
        return Aligned(self.both, which, at, ids, many)


class Aligned:
    """The alignment of a slice's texts: groups by shared cuts, and cells, each the link of one token of A and one of B."""

    def __init__(self, both, which, at, ids, many):
        self.both, self.which, self.at, self.ids, self.many = both, which, at, ids, many
        n = int(at[-1])
        self.a, self.b = (Bits.of(np.cumsum(v.length[i]) - 1, n) for v, i in zip(both, ids, strict=True))
        self.shared, self.union = self.a & self.b, self.a | self.b
        cut = self.shared.select()
        #: By group: the ends of its tokens of A and of B, and the byte where it ends.
        self.a_end, self.b_end, self.cut = self.a.rank(cut + 1), self.b.rank(cut + 1), cut + 1
        self.groups, self.cells = (np.diff(s.rank(at)) for s in (self.shared, self.union))

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all links in a row: the token of A, the token of B (their places among the ids), and the text."""
        cell = self.union.select()
        return self.a.rank(cell), self.b.rank(cell), np.repeat(np.arange(len(self.which)), self.cells)

    def said(self) -> list[str]:
        """The digest of each text's groups: `a1,a2|b1;a3|b2,b3`."""
        sizes = np.diff(starts_of(self.a_end)), np.diff(starts_of(self.b_end))
        codes = np.empty(len(self.ids[0]) + len(self.ids[1]), np.int64)
        base = len(self.both[0].said)
        for k, (end, other) in enumerate(((self.a_end, self.b_end - sizes[1]), (self.b_end, self.a_end))):
            size, mark = self.both[k].size, np.zeros(len(self.ids[k]), np.int64)
            mark[end - 1] = k + 1  # `|` after the last of A, `;` after the last of B
            codes[np.arange(len(mark)) + np.repeat(other, sizes[k])] = mark * size + self.ids[k] + k * base
        text = pa.concat_arrays([v.said for v in self.both]).take(pa.array(codes))
        raw, at = utf8(text)
        ends = at[starts(self.many[0] + self.many[1])].tolist()
        return [hashlib.sha256(raw[i : j - 1]).hexdigest() for i, j in itertools.pairwise(ends)]


def starts_of(end: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, end.dtype), end])


def blocks(pair: np.ndarray, doc: np.ndarray, n: int, size: int = BLOCK):
    """The distinct pairs of a slice, in blocks: pairs, the documents that hold each, and for each document that holds any of them: the document,
    how many it holds, which (by place in the block), and how often each is linked in it."""
    coded = pa.array(pair).dictionary_encode()
    named = coded.dictionary.to_numpy()
    order = np.argsort(named)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    code, named = place[coded.indices.to_numpy()], named[order]
    key = np.sort(((code // size) * n + doc) * size + code % size)
    first = np.flatnonzero(np.diff(key, prepend=-1))
    times, key = np.diff(np.append(first, len(key))), key[first]
    cut = np.searchsorted(key // (size * n), np.arange(-(-len(named) // size) + 1))
    for k, (i, j) in enumerate(itertools.pairwise(cut.tolist())):
        own, inside = key[i:j] // size % n, key[i:j] % size
        pairs = named[k * size : (k + 1) * size]
        begin = np.flatnonzero(np.diff(own, prepend=-1))
        yield k, pairs, np.bincount(inside, minlength=len(pairs)), own[begin], np.diff(np.append(begin, len(own))), inside, times[i:j]


def aligner(path_a: str, path_b: str) -> Aligner:
    mine, key = kept_in_worker("token_alignment"), (path_a, path_b)
    if key not in mine:
        mine[key] = Aligner(byte_level(path_a), pieces(path_b))
    return mine[key]


def groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, a_ids and b_ids of each row, and by group a_end, b_end (tokens up to its end) and byte_end (of the space and the text)."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in gathered(batches, SLICE, "token_alignment"):
            x = aligner(path_a, path_b).align(b.column("text"))

            def lists(values, many, less=0, x=x, n=b.num_rows):
                size = np.zeros(n, np.int64)
                size[x.which] = many
                return pa.ListArray.from_arrays(pa.array(starts(size), pa.int32()), pa.array(values - less, pa.int32()))

            before = [np.repeat(s, x.groups) for s in (starts(x.many[0])[:-1], starts(x.many[1])[:-1], x.at[:-1])]
            cols = [lists(i, m) for i, m in zip(x.ids, x.many, strict=True)] + [lists(v, x.groups, s) for v, s in zip((x.a_end, x.b_end, x.cut), before, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", "a_ids", "b_ids", "a_end", "b_end", "byte_end"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, a_ids array<int>, b_ids array<int>, a_end array<int>, b_end array<int>, byte_end array<int>")


def sliced(docs: DataFrame, path_a: str, path_b: str, block: int = BLOCK) -> DataFrame:
    """Rows of documents (slice, nth, doc_id, their numbers and digest), and rows of blocks of the slices' pairs (slice, block, pairs, ...)."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    longs, lists = ["n_a", "n_b", "n_groups", "n_links"], ["pairs", "n_docs", "doc", "many", "code", "times"]
    schema = f"slice long, nth int, doc_id {kind}, " + ", ".join(f"{k} long" for k in longs) + ", groups_sha256 string, block int, " + ", ".join(f"{k} array<{'long' if k == 'pairs' else 'int'}>" for k in lists)

    def run(batches):
        task = TaskContext.get().partitionId() << 32
        for number, b in enumerate(gathered(batches, SLICE, "token_alignment")):
            n, own = b.num_rows, task + number
            x = aligner(path_a, path_b).align(b.column("text"))
            sums = []
            for v in (*x.many, x.groups, x.cells):
                whole = np.zeros(n, np.int64)
                whole[x.which] = v
                sums.append(pa.array(whole))
            digest = np.full(n, "", object)
            digest[x.which] = x.said()
            none = lambda kind, k: pa.nulls(k, kind)
            int_list, long_list = pa.list_(pa.int32()), pa.list_(pa.int64())
            names = ["slice", "nth", "doc_id", *longs, "groups_sha256", "block", *lists]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, own)), pa.array(np.arange(n, dtype=np.int32)), b.column("doc_id"), *sums, pa.array(digest, pa.string()), none(pa.int32(), n), none(long_list, n), *(none(int_list, n) for _ in lists[1:])], names
            )
            a, bb, doc = x.links()
            pair = x.ids[0][a].astype(np.int64) * x.both[1].size + x.ids[1][bb]
            for k, pairs, *rest in blocks(pair, doc, max(1, len(x.which)), block):
                rest[1] = x.which[rest[1]]
                cols = [pa.array([pairs], long_list), *(pa.array([r.astype(np.int32)], int_list) for r in rest)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([own], pa.int64()), none(pa.int32(), 1), none(b.column("doc_id").type, 1), *(none(pa.int64(), 1) for _ in longs), none(pa.string(), 1), pa.array([k], pa.int32()), *cols], names
                )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def link_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """pair (id of A times B's vocabulary, plus id of B), in how many documents it is linked, and whether that is its A id's most."""
    each = rows.where("pairs is not null").select(F.inline(F.arrays_zip("pairs", "n_docs")))
    counts = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("n_docs").alias("count")).withColumn("a", F.floor(F.col("pair") / size_b).cast("int"))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    # a row for each id of A's vocabulary at most
    return counts.join(F.broadcast(most), "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, block: int = BLOCK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row."""
    size_b = pieces(path_b).size
    rows = materialize(sliced(docs, path_a, path_b, block), "aligned")
    held = rows.where("pairs is not null")
    wanted = held.select("slice", "block", F.posexplode("pairs").alias("place", "pair"))
    # `block` entries at most
    found = wanted.join(link_counts(rows, size_b), "pair").groupBy("slice", "block").agg(F.collect_list(F.struct("place", "count", "best")).alias("found"))

    def total(batches):
        for b in batches:
            for r in range(b.num_rows):
                got = b.column("found")[r].values
                place = got.field("place").to_numpy()
                count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
                count[place], best[place] = got.field("count").to_numpy(), got.field("best").to_numpy(zero_copy_only=False)
                doc, many, code, times = (b.column(k)[r].values.to_numpy().astype(np.int64) for k in ("doc", "many", "code", "times"))
                begin = starts(many)[:-1]
                sums = [np.add.reduceat(v[code] * times, begin) for v in (best, count)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), b.column("slice")[r].as_py())), pa.array(doc.astype(np.int32)), *map(pa.array, sums)], ["slice", "nth", "n_best", "count_sum"])

    parts = held.select("slice", "block", "doc", "many", "code", "times").join(found, ["slice", "block"]).select("slice", "doc", "many", "code", "times", "found")
    sums = parts.mapInArrow(total, "slice long, nth int, n_best long, count_sum long").groupBy("slice", "nth").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = rows.where("nth is not null").join(sums, ["slice", "nth"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
