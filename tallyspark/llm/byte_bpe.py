"""Byte-level BPE encoding and decoding by DuckDB recursive queries within each partition.

Encoding: the distinct words (matches of the pattern) of a partition's texts that are no token themselves become rows of (word, position,
tokens). A recursive query joins neighbouring positions with the merge table, contracts the leftmost pair of minimum rank of each word, and ends
when no word has a pair left; an ordered aggregation gives each word's ids. Decoding joins (word, position, id) rows with the vocabulary and
aggregates their bytes in order. In between, the texts of a slice (`SLICE`) are columns of codes into their distinct words, each of which is
contracted and decoded once; ids, decimal ids and decoded bytes of whole texts are gathered by Arrow.

Defined results: a null text is an empty one (0 tokens, the digests of nothing); repeated rows get a row each; a null doc_id is kept; an empty
table gives an empty result; a very long text stands in a slice of its own. A word of `LONG` bytes or more is contracted by a query that takes
all places of the least pair in one turn. One of over `VERY_LONG` bytes is contracted with a heap: the query keeps the rows of all its turns,
and their number grows with the square of the length. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import sys

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm.common import filled, gathered, kept_in_worker, small_batches, table, utf8

#: Bytes of text whose distinct words are told together (one longer text makes a slice of its own).
SLICE = 24 << 20
#: Distinct words in one query.
WORDS = 40_000
#: Bytes of a word from which all places of a pair go in one turn, and over which the query is not used.
LONG, VERY_LONG = 256, 4096
#: What str.isspace() takes as white space.
SPACES = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace()]

#: A row is a pair of neighbouring tokens: (word, position of the first, first, second). Contracting the pair at k drops its row and puts the
#: made token into the rows beside it. A word that is no token itself keeps a pair to the end.
CONTRACT = f"""
WITH RECURSIVE step AS (
    SELECT w, pos, l, r, 0 AS turn FROM start_rows
  UNION ALL
    (WITH best AS (
        SELECT w, min(m.made::BIGINT * {LONG} + pos) AS key FROM step JOIN merges m USING (l, r) GROUP BY w
    ), hit AS (
        SELECT w, (key % {LONG})::INT AS k, (key // {LONG})::INT AS made FROM best
    )
    SELECT s.w, s.pos - (s.pos > k)::INT, CASE WHEN s.pos = k + 1 THEN made ELSE s.l END, CASE WHEN s.pos = k - 1 THEN made ELSE s.r END, s.turn + 1
    FROM step s JOIN hit USING (w) WHERE s.pos <> k)
)
SELECT w, list_append(list(l ORDER BY pos), max_by(r, pos)) AS ids FROM step JOIN (SELECT w, max(turn) AS turn FROM step GROUP BY w) USING (w, turn) GROUP BY w ORDER BY w
"""

#: The same with all places of a word's least pair in a turn, from the left and without overlaps; only the leftmost where the made token is
#: part of one of lower rank (`alone`), which would have to come first.
CONTRACT_ALL = """
WITH RECURSIVE step AS (
    SELECT w, pos, l, r, 0 AS turn FROM start_rows
  UNION ALL
    (WITH met AS (
        SELECT s.*, m.made, m.alone FROM step s LEFT JOIN merges m USING (l, r)
    ), best AS (
        SELECT w, min(made) AS least FROM met GROUP BY w HAVING least IS NOT NULL
    ), hits AS (
        SELECT w, pos, l, r, turn, least, alone, coalesce(made = least, false) AS same FROM met JOIN best USING (w)
    ), island AS (
        SELECT *, sum(same::INT) OVER (PARTITION BY w ORDER BY pos) AS nth, max(CASE WHEN same THEN -1 ELSE pos END) OVER (PARTITION BY w ORDER BY pos) AS gap FROM hits
    ), hit AS (
        SELECT w, pos, l, r, turn, least, same AND CASE WHEN alone THEN nth = 1 ELSE l <> r OR (pos - gap) % 2 = 1 END AS hit FROM island
    ), moved AS (
        SELECT w, pos - coalesce(sum(hit::INT) OVER (PARTITION BY w ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS pos,
            CASE WHEN lag(hit, 1, false) OVER (PARTITION BY w ORDER BY pos) THEN least ELSE l END AS l, CASE WHEN lead(hit, 1, false) OVER (PARTITION BY w ORDER BY pos) THEN least ELSE r END AS r, turn + 1 AS turn, hit FROM hit
    )
    SELECT w, pos, l, r, turn FROM moved WHERE NOT hit)
)
SELECT w, list_append(list(l ORDER BY pos), max_by(r, pos)) AS ids FROM step JOIN (SELECT w, max(turn) AS turn FROM step GROUP BY w) USING (w, turn) GROUP BY w ORDER BY w
"""

EXPAND = "SELECT w, list(raw ORDER BY pos) AS raw FROM given_ids JOIN vocab USING (id) GROUP BY w ORDER BY w"

#: Pieces that are one match of the pattern: letters, perhaps after a space. (The pattern tells all letters; these ranges hold nothing else.)
ONE_WORD = "^ ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+$"


def spread(begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (many[0] of them), then the same of the next, and so on."""
    return np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(many.sum())


def ends(many: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(many)])


class ByteBpe:
    """A rank file's tokens, in a DuckDB connection of this process."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.single = np.array([self.ranks[bytes([k])] for k in range(256)], np.int32)
        splits = [(self.ranks[k[:i]], self.ranks[k[i:]], v) for k, v in self.ranks.items() for i in range(1, len(k)) if k[:i] in self.ranks and k[i:] in self.ranks]
        l, r, made = np.array(splits, np.int32).reshape(-1, 3).T  # noqa: E741
        self.tokens, self.rank_of = pa.array(self.ranks, pa.large_binary()), np.array(list(self.ranks.values()), np.int32)
        vocab = pa.table({"id": self.rank_of, "raw": self.tokens})
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "500MB"})
        self.db.execute("SET preserve_insertion_order = false")
        self.db.register("given_merges", pa.table({"l": l, "r": r, "made": made}))
        self.db.register("given_vocab", vocab)
        self.db.execute("CREATE TABLE merges AS SELECT l, r, made, made IN (SELECT l FROM given_merges WHERE made < l UNION SELECT r FROM given_merges WHERE made < r) AS alone FROM given_merges")
        self.db.execute("CREATE TABLE vocab AS FROM given_vocab")

    def contract(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each word, and all ids in a row."""
        known = pc.index_in(words.cast(pa.large_binary()), self.tokens)
        size = np.where(known.is_valid().to_numpy(zero_copy_only=False), 1, 0)
        todo = np.flatnonzero(size == 0)
        raw, at = utf8(words)
        length = np.diff(at)
        found = [(np.flatnonzero(size), np.ones(size.sum(), np.int64), self.rank_of[known.drop_null().to_numpy()])]
        short = todo[length[todo] < LONG]
        parts = [(CONTRACT, short[i : i + WORDS]) for i in range(0, len(short), WORDS)] + [(CONTRACT_ALL, todo[[k]]) for k in np.flatnonzero((length[todo] >= LONG) & (length[todo] <= VERY_LONG))]
        for query, part in parts:
            n = length[part]
            w, token, pos = np.repeat(np.arange(len(part), dtype=np.int32), n), self.single[raw[spread(at[part], n)]], spread(np.zeros(len(part), np.int64), n).astype(np.int32)
            pair = np.flatnonzero(w[:-1] == w[1:])
            self.db.register("start_rows", pa.table({"w": w[pair], "pos": pos[pair], "l": token[pair], "r": token[pair + 1]}))
            ids = self.db.sql(query).to_arrow_table().combine_chunks()["ids"].chunk(0)
            found.append((part, pc.list_value_length(ids).to_numpy(), pc.list_flatten(ids).to_numpy()))
        for k in todo[length[todo] > VERY_LONG]:
            ids = self.contract_long(raw[at[k] : at[k + 1]].tobytes())
            found.append((np.array([k]), np.array([len(ids)]), np.array(ids, np.int32)))
        which, many, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(which)
        return many[order], ids[spread((np.cumsum(many) - many)[order], many[order])].astype(np.int32)

    def contract_long(self, word: bytes) -> list[int]:
        """A word's ids by the same contractions, one after another, from a heap of (rank, position)."""
        end = list(range(1, len(word) + 1))  # of the part that starts at a position
        before = list(range(-1, len(word) - 1))
        alive = [True] * len(word)

        def rank(i: int) -> int | None:
            j = end[i]
            return self.ranks.get(word[i : end[j]]) if j < len(word) else None

        heap = [(r, i, end[i], end[end[i]]) for i in range(len(word) - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, mid, stop = heapq.heappop(heap)
            if not alive[i] or end[i] != mid or mid >= len(word) or not alive[mid] or end[mid] != stop:
                continue
            alive[mid], end[i] = False, stop
            if stop < len(word):
                before[stop] = i
            for k in (before[i], i):
                if k >= 0 and (r := rank(k)) is not None:
                    heapq.heappush(heap, (r, k, end[k], end[end[k]]))
        ids, i = [], 0
        while i < len(word):
            ids.append(self.ranks[word[i : end[i]]])
            i = end[i]
        return ids

    def plain(self, text: str) -> bool:
        """Whether the text may be cut before each space: every space stands alone between two other characters, where every match ends."""
        return bool(text) and "\0" not in text and text.strip() == text and not any(w in text and (f" {w}" in text or f"{w} " in text) for w in SPACES)

    def pieces(self, text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct pieces, the code of each piece of the texts, and the number of pieces of each text."""
        arr = filled(text)
        told = arr.to_pylist()
        plain = np.array([self.plain(x) for x in told], bool)
        lists = pc.split_pattern(pc.replace_substring(arr.filter(pa.array(plain)), " ", "\0 "), "\0")
        odd = [self.pattern.findall(told[k]) for k in np.flatnonzero(~plain)]
        coded = pa.concat_arrays([pc.list_flatten(lists), pa.array(list(itertools.chain.from_iterable(odd)), pa.large_string())]).dictionary_encode()
        many = np.zeros(len(told), np.int64)
        many[plain], many[~plain] = pc.list_value_length(lists).to_numpy(), [len(x) for x in odd]
        # plain texts' pieces stand first: back to the order of the texts
        order, begin = np.argsort(~plain, kind="stable"), np.zeros(len(told), np.int64)
        begin[order] = np.cumsum(many[order]) - many[order]
        return coded.dictionary, coded.indices.to_numpy()[spread(begin, many)], many

    def words(self, text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct words, the code of each word of the texts, and the number of words of each text."""
        pieces, code, many = self.pieces(text)
        one = pc.match_substring_regex(pieces, ONE_WORD)
        single = one.to_numpy(zero_copy_only=False)
        rest = [self.pattern.findall(p) for p in pieces.filter(pc.invert(one)).to_pylist()]
        coded = pa.concat_arrays([pieces.filter(one), pa.array(list(itertools.chain.from_iterable(rest)), pa.large_string())]).dictionary_encode()
        n = np.ones(len(single), np.int64)
        n[~single] = [len(x) for x in rest]
        order, begin = np.argsort(~single, kind="stable"), np.zeros(len(single), np.int64)
        begin[order] = np.cumsum(n[order]) - n[order]
        of_text = np.diff(ends(n[code])[ends(many)])
        return coded.dictionary, coded.indices.to_numpy()[spread(begin[code], n[code])], of_text

    def encode(self, text: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Of each text its ids, its ids as decimal numbers joined by commas, and the bytes that its words' ids decode to."""
        words, code, many = self.words(text)
        size, ids = self.contract(words)
        said = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends(size)), pa.array(ids).cast(pa.large_string())), pa.scalar(",", pa.large_string()))
        at, rows, taken = ends(size), pa.array(ends(many)), pa.array(code)
        own = ids[spread(at[:-1][code], size[code])]
        by_text = lambda values, sep: pc.binary_join(pa.LargeListArray.from_arrays(rows, values.take(taken)), pa.scalar(sep, values.type))
        return pa.LargeListArray.from_arrays(pa.array(ends(size[code])[ends(many)]), pa.array(own)), by_text(said, ","), by_text(self.expand(ids, size), b"")

    def expand(self, ids: np.ndarray, size: np.ndarray) -> pa.Array:
        """The bytes of rows of ids, of `size` ids each."""
        if not len(ids):
            return pa.array([b""] * len(size), pa.large_binary())
        w = np.repeat(np.arange(len(size), dtype=np.int32), size)
        self.db.register("given_ids", pa.table({"w": w, "pos": spread(np.zeros(len(size), np.int64), size).astype(np.int32), "id": ids.astype(np.int32)}))
        found = self.db.sql(EXPAND).to_arrow_table().combine_chunks()
        joined = pc.binary_join(found["raw"].chunk(0), pa.scalar(b"", found["raw"].type.value_type)).cast(pa.large_binary())
        row = np.full(len(size), -1)
        row[found["w"].to_numpy()] = np.arange(len(joined))
        return pc.fill_null(joined.take(pa.array(row, mask=row < 0)), b"")


def coder(path: str, pattern: str) -> ByteBpe:
    """One coder for each rank file in a worker."""
    mine, key = kept_in_worker("byte_bpe"), (path, pattern)
    if key not in mine:
        mine[key] = ByteBpe(path, pattern)
    return mine[key]


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and ids (a list) of each row."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in gathered(batches, SLICE, "byte_bpe"):
            ids, _, _ = coder(path, pattern).encode(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids.cast(pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and the bytes of each row's ids (null ids: nothing)."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            lists = pc.fill_null(b.column("ids"), pa.scalar([], b.column("ids").type))
            raw = coder(path, pattern).expand(lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), raw.cast(pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of what they decode to: encode() and decode() without moving the ids between. A piece that
    many texts have is decoded once, as the bytes of ids in a row are the bytes of their parts in a row."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in gathered(batches, SLICE, "byte_bpe"):
            ids, said, back = coder(path, pattern).encode(b.column("text"))
            sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs.cast(pa.large_binary()).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pc.list_value_length(ids).cast(pa.int64()), sha(said), sha(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
