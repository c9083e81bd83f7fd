"""Exact top-k search by the threshold algorithm over sorted per-dimension lists.

Candidates and queries are dealt into blocks by hash, and every pair of a candidate block and a query block is one group. In it, each dimension
has its candidates sorted by component; a query reads all lists from their better ends in rounds, scores what it has not met, and stops
when no unread candidate can beat its kth score: the bound is the inner product of the query with the components last read. The groups'
results are merged by rank.

Scores and bounds are whole numbers, exact at any size: doubles where all products fit 53 bits, longs up to 62, Python's numbers beyond.

Defined results: a vector that is null, or holds a null or non-finite component, takes no part; a repeated row is a candidate each time, and is
asked once; rows that share a vec_id but not the vector are queries and candidates of their own, and none is a candidate of its own id; a
vector only meets those of its length; ties go to the smaller vec_id. Empty tables give an empty result; other columns are ignored. A score
that does not fit a long is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import materialize, small_batches, table

K = 5
#: Rows of a candidate block and of a query block.
CANDIDATES, QUERIES = 8192, 1024
FIRST_DEPTH = 32


class SortedLists:
    """The candidates of one block, sorted in every dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").T.copy()
        self.values = np.sort(vectors, axis=0).T.copy()

    def top(self, own: int, query: np.ndarray, k: int) -> np.ndarray:
        """Places of the k best candidates, best first."""
        n, dims = self.vectors.shape
        rising = query < 0  # a negative weight is best served by the smallest components
        use = np.flatnonzero(query)
        seen, scores, met, depth, read = self.ids == own, np.zeros(n, self.vectors.dtype), np.zeros(0, int), FIRST_DEPTH, 0
        while True:
            depth = min(depth, n)
            # sorted access: from `read` to `depth` in each list that matters
            found = [self.order[use[rising[use]], read:depth].ravel(), self.order[use[~rising[use]], n - depth : n - read].ravel()]
            new = np.unique(np.concatenate(found)) if len(use) else np.arange(n)
            new = new[~seen[new]]
            seen[new] = True
            scores[new] = self.vectors[new] @ query  # random access
            met = np.concatenate([met, new])
            if len(met) > k:
                kth = np.sort(scores[met])[-k]
                met = met[scores[met] >= kth]
            if seen.all() or depth == n:
                break
            if len(met) >= k:
                last = np.where(rising, self.values[:, depth - 1], self.values[:, n - depth])
                if scores[met].min() > last @ query:  # an equal score could still go to a smaller id
                    break
            read, depth = depth, 2 * depth
        return met[np.lexsort((self.ids[met], -scores[met]))][:k]


def first_copies(ids: np.ndarray, vectors: np.ndarray, keep: int) -> np.ndarray:
    """Of equal vectors, the rows of the `keep` smallest ids: others can't be among a query's best."""
    _, which = np.unique(vectors, axis=0, return_inverse=True)
    order = np.lexsort((ids, which.ravel()))
    sorted_which = which.ravel()[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_which, sorted_which) < keep]


def exact_dtype(a: np.ndarray, b: np.ndarray):
    """The fastest type in which the inner products of two sets of whole numbers are exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[-1])
    return float if most < 2.0**53 else np.int64 if most < 2.0**62 and max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) < 2.0**62 else object


def as_type(x: np.ndarray, kind) -> np.ndarray:
    return np.vectorize(int, otypes=[object])(x) if kind is object and x.size else x.astype(kind)


def matrix(t: pa.Table) -> np.ndarray:
    """The vectors of a table, which are of one length, as rows of doubles."""
    flat = pc.list_flatten(t.column("v").combine_chunks())
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(t.num_rows, len(flat) // t.num_rows)


def search_block(cands: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    out = {"query_id": [], "query_key": [], "vec_id": [], "score": []}
    if cands.num_rows and queries.num_rows:
        ids, vectors, asked = cands.column("vec_id").to_numpy(), matrix(cands), matrix(queries)
        kind = exact_dtype(vectors, asked)
        pick = first_copies(ids, vectors, k + 1)
        lists, copies = SortedLists(ids[pick], as_type(vectors[pick], kind)), np.minimum(cands.column("copies").to_numpy()[pick], k).tolist()
        for own, key, q in zip(queries.column("vec_id").to_pylist(), queries.column("key").to_pylist(), as_type(asked, kind), strict=True):
            for p in lists.top(own, q, k):
                for name, value in zip(out, (own, key, int(lists.ids[p]), int(lists.vectors[p] @ q)), strict=True):
                    out[name] += [value] * copies[p]
    return pa.table({name: pa.array(x, pa.int64()) for name, x in out.items()})


def search(vectors: DataFrame, is_query, k: int = K, scale: int = 256, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score of the k best other rows for each row where `is_query` holds, over floor(scale * component)."""
    small_batches(vectors.sparkSession)
    # floor() gives a long; a double of 2^53 and more is a whole number already
    floor = lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)
    whole = F.transform("embedding", lambda x: floor(F.lit(scale) * x.cast("double")))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & good).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.groupBy("vec_id", "v", "asks").agg(F.count("*").alias("copies"))
    rows = materialize(rows.withColumns({"key": F.xxhash64("vec_id", "v"), "size": F.size("v")}), "vectors")
    counts = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("asks").cast("int")), F.lit(0)).alias("q")).first()
    n_c, n_q = max(1, -(-counts["n"] // candidates)), max(1, -(-counts["q"] // queries))
    spread = lambda n: F.pmod(F.col("key"), F.lit(n).cast("long"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    cands = rows.select("size", spread(n_c).alias("c"), every(n_q).alias("q"), "vec_id", "copies", "v")
    asked = rows.where("asks").select("size", every(n_c).alias("c"), spread(n_q).alias("q"), "vec_id", "key", "v")
    by = ["size", "c", "q"]
    best = cands.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(lambda a, b: search_block(a, b, k), "query_id long, query_key long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE = {
    "op4_exact_topk": """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM (SELECT DISTINCT vec_id, v FROM v) q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
}
