"""Helpers that the text operators share: scratch tables, bounded slices, words as codes, labelled samples."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a task holds as numpy arrays at once (one longer text makes a slice of its own).
SLICE_BYTES = 2 << 20
#: Bytes in an Arrow batch: the texts of a batch are in a Python worker's memory together.
BATCH_BYTES = 8 << 20

#: Bounds of a labelled sample: rows, values of the label, and characters of all its texts.
SAMPLE, MAX_LABELS, SAMPLE_CHARS = 20_000, 4096, 1 << 26
#: Removes the shuffle files of a query as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_dirs: dict[str, str] = {}
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir; where that is unset, a folder of our own on a local master, and an error on a cluster."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="spark-")
    return _own_dirs[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it again. Its shuffle files go once it is written."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """The number of scratch tables so far, for written()."""
    return len(_written)


def written(since: int) -> list[str]:
    return _written[since:]


def release(spark: SparkSession, paths: list[str], keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete scratch tables, but for those that `keep` reads. What still reads them must not run any more."""
    needed = {f.rsplit("/", 1)[0].rsplit("/", 1)[1] for df in keep for f in df.inputFiles()}
    for path in paths:
        if path in _written and path.rsplit("/", 1)[1] not in needed:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
            _written.remove(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, as whole texts go into it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


#: What operators keep in a Python worker from task to task, by operator.
_kept: dict[str, dict] = {}


def kept_in_worker(owner: str) -> dict:
    return _kept.setdefault(owner, {})


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES, owner: str = "") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows with at most `limit` bytes of text; a longer text stands alone. Workers go from one operator's
    tasks to another's: what others than `owner` have kept goes first."""
    for other in set(_kept) - {owner}:
        del _kept[other]
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, first = np.cumsum(size), 0
        while first < batch.num_rows:
            base = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(first, last - first)
            first = last


def gathered(batches: Iterator[pa.RecordBatch], limit: int, owner: str) -> Iterator[pa.RecordBatch]:
    """Arrow batches put together to `limit` bytes of text, and cut to that."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.column("text").nbytes
        if size >= limit:
            yield from slices([pa.concat_batches(held)], limit=limit, owner=owner)
            held, size = [], 0
    if held:
        yield from slices([pa.concat_batches(held)], limit=limit, owner=owner)


def kept_rows(docs: DataFrame, decide) -> DataFrame:
    """The rows of docs (all columns) for which decide(batch) is true."""
    small_batches(docs.sparkSession)

    def choose(batches):
        for b in slices(batches):
            yield b.filter(pa.array(decide(b), pa.bool_()))

    return docs.mapInArrow(choose, docs.schema)


def filled(text: pa.Array) -> pa.Array:
    """Large strings without nulls that begin at their buffer's start: some Arrow functions take a sliced array's bytes from the wrong place."""
    arr = pc.fill_null(text.cast(pa.large_string()), "")
    at = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    if not len(arr) or arr.buffers()[2] is None or (not at[0] and not arr.offset):
        return arr
    return pa.LargeStringArray.from_buffers(len(arr), pa.py_buffer(at - at[0]), arr.buffers()[2].slice(at[0], at[-1] - at[0]))


def utf8(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and the places where each text starts (one more at the end)."""
    arr = filled(text)
    at = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def words(text: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space: each word's code, the row of its text, and the words by code."""
    arr = filled(text)
    if lower:
        arr = pc.ascii_lower(arr)
    lists = pc.ascii_split_whitespace(arr)
    flat, row = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(full).dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), row.filter(full).to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def hashed(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, the same in every process."""
    if not len(values):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(values.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Recent:
    """A dictionary of at most two generations of about `size` entries: what the younger one lacks is taken over from the older or made anew."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def missing(self, keys) -> list:
        """Those of the keys that are in neither; all others are in `young` then, until the next call."""
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}
        new = set(keys).difference(self.young)
        self.young.update((k, self.old[k]) for k in new if k in self.old)
        return list(new.difference(self.young)) if self.old else list(new)


def bounds(row: np.ndarray, n: int) -> np.ndarray:
    """Where each of n rows starts in a sorted array of row numbers (one more at the end)."""
    return np.searchsorted(row, np.arange(n + 1))


def bucket(column: Column | str, n: int) -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % n, F.lit(-1))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, where: Column, per_class: int, max_chars: int) -> pd.DataFrame:
    """A bounded sample for fitting: for each value of `label`, the `per_class` rows of least hash whose text has 1 to `max_chars`
    characters; fewer of each where they would be more than `SAMPLE` rows or `SAMPLE_CHARS` characters together, but one at least. `labels` has doc_id
    and `label`; rows where either is null, or where `where` fails, are left out. More than `MAX_LABELS` values are an error. Of rows that
    share a doc_id, the one whose text has the least hash counts, and the least label.

    The rows of a label are counted by the size of their hashes, in steps of a twelfth of a power of two, which tells a bound under which just
    over `per_class` rows lie; only these are sorted."""
    ids = labels.select("doc_id", F.col(label).alias("label")).where(where & F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    short = docs.select("doc_id", F.length("text").alias("chars")).where(F.col("chars").between(1, max_chars)).select("doc_id")
    hashes = F.xxhash64("doc_id")
    share = hashes.cast("double") / F.lit(2.0**64) + F.lit(0.5)
    step = F.floor(F.lit(-12.0) * F.log2(F.greatest(share, F.lit(2.0**-64)))).cast("int")
    found = materialize(ids.join(short, "doc_id", "left_semi").withColumn("step", step), "labelled")
    steps = found.groupBy("label", "step").agg(F.count("*").alias("n"))
    values = [r["label"] for r in steps.select("label").distinct().limit(MAX_LABELS + 1).collect()]
    if len(values) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} values of {label}")
    per_class = max(1, min(per_class, SAMPLE // max(1, len(values))))
    below = F.sum("n").over(Window.partitionBy("label").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1))
    # a row for each label
    least = steps.withColumn("below", F.coalesce(below, F.lit(0))).where(F.col("below") < per_class).groupBy("label").agg(F.min("step").alias("least"))
    near = found.join(F.broadcast(least), "label").where("step >= least").select("doc_id", "label")
    order = Window.partitionBy("label").orderBy(hashes, "doc_id")
    chosen = near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_class).select("doc_id", "label")
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    # SAMPLE rows at most, or one for each label
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "label")).alias("row")
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(one).select("doc_id", "row.text", "row.label")
    rows = rows.withColumns({"nth": F.row_number().over(order), "chars": F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    rows = rows.where((F.col("nth") == 1) | (F.col("chars") <= SAMPLE_CHARS // max(1, len(values))))
    return rows.drop("nth", "chars").orderBy(hashes, "doc_id").toPandas()
