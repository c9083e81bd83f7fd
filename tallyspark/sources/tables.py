"""Readers of landed files with explicit schemas, and sinks. A path with no file gives an empty table, a file that does not parse no rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_own: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path under spark.checkpoint.dir, which driver and executors share; a temporary one on a local master that has none set."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = _own.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="spark-")
        _own[spark.sparkContext.applicationId] = shared
    return f"{shared}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in a scratch folder and read again: what follows is planned from there, and a lost executor costs no more than it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _or_empty(spark: SparkSession, read, schema: T.StructType) -> DataFrame:
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def csv_or_empty(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of CSV files with a header. Columns are found by name; those that a file lacks are null."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    def read() -> DataFrame:
        found = spark.read.option("header", True).csv(path)  # all as text: no values are inferred, so leading zeros stay
        at = {c: F.col(f"`{c}`") for c in found.columns}
        return found.select(*(at.get(f.name, F.lit(None)).try_cast(f.dataType).alias(f.name) for f in schema))

    return _or_empty(spark, read, schema)


def json_or_empty(spark: SparkSession, path: str, schema: T.StructType | str, *folders: str) -> DataFrame:
    """Documents of JSON files, one a file; `folders` names the columns that subfolders such as `prop_type=points` give."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    whole = T.StructType([*schema.fields, *(T.StructField(c, T.StringType()) for c in folders)])
    return _or_empty(spark, lambda: spark.read.schema(whole).option("multiLine", True).option("mode", "DROPMALFORMED").json(path), whole)


RESULT_SETS = "resultSets array<struct<name: string, headers: array<string>, rowSet: array<array<string>>>>"


def result_set(spark: SparkSession, path: str, columns: dict[str, str], *folders: str) -> DataFrame:
    """Landed {resultSets: [{headers: [...], rowSet: [[...]]}]}: the first set's rows as named columns, cast as given; missing ones are null."""
    rows = json_or_empty(spark, path, RESULT_SETS, *folders).select(*folders, F.col("resultSets")[0].alias("s")).select(*folders, "s.headers", F.explode("s.rowSet").alias("r"))
    at = lambda c: F.array_position("headers", c)
    return rows.select(*folders, *(F.when(at(c) > 0, F.try_element_at("r", at(c).cast("int"))).try_cast(kind).alias(c) for c, kind in columns.items()))


def positional(rows: DataFrame, column: str, names: list[str], kinds: dict[str, str], default: str = "double") -> DataFrame:
    """An array's elements as columns by their place; rows of another length are left out."""
    kept = rows.where(F.size(column) == len(names))
    return kept.select(*(F.try_element_at(column, F.lit(k + 1)).try_cast(kinds.get(c, default)).alias(c) for k, c in enumerate(names)))


def view(df: DataFrame, name: str) -> DataFrame:
    """df under a name that SQL can read."""
    df.createOrReplaceTempView(name)
    return df


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header, in place of what was there."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One document a row, nulls kept."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)
