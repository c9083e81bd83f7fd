"""Landed JSON documents as they are: whole files, parsed into VARIANT where they parse, and kept aside where they don't."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a bad file that a quarantine row shows.
SHOWN = 200


def documents(spark: SparkSession, path: str, *folders: str) -> DataFrame:
    """file, folders (such as prop_type, from subfolders `prop_type=points`), text and doc, a VARIANT, of every file; doc is null where the file does
    not parse. A missing path has no rows."""
    names = T.StructType([T.StructField("value", T.StringType()), *(T.StructField(c, T.StringType()) for c in folders)])
    try:
        files = spark.read.schema(names).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), *folders, F.col("value").alias("text"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        files = spark.createDataFrame([], T.StructType([T.StructField("file", T.StringType()), *names.fields[1:], T.StructField("text", T.StringType())]))
    return files.withColumn("doc", F.try_parse_json("text"))


def good(docs: DataFrame, schema: str, *folders: str) -> DataFrame:
    """The documents that parse, as columns of a schema: what it does not name stays in doc, and a value of another type is null."""
    whole = F.try_variant_get("doc", "$", f"struct<{_typed(schema)}>")
    fields = [f.name for f in T.StructType.fromDDL(schema)]
    return docs.where("doc is not null").withColumn("d", F.coalesce(whole, F.from_json("text", schema))).select("file", *folders, *(F.col(f"d.{c}").alias(c) for c in fields), "doc")


def _typed(schema: str) -> str:
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in T.StructType.fromDDL(schema))


def quarantine(docs: DataFrame) -> DataFrame:
    """file, its length and its beginning, of the files that do not parse."""
    return docs.where("doc is null").select("file", F.coalesce(F.length("text"), F.lit(0)).alias("length"), F.left("text", F.lit(SHOWN)).alias("begins"))


def value(doc: Column | str, path: str, kind: str, default: object = None) -> Column:
    """What is at a path such as `$.a.b[0]` of a document, whether or not any schema names it; the default where nothing is, or of another type."""
    return F.coalesce(F.try_variant_get(doc, path, kind), F.lit(default).cast(kind))


def keys(docs: DataFrame, column: str = "doc") -> DataFrame:
    """key and files: the keys at the top of the documents, and how many have each, to find what a schema lacks."""
    each = docs.where(F.col(column).isNotNull()).select(F.map_keys(F.try_variant_get(column, "$", "map<string, variant>")).alias("keys"))
    return each.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("files"))


def counts(docs: DataFrame) -> DataFrame:
    """One row: files, those that parse and those that don't."""
    return docs.agg(F.count("*").alias("files"), F.count("doc").alias("good"), F.sum(F.col("doc").isNull().cast("long")).alias("bad"))


def merged(frames: Sequence[DataFrame]) -> DataFrame:
    """The rows of several landings in one, by name; columns that one lacks are null."""
    first, *rest = frames
    for f in rest:
        first = first.unionByName(f, allowMissingColumns=True)
    return first
