"""The feed as JSON files: arrays of documents, written in one commit with what the run has to say of them, and read back with a fixed schema."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.operators.feed import COMBOS, PRICE
from tallyspark.sources.stats import LOG, MEASURES

ZONES = "map<string, struct<percentage: string, makes: string>>"
GAME = ", ".join([LOG, "DATE_STR string", *(f"{c} double" for cols in MEASURES.values() for c in cols), *(f"`{c}` double" for c in COMBOS)])
FEED = f"id bigint, name string, team string, stats map<string, double>, game_log array<struct<{GAME}>>, shooting_zones {ZONES}, assist_zones {ZONES}, props map<string, map<string, {PRICE}>>"


def write_arrays(docs: DataFrame, path: str, files: int = 200, key: str = "id", totals: dict[str, Column] | None = None) -> dict:
    """Write documents as at most `files` files, each one JSON array (nulls kept), in place of what was there; a failed run leaves nothing to be
    read. Returns `rows` and the totals (aggregates over docs' columns), which the run that writes has counted on its way."""
    seen = Observation()
    watched = docs.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in (totals or {}).items()))
    said = watched.select(F.pmod(F.xxhash64(key), F.lit(files)).alias("file"), F.col(key).alias("key"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("doc"))
    arrays = said.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("key", "doc"))).alias("docs"))
    text = F.concat(F.lit("["), F.array_join(F.transform("docs", lambda d: d["doc"]), ",\n"), F.lit("]"))
    arrays.select(text.alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
    return seen.get


def read_arrays(spark: SparkSession, path: str, schema: str = FEED) -> DataFrame:
    """The documents of all files that hold a JSON array. A missing path, a file that does not parse and one that holds something else give none."""
    try:
        files = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], T.StructType.fromDDL(schema))
    arrays = files.where(F.startswith(F.ltrim("value"), F.lit("["))).select(F.from_json("value", f"array<struct<{schema}>>").alias("docs"))
    return arrays.select(F.inline("docs"))
