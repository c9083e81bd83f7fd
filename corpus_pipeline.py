"""A corpus pipeline: language, toxicity, near duplicates, repeated passages, packing.

Each stage's result is written before the next stage begins, so a stage deletes what the one before it wrote on its way. All stages take an
empty table (an empty result), null and empty texts (no language: rejected by the first stage), repeated rows (one of them stays after the
third) and extra columns (kept, under their names, by all but the last). No stage cuts a text to a length.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import jaccard_join, language_id, packing, suffix_dedup, toxicity
from tallyspark.llm.common import mark, materialize, release, table, written


_on_the_way: list[str] = []


def stage(apply):
    """apply, after the scratch tables of the stage before are deleted."""

    @functools.wraps(apply)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _on_the_way, (docs,))
        since = mark()
        out = apply(spark, docs, sf_dir)
        _on_the_way[:] = written(since)
        return out

    return run_stage


@stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs whose language is told; a null text, or one without a letter, has none and goes."""
    return language_id.drop_unknown(docs)


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that are not predicted to be toxic, by a network fitted on the documents in `labels`; without labels all stay."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of Jaccard similarity 0.75 or more hold together: the one of least doc_id, null last."""
    return jaccard_join.one_of_each(docs)


@stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from the texts; every document stays, with n_chars of what is left."""
    left = suffix_dedup.dedup(docs, keep_text=True)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens; a null or empty text is its end token alone."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", identify_language), ("toxicity", drop_toxic), ("jaccard_join", drop_near_duplicates), ("suffix_dedup", cut_repeats), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet and read again as the next one's docs."""
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = materialize(apply(spark, docs, sf_dir), f"stage-{name}")
    return docs
