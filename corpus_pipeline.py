"""Cleaning pipeline over documents: quality, line dedup, near-duplicates, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from arborlake.llm import line_dedup, mixing, packing, quality, simhash
from arborlake.session import materialise, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are scored like any other (all statistics 0); null ids
    and repeated rows stay or go by their own text; without labels all stay.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on over a twentieth of a source's documents go; n_chars is that of what is left.

    Null texts stay null and have a null n_chars; every row stays, repeated
    ones too; a null source is a source of its own.
    """
    clean = line_dedup.drop_boilerplate(docs).drop("n_lines", "n_dropped")
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the least id.

    Texts without words (null, empty, blank) are one group. Of repeated rows
    one stays; rows with a null id all stay, as they cannot represent a group.
    """
    return simhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row comes as many times as the mix takes its words, to the nearest whole; none at 0.

    Rows without words (null, empty, blank) are never taken and go. Rows of one
    id, of null ids and repeated rows have shares of their own.
    """
    return mixing.resample(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece's place in the training sequences; a null or empty text is its end alone, repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("simhash", simhash_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: The classifier, the fingerprints and the tokenizer are beyond SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each to what the one before it wrote."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, name)
    return docs
