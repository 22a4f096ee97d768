"""A corpus from documents: rules, line dedup, near duplicates, mixing, packing; each stage is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from packetloom.llm import curve_packing, jaccard_join, line_crf, line_dedup, soft_mixing
from packetloom.llm.util import stash, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line labels keep."""
    return line_crf.keep(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document holds; n_chars follows."""
    return line_dedup.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component."""
    return jaccard_join.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the rates of their domains say; at least once, and before the common scale at most 64 times."""
    return soft_mixing.mix(docs, table(spark, sf_dir, "labels"), most=64, fewest=1)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 ids."""
    return curve_packing.digest(curve_packing.pack(docs, curve_packing.vocabulary()))


STAGES = [("quality rules", rules), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("mixing", mixed), ("packing", packed)]
ORACLE_SQL = None  # labels by Viterbi, soft rates and tokenizer ids are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
