"""The corpus pipeline: five stages, each of which reads what the one before has written.

Toxic documents go; of near duplicates one document stays; contaminated documents go and hit words of others are cut;
documents are repeated or left out so that sources come near their targets; what is left is written as token files and
read back. Each stage takes (spark, docs, sf_dir) and returns a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rivergraph.functions.scratch import drop_scratch, scratch_tables
from rivergraph.llm import decontaminate, mixing, neardup, tokens, toxicity
from rivergraph.llm.common import stored, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.encode_and_read(docs)


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontamination", contamination), ("mixing", mixture), ("tokens", token_files)]

#: The first stages' models and the tokenizer have no form in SQL; a test holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stage has written for itself goes when its result is stored; what came before run() stays."""
    docs, known = table(spark, sf_dir, "documents"), scratch_tables(spark)
    for _, stage in STAGES:
        found = stage(spark, docs, sf_dir)
        before = scratch_tables(spark)
        docs = stored(found)
        drop_scratch(spark, before - known)
    return docs
