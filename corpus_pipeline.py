"""Corpus pipeline: language ID, near duplicates, repeated passages, benchmark leaks, packing.

``run`` applies the stages in order; each one's rows are written as Parquet in the shared folder and read again, and those
of the stage before are deleted then.

All stages but the last return the columns of their input, further ones with any names included.  Null and empty texts go
in the first stage, very long ones are read whole; repeated rows and equal texts are left with the smallest id in the second
(rows of one id together); a row that loses all its words goes in the third.  An empty table passes all stages as such.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logmill.llm import common, decontamination, language_mixture, near_copies, packing, substring_dedup

#: A document goes if it has no letter or no language has this share of it.
LEAST_LANGUAGE_SHARE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_mixture.identify(docs, language_mixture.fit(docs), min_share=LEAST_LANGUAGE_SHARE)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, common.table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The stages learn a model, follow links to their end and pack greedily, none of which SQL expresses; tests/llm holds
#: them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        rows, path = common.materialise(stage(spark, rows, sf_dir), f"pipeline-{name}")
        if before:  # the rows that the stage has read
            common.remove(spark, before)
        before = path
    return rows
