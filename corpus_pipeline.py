"""Corpus preparation in five stages, each written and read again.

1. language id: documents whose language is not recognised go.
2. near duplicates: the document with the smallest id of each SimHash group stays.
3. decontamination: documents that hold a benchmark item's template go.
4. secrets: every found span is replaced by a mark; no document goes.
5. mixing: documents get rates that bring the domains' token totals to their
   targets; those with at least one copy are returned with rate and copies.

Every stage works on all rows its predecessor kept and returns the columns of
``documents``; the last adds its own.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from marquee.llm import decontamination, langid, mixing, secrets, simhash  # noqa: E402
from marquee.llm.common import stored, table  # noqa: E402


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.recognised(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, table(spark, sf_dir, "labels"))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontaminate),
          ("secrets", redact_secrets), ("mixing", mix)]

#: The stages learn models and hash texts in ways SQL cannot express; tests/llm
#: holds them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
