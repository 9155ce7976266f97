"""The training-corpus pipeline: STAGES over ``documents``, ``run`` for all.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``. All but the last return
the columns of documents; the last returns one row per packed piece, with its
token ids.

Documents rejected by the quality rules go, and common lines of a host leave
the text of the others; documents whose language is not told go; lines common
to the corpus leave the text; one document of each near-duplicate group stays;
what is left is packed into sequences. Nulls, empty tables, repeated rows and
extra columns have the results that the operators' docstrings state.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import language_id, line_dedup, packing, quality_rules, simhash
from tagloom.llm.common import fold, staged, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.clean(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_known(docs, language_id.train(docs.filter(fold("doc_id", 5) != 0)))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.clean(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(cut).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("simhash", near_duplicate_stage),
    ("packing", packing_stage),
]

#: SQL cannot express a trained network; tests hold each stage against a restatement.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
