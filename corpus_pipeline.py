"""A corpus pipeline of five stages over documents: quality, exact dedup, near dedup, repeated strings, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Stages read what the one
before has written.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession

from assaylake.llm import exact_dedup, minhash, packing, quality, suffix_dedup
from assaylake.llm.common import stored, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose perplexity is beyond the quantile of trusted text of their language."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels").where("quality = 1"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of equal texts."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of each near-duplicate group."""
    return minhash.keep_one(docs)


#: Strings of this many bytes that start more than once are cut. A passage of over 50 words has 270 to 400 bytes here.
PASSAGE_BYTES = 200


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of PASSAGE_BYTES that start more than once; every document stays, an emptied one with an empty text."""
    return suffix_dedup.cut_text(docs, length=PASSAGE_BYTES)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of what is left into sequences."""
    return packing.pack_documents(docs)


STAGES = [("quality classifier", quality_filter), ("exact dedup", exact), ("minhash near-dedup", near), ("suffix-array dedup", repeats), ("best-fit packing", packed)]
#: Not expressible: the classifier's sample, the samples of near dedup and the packing are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, "pipeline")
    return docs
