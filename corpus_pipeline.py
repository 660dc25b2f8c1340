"""A training-data pipeline over `documents`: five stages, each written as Parquet and read again by the next.

Stages keep whole rows, extra columns included, but for the last. Null ids are kept like others; null and empty texts go with
the first stage, as they have no letter. Repeated rows and ties are settled as each stage's operator says. Very long texts
are read whole. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm import langid, packing, quality, secrets, simhash
from pixelloom.llm._common import mark, stored, sweep, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an identified language; what has no letter or lies between two languages goes."""
    return langid.keep_identified(docs, langid.fit(docs))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label quality model accepts."""
    return quality.keep_good(docs, quality.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one of smallest doc_id."""
    return simhash.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; n_chars, where there is one, follows the text."""
    clean = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces, packed into sequences of at most 2048."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: The stages are trained models, searches and a plan, which SQL can't express; tests/llm/test_pipeline.py checks each against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what stages have written on the way is deleted as soon as the next one is done."""
    docs, begin = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        sweep(begin, docs)
    return docs
