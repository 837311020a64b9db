"""The corpus pipeline: five stages from raw documents to packed sequences.

Every stage is a function of ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from dossier.llm import common, decontam, langid, linededup, minhash, packing, simhash
from dossier.session import CLEANUP, shuffles_removed  # noqa: F401, CLEANUP names the setting


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from the labelled rows of the corpus itself; the rest go."""
    model = langid.fit(docs.where(langid.training_rows(docs)))
    return langid.keep_identified(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many documents of their source share, copies and verified near copies counted as one."""
    with shuffles_removed(spark):
        cleaned = linededup.drop_lines(docs, host="source", near=True)
    return linededup.recount(cleaned, "text", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash fingerprints within three bits, or a Jaccard similarity of 0.8 or more
    over five-word shingles; links of both kinds connect a group."""
    with shuffles_removed(spark):
        return minhash.keep_one(docs, linked=simhash.groups(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no notable part of a benchmark."""
    return decontam.remove(docs, common.table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    return packing.pack(common.materialise(packing.tokenise(docs, with_ids=False)))


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sequences", sequences),
]

# Parsing by automata, hashing of shingles and byte-pair encoding have no SQL form; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the stages' tables stand in the shared folder while the result is read."""
    common.ensure_shared(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = common.table(spark, sf_dir, "documents")
    with shuffles_removed(spark):
        for name, stage in STAGES:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    return docs
