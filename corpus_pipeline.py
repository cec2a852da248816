"""A training corpus out of the documents table, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; its result is written as Parquet and
read again as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillpack.llm import common, jaccard_join, line_dedup, mixing, packing, quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def grade_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are good (grade 1 or more) with a chance of a half at least. Rejected: junk, NULL and empty texts.

    Repeated rows are judged alike; a NULL id is carried; very long texts are judged whole; further columns go.
    """
    labels = spark.read.parquet(os.path.join(sf_dir, "labels.parquet"))
    model = quality.fit(docs, quality.graded(labels))
    return _columns(quality.grade(docs, model).where("keep"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each line stays only where it first occurs in the corpus; documents left without any go. n_chars follows the text.

    NULL and empty texts have no line to keep and go; of repeated rows one stays; a NULL id is an id of its own; further columns go.
    """
    return _columns(line_dedup.apply_bitmaps(docs).withColumn("n_chars", F.length("text").cast("long")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the least id.

    Rows with a NULL id or text, or without words, stay; of repeated rows one stays; further columns go.
    """
    return _columns(jaccard_join.keep_one(docs))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that fill every source's token budget: mixing.SHARE of all tokens, by weights n ** 0.7 of sources of n tokens.

    NULL and empty texts have no tokens and go; a NULL source is one of its own; a small source gives all it has; repeated rows are documents each; further columns go.
    """
    return _columns(mixing.select_mix(docs, share=mixing.SHARE))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document, or piece of one, goes: pack_group and seq, with its tokens and cost.

    NULL and empty texts have no tokens and no place; repeated rows are documents each; a NULL id is carried; a text above a sequence's capacity is
    cut into pieces; further columns are ignored.
    """
    return packing.pack_balanced(docs)


STAGES = [
    ("quality classifier", grade_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources to target weights", mix_to_weights),
    ("packing", pack_sequences),
]

#: A trained classifier, an approximate join and a dynamic programme can't be put in SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents table in sf_dir."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    folder = f"{common.ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        # What this stage read is of no more use; the last stage's rows are the result and stay.
        common.drop_stored(spark)
        if k:
            common.remove(spark, f"{folder}/{k - 1}")
    return docs
