"""File rows out of tables of texts."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rows import file_rows

EXTENSIONS = ("cs", "py", "js", "md", "json", "sql", "txt", "html")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


#: Bytes of input a core below which rows are spread before sequential work on each text.
SMALL = 64 << 20


def spread(rows: DataFrame, small: int = SMALL) -> DataFrame:
    """rows over all cores, if their input is small: such a table often is one row group and so one task.

    A larger input has splits enough, and is not moved.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < small * cores else rows


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as source/lang/doc<id>.<ext>, the extension by id in turn."""
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % len(EXTENSIONS) + 1).cast("int"))
    path = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc"), F.col("doc_id").cast("string"), F.lit("."), ext)
    return file_rows(table(spark, sf_dir, "documents"), path, F.col("doc_id"), F.col("text"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages under their address without scheme and query, as .html."""
    path = F.concat(F.regexp_replace("url", "^[a-z]+://|[?#].*$", ""), F.lit(".html"))
    return file_rows(table(spark, sf_dir, "pages"), path, F.col("page_id"), F.col("html"))


def conversation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as repositories with one file per turn."""
    path = F.concat(F.col("turn").cast("string"), F.lit("_"), F.col("role"), F.lit(".md"))
    return file_rows(table(spark, sf_dir, "conversations"), path, F.col("conv_id") * 1000 + F.col("turn"), F.col("text"), repo=F.concat(F.lit("conv"), F.col("conv_id").cast("string")))
