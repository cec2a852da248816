"""The history of runs: (directory, arguments, last_run), the latest of each kind, newest first."""

from __future__ import annotations

import os
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "directory string, arguments array<string>, last_run timestamp"
KEPT = 50


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The history in a folder of JSON lines; none, or damaged lines, count as empty."""
    if not os.path.exists(path):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).json(path).where("directory IS NOT NULL")


def upsert(history: DataFrame, runs: DataFrame, kept: int = KEPT) -> DataFrame:
    """history with runs added: of equal directory and arguments the latest stays, of all the newest `kept`."""
    both = history.select("directory", "arguments", "last_run").unionByName(runs.select("directory", "arguments", "last_run"))
    latest = both.groupBy("directory", "arguments").agg(F.max("last_run").alias("last_run"))
    return latest.orderBy(F.col("last_run").desc(), "directory", F.to_json("arguments")).limit(kept)


def numbered(history: DataFrame) -> DataFrame:
    """history with its number in the list (from 1); it has few rows, so one partition orders them."""
    order = Window.partitionBy().orderBy(F.col("last_run").desc(), "directory", F.to_json("arguments"))
    return history.withColumn("number", F.row_number().over(order))


def record(spark: SparkSession, path: str, directory: str, arguments: list[str], when: datetime) -> None:
    """Adds a run to the history at path."""
    rows = upsert(read_history(spark, path), spark.createDataFrame([(directory, arguments, when)], SCHEMA)).collect()
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").json(path)


def existing(history: DataFrame) -> list:
    """The rows whose directory is still there, newest first."""
    return [r for r in history.orderBy(F.col("last_run").desc()).collect() if os.path.isdir(r.directory)]
