"""A landing folder of texts as a stream of sections, and a ledger of what was packed before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Settings
from ..operators import content, filters, render
from ..operators.rows import file_rows


def landing_rows(spark: SparkSession, path: str, schema: T.StructType | str, name: str = "path", text: str = "content", **options) -> DataFrame:
    """File rows of Parquet files (name, text) as they land in a folder."""
    stream = spark.readStream.schema(schema).options(**options).parquet(path)
    return file_rows(stream, F.col(name), F.lit(0), F.col(text))


def stream_sections(rows: DataFrame, rules: filters.PathRules = filters.PathRules(), settings: Settings = Settings(), max_file_size: int = 1 << 20, brain: bool = False) -> DataFrame:
    """rows filtered and rendered, without state: what batch packing does before it puts sections in order."""
    kept = content.with_status(filters.filter_paths(rows, rules), max_file_size)
    return render.with_section(render.with_body(kept, brain=brain), settings, changed=brain)


def unseen(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """rows whose path and content are not in the ledger (path, sha2)."""
    keyed = rows.withColumn("__sha", F.sha2(F.coalesce("content", F.lit("")), 256))
    seen = ledger.select(F.col("path").alias("__p"), F.col("sha2").alias("__h"))
    return keyed.join(seen, (F.col("display") == F.col("__p")) & (F.col("__sha") == F.col("__h")), "left_anti").drop("__sha")


def ledger_rows(rows: DataFrame) -> DataFrame:
    """What a ledger keeps of rows that were packed."""
    return rows.select(F.col("display").alias("path"), F.sha2(F.coalesce("content", F.lit("")), 256).alias("sha2")).distinct()
