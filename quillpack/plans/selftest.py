"""Checks that an installation works, and how fast it is, on data made in memory."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.globs import glob_match
from ..functions.minify import minify
from ..functions.phrases import compress, expand
from ..functions.tokens import token_estimate
from ..operators import shard
from ..operators.rows import file_rows
from .pack import pack


def _files(spark: SparkSession, count: int, lines: int) -> DataFrame:
    line = F.concat(F.lit("var value = Repository.Load("), F.col("id").cast("string"), F.lit("); // note\n"))
    return file_rows(spark.range(count), F.concat(F.lit("src/m"), (F.col("id") % 7).cast("string"), F.lit("/f"), F.col("id").cast("string"), F.lit(".cs")), F.col("id"), F.repeat(line, lines))


def checks(spark: SparkSession) -> dict[str, Callable[[], bool]]:
    """What is checked, by name."""
    one = spark.range(1)
    text = "bucketCapacityMask = true; " * 15
    return {
        "globs": lambda: one.where(glob_match(F.lit("src/x/a.cs"), ["src/**/*.cs"])).count() == 1,
        "tokens": lambda: one.select(token_estimate(F.lit("public async Task<Result>"))).first()[0] == 6,
        "minifier": lambda: minify("int x = 5; // note") == "int x = 5;",
        "phrases": lambda: expand((done := compress(text)).output, done.legend) == text and done.replacements > 0,
        "packing": lambda: pack(_files(spark, 3, 2)).document.first().document.count("## File: ") == 3,
        "shards": lambda: shard.assign_shards(_files(spark, 20, 1), 3).select("shard_id").distinct().count() == 3,
    }


def self_test(spark: SparkSession) -> dict[str, str]:
    """'ok', 'wrong' or the error of each check."""
    out = {}
    for name, check in checks(spark).items():
        try:
            out[name] = "ok" if check() else "wrong"
        except Exception as e:  # one that fails must not keep the others from running
            out[name] = f"{type(e).__name__}: {e}"[:200]
    return out


def benchmark(spark: SparkSession, count: int = 1500, lines: int = 40, repeats: int = 3) -> dict[str, float]:
    """files, megabytes, seconds (the best of repeats) and megabytes a second of packing made files."""
    rows = _files(spark, count, lines)
    size = rows.agg(F.sum("size")).first()[0] / 1e6
    best = float("inf")
    for _ in range(repeats):
        began = time.perf_counter()
        pack(rows).rows.write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - began)
    return {"files": count, "megabytes": round(size, 3), "seconds": round(best, 3), "megabytes_per_second": round(size / best, 2)}
