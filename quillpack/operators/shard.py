"""Balanced shards: files of a module stay together where that fits, and the fullest go first to the emptiest shard."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import module_key


def assign_shards(rows: DataFrame, shards: int) -> DataFrame:
    """rows with shard_id (1 to shards).

    A module (first folder; with repo, within its repository) is placed as a whole if it has one file or at most 1.5 times the mean shard's bytes, else
    file by file. Units go by module size, then file size, descending, each to the shard with the fewest bytes, the first among equals.
    Only units (modules, or files of those that are split) pass through the one sequential fold: a stream through one task that holds
    the shards' loads and no unit. Files get their shard back by a join.
    """
    shards = max(1, shards)
    both = rows.where(F.col("kind") == "file") if "kind" in rows.columns else rows
    keyed = both.withColumn("__module", F.concat_ws("\x01", F.coalesce("repo", F.lit("")), F.upper(module_key(F.col("relative")))))
    modules = keyed.groupBy("__module").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("files"), F.min_by(module_key(F.col("relative")), "ord").alias("name"))
    total = modules.agg(F.sum("bytes").alias("all_bytes"))
    sized = modules.crossJoin(total).withColumn("whole", (F.col("files") == 1) | (F.col("bytes") <= (F.col("all_bytes") / shards * 1.5).cast("long")))
    whole = sized.where("whole").select("__module", "name", "bytes", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("long").alias("ord"), F.lit(None).cast("string").alias("relative"), F.col("bytes").alias("unit"))
    files = keyed.join(sized.where("NOT whole").select("__module", "name", "bytes"), "__module")
    order = Window.partitionBy("__module").orderBy(F.col("size").desc(), "ord", "relative")
    single = files.select("__module", "name", "bytes", F.row_number().over(order).cast("long").alias("pos"), "ord", "relative", F.col("size").alias("unit"))
    units = whole.unionByName(single)
    queue = units.select("__module", "pos", "ord", "relative", "unit", "bytes", "name").repartition(1).sortWithinPartitions(F.col("bytes").desc(), "name", "__module", "pos", "ord", "relative")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads = [(0, k) for k in range(1, shards + 1)]
        for batch in batches:
            picks = []
            for unit in batch.column(4).to_pylist():
                load, k = loads[0]
                heapq.heapreplace(loads, (load + (unit or 0), k))
                picks.append(k)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(picks, pa.int32())], names=["__module", "pos", "ord", "relative", "shard_id"])

    placed = queue.mapInArrow(place, "__module string, pos long, ord long, relative string, shard_id int")
    # A unit is a module (pos 0) or one file of it; a file takes the shard of whichever it belongs to.
    as_whole = keyed.join(placed.where("pos = 0").select("__module", "shard_id"), "__module")
    as_file = keyed.join(placed.where("pos > 0").select("__module", "ord", "relative", "shard_id"), ["__module", "ord", "relative"])
    return as_whole.unionByName(as_file, allowMissingColumns=True).select(*rows.columns, "shard_id")


def shard_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("shard_id").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def take_shard(assigned: DataFrame, slice: int) -> DataFrame:
    return assigned.where(F.col("shard_id") == slice).drop("shard_id")
