"""Shared pieces of the training-data operators: input shaping, durable cuts of lineage, token counts."""

from __future__ import annotations

import base64
import os
import tempfile
import uuid
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Vocabulary of a public byte-level BPE; a parameter of every operator that counts tokens.
TOKENIZER = os.environ.get("QUILLPACK_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
_SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the one the cluster names. Where none is named: on a local master (as in tests) a temporary one, on a cluster an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(named)
        return named
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillpack-"))
    return sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder, so that a lost executor costs nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_stored: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """df, written once as Parquet in the shared folder and read again: unlike a checkpoint it is compressed, and columns that aren't needed aren't read."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stored.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever storage it is in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_stored(spark: SparkSession) -> None:
    """Deletes what stored wrote so far: for callers that have written or counted the results that were read from it."""
    while _stored:
        remove(spark, _stored.pop())


def unused(df: DataFrame, name: str) -> str:
    """A column name like name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(name: str = "text") -> Column:
    """The text column; NULL counts as an empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


@lru_cache(maxsize=4)
def encoding(path: str):
    """The BPE in a file of ranks (base64 token, space, rank); loaded once in a Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})


def token_lengths(path: str):
    """A pandas UDF that gives each text's exact number of tokens; an empty or NULL text has 0.

    The vocabulary is read where the driver runs and shipped to the executors, which need not have it.
    """
    spark = SparkSession.active()
    spark.sparkContext.addFile(path)
    name = os.path.basename(path)

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encode = encoding(SparkFiles.get(name)).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count
