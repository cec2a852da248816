"""A table of awkward documents, and helpers, for the tests of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

LONG = "lorem ipsum dolor sit amet consectetur " * 30_000


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows of (doc_id, text[, lang[, source]])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def awkward(spark: SparkSession) -> DataFrame:
    """NULLs in each column, an empty and a blank text, a very long one, ties and repeated rows."""
    return spark.createDataFrame(
        [
            (1, "alpha beta gamma delta\nsecond line here", "en", "a", 40),
            (1, "alpha beta gamma delta\nsecond line here", "en", "a", 40),
            (2, "", "en", "a", 0),
            (3, None, "en", "a", None),
            (None, "an id is missing from this row of words", "en", "a", None),
            (4, "tie one two three four", None, None, 22),
            (5, "tie one two three four", None, None, 22),
            (6, " \n ", "fr", "b", 3),
            (7, LONG, "fr", "b", len(LONG)),
            (8, "x" * 300_000, "fr", "b", 300_000),
            (1, "one id with another text altogether", "de", "b", 35),
            (9, "un été à la mer, ça va\nsecond line here", "fr", "b", 40),
        ],
        SCHEMA,
    )


def crowded(docs: DataFrame) -> DataFrame:
    """docs with columns whose names the operators use inside or return."""
    from pyspark.sql import functions as F

    out = docs
    for name in ("th", "h", "pos", "keep", "kept", "n_tokens", "p_toxic", "toxic", "rank", "sid", "sig", "grams", "label", "stratum", "entities", "rest", "__id", "__th", "__sid", "__rated", "_id", "y", "expected_grade", "p_tail", "license", "image_id", "seq", "piece"):
        out = out.withColumn(name, F.lit("clash"))
    return out


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def same(a: DataFrame, b: DataFrame) -> bool:
    def rows(df: DataFrame) -> list[str]:
        return sorted(str(sorted(r.asDict().items())) for r in df.collect())

    return rows(a) == rows(b)
