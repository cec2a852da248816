"""Line operators, as higher-order functions over the split text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import LINE_END


def split_lines(text: Column) -> Column:
    return F.split(text, LINE_END, -1)


def drop_lines(text: Column, prefixes: Iterable[str]) -> Column:
    """text without the lines that start with a prefix behind their indentation; the rest as they stand, joined by line feeds.

    The prefix "\\n" (also spelt as backslash and n) drops blank lines.
    """
    prefixes = [p.replace("\\n", "\n") for p in prefixes]
    starts, blank = [p for p in prefixes if p and p != "\n"], "\n" in prefixes
    if not starts and not blank:
        return text

    def kept(line: Column) -> Column:
        bare = F.regexp_replace(line, "^(?U:\\s)*\\x{feff}*", "")
        out = F.lit(True)
        for p in starts:
            out = out & ~bare.startswith(p)
        return out & (F.length(F.regexp_replace(bare, "(?U:\\s)+", "")) > 0) if blank else out

    return F.array_join(F.filter(split_lines(text), kept), "\n")


#: Info strings of fences whose lines are data, not code.
DATA_LANGUAGES = ("xml", "json", "yaml", "yml", "log", "txt", "csv", "md", "sql")


def fenced_code_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, line_no (from 0), line: the lines inside fences of source languages; of a text without any fence, all lines.

    Whether a line is inside is the parity of the fences above it: a running sum per document.
    """
    lines = docs.select(F.col(id_col), F.col(text_col).contains("```").alias("fenced"), F.posexplode(F.split(text_col, "\n", -1)).alias("line_no", "line"))
    order = Window.partitionBy(id_col).orderBy("line_no")
    fence = F.col("line").startswith("```")
    marked = lines.withColumn("fence", fence).withColumn("fences", F.sum(fence.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    opened = F.last(F.when(F.col("fence") & (F.col("fences") % 2 == 1), F.lower(F.trim(F.substring("line", 4, 1 << 20)))), True).over(order)
    source = ~F.col("fence") & (F.col("fences") % 2 == 1) & ~F.col("info").isin(*DATA_LANGUAGES)
    inside = marked.withColumn("info", opened).where(~F.col("fenced") | source)
    return inside.select(id_col, "line_no", "line")
