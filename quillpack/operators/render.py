"""Rendering: each file a section of Markdown, in order, under a limit, with the list of files behind."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.minify import minify_udf
from ..functions.tokens import token_estimate
from ..model import Settings
from .lines import drop_lines

#: Bytes of files in one part of a document in parts, but for a single larger file.
PART = 64 << 20


def path_order() -> list[Column]:
    """By path without regard to case, then as discovered."""
    return [F.upper("display"), F.col("ord"), F.col("display")]


def with_body(rows: DataFrame, prefixes: Iterable[str] = (), brain: bool = False) -> DataFrame:
    """rows with body: content as it is shown. Lines are dropped first, then the rest is minified; else only its end is trimmed."""
    prefixes = list(prefixes)
    shown = F.when(F.col("status") == "ok", F.col("content"))
    if prefixes:
        shown = drop_lines(shown, prefixes)
    if brain:
        return rows.withColumn("body", minify_udf(shown, F.col("language")))
    return rows.withColumn("body", shown if prefixes else X.trim_end(shown))


def with_section(rows: DataFrame, settings: Settings = Settings(), changed: bool = False) -> DataFrame:
    """rows with section (the text of the file in the document), section_bytes and section_tokens.

    changed: the bodies are not as read (minified or with lines dropped), and an empty line follows them. The
    fence is longer than any in the raw content. Files that can't be shown have one line that says why.
    """
    shown = X.printable(F.col("display"))
    header = F.replace(F.lit(settings.header), F.lit("{path}"), shown)
    fence = X.fence_for(F.coalesce("content", F.lit("")))
    body = F.when(F.col("body") != "", F.concat(F.col("body"), F.lit("\n\n" if changed else "\n"))).otherwise(F.lit(""))
    file = F.concat(header, F.lit("\n"), fence, F.coalesce("language", F.lit("")), F.lit("\n"), body, fence, F.lit("\n\n"))

    def note(text: str) -> Column:
        return F.concat(F.lit(f"[{text}: "), shown, F.lit("]\n"))

    section = (
        F.when(F.col("status") == "ok", file).when(F.col("status") == "marker", F.concat(F.coalesce("content", F.lit("")), F.lit("\n\n"))).when(F.col("status") == "oversize", note("File too large"))
        .when(F.col("status") == "binary", note("Skipping binary file")).when(F.col("status") == "content_filtered", note("Skipped by content filter")).otherwise(note("Error reading file"))
    )
    return rows.withColumn("section", section).withColumn("section_bytes", F.octet_length("section").cast("long")).withColumn("section_tokens", token_estimate(F.col("section")))


def running_bytes(rows: DataFrame, order: list[Column], partition: str | None = None) -> DataFrame:
    """rows with running_bytes: the bytes of shown files up to and with each. With partition (a shard) per partition and in parallel."""
    counted = F.when(F.col("status") == "ok", F.col("section_bytes")).otherwise(F.lit(0).cast("long"))
    window = (Window.partitionBy(partition) if partition else Window.partitionBy()).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running_bytes", F.sum(counted).over(window))


def check_output_size(rows: DataFrame, limit: int) -> DataFrame:
    """rows, with an error as soon as they are computed if the shown files have more bytes than limit in all.

    The total is one partial aggregate per task: no ordered pass over the corpus is needed to know that it is exceeded.
    """
    total = rows.agg(F.sum(F.when(F.col("status") == "ok", F.col("section_bytes")).otherwise(0)).alias("__total"))
    checked = total.select(F.when(F.col("__total") > limit, F.raise_error(F.concat(F.lit(f"the output exceeds {limit} bytes: "), F.col("__total").cast("string")))).otherwise(F.lit(True)).alias("__ok"))
    return rows.crossJoin(F.broadcast(checked)).where(F.coalesce("__ok", F.lit(True))).drop("__ok")


def structure(rows: DataFrame, settings: Settings = Settings(), order: list[Column] | None = None, by: list[str] | None = None) -> DataFrame:
    """The list of shown files as one text (per value of the columns by)."""
    order = order or path_order()
    keys = [c.alias(f"k{i}") for i, c in enumerate(order)]
    listed = rows.where("status = 'ok'").select(*(by or []), F.struct(*keys, X.printable(F.col("display")).alias("shown")).alias("s"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: F.concat(s["shown"], F.lit("\n"))), "")
    return listed.groupBy(*(by or [])).agg(F.concat(F.lit(f"{settings.structure_header}\n{settings.fence}text\n"), lines, F.lit(f"{settings.fence}\n\n")).alias("structure"))


def document(rows: DataFrame, settings: Settings = Settings(), order: list[Column] | None = None, by: list[str] | None = None) -> DataFrame:
    """The packed document, one row (per value of by, such as shard_id): sections in order and the list of files.

    A document is one value, so it must fit an executor: pack large corpora by shard.
    """
    order = order or path_order()
    keys = [c.alias(f"k{i}") for i, c in enumerate(order)]
    parts = rows.select(*(by or []), F.struct(*keys, F.col("section").alias("section")).alias("s"))
    body = parts.groupBy(*(by or [])).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["section"]), "").alias("sections"))
    foot = structure(rows, settings, order, by)
    joined = body.join(foot, by, "left") if by else body.crossJoin(foot)
    return joined.select(*(by or []), F.concat("sections", F.coalesce("structure", F.lit(""))).alias("document"))


def document_parts(rows: DataFrame, by: str, settings: Settings = Settings(), order: list[Column] | None = None, most: int = PART) -> DataFrame:
    """by, part, parts, document: the documents of document(), those of more than `most` bytes of files in parts; joined by part they are the same.

    One task orders the names and sizes of a document's files to find where its parts start, another its list of files; a section goes to the task of its part.
    """
    order = order or path_order()
    keys = [c.alias(f"k{i}") for i, c in enumerate(order)]
    weight = F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)) + F.octet_length(F.coalesce("display", F.lit("")))
    sizes = rows.select(F.col(by), *keys, weight.cast("long").alias("weight"))
    named = [F.col(f"k{i}") for i in range(len(order))]
    before = F.coalesce(F.sum("weight").over(Window.partitionBy(by).orderBy(*named).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = sizes.withColumn("part", F.floor(before / most)).groupBy(by, "part").agg(F.min(F.struct(*named)).alias("first"))
    starts = firsts.groupBy(F.col(by).alias("__by")).agg(F.array_sort(F.collect_set("first")).alias("__starts"))
    # A hundred bytes for each part; a join by shuffle would bring all texts of a document together.
    placed = rows.join(F.broadcast(starts), F.col(by).eqNullSafe(F.col("__by")))
    parts, key = F.size("__starts"), F.struct(*keys)
    part = F.when(parts == 1, F.lit(1)).otherwise(F.size(F.filter("__starts", lambda s: s <= key)))
    placed = placed.select(F.col(by), parts.alias("parts"), part.alias("part"), key.alias("key"), "section", "status", X.printable(F.col("display")).alias("shown"))

    def joined(of: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(of)), lambda s: s["text"]), "")

    sections = placed.select(by, "parts", "part", F.struct(F.lit(0).alias("foot"), "key", F.col("section").alias("text")).alias("s"))
    lists = placed.where("status = 'ok'").groupBy(by, "parts", "part").agg(joined(F.struct("key", F.concat("shown", F.lit("\n")).alias("text"))).alias("text"))
    listed = lists.groupBy(by, "parts").agg(joined(F.struct("part", "text")).alias("text")).where(F.col(by).isNotNull())  # as document(), whose join has none for NULL
    foot = F.concat(F.lit(f"{settings.structure_header}\n{settings.fence}text\n"), F.col("text"), F.lit(f"{settings.fence}\n\n"))
    none = F.lit(None).cast(sections.schema["s"].dataType["key"].dataType)
    feet = listed.select(by, "parts", F.col("parts").alias("part"), F.struct(F.lit(1).alias("foot"), none.alias("key"), foot.alias("text")).alias("s"))
    return sections.union(feet).groupBy(by, "part", "parts").agg(joined(F.col("s")).alias("document"))


def totals(rows: DataFrame) -> DataFrame:
    """files, shown, bytes and tokens of all sections (placeholders count as bytes, not as files shown)."""
    ok = F.col("status") == "ok"
    return rows.agg(
        F.count_if(F.col("kind") == "file").alias("files"), F.count_if(ok).alias("shown"), F.coalesce(F.sum("section_bytes"), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum(F.when(ok, F.col("section_tokens"))), F.lit(0)).alias("tokens"),
    )
