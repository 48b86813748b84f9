"""Document blocks into sections and section chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexicarta.functions.text import is_blank, markdown_table, preview, strip
from lexicarta.operators.packing import paragraph_groups

#: The styles that open a section.
HEADING_STYLES = ("Heading 1", "Heading 2", "Heading 3", "Heading 4", "Heading 5", "Heading 6", "Title", "Subtitle")
START, UNTITLED = "(Document Start)", "(Untitled Section)"
#: What stands for a picture that no model has seen.
PICTURE = "[picture]"


def heading_level(style: Column) -> Column:
    """N of ``Heading N``, 1 of a title, 2 of a subtitle, else 0."""
    number = F.regexp_extract(style, r"(\d+)$", 1)
    return F.when(style.contains("Heading"), F.coalesce(F.nullif(number, F.lit("")).cast("int"), F.lit(0))).when(style == "Title", 1).when(style == "Subtitle", 2).otherwise(0)


def sections(blocks: DataFrame) -> DataFrame:
    """Sections of each document, numbered from 0.

    ``blocks`` has ``source_file, idx, kind ('paragraph' or 'table'), style, text, cells, has_image``.
    A heading opens a section; what stands before the first forms ``(Document Start)``. Blank
    paragraphs are dropped, others kept as they are; pictures of blank paragraphs count, those in
    headings don't. A null style is no heading; a null text counts as blank. Columns: ``source_file, section, heading, heading_level, style_name,
    paragraphs, tables, image_count, has_lists``.
    """
    opens = (F.col("kind") == "paragraph") & F.coalesce(F.col("style").isin(*HEADING_STYLES), F.lit(False))
    order = Window.partitionBy("source_file").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    numbered = blocks.withColumn("_opens", opens).withColumn("_n", F.sum(F.col("_opens").cast("int")).over(order))
    body = ~F.col("_opens")
    plain = body & (F.col("kind") == "paragraph")
    filled = plain & F.coalesce(~is_blank(F.col("text")), F.lit(False))
    shown = strip(F.coalesce("text", F.lit("")))
    grouped = numbered.groupBy("source_file", "_n").agg(
        F.max(F.when(F.col("_opens"), F.when(shown == "", UNTITLED).otherwise(shown))).alias("heading"),
        F.max(F.when(F.col("_opens"), F.col("style"))).alias("style_name"),
        F.sort_array(F.collect_list(F.when(filled, F.struct("idx", "text")))).alias("_p"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == "table", F.struct("idx", "cells")))).alias("_t"),
        F.count_if(plain & F.coalesce(F.col("has_image"), F.lit(False))).alias("image_count"),
        F.coalesce(F.max(filled & F.col("style").startswith("List")), F.lit(False)).alias("has_lists"),
    )
    kept = grouped.where((F.col("_n") > 0) | (F.size("_p") > 0) | (F.size("_t") > 0) | (F.col("image_count") > 0))
    place = Window.partitionBy("source_file").orderBy("_n")
    return kept.select(
        "source_file", (F.row_number().over(place) - 1).alias("section"), F.coalesce("heading", F.lit(START)).alias("heading"),
        F.coalesce(heading_level(F.col("style_name")), F.lit(0)).alias("heading_level"), F.coalesce("style_name", F.lit("Normal")).alias("style_name"),
        F.transform("_p", lambda p: p["text"]).alias("paragraphs"), F.transform("_t", lambda t: t["cells"]).alias("tables"), "image_count", "has_lists",
    )


def section_chunks(found: DataFrame, most: int = 1000, picture: Callable[[Column], Column] = lambda n: F.lit(None).cast("string")) -> DataFrame:
    """Text, table and picture chunks of each section, numbered per document.

    A section's paragraphs are packed to ``most``; the first text chunk carries the heading, table and
    picture chunks always do. ``picture`` gives what a vision model says of a section's picture by its place from 0, for
    instance an element of a column that a model filled; where it is null, ``PICTURE`` stands. A section without any of them gives no chunk.
    """
    whole = F.array_join("paragraphs", "\n\n")
    packed = F.when(F.length(whole) > most, F.col("_packed")).when(F.size("paragraphs") > 0, F.array(F.col("paragraphs")))
    title = F.concat(F.lit("# "), F.col("heading"), F.lit("\n\n"))
    kinds = "chunk_type string, content string, paragraph_count int, is_continuation boolean, parent_section string"
    shape = f"array<struct<{kinds.replace(' ', ':').replace(',:', ',')}>>"

    def text(group: Column, n: Column) -> Column:
        bare = F.array_join(group, "\n\n")
        return F.struct(
            F.lit("text").alias("chunk_type"), F.when((n == 0) & (F.col("heading") != START), F.concat(title, bare)).otherwise(bare).alias("content"),
            F.size(F.split(bare, "\n\n", -1)).alias("paragraph_count"), (n > 0).alias("is_continuation"), F.when(n > 0, F.col("heading")).alias("parent_section"),
        )

    def other(kind: str, name: str, n: Column, body: Column) -> Column:
        content = F.concat(title, F.lit(f"## {name} "), (n + 1).cast("string"), F.lit("\n\n"), body)
        none = F.lit(None)
        return F.struct(F.lit(kind).alias("chunk_type"), content.alias("content"), none.cast("int").alias("paragraph_count"), none.cast("boolean").alias("is_continuation"), none.cast("string").alias("parent_section"))

    nothing = F.array().cast(shape)
    pictures = F.when(F.col("image_count") > 0, F.sequence(F.lit(0), (F.col("image_count") - 1).cast("int")))
    parts = F.concat(
        F.coalesce(F.transform(packed, text).cast(shape), nothing),
        F.coalesce(F.transform("tables", lambda rows, n: other("table", "Table", n, markdown_table(F.transform(rows, lambda r: F.transform(r, strip))))).cast(shape), nothing),
        F.coalesce(F.transform(pictures, lambda n: other("image_heavy_page", "Image", n, F.coalesce(picture(n), F.lit(PICTURE)))).cast(shape), nothing),
    )
    grouped = found.withColumn("_packed", paragraph_groups(F.when(F.length(whole) > most, F.col("paragraphs")), most))
    order = Window.partitionBy("source_file").orderBy("section", "_place")
    return (
        grouped.select("source_file", "section", "heading", "heading_level", "style_name", "has_lists", F.posexplode(parts).alias("_place", "_chunk"))
        .select(
            "source_file", (F.row_number().over(order) - 1).alias("chunk_id"), (F.col("section") + 1).alias("page_number"), "_chunk.chunk_type", "_chunk.content",
            F.length("_chunk.content").alias("text_length"), preview(F.col("_chunk.content")).alias("preview"), "heading", "heading_level", "style_name", "has_lists",
            "_chunk.paragraph_count", "_chunk.is_continuation", "_chunk.parent_section",
        )
    )
