"""Page records into page chunks: routing, types and content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexicarta.functions.text import is_blank, markdown_table, preview, strip

TABLE_MARK = "\n\n--- Tables ---\n"


def coverage(images: Column, width: Column, height: Column) -> Column:
    """The pictures' areas over the page's; 0 for a page without area. Overlaps count twice, so it can exceed 1."""
    area = width * height
    covered = F.aggregate(images, F.lit(0.0), lambda total, i: total + (i["x1"] - i["x0"]) * (i["y1"] - i["y0"]))
    return F.when(area > 0, covered / area).otherwise(0.0)


def route(num_tables: Column, ratio: Column, threshold: float) -> Column:
    """``table`` if there are tables, else ``vision`` above the threshold, else ``text``."""
    return F.when(num_tables > 0, "table").when(ratio > threshold, "vision").otherwise("text")


def page_chunks(pages: DataFrame, threshold: float = 0.15) -> DataFrame:
    """One chunk per page.

    ``pages`` has ``source_file, page_number, text, tables array<array<array<string>>>, num_tables,
    images array<struct<x0,y0,x1,y1>>, num_images, page_width, page_height, vision_text``. A table
    page holds its stripped text and its tables as Markdown, a page above the threshold the vision
    model's text, any other its stripped text. Null text counts as empty; blank pages still give a
    chunk; null lists count as empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    tables = F.filter(F.coalesce(F.col("tables"), F.array().cast("array<array<array<string>>>")), lambda t: F.size(t) > 0)
    ratio = F.when(F.col("images").isNull(), 0.0).otherwise(coverage(F.col("images"), F.col("page_width"), F.col("page_height")))
    shaped = pages.withColumns({"_ratio": ratio, "_md": F.transform(tables, markdown_table)}).withColumn("route", route(F.coalesce("num_tables", F.lit(0)), F.col("_ratio"), threshold))
    nothing = F.array().cast("array<string>")
    parts = F.concat(F.when(is_blank(text), nothing).otherwise(F.array(strip(text))), F.when(F.size("_md") > 0, F.concat(F.array(F.lit(TABLE_MARK)), F.col("_md"))).otherwise(nothing))
    content = F.when(F.col("route") == "table", F.array_join(parts, "\n\n")).when(F.col("route") == "vision", F.coalesce("vision_text", F.lit(""))).otherwise(strip(text))
    pictured = F.coalesce(F.col("num_images"), F.lit(0)) > 0
    kind = (
        F.when((F.col("route") == "table") & pictured, "mixed").when(F.col("route") == "table", "table").when(F.col("route") == "vision", "image_heavy_page")
        .when(pictured, "mixed").otherwise("text")
    )
    return shaped.withColumn("content", content).select(
        "source_file", F.col("page_number").alias("chunk_id"), "page_number", kind.alias("chunk_type"), "content", F.length("content").alias("text_length"),
        preview(F.col("content")).alias("preview"), F.coalesce("num_tables", F.lit(0)).alias("num_tables"), F.coalesce("num_images", F.lit(0)).alias("num_images"),
        F.col("_ratio").alias("image_coverage_ratio"), (F.col("route") == "vision").alias("is_vision_processed"), F.col("_md").alias("table_content"),
    )


def file_summary(chunks: DataFrame) -> DataFrame:
    """Per file the pages of each kind (vision first) and all tables and pictures."""
    vision = F.col("is_vision_processed")
    return chunks.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(vision).alias("vision_pages"),
        F.count_if(~vision & (F.col("chunk_type") == "table")).alias("table_pages"),
        F.count_if(~vision & (F.col("chunk_type") == "mixed")).alias("mixed_pages"),
        F.count_if(~vision & (F.col("chunk_type") == "text")).alias("text_pages"),
        F.sum("num_tables").alias("tables"),
        F.sum("num_images").alias("images"),
    )
