"""Figures of chunk collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunk_statistics(chunks: DataFrame, chunk_type: Column, text_length: Column, tables: Column | None = None, pictures: Column | None = None) -> DataFrame:
    """Per type and, in the row of a null type, over all: ``chunk_type, chunks, total_length, avg_length, percentage``.

    With ``tables`` or ``pictures``, the numbers of a chunk wherever its metadata keeps them, also ``num_tables`` and ``num_images``.
    A null type counts as ``unknown``, a null number as 0. No chunks give a single row of zeros.
    """
    extra = {name: c for name, c in (("num_tables", tables), ("num_images", pictures)) if c is not None}
    narrow = chunks.select(F.coalesce(chunk_type, F.lit("unknown")).alias("chunk_type"), F.coalesce(text_length, F.lit(0)).alias("text_length"), *[c.cast("bigint").alias(name) for name, c in extra.items()])
    figures = [F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in extra]
    figures += [F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("text_length"), F.lit(0)).alias("total_length"), F.coalesce(F.avg("text_length"), F.lit(0.0)).alias("avg_length")]
    by_type = narrow.groupBy("chunk_type").agg(*figures)
    whole = narrow.agg(*figures).select(F.lit(None).cast("string").alias("chunk_type"), "chunks", "total_length", "avg_length", *extra)
    total = whole.select(F.col("chunks").alias("_all"))
    by_type = by_type.select("chunk_type", "chunks", "total_length", "avg_length", *extra)
    return by_type.unionByName(whole).crossJoin(F.broadcast(total)).select(  # a single row
        "chunk_type", "chunks", "total_length", "avg_length", F.when(F.col("_all") > 0, F.col("chunks") * 100.0 / F.col("_all")).otherwise(0.0).alias("percentage"), *extra
    )


def document_summary(chunks: DataFrame) -> DataFrame:
    """Chunks of each type in each document. ``chunks`` has ``source_file, chunk_type``; a null type counts as ``unknown``."""
    return chunks.groupBy("source_file", F.coalesce("chunk_type", F.lit("unknown")).alias("chunk_type")).agg(F.count(F.lit(1)).alias("chunks"))


def run_summary(outcomes: DataFrame) -> DataFrame:
    """Per file type the successful, failed and all files and the chunks made. ``outcomes`` has ``file_type, error, chunks``."""
    return outcomes.groupBy("file_type").agg(
        F.count_if(F.col("error").isNull()).alias("successful"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"),
    )


def collection_summary(collection: DataFrame) -> DataFrame:
    """One row: vectors, their dimension and how many rows lack a vector or content."""
    return collection.agg(
        F.count("vector").alias("num_vectors"), F.max(F.size("vector")).alias("dimension"), F.count("content").alias("num_contents"),
        F.count_if(F.col("vector").isNull()).alias("without_vector"),
    )
