"""New chunk files into a collection as they arrive."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexicarta.operators.embedding import Embedder, embed
from lexicarta.sources.collection import Collection


def stream_chunks(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 64) -> DataFrame:
    """A stream of the chunk rows in Parquet files that arrive in ``folder``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def append_stream(chunks: DataFrame, embedder: Embedder, target: Collection, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Embed each micro-batch and append it to ``target``; with ``once`` the stream ends when all files are in.

    A micro-batch that comes again after a failure is known by the stream's checkpoint folder and its number, and adds nothing.
    """
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, number: int) -> None:
        target.ingest_once(embed(batch, F.col("content"), embedder), f"{stream}-{number}")

    writer = chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def late_chunks(chunks: DataFrame, watermark: str = "30 days", window: str = "1 day") -> DataFrame:
    """Chunks per day of extraction and type on a stream, closed when the watermark has passed.

    ``chunks`` has ``extracted_at timestamp, chunk_type``.
    """
    return (
        chunks.withWatermark("extracted_at", watermark)
        .groupBy(F.window("extracted_at", window).alias("w"), F.coalesce("chunk_type", F.lit("text")).alias("chunk_type"))
        .agg(F.count(F.lit(1)).alias("chunks"))
        .select(F.col("w.start").alias("day"), "chunk_type", "chunks")
    )
