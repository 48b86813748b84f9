"""From a folder of files to chunks: discovery, reading, splitting and the fallback for languages without a rule."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexicarta.functions.text import lines, preview
from lexicarta.operators import code_elements, packing, pdf_pages, word_sections
from lexicarta.settings import Settings
from lexicarta.sources import docx, files

PAGES = (
    "page_number int, text string, tables array<array<array<string>>>, num_tables int, images array<struct<x0: double, y0: double, x1: double, y1: double>>, num_images int, "
    "page_width double, page_height double, vision_text string"
)
FIELDS = ("source_file", "chunk_id", "page_number", "chunk_type", "text_length", "preview")


def source_chunks(sources: DataFrame, settings: Settings) -> DataFrame:
    """Chunks of source texts ``source_file, extension, code``: by elements where the language is known, else by lines."""
    known = F.col("extension").isin(*code_elements.LANGUAGES)
    by_element = code_elements.code_chunks(sources, settings.least_code).select(*FIELDS, "content")
    packed = packing.pack_lines(sources.where(~known), F.col("source_file"), lines(F.col("code")), settings.code_size)
    by_lines = packed.select(
        F.col("key").alias("source_file"), "chunk_id", F.floor(F.col("line_start") / 100).cast("int").alias("page_number"), F.lit("code").alias("chunk_type"),
        F.length("content").alias("text_length"), preview(F.col("content")).alias("preview"), "content",
    )
    return by_element.unionByName(by_lines)


def _bytes_of(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return found.where(F.lower("path").rlike(r"(?:%s)$" % "|".join(rf"\{e}" for e in files.FILE_TYPES[kind]))).select("path", "content")


def chunk_folder(
    spark: SparkSession, folder: str, types: Sequence[str] = ("all",), settings: Settings | None = None, read_pages: Callable[[bytes], list[dict]] | None = None,
    picture: Callable[[Column], Column] = lambda n: F.lit(None).cast("string"),
) -> tuple[DataFrame, DataFrame]:
    """Chunks ``content, metadata`` of all files below ``folder`` of the given types, and an outcome ``source_file, file_type, error, chunks`` for each file.

    ``read_pages`` turns a page file's bytes into rows of ``PAGES``; without it such files end with an error. ``picture``: see
    ``word_sections.section_chunks``. A file that can't be read gives its error and no chunk; types that aren't known give nothing.
    """
    settings = settings or Settings()
    wanted = tuple(files.FILE_TYPES) if "all" in types else [t for t in types if t in files.FILE_TYPES]
    every, failures = [], []
    if "code" in wanted:
        every.append(("code", source_chunks(files.source_texts(spark, folder), settings)))
    if "word" in wanted:
        read = files.extract(_bytes_of(spark, folder, "word"), docx.blocks, docx.BLOCKS)
        failures.append(read.where("error is not null").select("source_file", "error"))
        blocks = read.where("error is null").drop("error")
        every.append(("word", word_sections.section_chunks(word_sections.sections(blocks), settings.section_size, picture).select(*FIELDS, "content")))
    if "pdf" in wanted:
        pages = _bytes_of(spark, folder, "pdf")
        if read_pages is None:
            failures.append(pages.select(F.col("path").alias("source_file"), F.lit("no reader of page files").alias("error")))
        else:
            read = files.extract(pages, read_pages, PAGES)
            failures.append(read.where("error is not null").select("source_file", "error"))
            every.append(("pdf", pdf_pages.page_chunks(read.where("error is null").drop("error"), settings.coverage_threshold).select(*FIELDS, "content")))
    chunks = None
    for kind, part in every:
        part = part.select(F.lit(kind).alias("file_type"), "content", F.struct(*[F.col(f).cast("int" if f in ("chunk_id", "page_number", "text_length") else "string").alias(f) for f in FIELDS]).alias("metadata"))
        chunks = part if chunks is None else chunks.unionByName(part)
    if chunks is None:
        chunks = spark.createDataFrame([], f"file_type string, content string, metadata struct<{', '.join(f'{f}: string' for f in FIELDS)}>")
    failed = None
    for part in failures:
        failed = part if failed is None else failed.unionByName(part)
    counts = chunks.groupBy(F.col("metadata.source_file").alias("source_file")).agg(F.count(F.lit(1)).alias("chunks"))
    outcomes = files.discover(spark, folder, types, fold_case=True).select(F.col("path").alias("source_file"), "file_type").join(counts, "source_file", "left")
    outcomes = outcomes.join(failed, "source_file", "left") if failed is not None else outcomes.withColumn("error", F.lit(None).cast("string"))
    return chunks.select("content", "metadata"), outcomes.select("source_file", "file_type", "error", F.coalesce("chunks", F.lit(0)).alias("chunks"))
