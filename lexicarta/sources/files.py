"""Documents and source files of a folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexicarta.functions.text import extension

#: Extensions of each type of file.
FILE_TYPES = {
    "pdf": (".pdf",),
    "word": (".doc", ".docx"),
    "code": (".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".c", ".cpp", ".h", ".hpp", ".go", ".rb", ".php", ".rs"),
}


def discover(spark: SparkSession, folder: str, types: Sequence[str] = ("all",), fold_case: bool = False) -> DataFrame:
    """``path, extension, file_type, length`` of all files below ``folder`` of the given types.

    Unknown types are left out. Extensions count as written unless ``fold_case``.
    """
    wanted = list(FILE_TYPES) if "all" in types else [t for t in types if t in FILE_TYPES]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    ext = F.lower(extension(F.col("path"))) if fold_case else extension(F.col("path"))
    kind = F.lit(None).cast("string")
    for name in wanted:
        kind = F.when(F.col("extension").isin(*FILE_TYPES[name]), name).otherwise(kind)
    return files.withColumn("extension", ext).withColumn("file_type", kind).where("file_type is not null").select("path", "extension", "file_type", "length")


def source_texts(spark: SparkSession, folder: str) -> DataFrame:
    """``source_file, extension, code`` of all source files below ``folder``, each read whole."""
    text = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True)
    named = text.select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("code"))
    return named.withColumn("extension", F.lower(extension(F.col("source_file")))).where(F.col("extension").isin(*FILE_TYPES["code"])).select("source_file", "extension", "code")


def extract(files: DataFrame, read: Callable[[bytes], list[dict]], schema: str) -> DataFrame:
    """Rows that ``read`` makes of each file's bytes, with ``source_file`` and ``error``.

    ``files`` has ``path, content``. ``schema`` names what ``read`` returns. A file that can't be read
    gives one row with its error and nothing else; a null content counts as such.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.strip().split(" ")[0] for part in _top_level(schema)]
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows += [{"source_file": path, "error": None, **row} for row in read(bytes(content))]
                except Exception as problem:  # noqa: BLE001 - whatever a broken file raises is its error
                    rows.append({"source_file": path, "error": f"{type(problem).__name__}: {problem}"})
            columns = ["source_file", "error", *names]
            yield pd.DataFrame([[row.get(c) for c in columns] for row in rows], columns=columns, dtype=object)

    return files.select("path", "content").mapInPandas(run, f"source_file string, error string, {schema}")


def _top_level(schema: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            parts.append(schema[start:i])
            start = i + 1
    return [*parts, schema[start:]]
