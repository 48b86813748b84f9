"""Greedy packers: paragraphs or lines into chunks of a size."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexicarta.functions.text import let


def _grouped(parts: Column, most: int, after: bool) -> Column:
    """Parts in groups. Only lengths go to Python, in Arrow batches, and only the groups' first places come back."""

    @F.pandas_udf("array<int>")
    def starts(lengths: pd.Series) -> pd.Series:
        found = []
        for sizes in lengths:
            if sizes is None:
                found.append(None)
                continue
            firsts, n, closed = [], 0, True
            for i, size in enumerate(sizes.tolist(), 1):
                if closed or not after and n + size > most:
                    firsts.append(i)
                    n, closed = 0, False
                n += size
                closed = after and n >= most
            found.append(firsts)
        return pd.Series(found)

    lengths = F.transform(parts, lambda p: F.coalesce(F.length(p), F.lit(0)) + (1 if after else 0))
    return let(starts(lengths), lambda firsts: F.transform(firsts, lambda s, i: F.slice(parts, s, F.coalesce(F.get(firsts, i + 1), F.size(parts) + 1) - s)))


def paragraph_groups(parts: Column, most: int) -> Column:
    """Paragraphs packed in order: a group is closed before the paragraph that would take it past ``most``.

    Lengths don't count the separators, so a joined group can exceed ``most``; a longer paragraph
    stands alone. Nulls count as empty.
    """
    return _grouped(parts, most, False)


def line_groups(parts: Column, most: int) -> Column:
    """Lines packed in order: a group is closed after the line, with its line end, that takes it to ``most``. Nulls count as empty."""
    return _grouped(parts, most, True)


def pack_paragraphs(df: DataFrame, key: Column, parts: Column, most: int = 1000) -> DataFrame:
    """``key, chunk_id, content, is_continuation`` of packed paragraphs.

    Paragraphs that fit together, separators included, stay one chunk. Null and empty lists give
    no rows.
    """
    whole = F.array_join(parts, "\n\n")
    groups = F.when(F.length(whole) > most, paragraph_groups(parts, most)).otherwise(F.array(parts))
    return (
        df.where(F.size(parts) > 0)
        .select(key.alias("key"), F.posexplode(groups).alias("chunk_id", "group"))
        .select("key", "chunk_id", F.array_join("group", "\n\n").alias("content"), (F.col("chunk_id") > 0).alias("is_continuation"))
    )


def pack_lines(df: DataFrame, key: Column, parts: Column, most: int = 1500) -> DataFrame:
    """``key, chunk_id, content, line_start, line_end`` of packed lines.

    Line numbers are estimates at 80 characters a line, as a text of unknown language has no
    elements to number; a remainder ends at the number of lines. Null lists give no rows.
    """
    groups = line_groups(parts, most)
    return (
        df.where(parts.isNotNull())
        .select(key.alias("key"), F.size(parts).alias("total"), groups.alias("groups"))
        .select("key", "total", F.posexplode("groups").alias("chunk_id", "group"))
        .select(
            "key", "chunk_id", F.array_join("group", "\n").alias("content"), F.floor(F.col("chunk_id") * most / 80).cast("int").alias("line_start"),
            F.when(F.length(F.array_join("group", "\n")) + 1 < most, F.col("total")).otherwise(F.floor((F.col("chunk_id") + 1) * most / 80).cast("int")).alias("line_end"),
        )
    )
