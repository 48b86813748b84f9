"""Oversized texts cut into pieces at natural boundaries, by balanced targets. The work is in proportion to the text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of boundaries, strongest first. Full-width marks need no white space after them.
BOUNDARIES = (
    ("paragraph", re.compile(r"\n[ \t\r]*\n\s*")),
    ("sentence", re.compile(r"(?<=[.!?…])[\"'»”’)\]]*\s+|[。！？｡]+[\"'»”’)\]」』）】》〉]*\s*")),
    ("line", re.compile(r"\n+")),
    ("clause", re.compile(r"(?<=[,;:])\s+|[，；：、､]+\s*")),
    ("word", re.compile(r"\s+")),
)
#: The share of a piece's step within which a target may move to a boundary, and the wider shares tried where there is none.
REACH, WIDER = 0.3, (0.6, 1.0)

SCHEMA = "id bigint, piece int, pieces int, start int, stop int, boundary string, content string"


def _snap(text: str, target: float, low: int, high: int) -> tuple[int, str]:
    """The place of the strongest boundary from ``low`` to ``high``, the nearest to the target among equals."""
    window = text[max(0, low - 2) : high]
    offset = max(0, low - 2)
    for name, pattern in BOUNDARIES:
        ends = [offset + m.end() for m in pattern.finditer(window)]
        ends = [e for e in ends if low <= e <= high]
        if ends:
            return min(ends, key=lambda e: abs(e - target)), name
    return min(max(round(target), low), high), "none"


def cut_points(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """``(start, stop, boundary)`` of each piece.

    The rest of the text is planned as the fewest pieces that can hold it, with equally spaced targets. The next target is moved to the
    strongest boundary nearby, or where there is none, to one further off that the limit allows; only a piece that can't reach any boundary
    ends at ``none``. Where a cut leaves more than the planned pieces can hold, the rest is planned with one more, so that
    what lies before isn't looked at again.
    """
    size = len(text)
    limit = max(1, limit)
    overlap = max(0, min(overlap, limit - 1))
    pieces, start, stop = [], 0, 0
    while size - start > limit:
        count = ceil((size - start - overlap) / (limit - overlap))
        step = (size - start - overlap) / count
        target = start + overlap + step
        last = min(size - 1, start + limit)
        for share in (REACH, *WIDER, size):
            low, high = max(stop + 1, ceil(target - share * step)), min(last, int(target + share * step))
            if low <= high:
                place, name = _snap(text, target, low, high)
                if name != "none":
                    break
        else:
            place, name = min(max(round(target), stop + 1), last), "none"
        pieces.append((start, place, name))
        start, stop = max(0, place - overlap), place
    return [*pieces, (start, size, "end")]


def split_oversized(
    df: DataFrame, row_id: Column, content: Column, kind: Column, limits: DataFrame, default_kind: str = "text"
) -> DataFrame:
    """The pieces of every row whose content exceeds the limit of its kind.

    Columns: ``id``; ``piece`` (from 0) of ``pieces``; ``start`` and ``stop`` in code points;
    ``boundary`` at which the piece ends; ``content``. Each piece but the first starts exactly the
    kind's overlap before the end of the one before it, so that the text can be put together
    again. ``limits`` has ``chunk_type, max_chars, overlap_chars``; a null kind counts as
    ``default_kind``. Rows with null content, of a kind without a limit or within it give no rows;
    repeated rows are cut each. An overlap of the limit or more counts as one less than the limit.
    """
    schema = pa.schema(
        [("id", pa.int64()), ("piece", pa.int32()), ("pieces", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("boundary", pa.string()), ("content", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text, limit, overlap in zip(*(c.to_pylist() for c in batch.columns)):
                pieces = cut_points(text, limit, overlap or 0)
                rows += [(key, n, len(pieces), a, b, name, text[a:b]) for n, (a, b, name) in enumerate(pieces)]
            columns = list(zip(*rows)) if rows else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    narrow = df.select(row_id.cast("bigint").alias("_id"), content.cast("string").alias("_content"), F.coalesce(kind, F.lit(default_kind)).alias("_kind"))
    rules = limits.where("max_chars is not null").groupBy("chunk_type").agg(F.min(F.struct("max_chars", "overlap_chars")).alias("rule"))
    return (
        narrow.join(rules, narrow["_kind"] == rules["chunk_type"])
        .where(F.length("_content") > F.col("rule.max_chars"))
        .select("_id", "_content", "rule.max_chars", "rule.overlap_chars")
        .mapInArrow(run, SCHEMA)
    )
