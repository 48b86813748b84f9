"""Deeply nested records into related flat tables.

Each record is stream-parsed into path-value-ordinal triples, the paths are grouped by their
repeated ancestor, and each group is pivoted into one table whose rows carry the record's id and
their place in every array above them. ``record_row`` tells records of one id or of none apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexicarta.functions.jsonevents import Unreadable, events
from lexicarta.runtime import spread

TRIPLES = "record_id bigint, record_row bigint, grp string, ordinals array<int>, path string, kind string, value string"

_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|[-\s.]+")


def canonical_key(key: str) -> str:
    """``boundingBoxes``, ``Bounding-Boxes`` and ``bounding_boxes`` are one key."""
    return _HUMP.sub("_", key.strip()).lower()


def _walk(text: str, lists: frozenset[str]) -> Iterator[tuple[str, tuple[int, ...], str, str, str | None]]:
    """Triples of one JSON text: group, ordinals, path below the group, kind, value.

    ``lists``: names of members that are arrays even where a lone value or JSON text stands for one.
    """
    # one frame per open container: [is_array, next ordinal, group, ordinals, path of the member in the group, wrapped]
    group, ordinals, path = "", (), ""
    frames: list[list] = []
    name = ""
    for kind, value in events(text):
        if kind == "key":
            name = canonical_key(value)
            continue
        if kind == "}" or kind == "]":
            frame = frames.pop()
            group, ordinals, path = frame[2], frame[3], frame[4]
            continue
        before = (group, ordinals, path)
        if frames and frames[-1][0]:
            frame = frames[-1]
            group, ordinals, path = frame[5], frame[6] + (frame[1],), ""
            frame[1] += 1
            yield group, ordinals, "", kind, value if kind != "{" and kind != "[" else None
            seen = True
        else:
            seen = False
            if frames:
                path = f"{path}.{name}" if path else name
            if name in lists and frames and kind not in ("[", "null"):
                if kind == "string" and (inner := _inner(value, lists)) is not None:
                    prefix = f"{group}{'.' if group and path else ''}{path}"
                    for g, o, p, k, v in inner:
                        yield f"{prefix}{g}", ordinals + o, p, k, v
                    group, ordinals, path = before
                    continue
                if kind == "string" and value.strip()[:1] in ("", "[", "{"):
                    group, ordinals, path = before
                    continue
                group, ordinals, path = f"{group}{'.' if group and path else ''}{path}[]", ordinals + (0,), ""
                yield group, ordinals, "", kind, value if kind != "{" else None
                seen = True
        if kind == "{":
            frames.append([False, 0, *before])
        elif kind == "[":
            frames.append([True, 0, *before, f"{group}{'.' if group and path else ''}{path}[]", ordinals])
        else:
            if not seen:
                yield group, ordinals, path, kind, value
            group, ordinals, path = before


def _inner(text: str, lists: frozenset[str]) -> list | None:
    """Triples of JSON text that stands for an array; None if it is no complete JSON container.

    JSON texts inside JSON texts are opened as deep as they go (each is shorter than the one around it); past what the
    interpreter can nest, some hundred levels, a text stays a text.
    """
    start = text.lstrip(" \t\r\n﻿")[:1]
    try:
        if start == "[":
            return list(_walk(text, lists))
        if start == "{":
            return list(_walk(f"[{text}]", lists))
        if start == '"' or text.strip() == "null":
            (kind, value), = events(text)
            if kind == "null":
                return []
            inner = _inner(value, lists)
            return inner if inner is not None else [("[]", (0,), "", kind, value)]
    except (Unreadable, ValueError, RecursionError):
        pass
    return None


def record_triples(text: str | None, lists: Iterable[str] = (), wrappers: Iterable[str] = ()) -> list[tuple]:
    """All triples of one record; none if it can't be read to its end.

    A record that is itself stored as JSON text counts by what it holds; members named in
    ``wrappers`` are transparent when they hold the record proper.
    """
    if not text:
        return []
    lists, skip = frozenset(lists), frozenset(wrappers)
    try:
        while text.lstrip(" \t\r\n﻿")[:1] == '"':
            (_, text), = events(text)
        found = list(_walk(text, lists))
    except (Unreadable, ValueError):
        return []
    if not skip:
        return found
    out = []
    for group, ordinals, path, kind, value in found:
        for w in skip:
            while group.startswith(f"{w}."):
                group = group[len(w) + 1 :]
            if not group:
                while path.startswith(f"{w}."):
                    path = path[len(w) + 1 :]
        out.append((group, ordinals, path, kind, value))
    return out


def to_triples(
    df: DataFrame,
    record_id: str | Column,
    payload: str | Column,
    lists: Sequence[str] = (),
    wrappers: Sequence[str] = (),
    groups: Sequence[str] | None = None,
) -> DataFrame:
    """Path-value-ordinal triples of every record.

    Columns: ``record_id``; ``record_row``, a number of its own for each record, also those of a null or repeated id; ``grp`` (path of the repeated ancestor, ``""`` for the record itself),
    ``ordinals`` (0-based place in each array on the way), ``path`` below the ancestor (``""``: the
    array's element itself), ``kind`` and ``value``. Null, empty and unreadable records give no rows;
    a null element gives a row of kind ``null``, so that it keeps its place. Other columns of
    ``df`` aren't read, so their names can't clash. ``groups`` limits the triples to these groups.
    """
    lists, wrappers = tuple(lists), tuple(wrappers)
    keep = None if groups is None else frozenset(groups)
    schema = pa.schema(
        [("record_id", pa.int64()), ("record_row", pa.int64()), ("grp", pa.string()), ("ordinals", pa.list_(pa.int32())), ("path", pa.string()), ("kind", pa.string()), ("value", pa.string())]
    )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                row += 1
                for group, ordinals, path, kind, value in record_triples(text, lists, wrappers):
                    if keep is None or group in keep:
                        for column, x in zip(out, (key, row, group, ordinals, path, kind, value)):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    narrow = df.select(as_column(record_id).cast("bigint").alias("record_id"), as_column(payload).cast("string").alias("payload"))
    return spread(narrow.where("payload is not null")).mapInArrow(parse, TRIPLES)


def pivot_groups(triples: DataFrame, columns: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """One row per element of the named groups, its members as columns.

    Elements are keyed by ``record_id``, ``record_row``, ``grp`` and ``ordinals``; the parent of an element is
    the row of the same record whose ordinals are these without the last. Null elements
    are no rows. All triples of an element come from one task, so the partial
    aggregate leaves one row each before the shuffle. A member that a broken writer repeats takes
    its greatest value.
    """
    pick = [F.max(F.when(F.col("path") == c, F.col("value"))).alias(c.replace(".", "_")) for c in columns]
    return (
        triples.where(F.col("grp").isin(*groups))
        .groupBy("record_id", "record_row", "grp", "ordinals")
        .agg(
            F.max(F.when(F.col("path") == "", F.when(F.col("kind") == "null", 0).otherwise(1))).alias("_real"),
            F.max(F.when(F.col("path") == "", F.col("value"))).alias("value"),
            *pick,
        )
        .where("_real = 1")
        .drop("_real")
    )


def child_table(triples: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """The flat table of one repeated group: ``record_id``, ``record_row``, ``parent_ordinals``, ``pos`` and its members."""
    rows = pivot_groups(triples, columns, [group])
    return rows.select(
        "record_id",
        "record_row",
        F.slice("ordinals", 1, F.size("ordinals") - 1).alias("parent_ordinals"),
        F.element_at("ordinals", -1).alias("pos"),
        "value",
        *[c.replace(".", "_") for c in columns],
    )


def record_table(triples: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The members of each record outside its arrays, one row per record that has any."""
    pick = [F.max(F.when(F.col("path") == c, F.col("value"))).alias(c.replace(".", "_")) for c in columns]
    return triples.where("grp = '' and path <> ''").groupBy("record_id", "record_row").agg(*pick)
