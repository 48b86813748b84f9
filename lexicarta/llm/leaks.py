"""Evaluation passages inside documents, by greedy string tiling.

Seeds are the passages' word windows of the least tile length. Documents are joined with them by
hash; of each pair that shares a seed the longest common runs of words are marked one after the
other, longest first and without overlap, so that reordered passages are found with all their
parts. Windows are hashed as in running Karp-Rabin matching and compared word by word before they count.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexicarta.llm.words import windows, word_codes
from lexicarta.runtime import spread

SCHEMA = "doc_id bigint, item_id bigint, tiles int, longest int, covered int, coverage double"
#: Words of all passages together up to which their seeds are broadcast; more are joined by a shuffle.
BROADCAST_WORDS = 2_000_000


def tiles(document: np.ndarray, passage: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two arrays of word codes: ``(place in document, place in passage, length)``.

    In each round the longest common runs of unmarked words are marked, longest first; a run that
    lost words to a longer one is taken up again by the next round. Ends when no run of ``least``
    words is left.
    """
    free_d, free_p = np.ones(len(document), dtype=bool), np.ones(len(passage), dtype=bool)
    one = lambda codes: windows(codes, np.array([len(codes)]), least)[0]
    hashed: dict[int, list[int]] = defaultdict(list)
    for j, h in enumerate(one(passage).tolist()):
        hashed[h].append(j)
    starts = [(i, j) for i, h in enumerate(one(document).tolist()) for j in hashed.get(h, ()) if (document[i : i + least] == passage[j : j + least]).all()]
    found: list[tuple[int, int, int]] = []
    while starts:
        matches = []
        reach: dict[int, int] = {}  # end of the run on each diagonal, so that a run is measured once
        for i, j in starts:
            if reach.get(i - j, -1) > i:
                continue
            if not (free_d[i : i + least].all() and free_p[j : j + least].all()):
                continue
            size = min(len(document) - i, len(passage) - j)
            same = (document[i : i + size] == passage[j : j + size]) & free_d[i : i + size] & free_p[j : j + size]
            n = size if same.all() else int(np.argmin(same))
            if n >= least:
                matches.append((n, i, j))
                reach[i - j] = i + n - least + 1
        if not matches:
            break
        matches.sort(key=lambda m: (-m[0], m[1], m[2]))
        for n, i, j in matches:
            if free_d[i : i + n].all() and free_p[j : j + n].all():
                free_d[i : i + n] = False
                free_p[j : j + n] = False
                found.append((i, j, n))
        starts = [(i, j) for i, j in starts if free_d[i : i + least].all() and free_p[j : j + least].all()]
    return found


class _Seeds:
    """Windows of all passages, sorted by hash, with the passages' words."""

    def __init__(self, ids: list[int], texts: list[str | None], least: int) -> None:
        codes, counts = word_codes(texts)
        h, owner, _ = windows(codes, counts, least)
        order = np.argsort(h, kind="stable")
        self.hash, self.owner = h[order], owner[order]
        ends = np.cumsum(counts)
        self.ids, self.words = ids, [codes[e - n : e] for e, n in zip(ends, counts)]


def _verify(doc_id: int, document: np.ndarray, item_id: int, passage: np.ndarray, least: int) -> tuple | None:
    found = tiles(document, passage, least)
    if not found:
        return None
    covered = sum(n for *_, n in found)
    return doc_id, item_id, len(found), max(n for *_, n in found), covered, covered / len(passage)


_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("tiles", pa.int32()), ("longest", pa.int32()), ("covered", pa.int32()), ("coverage", pa.float64())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def leaks(
    documents: DataFrame,
    doc_id: Column,
    text: Column,
    items: DataFrame,
    item_id: Column,
    passage: Column,
    least_words: int = 12,
    least_coverage: float = 0.0,
    least_run: int | None = None,
    broadcast_words: int = BROADCAST_WORDS,
) -> DataFrame:
    """Pairs of a document and an item whose passage it holds, wholly or partly.

    Columns: ``doc_id, item_id``; ``tiles``, the marked runs of at least ``least_words`` words;
    ``longest`` of them and ``covered`` in words; ``coverage``, the covered share of the passage.
    A pair counts if its coverage is ``least_coverage`` or more, or if one tile has ``least_run`` words. Short tiles with a threshold of coverage
    find a passage whose parts were put in another order; long ones a part of it. Null ids, null and empty texts and passages and passages
    shorter than ``least_words`` give no rows; repeated documents or items are pairs of their own.
    Other columns aren't read.

    The items are the held-out side. Their words are counted first: up to ``broadcast_words`` the
    seeds go to every task, so that documents aren't shuffled at all; beyond that, windows of both
    sides are joined by a shuffle on their hash.
    """
    spark = documents.sparkSession
    left = spread(documents.select(doc_id.cast("bigint").alias("doc_id"), text.cast("string").alias("text")).where((F.length("text") > 0) & F.col("doc_id").isNotNull()))
    right = items.select(item_id.cast("bigint").alias("item_id"), passage.cast("string").alias("passage")).where((F.length("passage") > 0) & F.col("item_id").isNotNull())
    size = right.agg(F.sum(F.regexp_count("passage", F.lit(r"(?U)[^\W_]+")))).first()[0] or 0
    if size <= broadcast_words:
        rows = right.collect()  # the held-out side, of a size checked above
        shared = spark.sparkContext.broadcast(([r.item_id for r in rows], [r.passage for r in rows]))
        found = left.mapInArrow(_scan(shared, least_words), SCHEMA)
    else:
        found = _shuffled(left, right, least_words)
    enough = F.col("coverage") >= least_coverage
    return found.where(enough if least_run is None else enough | (F.col("longest") >= least_run))


def _scan(shared, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _Seeds(*shared.value, least)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            codes, counts = word_codes(batch.column(1).to_pylist())
            h, owner, _ = windows(codes, counts, least)
            at = np.searchsorted(seeds.hash, h)
            hit = np.flatnonzero(seeds.hash[np.minimum(at, max(0, len(seeds.hash) - 1))] == h) if len(seeds.hash) else np.empty(0, dtype=np.int64)
            pairs: set[tuple[int, int]] = set()
            for i in hit:
                k = at[i]
                while k < len(seeds.hash) and seeds.hash[k] == h[i]:
                    pairs.add((int(owner[i]), int(seeds.owner[k])))
                    k += 1
            starts = np.cumsum(counts) - counts
            rows = [_verify(keys[d], codes[starts[d] : starts[d] + counts[d]], seeds.ids[p], seeds.words[p], least) for d, p in sorted(pairs)]
            yield _batch([r for r in rows if r])

    return run


def _window_rows(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, counts = word_codes(batch.column(1).to_pylist())
            h, owner, _ = windows(codes, counts, least)
            keys = batch.column(0).to_numpy()
            order = np.lexsort((h, owner))  # each window of a text once
            h, owner = h[order], owner[order]
            first = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])] if len(h) else np.empty(0, dtype=bool)
            yield pa.RecordBatch.from_arrays([pa.array(keys[owner[first]]), pa.array(h[first].view(np.int64))], names=["key", "h"])

    return run


def _shuffled(left: DataFrame, right: DataFrame, least: int) -> DataFrame:
    """The join by shuffle: windows of both sides meet on their hash, then texts are fetched for the pairs.

    A window that very many documents share is one key of the documents' side only; Spark's adaptive execution splits such a partition.
    """
    seeds = right.select("item_id", "passage").mapInArrow(_window_rows(least), "key bigint, h bigint").distinct().select(F.col("key").alias("item_id"), "h")
    seen = left.select("doc_id", "text").mapInArrow(_window_rows(least), "key bigint, h bigint").select(F.col("key").alias("doc_id"), "h")
    pairs = seen.join(seeds, "h").select("doc_id", "item_id").distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, ids, texts, passages = (c.to_pylist() for c in batch.columns)
            rows = [_verify(d, word_codes([t])[0], i, word_codes([p])[0], least) for d, i, t, p in zip(docs, ids, texts, passages)]
            yield _batch([r for r in rows if r])

    return pairs.join(left, "doc_id").join(right, "item_id").select("doc_id", "item_id", "text", "passage").mapInArrow(verify, SCHEMA)
