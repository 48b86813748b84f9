"""Near-duplicate texts by T-occurrence search over inverted lists of word shingles (DivideSkip).

Two texts with ``n`` and ``m`` distinct shingles are similar if their Jaccard similarity reaches
``t``; then they share at least ``T = ceil(t * max(n, m))`` shingles. DivideSkip sets the ``L``
longest inverted lists of a text aside: whoever shares ``T`` lists shares at least ``T - L`` of the
short ones. Here ``L = T - k`` for a small ``k``:

1. a count sketch over all shingles of all texts tells long lists from short ones;
2. each text puts itself on its ``n - T + k`` shortest lists. Spark's shuffle and sort-merge join
   merge these lists, and a text found on fewer than ``k`` lists of another is dropped. A list that the sketch
   says is longer than ``BLOCK`` is cut into blocks that meet in pairs, so that no list is one task's;
3. the long lists are never merged: each candidate is probed for the remaining shingles by binary
   search in its sorted shingle array, which gives the exact overlap.

Texts with equal shingle sets form one class that is searched once, so that many copies of one text
make no long lists. No list is capped: the order of lists only decides which are merged.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexicarta.llm.words import distinct_windows, mix, word_codes
from lexicarta.runtime import cut, spread

#: The sketch has about a counter for each sixteen characters, 2^16 to 2^26 (one byte each); a piece of it 2^16.
#: In collections too large for that more shingles share a counter, which makes lists look longer than they are but loses nothing.
LEAST_BITS, MOST_BITS, PIECE_BITS = 16, 26, 16
#: Members of a list that meet each other in one key of the join.
BLOCK = 2048
#: List places (shingles of all texts) for each partition of the join.
PLACES = 1 << 20


def _counter(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _length(level: np.ndarray) -> np.ndarray:
    """The length that a byte of the merged sketch stands for, rounded up."""
    return np.where(level <= 32, level, np.ceil(32 * 2 ** ((level.astype(np.float64) - 31) / 8)))


def _shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of words of each text, the distinct shingles of all, sorted in each text, and how many each has.

    A text of fewer than ``width`` words has one shingle of all its words.
    """
    codes, counts = word_codes(texts)
    h, n = distinct_windows(codes, counts, width)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if not len(short):
        return counts, h, n
    starts = (np.cumsum(counts) - counts)[short]
    whole = counts[short].astype(np.uint64)
    for j in range(width - 1):
        more = np.flatnonzero(counts[short] > j)
        whole[more] = mix(whole[more] ^ np.uint64(0x2545F4914F6CDD1D)) + codes[starts[more] + j]
    owner = np.concatenate([np.repeat(np.arange(len(n)), n), short])
    h = np.concatenate([h, mix(whole)])[np.argsort(owner, kind="stable")]
    n[short] = 1
    return counts, h, n


def _survey(width: int, min_words: int, bits: int):
    """Of each text its class and size; of each task the pieces of its count sketch."""
    schema = pa.schema([("id", pa.int64()), ("row_key", pa.int64()), ("cls", pa.int64()), ("n", pa.int32()), ("piece", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << bits, dtype=np.uint8)
        for batch in batches:
            counts, h, n = _shingle_sets(batch.column(2).to_pylist(), width)
            keep = (counts >= min_words) & (n > 0)
            owner = np.repeat(np.arange(len(n)), n)
            h, owner = h[keep[owner]], owner[keep[owner]]
            cell, add = np.unique(_counter(h, bits), return_counts=True)
            sketch[cell] = np.minimum(sketch[cell].astype(np.int64) + add, 255)
            cls = np.zeros(len(n), dtype=np.uint64)
            np.add.at(cls, owner, mix(h ^ np.uint64(0x5851F42D4C957F2D)))
            rows = np.flatnonzero(keep)
            nothing = pa.nulls(len(rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(cls[rows].view(np.int64)), pa.array(n[rows].astype(np.int32)), nothing.cast(pa.int32()), nothing.cast(pa.binary())], schema=schema
            )
        pieces = sketch.reshape(-1, 1 << PIECE_BITS)
        used = np.flatnonzero(pieces.any(axis=1))
        nothing = pa.nulls(len(used))
        yield pa.RecordBatch.from_arrays(
            [nothing.cast(pa.int64())] * 3 + [nothing.cast(pa.int32()), pa.array(used.astype(np.int32)), pa.array([zlib.compress(pieces[i].tobytes(), 1) for i in used], pa.binary())], schema=schema
        )

    return run


def _merge_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the counts of each piece; sums are kept as 32-bit numbers, compressed."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = zlib.decompress(counts.as_py())
            more = np.frombuffer(raw, dtype=np.uint8 if len(raw) == 1 << PIECE_BITS else np.uint32).astype(np.int64)
            total[piece] = total[piece] + more if piece in total else more
    packed = [zlib.compress(np.minimum(c, 2**32 - 1).astype(np.uint32).tobytes(), 1) for c in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(packed, pa.binary())], names=["piece", "counts"])


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A counter becomes one byte: exact up to 32, then by its logarithm."""
    for batch in batches:
        sums = [np.frombuffer(zlib.decompress(c), dtype=np.uint32).astype(np.int64) for c in batch.column(1).to_pylist()]
        level = [np.where(c <= 32, c, np.minimum(255, 32 + 8 * np.log2(np.maximum(c, 32) / 32))).astype(np.uint8).tobytes() for c in sums]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(level, pa.binary())], names=["piece", "level"])


def _short_lists(width: int, min_words: int, threshold: float, occurrences: int, level, bits: int, block: int):
    """The short lists each class is on. Lists of a single class, by the sketch, aren't written.

    ``role`` is 0 where all of a key's members meet each other. A list of several blocks has a key for each pair of blocks, in which the
    members of the one (1) meet those of the other (2).
    """
    schema = pa.schema([("token", pa.int64()), ("cls", pa.int64()), ("n", pa.int32()), ("role", pa.int8())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        length = np.frombuffer(level.value, dtype=np.uint8)
        for batch in batches:
            counts, h, n = _shingle_sets(batch.column(0).to_pylist(), width)
            owner = np.repeat(np.arange(len(n)), n)
            cls = np.zeros(len(n), dtype=np.uint64)
            np.add.at(cls, owner, mix(h ^ np.uint64(0x5851F42D4C957F2D)))
            keep = (counts >= min_words) & (n > 0)
            for i in np.flatnonzero(keep):
                if (c := int(cls[i])) in seen:
                    keep[i] = False
                seen.add(c)
            h, owner = h[keep[owner]], owner[keep[owner]]
            rank = length[_counter(h, bits)]
            order = np.lexsort((h, rank, owner))
            h, owner, rank = h[order], owner[order], rank[order]
            sizes = np.where(keep, n, 0)
            place = np.arange(len(h)) - (np.cumsum(sizes) - sizes)[owner]
            least = np.ceil(threshold * n - 1e-9).astype(np.int64)
            merged = np.minimum(n, n - least + occurrences)
            use = (place < merged[owner]) & (rank > 1)
            h, owner = h[use], owner[use]
            blocks = np.ceil(_length(rank[use]) / block).astype(np.int64)
            role = np.zeros(len(h), dtype=np.int8)
            if (blocks > 1).any():
                copies = np.repeat(np.arange(len(h)), blocks)
                other = np.arange(len(copies)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                h, owner, blocks = h[copies], owner[copies], blocks[copies]
                own = (mix(cls[owner] ^ h) % blocks.astype(np.uint64)).astype(np.int64)
                role = np.sign(other - own).astype(np.int8)
                role = np.where(role == 0, 0, np.where(role > 0, 1, 2)).astype(np.int8)
                pair = np.minimum(own, other) * blocks + np.maximum(own, other)
                h = np.where(blocks > 1, mix(h ^ mix(pair.astype(np.uint64) + np.uint64(1))), h)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(cls[owner].view(np.int64)), pa.array(n[owner].astype(np.int32)), pa.array(role)], schema=schema)

    return run


def _arrays(width: int):
    # 32 bits of each hash: the arrays of two texts are compared, not those of a collection
    schema = pa.schema([("cls", pa.int64()), ("shingles", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, h, n = _shingle_sets(batch.column(1).to_pylist(), width)
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array((h >> np.uint64(32)).astype(np.uint32).view(np.int32)))], schema=schema)

    return run


def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Binary search of one text's shingles in the other's sorted array."""
    for batch in batches:
        sides = []
        for column in (2, 3):
            values = batch.column(column)
            flat, ends = values.flatten().to_numpy().view(np.uint32), values.offsets.to_numpy()
            sides.append((flat, ends - ends[0]))
        (x, xe), (y, ye) = sides
        overlap = np.zeros(batch.num_rows, dtype=np.int32)
        union = np.zeros(batch.num_rows, dtype=np.int32)
        for i in range(batch.num_rows):
            a, b = x[xe[i] : xe[i + 1]], y[ye[i] : ye[i + 1]]
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            overlap[i] = np.count_nonzero(b[at] == a)
            union[i] = len(a) + len(b) - overlap[i]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(overlap), pa.array(union)], names=["cls_a", "cls_b", "overlap", "either"])


def similar_classes(
    texts: DataFrame, threshold: float = 0.8, width: int = 5, min_words: int = 1, occurrences: int = 4, block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """Similar texts as pairs between class representatives plus membership.

    ``texts`` has ``id bigint``, ``row_key bigint`` and ``content string``; other columns aren't read.

    Returns:
        ``members (id, row_key, cls, n)``, one row per text that takes part, and ``links (cls_a,
        cls_b, similarity)`` with ``cls_a < cls_b``, of all pairs of different classes whose Jaccard
        similarity is ``threshold`` or more.

    A class is a set of distinct ``width``-word shingles; a shorter text has one shingle of all its words. Rows of a null id,
    null texts, texts without a word and those of fewer than ``min_words`` words take no part. Repeated rows are members
    of one class. Equal 64-bit hashes count as equal shingles.
    """
    spark = texts.sparkSession
    texts = texts.select("id", "row_key", "content").where("id is not null and content is not null")
    size = texts.agg(F.sum(F.length("content"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, int(size // 16).bit_length()))
    texts = spread(texts)
    survey = cut(texts.mapInArrow(_survey(width, min_words, bits), "id bigint, row_key bigint, cls bigint, n int, piece int, counts binary"))
    members = survey.where("piece is null").select("id", "row_key", "cls", "n")
    # the tasks' sketches are added up in two steps, so that no task reads a piece of all of them
    merged = survey.where("piece is not null").select("piece", "counts", F.floor(F.sqrt(F.spark_partition_id())).alias("part")).repartition("piece", "part").select("piece", "counts")
    for keys in (["piece"], []):
        merged = merged.mapInArrow(_merge_pieces, "piece int, counts binary")
        merged = merged.repartition(*keys) if keys else merged
    level = bytearray(1 << bits)  # of bounded size, whatever the collection's
    for piece, counts in merged.mapInArrow(_levels, "piece int, level binary").collect():
        level[piece << PIECE_BITS : (piece + 1) << PIECE_BITS] = counts
    shared = spark.sparkContext.broadcast(bytes(level))

    places = members.agg(F.sum("n")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-places // PLACES))
    lists = (
        texts.select("content")
        .mapInArrow(_short_lists(width, min_words, threshold, occurrences, shared, bits, block), "token bigint, cls bigint, n int, role tinyint")
        .repartition(tasks, "token")
        .dropDuplicates(["token", "cls"])
    )
    x = lists.where("role <> 2").select("token", F.col("cls").alias("cls_a"), F.col("n").alias("n_a"), F.col("role").alias("role_a"))
    y = lists.where("role <> 1").select("token", F.col("cls").alias("cls_b"), F.col("n").alias("n_b"), F.col("role").alias("role_b"))
    alike = (F.col("n_a") >= threshold * F.col("n_b") - 1e-9) & (F.col("n_b") >= threshold * F.col("n_a") - 1e-9)
    once = (F.col("role_a") == 0) & (F.col("role_b") == 0) & (F.col("cls_a") < F.col("cls_b")) | (F.col("role_a") == 1) & (F.col("role_b") == 2)
    met = x.join(y, "token").where(once & alike).select(F.least("cls_a", "cls_b").alias("cls_a"), F.greatest("cls_a", "cls_b").alias("cls_b"), F.greatest("n_a", "n_b").alias("most"))
    enough = F.least(F.lit(occurrences), F.ceil(threshold * F.max("most") - 1e-9))
    candidates = cut(met.groupBy("cls_a", "cls_b").agg(F.count(F.lit(1)).alias("met"), enough.alias("enough")).where("met >= enough").select("cls_a", "cls_b"))

    wanted = candidates.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).distinct()
    chosen = members.join(wanted, "cls").groupBy("cls").agg(F.min("id").alias("id"))
    arrays = texts.select("id", "content").join(chosen, "id").select("cls", "content").mapInArrow(_arrays(width), "cls bigint, shingles array<int>")
    links = (
        candidates.join(arrays.select(F.col("cls").alias("cls_a"), F.col("shingles").alias("s_a")), "cls_a")
        .join(arrays.select(F.col("cls").alias("cls_b"), F.col("shingles").alias("s_b")), "cls_b")
        .select("cls_a", "cls_b", "s_a", "s_b")
        .mapInArrow(probe, "cls_a bigint, cls_b bigint, overlap int, either int")
        .where(F.col("overlap") >= threshold * F.col("either") - 1e-9)
        .select("cls_a", "cls_b", (F.col("overlap") / F.col("either")).alias("similarity"))
    )
    return members, links


def similar_rows(members: DataFrame, links: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every pair of rows in linked classes or in one class: ``id_a < id_b``.

    Pairs of rows with one ``row_key`` (the same chunk ingested twice) are left out. The result is
    as large as the number of such pairs; where groups of copies are large, use ``groups``.
    """
    a = members.select(F.col("cls").alias("cls_a"), F.col("id").alias("i"), F.col("row_key").alias("key_i"))
    b = members.select(F.col("cls").alias("cls_b"), F.col("id").alias("j"), F.col("row_key").alias("key_j"))
    # the copies of a class meet in blocks, so that no class is one task's
    several = members.groupBy("cls").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("cls").alias("cls_a"), F.ceil(F.col("rows") / block).alias("blocks"))
    sized = a.join(several, "cls_a").withColumn("own", F.pmod(F.xxhash64("i"), F.col("blocks")))
    zero = F.lit(0).cast("bigint")
    low = sized.select("cls_a", "i", "key_i", F.col("own").alias("x"), F.explode(F.sequence(F.col("own"), F.col("blocks") - 1)).alias("y"))
    high = sized.select("cls_a", F.col("i").alias("j"), F.col("key_i").alias("key_j"), F.explode(F.sequence(zero, F.col("own"))).alias("x"), F.col("own").alias("y"))
    within = low.join(high, ["cls_a", "x", "y"]).where("x < y or i < j")
    across = links.select("cls_a", "cls_b").join(a, "cls_a").join(b, "cls_b")
    columns = ["i", "j", "key_i", "key_j"]
    return (
        within.select(*columns)
        .unionByName(across.select(*columns))
        .where("key_i <> key_j")
        .select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"))
    )


def _signature(edges: DataFrame) -> tuple:
    """Number of edges and sums of two hashes of them: equal for equal sets, whatever their order."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.hash("v", "u").cast("bigint"))).first())


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """Connected components of ``links (cls_a, cls_b)``: ``cls`` and ``root``, the least class in reach.

    Alternating large-star and small-star steps, each a grouped aggregate and a join, until nothing
    changes; each round is checkpointed. Classes without a link aren't listed.
    """
    edges = cut(links.select(F.greatest("cls_a", "cls_b").alias("u"), F.least("cls_a", "cls_b").alias("v")).distinct())
    before = _signature(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = cut(small.select("e.u", "e.v").where("u <> v").distinct())
        now = _signature(after)
        edges = after
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not found in {rounds} rounds")
    return edges.select(F.col("u").alias("cls"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("cls"), F.col("v").alias("root")).distinct())


def groups(members: DataFrame, links: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """One row per text: ``id``, ``group_id`` (least id of its group), ``copies`` in its class and ``links`` of its class.

    With ``texts (id, content)`` its rows that aren't among the members come out too: those of equal content but for
    the blanks around it are one group without links, and each null or blank one is a group by itself.
    """
    roots = components(links)
    degree = links.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("links"))
    classes = members.groupBy("cls").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    placed = classes.join(roots, "cls", "left").join(degree, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named = placed.groupBy("root").agg(F.min("first").alias("group_id"))
    found = (
        members.select("id", "cls")
        .join(placed.join(named, "root").select("cls", "group_id", "copies", F.coalesce("links", F.lit(0)).alias("links")), "cls")
        .select("id", "group_id", "copies", "links")
    )
    if texts is None:
        return found
    bare = F.regexp_replace("content", r"^\s+|\s+$", "")
    other = texts.where("id is not null").select("id", F.when(bare != "", F.xxhash64(bare)).alias("same")).join(members.select("id"), "id", "left_anti")
    alone = other.where("same is null").select("id", F.col("id").alias("group_id"), F.lit(1).cast("bigint").alias("copies"), F.lit(0).cast("bigint").alias("links"))
    equal = other.where("same is not null")
    size = equal.groupBy("same").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("copies"))
    return found.unionByName(alone).unionByName(equal.join(size, "same").select("id", "group_id", "copies", F.lit(0).cast("bigint").alias("links")))
