"""The most similar vectors of every vector: an inverted file with product-quantised residuals.

Coarse centroids and the codebooks of the residuals are fitted on a bounded sample; every vector is
indexed. The cells are as many as the square root of the vectors. A vector asks the cells of the centroids nearest to
it, as many as the wanted recall takes on a sample. Neighbouring cells form groups; the index is written once, a shelf of files for each group,
to the folder that all executors share. The vectors of a group ask together: their task reads the cells that they ask from the shelves, so that no vector is sent
to the groups that ask its cell. A query is compared exactly with its own cell; of all others
the asymmetric distance tables and their error, as seen in the own cell, leave the vectors that may be among its best, and these are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexicarta.runtime import cut, shared_folder, spread


@dataclass(frozen=True)
class Settings:
    """Parameters of the index.

    ``sample`` bounds the rows that centroids and codebooks are fitted on, unless 30 rows a cell are more; ``cell`` is the
    aimed number of vectors in a cell, by default the square root of their number; at least ``probes`` cells are asked,
    more until ``recall`` is reached by each third (by similarity) of about ``asked`` sampled queries. ``parts`` codes of one byte stand
    for a residual, and ``margin`` times their usual error is allowed for. About ``group`` cells' vectors are one shelf, of which about half ask in one task; it
    compares them with about ``block`` vectors at once.
    """

    dimension: int = 64
    sample: int = 24_000
    cell: int | None = None
    probes: int = 8
    parts: int = 16
    recall: float = 0.9
    asked: int = 1536
    margin: float = 2.5
    group: int = 48
    block: int = 16_384
    seed: int = 7


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, unit: bool) -> np.ndarray:
    k = max(1, min(k, len(x)))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        half = 0 if unit else 0.5 * (centres**2).sum(1)
        at = np.concatenate([(x[i : i + 8192] @ centres.T - half).argmax(1) for i in range(0, len(x), 8192)])
        counts = np.bincount(at, minlength=k)
        sums = np.zeros_like(centres, dtype=np.float64)
        np.add.at(sums, at, x)
        empty = counts == 0
        centres = (sums / np.maximum(counts, 1)[:, None]).astype(np.float32)
        if empty.any():
            centres[empty] = x[rng.choice(len(x), int(empty.sum()))]
        if unit:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[i : i + 8192] @ centres.T).argmax(1) for i in range(0, len(x), 8192)]) if len(x) else np.empty(0, dtype=np.int64)


def _coarse(x: np.ndarray, cells: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids of unit vectors; many of them are fitted in two levels, each part of the first by itself."""
    if cells <= 1024:
        return _kmeans(x, cells, 8, rng, True)
    at = _nearest(x, _kmeans(x, round(cells**0.5), 8, rng, True))
    parts = [x[at == c] for c in np.unique(at)]
    return np.concatenate([_kmeans(part, max(1, round(cells * len(part) / len(x))), 8, rng, True) for part in parts])


def _residuals(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions and lengths of what is left of vectors without their centroid's direction."""
    left = x - (x * centre).sum(1, keepdims=True) * centre
    size = np.linalg.norm(left, axis=1)
    return left / np.maximum(size, 1e-12)[:, None], size


def fit(x: np.ndarray, cells: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Centroids ``(cells, d)`` of unit vectors and codebooks ``(parts, 256, d / parts)`` of their residuals' directions."""
    rng = np.random.default_rng(s.seed)
    centres = _coarse(x, cells, rng)
    residual, _ = _residuals(x, centres[_nearest(x, centres)])
    width = s.dimension // s.parts
    books = [_kmeans(np.ascontiguousarray(residual[:, p * width : (p + 1) * width]), 256, 6, rng, False) for p in range(s.parts)]
    return centres, np.stack(books)


def _unit_vectors(dimension: int):
    """Unit vectors of a batch; null, zero, non-finite and wrongly sized ones are dropped. Equal vectors get one class."""
    schema = pa.schema([("id", pa.int64()), ("cls", pa.int64()), ("vector", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(), batch.column(1)
            sizes = rows.value_lengths().fill_null(-1).to_numpy()
            keep = np.flatnonzero(sizes == dimension)
            flat = rows.take(pa.array(keep)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
            norm = np.sqrt((flat**2).sum(1))
            good = np.isfinite(norm) & (norm > 0)
            keep, unit = keep[good], (flat[good] / norm[good][:, None]).astype(np.float32)
            rounded = np.round(unit * 1e6).astype(np.int64).view(np.uint64)
            h = np.zeros(len(unit), dtype=np.uint64)
            for j in range(dimension):
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + rounded[:, j]
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(h.view(np.int64)), pa.array([v.tobytes() for v in unit], pa.binary())], schema=schema)

    return run


def _matrix(column, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float32).reshape(-1, dimension)


def _survey(cells: int, asked, k: int, s: Settings):
    """Of a task's vectors how many are in each cell and the cells of each sampled query's ``k`` best."""
    schema = pa.schema([("query", pa.int32()), ("cell", pa.int32()), ("similarity", pa.float32()), ("count", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = asked.value
        counts = np.zeros(cells, dtype=np.int64)
        best, where = np.full((len(q), k), -2, dtype=np.float32), np.zeros((len(q), k), dtype=np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = _matrix(part.column(1).to_pylist(), s.dimension)
                cell = part.column(2).to_numpy()
                counts += np.bincount(cell, minlength=cells)
                score = q @ x.T
                ids = part.column(0).to_numpy()
                order = np.argsort(ids)
                mine = order[np.minimum(np.searchsorted(ids, own, sorter=order), len(ids) - 1)]
                held = np.flatnonzero(ids[mine] == own)
                score[held, mine[held]] = -2
                both = np.concatenate([best, score], axis=1)
                keep = np.argpartition(-both, k - 1, axis=1)[:, :k]
                where = np.take_along_axis(np.concatenate([where, np.broadcast_to(cell, score.shape)], axis=1), keep, 1)
                best = np.take_along_axis(both, keep, 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(q), dtype=np.int32), k)), pa.array(where.ravel()), pa.array(best.ravel()), pa.nulls(best.size, pa.int64())], schema=schema
        )
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(used), pa.int32()), pa.array(used.astype(np.int32)), pa.nulls(len(used), pa.float32()), pa.array(counts[used])], schema=schema)

    return run


def _drawn(classes: DataFrame, count: int, wanted: int, seed: int) -> pd.DataFrame:
    """About ``wanted`` classes, or all of fewer, by a hash of them, each once."""
    share = F.lit(min(1 << 20, -(-(wanted << 20) // count)))
    return classes.select("cls", "vector").where(F.pmod(F.xxhash64("cls", F.lit(seed)), F.lit(1 << 20)) < share).dropDuplicates(["cls"]).orderBy("cls").toPandas()


def survey(classes: DataFrame, count: int, centres: np.ndarray, k: int, s: Settings) -> tuple[np.ndarray, int]:
    """Vectors in each cell, and how many of the cells nearest to it a vector must ask.

    Sampled queries are compared with all vectors. In each third of them by the similarity of their ``k``-th
    neighbour the mean recall less one standard error reaches ``s.recall``.
    """
    drawn = _drawn(classes, count, s.asked, 3)  # about s.asked rows
    q = _matrix(drawn["vector"], s.dimension)
    asked = classes.sparkSession.sparkContext.broadcast((drawn["cls"].to_numpy(), q))
    met = cut(classes.select("cls", "vector", "cell").mapInArrow(_survey(len(centres), asked, k, s), "query int, cell int, similarity float, count bigint"))
    counts = np.zeros(len(centres), dtype=np.int64)
    for row in met.where("query is null").groupBy("cell").agg(F.sum("count").alias("n")).collect():  # a row a cell
        counts[row["cell"]] = row["n"]
    nearest = Window.partitionBy("query").orderBy(F.desc("similarity"), "cell")
    true = met.where("similarity > -2").withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k).toPandas()  # k rows a query
    probes = min(s.probes, len(counts))
    if not len(true):
        return counts, probes
    at = np.empty(len(true), dtype=np.int64)  # the place of each true neighbour's cell in its query's order
    query, cell = true["query"].to_numpy(), true["cell"].to_numpy()
    for i in range(0, len(true), 1024):
        score = q[query[i : i + 1024]] @ centres.T
        at[i : i + 1024] = (score > score[np.arange(len(score)), cell[i : i + 1024]][:, None]).sum(1)
    far = true.groupby("query")["similarity"].min().sort_values(kind="stable").index.to_numpy()
    for third in np.array_split(far, 3):
        if len(third):
            mine = np.isin(query, third)
            got = np.zeros((len(q), len(counts)), dtype=np.float32)
            np.add.at(got, (query[mine], at[mine]), 1)
            got = np.cumsum(got[third], axis=1) / got[third].sum(1, keepdims=True)
            sure = got.mean(0) - got.std(0) / len(got) ** 0.5
            probes = max(probes, int(np.argmax(sure >= s.recall)) + 1)
    return counts, probes


def _lists(q: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """The cells that each query asks."""
    if probes >= len(centres):
        return np.tile(np.arange(len(centres)), (len(q), 1))
    return np.argpartition(-(q @ centres.T), probes - 1, axis=1)[:, :probes]


def _grouped(centres: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Neighbouring cells in groups of about ``size`` vectors: parts are halved along their widest direction."""
    group, found = np.zeros(len(centres), dtype=np.int64), 0
    parts = [np.arange(len(centres))]
    while parts:
        part = parts.pop()
        if len(part) == 1 or counts[part].sum() <= size:
            group[part] = found
            found += 1
            continue
        x = centres[part] - centres[part].mean(0)
        order = part[np.argsort(x @ np.linalg.svd(x, full_matrices=False)[2][0], kind="stable")]
        half = np.cumsum(counts[order])
        middle = min(max(1, int(np.searchsorted(half, half[-1] / 2)) + 1), len(order) - 1)
        parts += [order[middle:], order[:middle]]
    return group


def _assign(shared, s: Settings):
    """Of each vector its cell and that cell's shelf; of equal vectors that a task meets soon after each other only the first."""
    schema = pa.schema([("cls", pa.int64()), ("vector", pa.binary()), ("cell", pa.int32()), ("shelf", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, _, shelf = shared.value
        seen: set[int] = set()
        for batch in batches:
            new = []
            for i, c in enumerate(batch.column(0).to_pylist()):
                if c not in seen:
                    seen.add(c)
                    new.append(i)
            if len(seen) > 1 << 20:
                seen.clear()
            batch = batch.take(pa.array(new, pa.int64()))
            cell = _nearest(_matrix(batch.column(1).to_pylist(), s.dimension), centres)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(shelf[cell].astype(np.int32))], schema=schema)

    return run


def _place(shared, s: Settings):
    """Of each class, once, its part along its cell's centroid, and length and codes of its residual. Rows come sorted by cell and class."""
    schema = pa.schema([("cls", pa.int64()), ("vector", pa.binary()), ("cell", pa.int32()), ("shelf", pa.int32()), ("along", pa.float32()), ("size", pa.float32()), ("codes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, books, _ = shared.value
        width = s.dimension // s.parts
        last = None
        for batch in batches:
            cls = batch.column(0).to_numpy()
            new = np.r_[last is None or cls[:1] != last, cls[1:] != cls[:-1]][: len(cls)].astype(bool)
            last = cls[-1] if len(cls) else last
            batch = batch.filter(pa.array(new))
            x, cell = _matrix(batch.column(1).to_pylist(), s.dimension), batch.column(2).to_numpy()
            residual, size = _residuals(x, centres[cell])
            codes = np.empty((len(x), s.parts), dtype=np.uint8)
            near = np.empty_like(residual)
            for p in range(s.parts):
                part = residual[:, p * width : (p + 1) * width]
                codes[:, p] = (part @ books[p].T - 0.5 * (books[p] ** 2).sum(1)).argmax(1)
                near[:, p * width : (p + 1) * width] = books[p][codes[:, p]]
            along = ((x - size[:, None] * near) * centres[cell]).sum(1)  # the codes' own part along the centroid is made up for
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(along.astype(np.float32)), pa.array(size.astype(np.float32)), pa.array([c.tobytes() for c in codes], pa.binary())], schema=schema)

    return run


def _rows(column, kind: type, width: int) -> np.ndarray:
    """A column of equally long binary values as a matrix, without a copy of each."""
    column = column.combine_chunks()
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]].view(kind).reshape(-1, width)


def _row_groups(folder: str, shelf: int, wanted: np.ndarray, s: Settings) -> Iterator[tuple[np.ndarray, ...]]:
    """The row groups of a shelf that may hold a wanted cell: place of each row on the shelf, cell, class, vector, part along the centroid, size and codes."""
    store, root = fs.FileSystem.from_uri(folder)
    first = 0
    for info in sorted(store.get_file_info(fs.FileSelector(f"{root}/shelf={shelf}", allow_not_found=True)), key=lambda i: i.path):
        if not info.path.endswith(".parquet"):
            continue
        with store.open_input_file(info.path) as opened:
            file = pq.ParquetFile(opened)
            at = file.schema_arrow.get_field_index("cell")
            for i in range(file.num_row_groups):
                about = file.metadata.row_group(i)
                span = about.column(at).statistics
                if about.num_rows and (span is None or not span.has_min_max or wanted[span.min : span.max + 1].any()):
                    t = file.read_row_group(i)
                    yield (
                        np.arange(first, first + len(t)), t.column("cell").to_numpy(), t.column("cls").to_numpy(), _rows(t.column("vector"), np.float32, s.dimension),
                        t.column("along").to_numpy(), t.column("size").to_numpy(), _rows(t.column("codes"), np.uint8, s.parts),
                    )
                first += about.num_rows


class _Best:
    """The ``k`` best vectors of each query so far; what is found is merged in when it's much."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.of, self.other, self.exact = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
        self.bound = np.full(len(ids), -np.inf, dtype=np.float32)
        self.more: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, of: np.ndarray, others: np.ndarray, y: np.ndarray) -> None:
        """Queries and the rows of ``y`` that may be among their best."""
        for i in range(0, len(of), 65536):
            v, u = of[i : i + 65536], others[i : i + 65536]
            exact = np.einsum("ij,ij->i", self.x[v].astype(np.float64), y[0][u].astype(np.float64))
            keep = (exact >= self.bound[v]) & (y[1][u] != self.ids[v])
            self.more.append((v[keep], y[1][u[keep]], exact[keep]))
            self.held += int(keep.sum())
        if self.held > max(1 << 18, len(self.of)):
            self.merge()

    def merge(self) -> None:
        parts = [(self.of, self.other, self.exact), *self.more]
        of, other, exact = (np.concatenate(p) for p in zip(*parts))
        order = np.lexsort((other, -exact, of))
        of, other, exact = of[order], other[order], exact[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        kth = place == self.k - 1
        self.bound[of[kth]] = exact[kth] - 1e-5
        best = place < self.k
        self.of, self.other, self.exact, self.more, self.held = of[best], other[best], exact[best], [], 0


_FOUND = pa.schema([("cls", pa.int64()), ("other", pa.int64()), ("similarity", pa.float64())])


def _search(shared, folder: str, tasks: list[tuple[int, int, int]], k: int, s: Settings):
    """Of each task, named by its place in ``tasks``, the ``k`` best vectors of each of its queries. A task is a shelf and a span of places on it."""

    def answers(shelf: int, start: int, stop: int) -> pa.RecordBatch:
        centres, books, shelves, probes = shared.value
        mine = []
        for place, *row in _row_groups(folder, shelf, shelves == shelf, s):
            inside = (place >= start) & (place < stop)
            if inside.any():
                mine.append([c[inside] for c in row[:3]])
        cell, ids, x = (np.concatenate(c) for c in zip(*mine))
        best = _Best(ids, x, k)

        def told(centre: np.ndarray, along: np.ndarray, size: np.ndarray, codes: np.ndarray) -> np.ndarray:
            """What the codes tell of vectors: its products with a query are the sums of the query's asymmetric tables, by one matrix product instead of a table look-up a part."""
            y = np.concatenate([books[p][codes[:, p]] for p in range(s.parts)], axis=1)
            return size[:, None] * y + np.multiply.outer(along, centre)

        def by_cell(chunk: tuple[np.ndarray, ...], wanted: np.ndarray) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
            names, starts = np.unique(chunk[1], return_index=True)
            for c, a, b in zip(names.tolist(), starts, [*starts[1:], len(chunk[1])]):
                if wanted[c]:
                    yield c, tuple(column[a:b] for column in chunk[2:])

        # the own cells exactly, which also shows the tables' usual error for a residual of length one
        errors = np.zeros((2, len(centres)))
        home = np.zeros(len(centres), dtype=bool)
        home[cell] = True
        for chunk in _row_groups(folder, shelf, home, s):
            for c, (others, y, along, size, codes) in by_cell(chunk, home):
                first, last = np.searchsorted(cell, (c, c + 1))
                few = min(k + 1, len(others))  # one may be the query itself
                coded, sized = told(centres[c], along, size, codes), size > 1e-6
                for i in range(first, last, 512):
                    at = np.arange(i, min(last, i + 512))
                    q = x[at]
                    close = y @ q.T
                    if sized.any():
                        off = ((close - coded @ q.T)[sized] / size[sized, None]) ** 2
                        errors[:, c] += off.sum(), off.size
                    near = np.argpartition(-close, few - 1, axis=0)[:few]
                    best.add(np.tile(at, few), near.ravel(), (y, others))
        best.merge()
        allowed = (s.margin * (errors[0] / np.maximum(errors[1], 1)) ** 0.5).astype(np.float32)[cell]

        lists = _lists(x, centres, probes)
        order = np.argsort(lists, axis=None, kind="stable")  # the askers of each cell side by side
        listed, asker = lists.ravel()[order], order // lists.shape[1]
        wanted = np.zeros(len(centres), dtype=bool)
        wanted[listed] = True
        # shelves of many askers first, whose vectors raise the bounds of most queries
        for other in np.argsort(-np.bincount(shelves[listed], minlength=shelves.max() + 1), kind="stable").tolist():
            here = wanted & (shelves == other)
            if not here.any():
                continue
            for chunk in _row_groups(folder, other, here, s):
                for c, (others, y, along, size, codes) in by_cell(chunk, here):
                    askers = asker[np.searchsorted(listed, c) : np.searchsorted(listed, c, side="right")]
                    askers = askers[cell[askers] != c]
                    coded = np.c_[told(centres[c], along, size, codes), size, np.ones_like(size)]
                    for i in range(0, len(askers), 512):
                        at = askers[i : i + 512]
                        # what the tables allow for and the bound are two more columns of the product
                        score = coded @ np.c_[x[at], allowed[at], -np.maximum(best.bound[at], np.float32(-4))].T
                        u, v = np.divmod(np.flatnonzero(score.ravel() >= 0), len(at))
                        best.add(at[v], u, (y, others))
        best.merge()
        return pa.RecordBatch.from_arrays([pa.array(ids[best.of]), pa.array(best.other), pa.array(best.exact)], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in batch.column(0).to_pylist():
                yield answers(*tasks[n])

    return run


def most_similar(df: DataFrame, row_id: Column, embedding: Column, k: int = 5, settings: Settings | None = None) -> DataFrame:
    """``id, other, similarity, rank``: the ``k`` vectors most similar to each vector, by cosine.

    Rows of a null id and those whose embedding is null, all zero, not finite or not of the set dimension take no part.
    Ties go to the lesser id. Equal vectors (to a millionth) are indexed and searched once; each row
    then finds its own copies first, of which only the ``k + 1`` least ids can matter. Other columns
    aren't read. The result is approximate: what no visited cell holds isn't found.
    """
    s = settings or Settings()
    spark = df.sparkSession
    rows = df.select(row_id.cast("bigint").alias("id"), embedding.cast("array<float>").alias("e")).where((F.size("e") == s.dimension) & F.col("id").isNotNull())
    units = spread(rows).mapInArrow(_unit_vectors(s.dimension), "id bigint, cls bigint, vector binary")
    members = cut(units.select("id", "cls"))
    ranked = Window.partitionBy("cls").orderBy("id")
    least = members.withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= k + 1)
    count = members.select("cls").distinct().count()
    if not count:
        return spark.createDataFrame([], "id bigint, other bigint, similarity double, rank int")
    cells = max(1, round(count / s.cell if s.cell else count**0.5))
    drawn = _drawn(units, count, max(s.sample, 30 * cells), 0)  # a bounded number of rows
    sample = _matrix(drawn["vector"], s.dimension)
    centres, books = fit(sample, cells, s)
    size = max(1, round(s.group * count / len(centres)))
    shelves = _grouped(centres, np.bincount(_nearest(sample, centres), minlength=len(centres)) * (count / len(sample)), size)
    shared = spark.sparkContext.broadcast((centres, books, shelves))
    with shared_folder(spark) as folder:
        (
            units.select("cls", "vector")
            .mapInArrow(_assign(shared, s), "cls bigint, vector binary, cell int, shelf int")
            .repartition(int(shelves.max()) + 1, "shelf")
            .sortWithinPartitions("cell", "cls")
            .mapInArrow(_place(shared, s), "cls bigint, vector binary, cell int, shelf int, along float, size float, codes binary")
            .write.option("compression", "none").option("parquet.enable.dictionary", "false").option("parquet.block.size", s.block * (4 * s.dimension + s.parts + 40))
            .partitionBy("shelf").parquet(f"{folder}/shelves")
        )
        counts, probes = survey(spark.read.parquet(f"{folder}/shelves"), count, centres, k, s)
        tasks = []
        for shelf, held in enumerate(np.bincount(shelves, counts).astype(int).tolist()):
            turns = -(-held // max(4096, size // 2))
            tasks += [(shelf, held * t // turns, held * (t + 1) // turns) for t in range(turns)]
        index = spark.sparkContext.broadcast((centres, books, shelves, probes))
        top = cut(spark.range(0, len(tasks), 1, len(tasks)).mapInArrow(_search(index, f"{folder}/shelves", tasks, k, s), "cls bigint, other bigint, similarity double"))
    if counts.sum() != count:  # a vector between two cells and its copy are in one each
        top = top.where("cls <> other").groupBy("cls", "other").agg(F.max("similarity").alias("similarity"))

    # from classes to rows: a row's own copies, then the members of the classes found
    copies = members.join(least.select("cls", F.col("id").alias("other")), "cls").where("id <> other").select("id", "other", F.lit(1.0).alias("similarity"))
    # Spark takes the answers for as small as the list of tasks and would broadcast them, hence the hints
    named = top.withColumnRenamed("other", "there").hint("merge").join(least.select(F.col("cls").alias("there"), F.col("id").alias("other")), "there")
    nearest = Window.partitionBy("cls").orderBy(F.desc("similarity"), "other")
    found = members.join(named.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k).hint("merge"), "cls")
    best = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    return (
        copies.unionByName(found.select("id", "other", "similarity"))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("id", "other", "similarity", "rank")
    )


def similar_pairs(neighbours: DataFrame, least: float) -> DataFrame:
    """Unordered pairs of which one is among the other's neighbours, at ``least`` similarity or more."""
    return neighbours.where(F.col("similarity") >= least).select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
