"""Exact and inverted-file nearest-neighbour search over tables of vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexicarta.functions import clusters
from lexicarta.functions.clusters import matrix
from lexicarta.functions.vectors import normalise
from lexicarta.runtime import cut
from lexicarta.settings import StoreSettings, top_k

METRICS = ("IP", "L2", "COSINE")
#: Queries that go to the tasks at once; a larger query set is searched in several such blocks.
QUERY_BLOCK = 8192


def _scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "L2":
        return (q**2).sum(1)[:, None] - 2 * q @ x.T + (x**2).sum(1)[None, :]
    if metric == "COSINE":
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    return q @ x.T


def _best(keys: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the ``k`` least keys, ties by the lesser id."""
    order = np.lexsort((ids, keys, rows))
    keys, ids, rows = keys[order], ids[order], rows[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return keys[keep], ids[keep], rows[keep]


_HITS = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])


def _kernel(shared, metric: str, k: int):
    """The best ``k`` of all a task's rows for each query, by blocks of a dense product; they leave the task once, at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = shared.value
        sign = 1 if metric == "L2" else -1
        keys, ids, rows = np.empty(0), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        bound = np.full(len(q), np.inf)
        for batch in batches:
            step = max(64, 4_000_000 // max(1, len(q)))
            for at in range(0, batch.num_rows if len(q) else 0, step):
                part = batch.slice(at, step)
                found = part.column(0).to_numpy()
                key = sign * np.round(_scores(q, matrix(part.column(1), q.shape[1]), metric), 9)
                if len(found) > k:
                    bound = np.minimum(bound, np.partition(key, k - 1, axis=1)[:, k - 1])
                r, c = np.nonzero(key <= bound[:, None])
                keys, ids, rows = _best(np.r_[keys, key[r, c]], np.r_[ids, found[c]], np.r_[rows, r], k)
                full = np.bincount(rows, minlength=len(q)) == k
                bound[full] = np.minimum(bound[full], keys[np.searchsorted(rows, np.flatnonzero(full), side="right") - 1])
        yield pa.RecordBatch.from_arrays([pa.array(names[rows]), pa.array(ids), pa.array(sign * keys)], schema=_HITS)

    return run


def exact_top_k(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "IP", query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, id, score`` of the ``k`` best rows for each query.

    ``queries`` has ``query_id bigint, vector array<float>``, ``corpus`` ``id bigint, vector``. IP and
    COSINE rank downwards, L2 gives squared distances and ranks upwards; ties go to the lesser id.
    Scores are rounded to nine places. Null ids, null vectors and those of another length than the queries' give no hits; fewer than
    ``k`` rows give fewer hits. Queries go to the tasks in blocks of ``query_block``, whose best
    rows are kept in each task, so only ``k`` rows a query and task are shuffled.
    """
    if metric not in METRICS:
        raise ValueError(f"metric {metric!r} is none of {METRICS}")
    if k < 1:
        raise ValueError("k must be positive")
    spark = corpus.sparkSession
    asked = queries.where("vector is not null and query_id is not null").select(F.col("query_id").cast("bigint").alias("query_id"), "vector")
    first = asked.limit(query_block + 1).toPandas()
    blocks = 1 if len(first) <= query_block else -(-asked.count() // query_block)
    found = None
    for b in range(blocks):
        rows = first if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toPandas()  # about query_block rows
        width = len(rows["vector"].iloc[0]) if len(rows) else 0
        matrix_ = np.array(rows["vector"].to_list(), dtype=np.float64).reshape(len(rows), width)
        shared = spark.sparkContext.broadcast((rows["query_id"].to_numpy(dtype=np.int64), matrix_))
        narrow = corpus.where((F.size("vector") == width) & F.col("id").isNotNull()).select(F.col("id").cast("bigint").alias("id"), "vector")
        hits = narrow.mapInArrow(_kernel(shared, metric, k), "query_id bigint, id bigint, score double")
        found = hits if found is None else found.unionByName(hits)
    return ranked(found, k, metric)


def ranked(hits: DataFrame, k: int, metric: str = "IP") -> DataFrame:
    """The best ``k`` of ``query_id, id, score`` with their rank."""
    order = F.col("score") if metric == "L2" else F.desc("score")
    best = Window.partitionBy("query_id").orderBy(order, "id")
    return hits.withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def with_payload(hits: DataFrame, collection: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Hits with columns of the collection, fetched after scoring.

    ``fields``: columns to add, those the collection lacks are skipped; none named means all but
    the vector. A missing preview is filled from the content. Hits without a row keep nulls.
    """
    have = [c for c in collection.columns if c not in ("id", "vector")]
    wanted = [c for c in (fields or have) if c in have]
    side = collection.select("id", *dict.fromkeys([*wanted, *(["content"] if "content" in have else [])]))
    joined = hits.join(side, "id", "left")
    if "preview" in wanted and "content" in have:
        joined = joined.withColumn("preview", F.coalesce("preview", F.substring("content", 1, 200)))
    return joined.select(*hits.columns, *[c for c in wanted if c not in hits.columns])


def _meet(metric: str, k: int):
    """Of each query of a block the best ``k`` rows of the block."""

    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        if not held.num_rows or not asked.num_rows:
            return _HITS.empty_table()
        ids, names = held.column("id").to_numpy(), asked.column("query_id").to_numpy()
        width = len(held.column("vector")[0])
        x, q = (matrix(c.combine_chunks(), width) for c in (held.column("vector"), asked.column("asked")))
        sign, out = 1 if metric == "L2" else -1, []
        for at in range(0, len(q), step := max(1, 4_000_000 // len(x))):
            key = sign * np.round(_scores(q[at : at + step], x, metric), 9)
            bound = np.partition(key, k - 1, axis=1)[:, k - 1] if len(x) > k else np.full(len(key), np.inf)
            r, c = np.nonzero(key <= bound[:, None])
            keys, found, rows = _best(key[r, c], ids[c], r, k)
            out.append(pa.table([pa.array(names[at : at + step][rows]), pa.array(found), pa.array(sign * keys)], schema=_HITS))
        return pa.concat_tables(out)

    return run


def reparsed(hits: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``hits`` with the named fields, which hold nested values as JSON text, as variants again.

    Text that isn't JSON stays a text (as a variant), null stays null, fields that ``hits`` lacks are skipped.
    """
    for field in fields:
        if field in hits.columns:
            text = F.variant_get(F.parse_json(F.to_json(F.struct(F.col(field).alias("v")))), "$.v", "variant")
            hits = hits.withColumn(field, F.when(F.col(field).isNotNull(), F.coalesce(F.try_parse_json(field), text)))
    return hits


@dataclass(frozen=True)
class InvertedFile:
    """Coarse centroids; fitted on at most about ``sample`` rows. A stored one has its rows below ``path``, by list."""

    centres: np.ndarray
    path: str | None = None

    @staticmethod
    def fit(corpus: DataFrame, lists: int | None = None, sample: int = 50_000, seed: int = 11, rounds: int = 10) -> InvertedFile:
        """K-means over a bounded sample of ``corpus (id, vector)``, drawn by a hash of the id.

        Without ``lists`` their number is the square root of the number of rows, and ``sample`` is at least 32 rows a list.
        Vectors must be of one length; the first's length decides which rows count.
        """
        held = corpus.where("vector is not null and id is not null")
        count = held.count()
        if lists is None:
            lists = max(2, round(count**0.5))
            sample = max(sample, 32 * lists)
        rows = clusters.drawn(held, F.col("id"), count, sample).select("vector").toPandas()["vector"]
        width = len(rows.iloc[0]) if len(rows) else 0
        x = np.array([v for v in rows if len(v) == width], dtype=np.float64).reshape(-1, width)
        return InvertedFile(clusters.kmeans(x, lists, rounds, seed) if len(x) else np.zeros((1, 1)))

    def store(self, corpus: DataFrame, path: str) -> InvertedFile:
        """Write the rows ``id, vector`` below ``path``, a folder for each list, with the centroids beside them; a search reads the lists it visits only."""
        self.assign(corpus.where("id is not null").select(F.col("id").cast("bigint").alias("id"), "vector")).repartition("list_id").write.mode("overwrite").partitionBy("list_id").parquet(f"{path}/rows")
        centres = [(i, [float(v) for v in c]) for i, c in enumerate(self.centres)]
        corpus.sparkSession.createDataFrame(centres, "list_id int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
        return InvertedFile(self.centres, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> InvertedFile:
        """An index that ``store`` wrote."""
        rows = spark.read.parquet(f"{path}/centres").orderBy("list_id").collect()  # a row a list
        return InvertedFile(np.array([r["centre"] for r in rows]), path)

    def _nearest(self, x: np.ndarray) -> np.ndarray:
        """Every list for each row, the nearest first."""
        return np.argsort((self.centres**2).sum(1)[None, :] - 2 * x @ self.centres.T, axis=1, kind="stable")

    def assign(self, df: DataFrame, probes: int = 1) -> DataFrame:
        """``df`` with ``list_id``: one row for each of the ``probes`` nearest centroids."""
        shared = df.sparkSession.sparkContext.broadcast(self.centres)

        @F.pandas_udf("array<int>")
        def nearest(vectors: pd.Series) -> pd.Series:
            x = np.array(vectors.to_list(), dtype=np.float64).reshape(len(vectors), -1)
            return pd.Series(list(InvertedFile(shared.value)._nearest(x)[:, :probes].astype(np.int32)))

        return df.where(F.size("vector") == self.centres.shape[1]).withColumn("list_id", F.explode(nearest("vector")))

    def probes_for(self, queries: DataFrame, corpus: DataFrame, k: int, metric: str = "IP", recall: float = 0.9, sample: int = 1024) -> int:
        """The fewest lists to visit for a mean recall of ``recall`` against ``exact_top_k``.

        Measured on about ``sample`` queries, drawn by a hash of their id, or all of fewer. Of a larger set the mean less two
        standard errors must reach ``recall``. Where a query's true hits lie is told by the lists of these rows.
        """
        usable = queries.where((F.size("vector") == self.centres.shape[1]) & F.col("query_id").isNotNull()).select(F.col("query_id").cast("bigint").alias("query_id"), "vector")
        count = usable.count()
        whole = count <= sample
        asked = clusters.drawn(usable, F.col("query_id"), count, sample).toPandas()  # about `sample` rows
        drawn = queries.sparkSession.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(asked["query_id"], asked["vector"])], "query_id bigint, vector array<double>")
        true = exact_top_k(drawn, corpus, k, metric).select("query_id", "id")
        lists = self.assign(corpus.select(F.col("id").cast("bigint").alias("id"), "vector").join(F.broadcast(true), "id")).select("query_id", "list_id")  # k rows a query
        found = lists.toPandas()
        if not len(found):
            return 1
        place = np.argsort(self._nearest(np.array(asked["vector"].to_list(), dtype=np.float64)), axis=1)  # of each list in each query's order
        row = pd.Series(np.arange(len(asked)), index=asked["query_id"]).groupby(level=0).first()[found["query_id"]].to_numpy()
        counts = np.zeros(place.shape)
        np.add.at(counts, (row, place[row, found["list_id"].to_numpy()]), 1)
        counts = counts[counts.sum(1) > 0]
        got = np.cumsum(counts, axis=1) / counts.sum(1, keepdims=True)
        sure = got.mean(0) - (0 if whole else 2 * got.std(0) / len(got) ** 0.5)
        return int(np.argmax(sure >= min(recall, sure[-1]) - 1e-12)) + 1

    def search(self, queries: DataFrame, corpus: DataFrame, k: int, probes: int | None = None, metric: str = "IP", block: int = 4096) -> DataFrame:
        """Hits from the ``probes`` nearest lists of each query, compared exactly where they meet.

        Without ``probes`` as many lists are visited as ``probes_for`` finds. A list's rows and queries meet in
        blocks of about ``block`` rows each, and only ``k`` rows a query and block are shuffled. A stored index reads its own rows;
        ``corpus`` is then only what recall is measured against.
        """
        if probes is None:
            probes = self.probes_for(queries, corpus, k, metric)
        asked = self.assign(queries.where("query_id is not null").select(F.col("query_id").cast("bigint").alias("query_id"), "vector"), probes)
        if self.path is None:
            held = cut(self.assign(corpus.where("id is not null").select(F.col("id").cast("bigint").alias("id"), "vector")))
        else:
            held = corpus.sparkSession.read.parquet(f"{self.path}/rows")
        turns = {r["list_id"]: r["n"] for r in asked.groupBy("list_id").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a list
        held = held.where(F.col("list_id").isin(*turns) if len(turns) < len(self.centres) else F.lit(True))  # other lists' folders aren't read
        counts = held.groupBy("list_id").agg(F.count(F.lit(1)).alias("n")).collect()
        sizes = [(r["list_id"], -(-r["n"] // block), -(-turns[r["list_id"]] // block)) for r in counts if r["list_id"] in turns]
        sizes = F.broadcast(corpus.sparkSession.createDataFrame(sizes, "list_id int, blocks bigint, turns bigint"))  # a row a list
        keys = ["list_id", "block", "turn"]
        left = held.join(sizes, "list_id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("turn", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("turns") - 1)))
        right = asked.join(sizes, "list_id").withColumn("turn", F.pmod(F.xxhash64("query_id"), F.col("turns"))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        met = left.select(*keys, "id", "vector").groupBy(*keys).cogroup(right.select(*keys, "query_id", F.col("vector").alias("asked")).groupBy(*keys))
        return ranked(met.applyInArrow(_meet(metric, k), "query_id bigint, id bigint, score double"), k, metric)


#: Names of indexes that a store may ask for. A graph index isn't built: the exact search stands behind its name.
INDEXES = ("Flat", "IVF", "HNSW")


def search_by(store: StoreSettings, queries: DataFrame, corpus: DataFrame, k: int | None = None, index: InvertedFile | None = None) -> DataFrame:
    """Hits by a store's settings: its metric, its kind of index, its lists and probes.

    ``index`` is a fitted or stored inverted file for the kind ``IVF``; without one it's fitted. ValueError for an unknown kind.
    """
    if store.index not in INDEXES:
        raise ValueError(f"index {store.index!r} is none of {INDEXES}")
    k = top_k(k, store)
    if store.index != "IVF":
        return exact_top_k(queries, corpus, k, store.metric)
    index = index or InvertedFile.fit(corpus, store.lists)
    return index.search(queries, corpus, k, store.probes, store.metric)


def unit(vector: Column) -> Column:
    """A unit vector as ``array<float>``."""
    return normalise(vector).cast("array<float>")
