"""Collections of vectors as Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexicarta.functions.vectors import normalise
from lexicarta.runtime import cut

#: Columns every collection begins with.
BASE = {"id": "bigint", "vector": "array<float>", "content": "string", "preview": "string"}


def inferred_schema(df: DataFrame) -> dict[str, str]:
    """Types of a collection's columns: the base ones, then what ``df`` adds.

    Whole numbers and booleans become ``bigint``, other numbers ``float``, everything else text.
    """
    found = dict(BASE)
    for f in df.schema.fields:
        if f.name in found:
            continue
        if isinstance(f.dataType, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            found[f.name] = "bigint"
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            found[f.name] = "float"
        else:
            found[f.name] = "string"
    return found


def shaped(df: DataFrame, first_id: int = 0, unit: bool = True) -> DataFrame:
    """Rows of a collection: ids from ``first_id`` in the order of ``source_file, chunk_id, content``.

    Numbers are given per range of the sort, so that no task sees all rows: a row's id is the rows in
    the ranges before plus its place in its own. The sorted ranges are written once, and counted and numbered from
    there, so that both see the same ranges. Nested columns become JSON text. Null vectors are kept.
    """
    order = [c for c in ("source_file", "chunk_id", "content") if c in df.columns]
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df)
    marked = ranged.withColumn("_m", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_m", 33))
    sizes = marked.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()  # one row per range
    starts, total = [], first_id
    for row in sizes:
        starts.append((row["_part"], total))
        total += row["n"]
    lookup = df.sparkSession.createDataFrame(starts, "_part bigint, _start bigint")
    place = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = marked.join(F.broadcast(lookup), "_part").withColumn("id", F.col("_start") + place).drop("_m", "_part", "_start")
    if unit:
        numbered = numbered.withColumn("vector", normalise(F.col("vector")).cast("array<float>"))
    if "preview" not in numbered.columns:
        numbered = numbered.withColumn("preview", F.substring("content", 1, 200))
    kinds = inferred_schema(numbered)
    nested = {f.name for f in numbered.schema.fields if f.name not in BASE and isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))}
    return numbered.select(*[F.to_json(c).alias(c) if c in nested else F.col(c).cast(kinds[c]).alias(c) for c in kinds])


class Collection:
    """A named table of vectors below a folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _place(self, *below: str):
        """A path in the collection's file system, and that system."""
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path("/".join([self.path.rstrip("/"), *below]))
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        """Has anything been ingested? A folder of notes only holds nothing."""
        place, files = self._place()
        return files.exists(place) and any(not s.getPath().getName().startswith(("_", ".")) for s in files.listStatus(place))

    def read(self) -> DataFrame:
        """All rows."""
        return self.spark.read.parquet(self.path)

    def _next_id(self) -> int:
        return self.read().agg(F.coalesce(F.max("id"), F.lit(-1)) + 1).first()[0] if self.exists() else 0

    def ingest(self, df: DataFrame, replace: bool = False, unit: bool = True) -> int:
        """Write rows and return how many there are now. Appended rows continue the ids.

        One writer at a time: two at once would give the same ids.
        """
        first = 0 if replace else self._next_id()
        before = self.read().count() if first else 0
        rows = shaped(df, first, unit)
        rows.write.mode("overwrite" if replace or not self.exists() else "append").parquet(self.path)
        found = self.read().agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last")).first()
        if found["n"] and found["last"] - first + 1 != found["n"] - before:
            raise RuntimeError(f"{self.path}: {found['n'] - before} rows were added under {found['last'] - first + 1} ids")
        return found["n"]

    def ingest_once(self, df: DataFrame, name: str, unit: bool = True) -> int:
        """``ingest`` of a batch that may come again: one of a known ``name`` is written only if it isn't there yet.

        Before a batch is written its first id is noted below ``_batches``, which readers don't see. As there is one
        writer, rows from that id on are this batch's.
        """
        place, files = self._place("_batches")
        noted = {s.getPath().getName() for s in files.listStatus(place)} if files.exists(place) else set()
        firsts = [int(n.rpartition(".first-")[2]) for n in noted if n.startswith(f"{name}.first-")]
        if f"{name}.done" in noted:
            return self.read().count()
        if not firsts:
            note, _ = self._place("_batches", f"{name}.first-{self._next_id()}")
            files.create(note).close()
        if not firsts or self._next_id() <= firsts[0]:
            shaped(df, self._next_id(), unit).write.mode("append").parquet(self.path)
        done, _ = self._place("_batches", f"{name}.done")
        files.create(done).close()
        return self.read().count() if self.exists() else 0

    def statistics(self) -> dict[str, object]:
        """Name, number of vectors, dimension and column types; ``error`` if there is none."""
        if not self.exists():
            return {"error": f"no collection at {self.path}"}
        rows = self.read()
        found = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
        return {"name": self.path.rstrip("/").rpartition("/")[2], "num_vectors": found["n"], "dimension": found["d"], "schema": dict(rows.dtypes)}

    def delete(self) -> bool:
        """Remove the table; False if there is none."""
        place, files = self._place()
        return files.exists(place) and files.delete(place, True)
