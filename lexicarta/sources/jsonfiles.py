"""Chunk, query, result and judgement files in JSON, and comparison tables in CSV."""

from __future__ import annotations

import csv
import json
from collections.abc import Sequence
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexicarta.operators.comparison import csv_lines
from lexicarta.schemas import JUDGEMENT, QUERIES_FILE, RESULTS_FILE


def read_chunks(spark: SparkSession, path: str, metadata: str) -> DataFrame:
    """``content, metadata`` of files that hold an array of chunks. ``metadata``: its fields as DDL."""
    return spark.read.schema(f"content string, metadata struct<{_fields(metadata)}>").option("multiLine", True).json(path)


def _fields(ddl: str) -> str:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).simpleString()[len("struct<") : -1]


def write_chunks(chunks: DataFrame, path: str) -> None:
    """One JSON object a line; nulls are kept."""
    chunks.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, query_text`` of query files."""
    return spark.read.schema(QUERIES_FILE).option("multiLine", True).json(path).select(F.explode("queries").alias("q")).select("q.query_id", "q.query_text")


def inline_queries(spark: SparkSession, texts: list[str]) -> DataFrame:
    """Queries ``q1``, ``q2`` ... of the given texts."""
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts, 1)], "query_id string, query_text string")


def write_results(hits: DataFrame, queries: DataFrame, path: str, metadata: dict[str, str]) -> None:
    """Result files: an object with the run's metadata and each query's hits by rank."""
    fields = ["id", "score", "content", "source_file", "page_number", "chunk_type", "preview"]
    shaped = hits.select("query_id", F.struct("rank", *[F.col(c) if c in hits.columns else F.lit(None).alias(c) for c in fields]).alias("h"))
    lists = shaped.groupBy("query_id").agg(F.sort_array(F.collect_list("h")).alias("h"))
    rows = queries.join(lists, "query_id", "left").select(
        "query_id", "query_text", F.transform(F.coalesce("h", F.array().cast(lists.schema["h"].dataType)), lambda h: h.dropFields("rank")).alias("results")
    )
    given = F.create_map(*[F.lit(x) for kv in metadata.items() for x in kv]) if metadata else F.lit(None).cast("map<string,string>")
    rows.select(given.alias("metadata"), F.array(F.struct("query_id", "query_text", "results")).alias("queries")).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, query_text, rank`` and the hit's fields of result files; ranks are places in the list from 1.

    ValueError if a file has no ``queries``.
    """
    files = spark.read.schema(RESULTS_FILE).option("multiLine", True).json(path)
    if files.where("queries is null").limit(1).count():
        raise ValueError(f"{path} holds a file without queries")
    queries = files.select(F.explode("queries").alias("q"))
    return queries.select("q.query_id", "q.query_text", F.posexplode("q.results").alias("pos", "hit")).select("query_id", "query_text", (F.col("pos") + 1).cast("bigint").alias("rank"), "hit.*")


def read_judgements(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, query_text, relevant_doc_ids, pos`` of judgement files, which hold an array or an object with ``queries``.

    ValueError if a file is neither.
    """
    text = spark.read.text(path, wholetext=True)
    bare = F.from_json("value", f"array<{JUDGEMENT}>")
    wrapped = F.from_json("value", f"struct<queries: array<{JUDGEMENT}>>")["queries"]
    both = text.select(F.when(F.ltrim("value").startswith("["), bare).otherwise(wrapped).alias("queries"))
    if both.where("queries is null").limit(1).count():
        raise ValueError(f"{path} holds neither an array nor an object with queries")
    return both.select(F.posexplode("queries").alias("pos", "q")).select("q.query_id", "q.query_text", "q.relevant_doc_ids", "pos")


def write_judgements(truth: DataFrame, path: str) -> None:
    """One object with all queries and their number. Judgements are small: they are gathered and written as one file."""
    queries = [{"query_id": r.query_id, "query_text": r.query_text, "relevant_doc_ids": list(r.relevant_doc_ids or ())} for r in truth.orderBy("query_id").toLocalIterator()]
    document = {"queries": queries, "metadata": {"num_queries": len(queries), "format_version": "1.0"}}
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(document, indent=2, ensure_ascii=False), encoding="utf-8")


def write_evaluation(queries: DataFrame, means: DataFrame, covered: DataFrame, ks: Sequence[int], path: str, metadata: dict[str, object] | None = None) -> None:
    """An evaluation as one file: time, cut-offs, means, each query's figures and the numbers of queries.

    ``queries`` are per-query figures, ``means`` ``metric, value``, ``covered`` one row of ``evaluation.coverage``. Judged queries are few: they are gathered.
    """
    document: dict[str, object] = {
        "timestamp": datetime.now().isoformat(), "k_values": list(ks), "aggregate": {r["metric"]: r["value"] for r in means.orderBy("metric").collect()},
        "per_query": {str(r["query_id"]): {k: v for k, v in r.asDict().items() if k != "query_id"} for r in queries.orderBy("query_id").toLocalIterator()},
        "summary": {k: covered.first()[k] for k in ("queries_evaluated", "total_queries")},
    }
    if metadata:
        document["original_metadata"] = metadata
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(document, indent=2, ensure_ascii=False), encoding="utf-8")


EVALUATION = "timestamp string, k_values array<int>, aggregate map<string, double>, summary struct<queries_evaluated: bigint, total_queries: bigint>"


def read_evaluations(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Saved evaluations as ``experiment, position, metric, value`` and ``experiment, position, queries_evaluated, timestamp``, named by their files.

    Files that can't be read are skipped; ValueError if none can.
    """
    rows = []
    for position, path in enumerate(paths):
        try:
            found = json.loads(Path(path).read_text(encoding="utf-8"))
            values = {str(k): float(v) for k, v in found["aggregate"].items()}
        except (OSError, ValueError, KeyError, TypeError, AttributeError):
            continue
        rows.append((Path(path).stem, position, values, found.get("summary", {}).get("queries_evaluated"), found.get("timestamp")))
    if not rows:
        raise ValueError(f"no evaluation can be read of {', '.join(paths) or 'none'}")
    runs = spark.createDataFrame(rows, "experiment string, position int, aggregate map<string, double>, queries_evaluated bigint, timestamp string")
    return runs.select("experiment", "position", F.explode("aggregate").alias("metric", "value")), runs.drop("aggregate")


def write_comparison_file(table: DataFrame, names: Sequence[str], about: DataFrame, path: str) -> None:
    """One CSV file: a row a metric, then a blank row and each experiment's name, evaluated queries and time. A few hundred rows at most."""
    found = [["Metric", *names], *[list(r) for r in csv_lines(table, names).orderBy("metric").collect()], [], ["Metadata"]]
    found += [[r["experiment"], r["queries_evaluated"], r["timestamp"]] for r in about.orderBy("position").collect()]
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as out:
        csv.writer(out).writerows(found)


def write_comparison(table: DataFrame, names: list[str], path: str) -> None:
    """Comparison with four places a value, sorted by metric."""
    csv_lines(table, names).withColumnRenamed("metric", "Metric").orderBy("Metric").coalesce(1).write.mode("overwrite").option("header", True).csv(path)
