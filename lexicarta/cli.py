"""Commands over the operators: chunk, ingest, query, evaluate, compare and truth."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexicarta.operators import comparison, embedding, evaluation, ground_truth, retrieval, statistics
from lexicarta.plans import pipeline
from lexicarta.schemas import METADATA
from lexicarta.settings import StoreSettings, top_k
from lexicarta.sources import jsonfiles
from lexicarta.sources.collection import Collection


def ingest(spark: SparkSession, chunks: str, collection: str, replace: bool, model: embedding.Embedder) -> int:
    """Embed chunk files into a collection; the number of its rows."""
    rows = jsonfiles.read_chunks(spark, chunks, METADATA).select("content", "metadata.*")
    return Collection(spark, collection).ingest(embedding.embed(rows, F.col("content"), model), replace)


def query(spark: SparkSession, queries: DataFrame, collection: str, store: StoreSettings, model: embedding.Embedder) -> DataFrame:
    """Hits with their payload for ``query_id, query_text``, by the store's metric and kind of index."""
    asked = embedding.embed(queries, F.col("query_text"), model).withColumn("_key", F.xxhash64("query_id"))
    rows = Collection(spark, collection).read()
    hits = retrieval.search_by(store, asked.select(F.col("_key").alias("query_id"), "vector"), rows.select("id", "vector"))
    named = hits.withColumnRenamed("query_id", "_key").join(asked.select("_key", "query_id"), "_key").drop("_key")
    return retrieval.with_payload(named, rows, ["source_file", "page_number", "chunk_type", "preview", "content"])


def evaluate(spark: SparkSession, results: str, truth: str, ks: tuple[int, ...], save: str | None = None) -> DataFrame:
    """``metric, value`` of a result file; with ``save``, a folder, the evaluation is written there under the result file's name."""
    judged = ground_truth.qrels(ground_truth.last_wins(jsonfiles.read_judgements(spark, truth)))
    hits = jsonfiles.read_results(spark, results).select("query_id", "rank", F.col("id").cast("string").alias("doc_id"))
    found = evaluation.per_query(hits, judged, ks)
    means = evaluation.averages(found, ks)
    if save:
        jsonfiles.write_evaluation(found, means, evaluation.coverage(hits, judged), ks, str(Path(save) / f"{Path(results).stem}.json"), {"results": results})
    return means


def compare(runs: dict[str, DataFrame]) -> DataFrame:
    """``metric`` and a column per run of ``metric, value`` tables."""
    every = None
    for name, table in runs.items():
        part = table.select(F.lit(name).alias("experiment"), "metric", "value")
        every = part if every is None else every.unionByName(part)
    return comparison.pivoted(every, list(runs))


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lexicarta", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("chunk", help="files into chunk files")
    one.add_argument("folder")
    one.add_argument("output")
    one.add_argument("--types", nargs="*", default=["all"])
    one = commands.add_parser("ingest", help="chunk files into a collection")
    one.add_argument("chunks")
    one.add_argument("collection")
    one.add_argument("--replace", action="store_true")
    one = commands.add_parser("query", help="search a collection")
    one.add_argument("collection")
    one.add_argument("output")
    one.add_argument("--query", nargs="*", default=[])
    one.add_argument("--queries", help="a query file")
    one.add_argument("--top-k", type=int, default=0)
    one.add_argument("--metric", choices=retrieval.METRICS, default="IP")
    one.add_argument("--index", choices=retrieval.INDEXES, default="Flat")
    one = commands.add_parser("evaluate", help="score result files")
    one.add_argument("truth")
    one.add_argument("results", nargs="+")
    one.add_argument("--k", type=int, nargs="*", default=list(evaluation.DEFAULT_KS))
    one.add_argument("--csv")
    one.add_argument("--save", help="a folder for one evaluation file of each result file")
    one = commands.add_parser("compare", help="saved evaluations side by side")
    one.add_argument("evaluations", nargs="+")
    one.add_argument("--csv")
    one = commands.add_parser("truth", help="a template of judgements")
    one.add_argument("output")
    one.add_argument("--number", type=int, default=10)
    one.add_argument("--batch", help="a CSV file of query_id, query_text and comma-separated relevant_docs, instead of a template")
    for command in commands.choices.values():
        command.add_argument("--provider", default="hash")
    return parser


def main(argv: list[str] | None = None) -> int:
    """0 if the command went well, else 1."""
    given = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("lexicarta").getOrCreate()
    try:
        if given.command == "chunk":
            chunks, outcomes = pipeline.chunk_folder(spark, given.folder, given.types)
            jsonfiles.write_chunks(chunks, given.output)
            statistics.run_summary(outcomes).orderBy("file_type").show(truncate=False)
        elif given.command == "ingest":
            print(ingest(spark, given.chunks, given.collection, given.replace, embedding.create(given.provider)), "rows")
        elif given.command == "query":
            asked = jsonfiles.read_queries(spark, given.queries) if given.queries else jsonfiles.inline_queries(spark, given.query)
            hits = query(spark, asked, given.collection, StoreSettings(metric=given.metric, index=given.index, top_k=top_k(given.top_k, StoreSettings())), embedding.create(given.provider))
            jsonfiles.write_results(hits, asked, given.output, {"collection_name": given.collection, "embedding_provider": given.provider, "timestamp": datetime.now().isoformat()})
        elif given.command == "evaluate":
            table = compare({path: evaluate(spark, path, given.truth, tuple(given.k), given.save) for path in given.results})
            if given.csv:
                jsonfiles.write_comparison(table, given.results, given.csv)
            table.orderBy("metric").show(200, truncate=False)
        elif given.command == "compare":
            values, about = jsonfiles.read_evaluations(spark, given.evaluations)
            names = [r["experiment"] for r in about.orderBy("position").collect()]
            table = comparison.pivoted(values, names)
            if given.csv:
                jsonfiles.write_comparison_file(table, names, about, given.csv)
            table.orderBy("metric").show(200, truncate=False)
        else:
            batch = spark.read.schema("query_id string, query_text string, relevant_docs string").option("header", True).csv(given.batch) if given.batch else None
            truth = ground_truth.template(spark, given.number) if batch is None else ground_truth.from_batch(batch)
            jsonfiles.write_judgements(truth, given.output)
    except (ValueError, OSError) as problem:
        print(problem, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
