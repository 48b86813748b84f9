"""Retrieval metrics over ranked results and relevance judgements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DEFAULT_KS = (1, 3, 5, 10)


def resolved_ids(results: DataFrame, mode: str = "truthy") -> DataFrame:
    """``query_id, rank, doc_id`` from rows with ``id, alt_id, chunk_id``.

    ``truthy`` takes the first of the three that is neither null nor zero, and for a zero at the
    end that zero; ``coalesce`` the first that isn't null. Rows without an id are dropped and the
    rest ranked anew.
    """
    columns = [F.col(c) for c in ("id", "alt_id", "chunk_id")]
    if mode == "truthy":
        doc = F.coalesce(*[F.when(c != 0, c) for c in columns[:2]], columns[2])
    elif mode == "coalesce":
        doc = F.coalesce(*columns)
    else:
        raise ValueError(f"mode {mode!r} is neither truthy nor coalesce")
    kept = results.withColumn("doc_id", doc.cast("string")).where("doc_id is not null")
    again = Window.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("rank", F.row_number().over(again).cast("bigint")).select("query_id", "rank", "doc_id")


def per_query(results: DataFrame, qrels: DataFrame, ks: Sequence[int] = DEFAULT_KS, graded: bool = False) -> DataFrame:
    """One row per evaluated query: ``precision@k, recall@k, f1@k, hit_rate@k, ndcg@k, mrr, map, num_retrieved, num_relevant``.

    ``results`` has ``query_id, rank, doc_id``; ``qrels`` ``query_id, doc_id`` and, if ``graded``,
    ``grade``. Ids are compared as text; a judgement that is given twice counts once, with its
    greatest grade. Queries without judgements or without results aren't evaluated. Precision divides by k
    even when fewer were found; a document found twice counts twice. A grade of 0 is relevant to
    all but nDCG. Columns are named ``precision_at_1`` and so on.
    """
    grade = F.col("grade").cast("double") if graded else F.lit(1.0)
    judged = qrels.where("doc_id is not null").groupBy("query_id", F.col("doc_id").cast("string").alias("doc_id")).agg(F.max(grade).alias("grade"))
    best = Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id")
    ranked = judged.withColumn("place", F.row_number().over(best))
    ideals = [F.sum(F.when(F.col("place") <= k, F.col("grade") / F.log2(F.col("place") + 1.0))).alias(f"ideal_{k}") for k in ks]
    totals = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("num_relevant"), *ideals)

    marked = results.select("query_id", "rank", F.col("doc_id").cast("string").alias("doc_id")).join(judged, ["query_id", "doc_id"], "left")
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("rel", F.col("grade").isNotNull().cast("int")).withColumn("hits", F.sum("rel").over(upto))
    parts = [F.count(F.lit(1)).alias("num_retrieved"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"), F.sum(F.when(F.col("rel") == 1, F.col("hits") / F.col("rank"))).alias("precisions")]
    for k in ks:
        parts += [
            F.coalesce(F.sum(F.when(F.col("rank") <= k, F.col("rel"))), F.lit(0)).alias(f"hits_{k}"),
            F.coalesce(F.sum(F.when(F.col("rank") <= k, F.col("grade") / F.log2(F.col("rank") + 1.0))), F.lit(0.0)).alias(f"gain_{k}"),
        ]
    sums = marked.groupBy("query_id").agg(*parts).join(totals, "query_id")
    out = ["query_id"]
    for k in ks:
        precision = F.col(f"hits_{k}") / F.lit(float(k)) if k > 0 else F.lit(0.0)
        recall = F.col(f"hits_{k}") / F.col("num_relevant")
        out += [
            precision.alias(f"precision_at_{k}"),
            recall.alias(f"recall_at_{k}"),
            F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias(f"f1_at_{k}"),
            (F.col(f"hits_{k}") > 0).cast("double").alias(f"hit_rate_at_{k}"),
            F.when(F.col(f"ideal_{k}") > 0, F.col(f"gain_{k}") / F.col(f"ideal_{k}")).otherwise(0.0).alias(f"ndcg_at_{k}"),
        ]
    return sums.select(
        *out, F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), F.coalesce(F.col("precisions") / F.col("num_relevant"), F.lit(0.0)).alias("map"), "num_retrieved", "num_relevant"
    )


def metric_names(ks: Sequence[int] = DEFAULT_KS) -> list[str]:
    """Names of the averaged columns."""
    return [*(f"{m}_at_{k}" for k in ks for m in ("precision", "recall", "f1", "hit_rate", "ndcg")), "mrr", "map"]


def averages(queries: DataFrame, ks: Sequence[int] = DEFAULT_KS) -> DataFrame:
    """``metric, value``: means over the evaluated queries; no rows for no queries."""
    names = metric_names(ks)
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])).alias("e")
    return queries.select(pairs).groupBy("e.metric").agg(F.avg("e.value").alias("value"))


def coverage(results: DataFrame, qrels: DataFrame) -> DataFrame:
    """One row: queries with results, evaluated, and skipped for want of judgements."""
    asked = results.select("query_id").distinct()
    judged = qrels.where("doc_id is not null").select("query_id", F.lit(1).alias("judged")).distinct()
    return asked.join(judged, "query_id", "left").agg(
        F.count(F.lit(1)).alias("total_queries"), F.count("judged").alias("queries_evaluated"), F.count_if(F.col("judged").isNull()).alias("queries_skipped")
    )
