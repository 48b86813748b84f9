"""Relevance judgements: loading rules, validation, statistics and templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexicarta.functions.text import is_blank, listed_ids, strip


def last_wins(entries: DataFrame) -> DataFrame:
    """``query_id, query_text, relevant_doc_ids`` with the last of the entries of each query.

    ``entries`` also has ``pos``, the place in the file; entries without a query id are dropped, ties in ``pos`` go to the
    greater text.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("pos"), F.desc("query_text"))
    return (
        entries.where("query_id is not null").withColumn("_n", F.row_number().over(order)).where("_n = 1").select("query_id", "query_text", "relevant_doc_ids")
    )


def add_queries(truth: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or replace by query id."""
    columns = ["query_id", "query_text", "relevant_doc_ids"]
    return last_wins(truth.select(*columns, F.lit(0).alias("pos")).unionByName(new.select(*columns, F.lit(1).alias("pos"))))


def qrels(truth: DataFrame) -> DataFrame:
    """``query_id, doc_id``, each pair once; null ids are dropped."""
    return truth.select("query_id", F.explode("relevant_doc_ids").alias("doc_id")).where("doc_id is not null").distinct()


def from_batch(rows: DataFrame) -> DataFrame:
    """Judgements from ``query_id, query_text, relevant_docs`` with comma-separated ids.

    Rows whose id or text is null or blank are dropped; those without any relevant id are kept.
    """
    kept = rows.where(~is_blank(F.col("query_id")) & ~is_blank(F.col("query_text")))
    return kept.select("query_id", strip(F.col("query_text")).alias("query_text"), F.coalesce(listed_ids(F.col("relevant_docs")), F.array().cast("array<string>")).alias("relevant_doc_ids"))


def validation(truth: DataFrame) -> DataFrame:
    """Per query ``blank_text`` (an error), ``no_relevant`` and ``repeated_relevant`` (warnings) and ``valid``."""
    n = F.coalesce(F.size("relevant_doc_ids"), F.lit(0))
    blank = F.coalesce(is_blank(F.col("query_text")), F.lit(True))
    return truth.select(
        "query_id", blank.alias("blank_text"), (n == 0).alias("no_relevant"),
        F.coalesce(F.size(F.array_distinct("relevant_doc_ids")) < n, F.lit(False)).alias("repeated_relevant"), (~blank).alias("valid"),
    )


def is_valid(truth: DataFrame) -> DataFrame:
    """One row ``valid``: there are queries and none has a blank text."""
    return validation(truth).agg((F.coalesce(F.bool_and("valid"), F.lit(False))).alias("valid"))


def statistics(truth: DataFrame) -> DataFrame:
    """One row: queries, their numbers of relevant ids, repeats included, and how many have metadata; zeros for no queries.

    A query has metadata if its column ``metadata``, a map, is there and not empty.
    """
    n = F.coalesce(F.size("relevant_doc_ids"), F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0))
    described = F.count_if(F.coalesce(F.size("metadata") > 0, F.lit(False))) if "metadata" in truth.columns else F.lit(0).cast("bigint")
    return truth.agg(
        F.count(F.lit(1)).alias("num_queries"), zero(F.sum(n)).alias("total_relevant"), F.coalesce(F.avg(n), F.lit(0.0)).alias("avg_relevant"),
        zero(F.min(n)).alias("min_relevant"), zero(F.max(n)).alias("max_relevant"), described.alias("queries_with_metadata"),
    )


def template(spark: SparkSession, queries: int = 5) -> DataFrame:
    """Example judgements to fill in."""
    return spark.range(1, queries + 1).select(
        F.format_string("q%d", "id").alias("query_id"), F.format_string("Example query %d", "id").alias("query_text"),
        F.array(F.format_string("doc_%d", F.col("id")), F.format_string("doc_%d", F.col("id") + 1)).alias("relevant_doc_ids"),
    )
