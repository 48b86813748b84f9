"""Experiments side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pivoted(results: DataFrame, names: Sequence[str]) -> DataFrame:
    """``metric`` and a column for each experiment; a missing value is 0. ``results`` has ``experiment, metric, value``."""
    return results.groupBy("metric").pivot("experiment", list(names)).agg(F.first("value")).na.fill(0.0)


def marked(results: DataFrame) -> DataFrame:
    """``results`` with ``is_best``: equal to the metric's greatest value and positive."""
    most = F.max("value").over(Window.partitionBy("metric"))
    return results.select("experiment", "metric", "value", ((F.col("value") == most) & (F.col("value") > 0)).alias("is_best"))


def best_experiment(results: DataFrame, metric: str = "ndcg_at_5") -> DataFrame:
    """One row ``experiment, metric, value`` of the greatest value, the first in ``position`` on ties.

    A metric that no experiment has is replaced by the first name in order; an experiment without
    the metric counts as 0; no experiments give no row.
    """
    names = results.agg(F.max(F.when(F.col("metric") == metric, metric)).alias("asked"), F.min("metric").alias("least")).select(F.coalesce("asked", "least").alias("metric"))
    runs = results.groupBy("experiment").agg(F.min("position").alias("position"))
    wanted = results.join(F.broadcast(names), "metric").select("experiment", "metric", "value")  # names is one row
    scored = runs.join(wanted, "experiment", "left")
    filled = scored.select("experiment", "position", F.coalesce("value", F.lit(0.0)).alias("value"), F.coalesce("metric", F.max("metric").over(Window.partitionBy())).alias("metric"))
    return filled.orderBy(F.desc("value"), "position").limit(1).select("experiment", "metric", "value")


def csv_lines(table: DataFrame, names: Sequence[str]) -> DataFrame:
    """The comparison as formatted text columns, four places each."""
    return table.select("metric", *[F.format_string("%.4f", F.col(f"`{n}`")).alias(n) for n in names])
