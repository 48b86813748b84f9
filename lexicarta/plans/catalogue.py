"""Queries over the core operators, keyed by name, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexicarta.operators import nested
from lexicarta.plans import chunking_queries, retrieval_queries
from lexicarta.runtime import table

PDF_LISTS = ("table_content", "image_details", "bounding_boxes")
PDF_WRAPPERS = ("document_specific_metadata",)
PDF_GROUPS = tuple(f"{name}[]" for name in PDF_LISTS)


def _pdf_triples(spark: SparkSession, folder: str, groups: tuple[str, ...] | None = None) -> DataFrame:
    return nested.to_triples(table(spark, folder, "pdf_chunks"), "id", "metadata.document_specific_metadata", PDF_LISTS, PDF_WRAPPERS, groups)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Children of each page payload."""
    rows = nested.pivot_groups(_pdf_triples(spark, folder, PDF_GROUPS), ["index", "area", "rows"], PDF_GROUPS)
    return rows.select(F.col("record_id").alias("id"), F.regexp_replace("grp", r"\[\]$", "").alias("child"), F.element_at("ordinals", 1).alias("pos"))


def p2_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The members of each page payload outside its arrays."""
    return nested.record_table(
        _pdf_triples(spark, folder, ("",)), ["total_pages", "num_tables", "num_images", "image_coverage_ratio", "is_vision_processed"]
    ).withColumnRenamed("record_id", "id").drop("record_row")


def p2_images(spark: SparkSession, folder: str) -> DataFrame:
    """The image table: one row per image with its place on the page."""
    rows = nested.child_table(_pdf_triples(spark, folder, ("image_details[]",)), "image_details[]", ["index", "area", "width", "height"])
    return rows.select(F.col("record_id").alias("id"), "pos", "index", F.expr("try_cast(area as double)").alias("area"), F.expr("try_cast(width as double)").alias("width"), F.expr("try_cast(height as double)").alias("height"))


def p2_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The table of a page's tables: one row per table with its place on the page and its text."""
    rows = nested.child_table(_pdf_triples(spark, folder, ("table_content[]",)), "table_content[]", [])
    return rows.select(F.col("record_id").alias("id"), "pos", F.md5("value").alias("digest"), F.length("value").alias("size"))


def p2_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """The table of a page's boxes: one row per box with its place and its rows and columns."""
    rows = nested.child_table(_pdf_triples(spark, folder, ("bounding_boxes[]",)), "bounding_boxes[]", ["rows", "cols"])
    return rows.select(F.col("record_id").alias("id"), "pos", "rows", "cols")


def p2_corners(spark: SparkSession, folder: str) -> DataFrame:
    """The grandchild table of box corners: image or table, its place, the corner's place and value."""
    groups = ("image_details[].bbox[]", "bounding_boxes[].bbox[]")
    rows = nested.pivot_groups(_pdf_triples(spark, folder, groups), [], groups)
    return rows.select(
        F.col("record_id").alias("id"), F.substring_index("grp", "[", 1).alias("parent"), F.element_at("ordinals", 1).alias("parent_pos"),
        F.element_at("ordinals", 2).alias("pos"), F.expr("try_cast(value as double)").alias("corner"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **retrieval_queries.QUERIES,
    **chunking_queries.QUERIES,
    "p2_found": p2_found,
    "p2_pages": p2_pages,
    "p2_images": p2_images,
    "p2_tables": p2_tables,
    "p2_boxes": p2_boxes,
    "p2_corners": p2_corners,
}

#: Payloads that are JSON texts are unwrapped twice, arrays that are texts once; what isn't JSON is no payload.
_PAYLOAD = r"""
    WITH raw AS (SELECT id, regexp_replace(metadata.document_specific_metadata, '^\x{feff}', '') AS j FROM pdf_chunks),
    one AS (SELECT id, CASE WHEN json_valid(j) THEN CASE WHEN json_type(j) = 'VARCHAR' THEN j::JSON->>'$' ELSE j END END AS j FROM raw),
    two AS (SELECT id, CASE WHEN json_valid(j) AND json_type(j) = 'OBJECT' THEN coalesce(j::JSON->'document_specific_metadata', j::JSON) END AS j FROM one),
    p AS (SELECT id, j FROM two WHERE j IS NOT NULL)"""


_PAGE_FIELDS = (
    ("total_pages", "totalPages"), ("num_tables", "numTables"), ("num_images", "numImages"), ("image_coverage_ratio", "imageCoverageRatio"),
    ("is_vision_processed", "isVisionProcessed"),
)


def _elements_sql(name: str, camel: str, columns: str) -> str:
    return f"""SELECT id, (i - 1)::INT AS pos{columns} FROM (
        SELECT id, x, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM (
            SELECT id, CASE WHEN json_type(v) = 'ARRAY' THEN v::JSON[] WHEN json_type(v) = 'VARCHAR' THEN
                CASE WHEN json_valid(v->>'$') AND json_type(v->>'$') = 'ARRAY' THEN (v->>'$')::JSON::JSON[] WHEN json_valid(v->>'$') AND json_type(v->>'$') = 'NULL' THEN []::JSON[] ELSE [v] END
                WHEN json_type(v) = 'NULL' THEN []::JSON[] ELSE [v] END AS x FROM (
                SELECT id, coalesce(j->'{name}', j->'{camel}') AS v FROM p) WHERE v IS NOT NULL)) WHERE json_type(v) <> 'NULL'"""


def _child_sql(name: str, camel: str) -> str:
    return _elements_sql(name, camel, f", '{name}' AS child")


def _corners_sql(name: str, camel: str) -> str:
    elements = _elements_sql(name, camel, ", v->'bbox' AS box")
    return f"""SELECT id, '{name}' AS parent, parent_pos, (k - 1)::INT AS pos, try_cast(c->>'$' AS DOUBLE) AS corner FROM (
        SELECT id, parent_pos, unnest(box::JSON[]) AS c, generate_subscripts(box::JSON[], 1) AS k FROM (SELECT id, pos AS parent_pos, box FROM ({elements})) WHERE json_type(box) = 'ARRAY') WHERE json_type(c) <> 'NULL'"""


_P2_FOUND = f"""{_PAYLOAD} {_child_sql("table_content", "tableContent")} UNION ALL {_child_sql("image_details", "imageDetails")} UNION ALL {_child_sql("bounding_boxes", "boundingBoxes")}"""

SQL: dict[str, str] = {
    "p2_found": _P2_FOUND,
    "p2_pages": f"""{_PAYLOAD} SELECT id, {", ".join(f"coalesce(j->>'{a}', j->>'{b}') AS {a}" for a, b in _PAGE_FIELDS)} FROM p WHERE len(json_keys(j)) > 0""",
    "p2_images": f"""{_PAYLOAD} {_elements_sql("image_details", "imageDetails", ", v->>'index' AS index, " + ", ".join(f"try_cast(v->>'{m}' AS DOUBLE) AS {m}" for m in ("area", "width", "height")))}""",
    "p2_tables": f"""{_PAYLOAD} {_elements_sql("table_content", "tableContent", ", md5(v->>'$') AS digest, length(v->>'$')::INT AS size")}""",
    "p2_boxes": f"""{_PAYLOAD} {_elements_sql("bounding_boxes", "boundingBoxes", ", v->>'rows' AS rows, v->>'cols' AS cols")}""",
    "p2_corners": f"""{_PAYLOAD} {_corners_sql("image_details", "imageDetails")} UNION ALL {_corners_sql("bounding_boxes", "boundingBoxes")}""",
    **retrieval_queries.SQL, **chunking_queries.SQL,
}

FLAGSHIP = "evaluate_means"
