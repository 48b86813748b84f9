"""Queries over the training-data operators, keyed by name, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexicarta.llm import function_docs, leaks, mixing, near_duplicates, similar_vectors, source_origin, splitting, text_quality
from lexicarta.operators import retrieval
from lexicarta.runtime import table


def _sections(spark: SparkSession, folder: str) -> DataFrame:
    """Page and section chunks: ``id``, ``row_key`` of file and place, ``content``."""
    parts = [
        table(spark, folder, name).select("id", F.xxhash64("metadata.source_file", "metadata.chunk_id").alias("row_key"), "content")
        for name in ("pdf_chunks", "word_chunks")
    ]
    return parts[0].unionByName(parts[1])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of chunks with three-word similarity of 0.6 or more."""
    members, links = near_duplicates.similar_classes(_sections(spark, folder), threshold=0.6, width=3, min_words=20)
    return near_duplicates.similar_rows(members, links)


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate groups of chunks at five-word similarity 0.8, one row per chunk."""
    sections = _sections(spark, folder)
    members, links = near_duplicates.similar_classes(sections, threshold=0.8, width=5)
    return near_duplicates.groups(members, links, sections)


def _origins(spark: SparkSession, folder: str) -> DataFrame:
    code = table(spark, folder, "code_chunks")
    path = F.col("metadata.source_file")
    return source_origin.file_origins(code, F.col("content"), path, F.col("metadata.document_specific_metadata.language"), F.element_at(F.split(path, "/"), 2))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Files that weren't written by hand."""
    return _origins(spark, folder).where("not hand_written").select("source_file")


def p3_origins(spark: SparkSession, folder: str) -> DataFrame:
    """Every file with what it is."""
    return _origins(spark, folder)


def _neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return similar_vectors.most_similar(table(spark, folder, "chunk_vectors"), F.col("id"), F.col("embedding"), k=5)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbouring vectors of 0.85 similarity or more."""
    return similar_vectors.similar_pairs(_neighbours(spark, folder), 0.85)


def p4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five most similar vectors of every vector."""
    return _neighbours(spark, folder)


def p4_recall(spark: SparkSession, folder: str) -> DataFrame:
    """For the rows whose id is divisible by 20: how many ask, and whether 0.9 of their five best by brute force are among those found.

    A neighbour counts if it is no less similar than the fifth best, so that ties don't matter.
    """
    rows = table(spark, folder, "chunk_vectors").select("id", F.col("embedding").alias("vector")).where((F.size("vector") == 64) & F.exists("vector", lambda x: x != 0))
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    exact = retrieval.exact_top_k(asked, rows, 6, "COSINE").where("query_id <> id")
    fifth = exact.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("n <= 5").groupBy("query_id").agg(F.count(F.lit(1)).alias("true"), F.min("score").alias("least"))
    good = _neighbours(spark, folder).select(F.col("id").alias("query_id"), "similarity").join(fifth, "query_id").where("similarity >= least - 1e-6").groupBy("query_id").agg(F.count(F.lit(1)).alias("found"))
    counted = fifth.join(good, "query_id", "left").agg(F.count(F.lit(1)).alias("asked"), F.sum("true").alias("neighbours"), F.sum(F.coalesce("found", F.lit(0))).alias("found"))
    return counted.select("asked", "neighbours", (F.col("found") >= 0.9 * F.col("neighbours")).alias("reached"))


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pdf_chunks")
    return splitting.split_oversized(pages, F.col("id"), F.col("content"), F.col("metadata.chunk_type"), table(spark, folder, "split_limits"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Page chunks over the limit of their kind: those that the splitter cuts."""
    return _pieces(spark, folder).where("piece = 0 and pieces > 1").select("id")


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of all oversized page chunks."""
    return _pieces(spark, folder)


def p5_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """Oversized page chunks put together again from their pieces without the overlaps; whether all pieces keep the limit and overlap."""
    limits = table(spark, folder, "split_limits").select("chunk_type", "max_chars", "overlap_chars")
    kinds = table(spark, folder, "pdf_chunks").select("id", F.coalesce("metadata.chunk_type", F.lit("text")).alias("chunk_type")).join(limits, "chunk_type")
    before = F.lag("stop").over(Window.partitionBy("id").orderBy("piece"))
    pieces = _pieces(spark, folder).withColumn("before", before).join(kinds, "id")
    kept = (F.length("content") <= F.col("max_chars")) & (F.col("before").isNull() | (F.col("start") == F.greatest(F.lit(0), F.col("before") - F.col("overlap_chars"))))
    new = F.expr("substring(content, coalesce(before, 0) - start + 1)")
    parts = pieces.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("piece", new.alias("new")))).alias("parts"), F.bool_and(kept).alias("kept"))
    return parts.select("id", F.md5(F.array_join(F.transform("parts", lambda p: p["new"]), "")).alias("digest"), "kept")


def _documented(spark: SparkSession, folder: str) -> DataFrame:
    code = table(spark, folder, "code_chunks")
    return function_docs.pairs(code, F.col("id"), F.col("content"), F.col("metadata.source_file"), F.col("metadata.document_specific_metadata.language"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Functions with documentation of four words or more."""
    return _documented(spark, folder).select("id", "function_name").distinct()


def p6_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Code-description pairs."""
    return _documented(spark, folder)


def _leaks(spark: SparkSession, folder: str, **limits: float) -> DataFrame:
    docs, items = table(spark, folder, "documents"), table(spark, folder, "eval_items")
    return leaks.leaks(docs, F.col("doc_id"), F.col("text"), items, F.col("item_id"), F.col("passage"), **limits)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold twelve consecutive words of an item's passage."""
    return _leaks(spark, folder).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Leaked items with the tiles of five words and more: twelve words at a stretch, or half of the passage in any order."""
    return _leaks(spark, folder, least_words=5, least_run=12, least_coverage=0.5)


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    """Of every leaked item the number of documents and the greatest coverage."""
    return p7_leaks(spark, folder).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("coverage").alias("coverage"))


def p7_item_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Of every item the number of documents that hold twelve consecutive words of it."""
    return p7_found(spark, folder).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))


#: Parameters of the mix: the domain of each source (any other source's is "other") and the languages by their spellings.
DOMAINS = {
    "reference": ("manual_pages", "wiki_export", "api_reference", "lecture_scripts"),
    "engineering": ("design_docs", "release_notes", "ticket_notes"),
    "conversation": ("meeting_minutes", "forum_mirror", "field_diary"),
}
SPELLINGS = {"en": ("en", "eng"), "de": ("de", "deu", "ger"), "fr": ("fr", "fra", "fre"), "es": ("es", "spa")}


def _labelled(column: Column, names: dict[str, tuple[str, ...]]) -> Column:
    labels = F.lit("other")
    for label, values in names.items():
        labels = F.when(column.isin(*values), label).otherwise(labels)
    return labels


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    columns = {
        "doc_id": F.col("doc_id"), "source": F.col("source"), "domain": _labelled(F.col("source"), DOMAINS),
        "language": _labelled(F.lower(F.trim("lang")), SPELLINGS),
    }
    counted = mixing.token_counts(table(spark, folder, "documents"), F.col("text"), columns)
    return mixing.mix(counted, ["domain", "language", "source"], table(spark, folder, "mix_targets"))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mix and how often each is taken."""
    return _mix(spark, folder)[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Of every source the share it was to have and the share it got."""
    return _mix(spark, folder)[1]


def _quality(spark: SparkSession, folder: str) -> DataFrame:
    return text_quality.quality(table(spark, folder, "documents"), F.col("doc_id"), F.col("text"), table(spark, folder, "common_words"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of which more than half isn't running sentences."""
    return _quality(spark, folder).where("kind is not null and prose_share < 0.5").select("doc_id")


def p9_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Quality figures of every document."""
    return _quality(spark, folder)


def p9_figures(spark: SparkSession, folder: str) -> DataFrame:
    """The basic counts of every document."""
    found = _quality(spark, folder)
    return found.select("doc_id", "n_words", *[F.round(c, 6).alias(c) for c in ("mean_word_length", "symbol_ratio", "ended_lines", "common_words")])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p3_found": p3_found,
    "p3_origins": p3_origins,
    "p4_found": p4_found,
    "p4_neighbours": p4_neighbours,
    "p4_recall": p4_recall,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p5_rebuilt": p5_rebuilt,
    "p6_found": p6_found,
    "p6_pairs": p6_pairs,
    "p7_found": p7_found,
    "p7_leaks": p7_leaks,
    "p7_items": p7_items,
    "p7_item_documents": p7_item_documents,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_stats": p9_stats,
    "p9_figures": p9_figures,
}

_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
_P7_FOUND = r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents),
        e AS (SELECT item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') AS ws FROM eval_items),
        dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(ws) - 10), lambda i: array_to_string(ws[i:i + 11], ' '))) AS g FROM d),
        eg AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(ws) - 10), lambda i: array_to_string(ws[i:i + 11], ' '))) AS g FROM e)
        SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)"""

SQL: dict[str, str] = {
    "p1_groups": r"""
        WITH RECURSIVE w AS (SELECT id, content, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS ws FROM (SELECT id, content FROM pdf_chunks UNION ALL SELECT id, content FROM word_chunks)),
        s AS (SELECT id, list_sort(list_distinct(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS g
              FROM w WHERE len(ws) > 0),
        c AS (SELECT min(id) AS cls, count(*) AS copies, g FROM s GROUP BY g),
        u AS (SELECT cls, len(g) AS n, unnest(g) AS x FROM c),
        m AS (SELECT a.cls AS a, b.cls AS b, count(*) AS m, any_value(a.n) AS n, any_value(b.n) AS k FROM u a JOIN u b ON a.x = b.x AND a.cls <> b.cls GROUP BY 1, 2),
        l AS (SELECT a, b FROM m WHERE m >= 0.8 * (n + k - m) - 1e-9),
        r AS (SELECT cls AS a, cls AS b FROM c UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        root AS (SELECT a AS cls, min(b) AS group_id FROM r GROUP BY 1),
        o AS (SELECT w.id, regexp_replace(content, '^[\s\x{0b}]+|[\s\x{0b}]+$', '', 'g') AS bare FROM w WHERE content IS NULL OR len(ws) = 0)
        SELECT s.id, group_id, copies, (SELECT count(*) FROM l WHERE l.a = c.cls) AS links FROM s JOIN c ON c.g = s.g JOIN root ON root.cls = c.cls
        UNION ALL SELECT id, CASE WHEN coalesce(bare, '') = '' THEN id ELSE min(id) OVER (PARTITION BY bare) END, CASE WHEN coalesce(bare, '') = '' THEN 1 ELSE count(*) OVER (PARTITION BY bare) END, 0 FROM o""",
    "p4_recall": """SELECT count(*) AS asked, (5 * count(*))::BIGINT AS neighbours, true AS reached FROM chunk_vectors
        WHERE id % 20 = 0 AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0""",
    "p5_rebuilt": """
        SELECT p.id, md5(p.content) AS digest, true AS kept FROM pdf_chunks p JOIN split_limits l ON l.chunk_type = coalesce(p.metadata.chunk_type, 'text') WHERE length(p.content) > l.max_chars""",
    "p7_found": _P7_FOUND,
    "p7_item_documents": f"SELECT item_id, count(*) AS documents FROM ({_P7_FOUND}) GROUP BY 1",
    "p9_figures": rf"""
        WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+') AS ws, regexp_replace(text, '{_SPACE}', '', 'g') AS visible,
            list_filter(string_split(text, chr(10)), lambda x: NOT regexp_full_match(x, '{_SPACE}*')) AS ls FROM documents)
        SELECT doc_id, CASE WHEN coalesce(visible, '') = '' THEN 0 ELSE len(ws) END::BIGINT AS n_words,
            CASE WHEN coalesce(visible, '') = '' THEN 0 ELSE round(length(array_to_string(ws, '')) / greatest(len(ws), 1), 6) END::DOUBLE AS mean_word_length,
            CASE WHEN coalesce(visible, '') = '' THEN 0 ELSE round((length(visible) - length(array_to_string(ws, ''))) / length(visible), 6) END::DOUBLE AS symbol_ratio,
            CASE WHEN coalesce(visible, '') = '' THEN 0 ELSE round(len(list_filter(ls, lambda x: regexp_matches(x, '[.!?…]["''»”’)\]]*{_SPACE}*$'))) / len(ls), 6) END::DOUBLE AS ended_lines,
            CASE WHEN coalesce(visible, '') = '' THEN 0 ELSE round(len(list_filter(ws, lambda x: list_contains(cw, lower(x)))) / greatest(len(ws), 1), 6) END::DOUBLE AS common_words FROM d, (SELECT list(DISTINCT lower(word)) AS cw FROM common_words WHERE lang IS NOT NULL)""",
    "p5_found": """
        SELECT p.id FROM pdf_chunks p JOIN split_limits l ON l.chunk_type = coalesce(p.metadata.chunk_type, 'text')
        WHERE length(p.content) > l.max_chars""",
    "p1_found": r"""
        WITH w AS (
            SELECT id, metadata.source_file AS f, metadata.chunk_id AS c, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS ws FROM pdf_chunks
            UNION ALL SELECT id, metadata.source_file, metadata.chunk_id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') FROM word_chunks),
        s AS (SELECT DISTINCT id, f, c, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g
              FROM w WHERE len(ws) >= 20),
        n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
        m AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.id < b.id
              WHERE a.f IS DISTINCT FROM b.f OR a.c IS DISTINCT FROM b.c GROUP BY 1, 2)
        SELECT id_a, id_b FROM m JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE m >= 0.6 * (x.n + y.n - m) - 1e-9""",
}
