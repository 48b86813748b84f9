"""Queries over packers, pages, sections, source files and chunk figures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexicarta.functions.text import extension, lines, markdown_table, paragraphs, preview, strip
from lexicarta.operators import code_elements, packing, pdf_pages, statistics, word_sections
from lexicarta.runtime import spread, table

CHUNK_TABLES = ("pdf_chunks", "word_chunks", "code_chunks")


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    parts = [table(spark, folder, name).select("id", "content", *[f"metadata.{c}" for c in ("source_file", "chunk_type", "text_length", "preview")]) for name in CHUNK_TABLES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def pack_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that aren't blank packed to 1000 characters."""
    docs = spread(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", paragraphs(F.col("text")).alias("parts"))
    found = packing.pack_paragraphs(docs, F.col("doc_id"), F.col("parts"), 1000)
    return found.select(F.col("key").alias("doc_id"), "chunk_id", F.md5("content").alias("digest"), "is_continuation")


def pack_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines packed to 1500 characters."""
    docs = spread(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", lines(F.col("text")).alias("parts"))
    found = packing.pack_lines(docs, F.col("doc_id"), F.col("parts"), 1500)
    return found.select(F.col("key").alias("doc_id"), "chunk_id", F.md5("content").alias("digest"), "line_start", "line_end")


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of documents as blocks: those that begin with ``#`` are headings, with a dash or a number list items."""
    docs = table(spark, folder, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("source_file"), F.posexplode(lines(F.col("text"))).alias("idx", "line"))
    line = F.col("line")
    head = line.rlike(r"^ *#{1,6} ")
    style = F.when(head, F.concat(F.lit("Heading "), F.length(F.regexp_extract(line, r"^ *(#+)", 1)).cast("string"))).when(line.rlike(r"^ *([-*+]|[0-9]+[.)]) "), "List Bullet").otherwise("Normal")
    return docs.select(
        "source_file", "idx", F.lit("paragraph").alias("kind"), style.alias("style"), F.when(head, F.regexp_replace(line, r"^ *#+ ", "")).otherwise(line).alias("text"),
        F.lit(None).cast("array<array<string>>").alias("cells"), F.lit(False).alias("has_image"),
    )


def section_list(spark: SparkSession, folder: str) -> DataFrame:
    """Sections of documents with their headings and levels."""
    found = word_sections.sections(_blocks(spark, folder))
    return found.select(
        "source_file", "section", "heading", "heading_level", "style_name", F.size("paragraphs").alias("paragraphs"), F.length(F.array_join("paragraphs", "\n\n")).alias("size"), "has_lists"
    )


def section_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of the sections of documents."""
    return word_sections.section_chunks(word_sections.sections(_blocks(spark, folder)))


def markdown_tables(spark: SparkSession, folder: str) -> DataFrame:
    """A Markdown table of the lines of each order."""
    cells = F.array(F.col("l_linenumber").cast("string"), F.col("l_returnflag"), F.col("l_quantity").cast("int").cast("string"))
    lines_ = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", cells.alias("cells")))).alias("rows"))
    header = F.array(F.array(F.lit("line"), F.lit("flag"), F.lit("quantity")))
    return lines_.select("l_orderkey", F.md5(markdown_table(F.concat(header, F.transform("rows", lambda r: r["cells"])))).alias("digest"))


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages whose geometry comes from order lines: a file per supplier, a page per line."""
    l = spread(table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus"))  # noqa: E741
    side = F.col("l_quantity") * 5
    image = F.struct(F.lit(10.0).alias("x0"), F.lit(20.0).alias("y0"), (F.lit(10.0) + side).alias("x1"), (F.lit(20.0) + side * 2).alias("y1"))
    row = F.array(F.array(F.lit("flag"), F.lit("status")), F.array("l_returnflag", "l_linestatus"))
    tables = F.pmod(F.col("l_partkey"), F.lit(3))
    pictures = F.pmod(F.col("l_orderkey"), F.lit(2))
    return l.select(
        F.concat(F.lit("supplier-"), F.col("l_suppkey").cast("string")).alias("source_file"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("page_number"),
        F.concat(F.lit(" \n"), F.col("l_returnflag"), F.lit(" page "), F.col("l_linenumber").cast("string"), F.lit("\t ")).alias("text"),
        F.when(tables > 0, F.array(row)).otherwise(F.array().cast("array<array<array<string>>>")).alias("tables"), tables.cast("int").alias("num_tables"),
        F.when(pictures > 0, F.array(image)).alias("images"), pictures.cast("int").alias("num_images"),
        F.when(F.col("l_linenumber") == 7, 0.0).otherwise(600.0).alias("page_width"), F.lit(800.0).alias("page_height"), F.lit("a picture").alias("vision_text"),
    )


def page_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Pages routed by tables and covered area."""
    found = pdf_pages.page_chunks(_pages(spark, folder))
    return found.select("source_file", "page_number", "chunk_type", F.md5("content").alias("digest"), "text_length", F.round("image_coverage_ratio", 6).alias("ratio"), "is_vision_processed")


def page_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of each kind per file."""
    return pdf_pages.file_summary(pdf_pages.page_chunks(_pages(spark, folder)))


def _sources(spark: SparkSession, folder: str) -> DataFrame:
    path = F.col("metadata.source_file")
    return spread(table(spark, folder, "code_chunks").select("id", "content", "metadata")).select(F.concat(F.col("id").cast("string"), extension(path)).alias("source_file"), F.lower(extension(path)).alias("extension"), F.col("content").alias("code"))


def element_list(spark: SparkSession, folder: str) -> DataFrame:
    """Classes, functions and methods of source texts with their lines."""
    found = code_elements.elements(_sources(spark, folder).where(F.col("extension").isin(*code_elements.LANGUAGES)))
    # an outer explode: the inner one would have the optimiser work the elements out twice to filter empty ones
    return found.select("source_file", F.explode_outer("code_elements").alias("e")).where("e is not null").select("source_file", F.col("e.start").alias("line_start"), F.col("e.stop").alias("line_end"), "e.kind", "e.name", "e.parent")


def source_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Module and element chunks of source texts."""
    found = code_elements.code_chunks(_sources(spark, folder))
    return found.select("source_file", "chunk_id", "element_type", "element_name", "parent_class", "line_start", "line_end", "complexity_score", "page_number", "text_length", F.md5("content").alias("digest"))


def source_figures(spark: SparkSession, folder: str) -> DataFrame:
    """Imports and complexity of source texts."""
    code = _sources(spark, folder)
    return code.select("source_file", F.size(code_elements.imports(lines(F.col("code")), F.col("extension"))).alias("imports"), code_elements.complexity(F.col("code")).alias("complexity"))


def chunk_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Figures of all chunks by type and over all."""
    found = statistics.chunk_statistics(_chunks(spark, folder), F.col("chunk_type"), F.col("text_length"))
    return found.select("chunk_type", "chunks", "total_length", F.round("avg_length", 6).alias("avg_length"), F.round("percentage", 6).alias("percentage"))


def preview_and_length(spark: SparkSession, folder: str) -> DataFrame:
    """Lengths and previews of all chunks as they should be."""
    return _chunks(spark, folder).select("id", F.length("content").alias("size"), F.md5(preview(F.col("content"))).alias("preview"), F.length(strip(F.col("content"))).alias("stripped"))


def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Files by extension that a chunker for known languages can and can't take."""
    path = F.col("metadata.source_file")
    files = table(spark, folder, "code_chunks").groupBy(path.alias("path")).agg(F.count(F.lit(1)).alias("chunks"))
    ext = F.lower(extension(F.col("path")))
    return statistics.run_summary(files.select(ext.alias("file_type"), F.when(~ext.isin(*code_elements.LANGUAGES), "no rule").alias("error"), "chunks"))


def collection_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors and contents of all chunks taken as one collection."""
    vectors = table(spark, folder, "chunk_vectors").select("id", F.col("embedding").alias("vector"))
    return statistics.collection_summary(_chunks(spark, folder).select("id", "content").join(vectors, "id", "left"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pack_paragraphs": pack_paragraphs, "pack_lines": pack_lines, "section_list": section_list, "section_chunks": section_chunks, "markdown_tables": markdown_tables,
    "page_chunks": page_chunks, "page_summary": page_summary, "element_list": element_list, "source_chunks": source_chunks, "source_figures": source_figures,
    "chunk_statistics": chunk_statistics, "preview_and_length": preview_and_length, "run_summary": run_summary, "collection_summary": collection_summary,
}

_ALL = " UNION ALL ".join(f"SELECT id, content, metadata.chunk_type AS chunk_type, metadata.text_length AS text_length FROM {t}" for t in CHUNK_TABLES)
_BLANK = r"'^[\s\x1c-\x1f\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0085}\x0b]+|[\s\x1c-\x1f\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0085}\x0b]+$'"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, {_BLANK}, '', 'g')"


_EXT = r"lower(regexp_extract(metadata.source_file, '[^/](\.[^./]+)$', 1))"
_SRC = rf"SELECT id::VARCHAR || regexp_extract(metadata.source_file, '[^/](\.[^./]+)$', 1) AS source_file, {_EXT} AS ext, content AS code FROM code_chunks"


def _opener(line: str, group: int) -> str:
    cases = "".join(
        f" WHEN '{e}' THEN regexp_extract({line}, '{pattern}', {name if group == 3 else group})" for e, (pattern, name) in code_elements.OPENERS.items()
    )
    other, name = code_elements.OTHER_OPENER
    return f"CASE ext{cases} ELSE regexp_extract({line}, '{other}', {name if group == 3 else group}) END"


def _words(index: int, empty: str) -> str:
    cases = "".join(f" WHEN '{e}' THEN [{', '.join(repr(w) for w in v[index])}]::VARCHAR[]" for e, v in code_elements.LANGUAGES.items())
    return f"CASE ext{cases} ELSE {empty} END"


_COMMENT = "CASE ext" + "".join(f" WHEN '{e}' THEN '{v[1]}'" for e, v in code_elements.LANGUAGES.items()) + " ELSE '//' END"
_KNOWN = ", ".join(f"'{e}'" for e in code_elements.LANGUAGES)
_COUNT = " + ".join(f"(length(code) - length(replace(code, ' {w}{c}', ''))) // {len(w) + 2}" for w in code_elements.BRANCHES for c in (" ", "("))
_IMPORT = "CASE ext" + "".join(f" WHEN '{e}' THEN len(list_filter(string_split(code, chr(10)), lambda x: regexp_matches({strip_sql('x')}, '{p}')))" for e, p in code_elements.IMPORTS.items()) + " ELSE 0 END"
_PAGE = """SELECT 'supplier-' || l_suppkey AS source_file, l_orderkey * 10 + l_linenumber AS page_number, l_partkey % 3 AS nt, l_orderkey % 2 AS ni, l_returnflag || ' page ' || l_linenumber AS body,
    '| flag | status |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || l_returnflag || ' | ' || l_linestatus || ' |' AS md,
    CASE WHEN l_orderkey % 2 = 1 AND l_linenumber <> 7 THEN (l_quantity * 5) * (l_quantity * 10) / 480000.0 ELSE 0 END AS ratio FROM lineitem"""
_ROUTED = f"""SELECT *, nt = 0 AND ratio > 0.15 AS vision, CASE WHEN nt > 0 AND ni > 0 THEN 'mixed' WHEN nt > 0 THEN 'table' WHEN ratio > 0.15 THEN 'image_heavy_page' WHEN ni > 0 THEN 'mixed' ELSE 'text' END AS chunk_type,
    CASE WHEN nt > 0 THEN body || chr(10) || chr(10) || chr(10) || chr(10) || '--- Tables ---' || chr(10) || chr(10) || chr(10) || md WHEN ratio > 0.15 THEN 'a picture' ELSE body END AS content FROM ({_PAGE})"""

_SECTIONS = rf"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS idx FROM documents WHERE text IS NOT NULL),
        b AS (SELECT doc_id, idx, line, regexp_matches(line, '^ *#{{1,6}} ') AS head, regexp_matches(line, '^ *([-*+]|[0-9]+[.)]) ') AS item FROM l),
        n AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY idx) AS s, NOT head AND {strip_sql('line')} <> '' AS filled FROM b),
        g AS (SELECT doc_id, s, max(CASE WHEN head THEN {strip_sql("regexp_replace(line, '^ *#+ ', '')")} END) AS heading, max(CASE WHEN head THEN length(regexp_extract(line, '^ *(#+)', 1)) END) AS lev,
            count(*) FILTER (filled) AS paragraphs, coalesce(sum(length(line)) FILTER (filled), 0) + 2 * greatest(count(*) FILTER (filled) - 1, 0) AS size, coalesce(bool_or(item AND filled), false) AS has_lists
            FROM n GROUP BY 1, 2),
        named AS (SELECT doc_id, s, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INT AS section,
            CASE WHEN s = 0 THEN '(Document Start)' WHEN heading = '' THEN '(Untitled Section)' ELSE heading END AS heading, coalesce(lev, 0)::INT AS heading_level,
            CASE WHEN s = 0 THEN 'Normal' ELSE 'Heading ' || lev END AS style_name, paragraphs::INT AS paragraphs, size::INT AS size, has_lists FROM g WHERE s > 0 OR paragraphs > 0)"""

_IMPORTS = "CASE ext" + "".join(
    f" WHEN '{e}' THEN list_filter(list_transform(string_split(code, chr(10)), lambda y: {strip_sql('y')}), lambda x: regexp_matches(x, '{p}'))" for e, p in code_elements.IMPORTS.items()
) + " ELSE []::VARCHAR[] END"
_ELEMENTS = rf"""src AS ({_SRC}), f AS (SELECT *, string_split(code, chr(10)) AS ls, {_words(3, "['class']")} AS cls, {_words(2, "[]::VARCHAR[]")} AS fns, {_COMMENT} AS com FROM src WHERE ext IN ({_KNOWN}) AND code IS NOT NULL),
        l AS (SELECT source_file, ext, cls, fns, com, len(ls) AS total, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM f),
        m AS (SELECT *, length({_opener('line', 1)}) AS ind, {_opener('line', 2)} AS kw, {_opener('line', 3)} AS name, length(regexp_extract(line, '^(\s*)', 1)) AS li,
            {strip_sql('line')} <> '' AND NOT starts_with({strip_sql('line')}, com) AS solid FROM l),
        o AS (SELECT *, list_contains(cls, kw) AS is_class, last_value(CASE WHEN list_contains(cls, kw) THEN name END IGNORE NULLS) OVER (PARTITION BY source_file ORDER BY i ROWS UNBOUNDED PRECEDING) AS parent FROM m WHERE kw <> ''),
        e AS (SELECT o.source_file, o.i, any_value(o.total) AS total, any_value(o.kw) AS kw, any_value(o.name) AS name, any_value(o.is_class) AS is_class, any_value(o.parent) AS parent, any_value(o.fns) AS fns, min(s.i) AS nxt
            FROM o LEFT JOIN m s ON s.source_file = o.source_file AND s.solid AND s.i > o.i AND s.li <= o.ind GROUP BY 1, 2),
        elements AS (SELECT source_file, i::INT AS line_start, coalesce(nxt - 1, total - 1)::INT AS line_end, k AS kind, name, CASE WHEN k = 'method' THEN parent END AS parent FROM (
                    SELECT *, CASE WHEN is_class THEN 'class' WHEN (list_contains(fns, kw) OR kw IN ('public', 'private', 'protected', 'static')) AND parent IS NOT NULL THEN 'method' ELSE 'function' END AS k FROM e))"""

SQL: dict[str, str] = {
    "pack_paragraphs": f"""
        WITH RECURSIVE l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn, p FROM (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE {strip_sql('p')} <> ''),
        whole AS (SELECT doc_id, length(string_agg(p, chr(10) || chr(10) ORDER BY rn)) AS total FROM l GROUP BY 1),
        f AS (SELECT l.doc_id, rn, p, 0 AS cid, length(p) AS n, total FROM l JOIN whole USING (doc_id) WHERE rn = 1
            UNION ALL SELECT l.doc_id, l.rn, l.p, CASE WHEN f.n + length(l.p) > 1000 AND total > 1000 THEN cid + 1 ELSE cid END,
                CASE WHEN f.n + length(l.p) > 1000 AND total > 1000 THEN length(l.p) ELSE f.n + length(l.p) END, total FROM f JOIN l ON l.doc_id = f.doc_id AND l.rn = f.rn + 1)
        SELECT doc_id, cid::INT AS chunk_id, md5(string_agg(p, chr(10) || chr(10) ORDER BY rn)) AS digest, cid > 0 AS is_continuation FROM f GROUP BY doc_id, cid""",
    "pack_lines": """
        WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS rn FROM documents),
        f AS (SELECT doc_id, rn, p, 0 AS cid, length(p) + 1 AS n FROM l WHERE rn = 1
            UNION ALL SELECT l.doc_id, l.rn, l.p, CASE WHEN f.n >= 1500 THEN cid + 1 ELSE cid END, CASE WHEN f.n >= 1500 THEN length(l.p) + 1 ELSE f.n + length(l.p) + 1 END
            FROM f JOIN l ON l.doc_id = f.doc_id AND l.rn = f.rn + 1)
        SELECT doc_id, cid::INT AS chunk_id, md5(string_agg(p, chr(10) ORDER BY rn)) AS digest, (cid * 1500 // 80)::INT AS line_start,
            (CASE WHEN max(n) < 1500 THEN (SELECT count(*) FROM l WHERE l.doc_id = f.doc_id) ELSE (cid + 1) * 1500 // 80 END)::INT AS line_end FROM f GROUP BY doc_id, cid""",
    "section_list": f"WITH {_SECTIONS} SELECT doc_id::VARCHAR AS source_file, section, heading, heading_level, style_name, paragraphs, size, has_lists FROM named",
    "section_chunks": f"""WITH RECURSIVE {_SECTIONS},
        p AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id, s ORDER BY idx) AS rn, line FROM n WHERE filled),
        f AS (SELECT p.doc_id, p.s, rn, line, 0 AS cid, length(line) AS m, size FROM p JOIN named ON named.doc_id = p.doc_id AND named.s = p.s WHERE rn = 1
            UNION ALL SELECT p.doc_id, p.s, p.rn, p.line, CASE WHEN f.m + length(p.line) > 1000 AND size > 1000 THEN cid + 1 ELSE cid END,
                CASE WHEN f.m + length(p.line) > 1000 AND size > 1000 THEN length(p.line) ELSE f.m + length(p.line) END, size FROM f JOIN p ON p.doc_id = f.doc_id AND p.s = f.s AND p.rn = f.rn + 1),
        c AS (SELECT doc_id, s, cid, string_agg(line, chr(10) || chr(10) ORDER BY rn) AS bare, count(*)::INT AS paragraph_count FROM f GROUP BY 1, 2, 3),
        t AS (SELECT *, CASE WHEN cid = 0 AND heading <> '(Document Start)' THEN '# ' || heading || chr(10) || chr(10) || bare ELSE bare END AS content FROM c JOIN named USING (doc_id, s))
        SELECT doc_id::VARCHAR AS source_file, (row_number() OVER (PARTITION BY doc_id ORDER BY section, cid) - 1)::INT AS chunk_id, section + 1 AS page_number, 'text' AS chunk_type, content,
            length(content)::INT AS text_length, substr(content, 1, 200) AS preview, heading, heading_level, style_name, has_lists, paragraph_count, cid > 0 AS is_continuation,
            CASE WHEN cid > 0 THEN heading END AS parent_section FROM t""",
    "markdown_tables": """SELECT l_orderkey, md5('| line | flag | quantity |' || chr(10) || '| --- | --- | --- |' || chr(10) ||
        string_agg('| ' || l_linenumber || ' | ' || l_returnflag || ' | ' || l_quantity::INT || ' |', chr(10) ORDER BY l_linenumber, l_returnflag, l_quantity::INT::VARCHAR)) AS digest FROM lineitem GROUP BY 1""",
    "page_chunks": f"SELECT source_file, page_number, chunk_type, md5(content) AS digest, length(content)::INT AS text_length, round(ratio, 6)::DOUBLE AS ratio, vision AS is_vision_processed FROM ({_ROUTED})",
    "page_summary": f"""SELECT source_file, count(*) AS pages, count(*) FILTER (vision) AS vision_pages, count(*) FILTER (chunk_type = 'table') AS table_pages, count(*) FILTER (chunk_type = 'mixed') AS mixed_pages,
        count(*) FILTER (chunk_type = 'text') AS text_pages, sum(nt)::BIGINT AS tables, sum(ni)::BIGINT AS images FROM ({_ROUTED}) GROUP BY 1""",
    "element_list": f"WITH {_ELEMENTS} SELECT * FROM elements",
    "source_chunks": f"""WITH {_ELEMENTS},
        base AS (SELECT source_file, ext, ls, {_IMPORTS} AS imps FROM f),
        outside AS (SELECT source_file, {strip_sql("string_agg(line, chr(10) ORDER BY i)")} AS body FROM l
            WHERE NOT EXISTS (SELECT 1 FROM elements e WHERE e.source_file = l.source_file AND l.i BETWEEN e.line_start AND e.line_end) GROUP BY 1),
        x AS (SELECT b.source_file, -1 AS place, 'module' AS element_type, regexp_replace(b.source_file, '([^.])[.][^.]+$', '\\1') AS element_name, NULL AS parent_class, 0 AS line_start, len(ls)::INT AS line_end, 0 AS page_number,
                coalesce(o.body, '') AS body, imps AS lead FROM base b LEFT JOIN outside o USING (source_file)
            UNION ALL SELECT b.source_file, e.line_start, kind, name, parent, e.line_start, e.line_end, e.line_start // 100, array_to_string(ls[e.line_start + 1:e.line_end + 1], chr(10)),
                list_concat(list_filter(ls[greatest(0, e.line_start - 20) + 1:e.line_start], lambda y: contains(y, 'class ' || parent))[1:1], imps[1:5]) FROM base b JOIN elements e USING (source_file)),
        y AS (SELECT *, CASE WHEN len(lead) > 0 THEN array_to_string(lead, chr(10)) || chr(10) || chr(10) || body ELSE body END AS content FROM x WHERE length(body) >= 100),
        z AS (SELECT *, CASE WHEN place < 0 THEN content ELSE body END AS code FROM y)
        SELECT source_file, (row_number() OVER (PARTITION BY source_file ORDER BY place) - 1)::INT AS chunk_id, element_type, element_name, parent_class, line_start::INT AS line_start, line_end,
            (1 + {_COUNT})::INT AS complexity_score, page_number::INT AS page_number, length(content)::INT AS text_length, md5(content) AS digest FROM z""",
    "source_figures": f"SELECT source_file, ({_IMPORT})::INT AS imports, (1 + {_COUNT})::INT AS complexity FROM ({_SRC})",
    "chunk_statistics": f"""SELECT chunk_type, count(*) AS chunks, sum(coalesce(text_length, 0))::BIGINT AS total_length, round(avg(coalesce(text_length, 0)), 6) AS avg_length,
        round(count(*) * 100.0 / (SELECT count(*) FROM ({_ALL})), 6)::DOUBLE AS percentage FROM (SELECT coalesce(chunk_type, 'unknown') AS chunk_type, text_length FROM ({_ALL})) GROUP BY GROUPING SETS ((), (chunk_type))""",
    "preview_and_length": f"SELECT id, length(content)::INT AS size, md5(substr(content, 1, 200)) AS preview, length({strip_sql('content')})::INT AS stripped FROM ({_ALL})",
    "run_summary": f"""SELECT file_type, count(*) FILTER (file_type IN ({_KNOWN})) AS successful, count(*) FILTER (file_type NOT IN ({_KNOWN})) AS failed, count(*) AS total, sum(n)::BIGINT AS chunks
        FROM (SELECT {_EXT} AS file_type, count(*) AS n FROM code_chunks GROUP BY metadata.source_file, 1) GROUP BY 1""",
    "collection_summary": f"""SELECT count(v.embedding) AS num_vectors, max(len(v.embedding))::INT AS dimension, count(c.content) AS num_contents, count(*) FILTER (v.embedding IS NULL) AS without_vector
        FROM ({_ALL}) c LEFT JOIN chunk_vectors v ON v.id = c.id""",
}
