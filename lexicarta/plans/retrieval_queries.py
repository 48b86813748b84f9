"""Queries over vectors, judgements and experiments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexicarta.functions.text import with_language
from lexicarta.functions.vectors import norm, normalise
from lexicarta.operators import comparison, embedding, evaluation, ground_truth, retrieval
from lexicarta.plans.chunking_queries import strip_sql
from lexicarta.runtime import spread, table
from lexicarta.sources.collection import shaped

KS = evaluation.DEFAULT_KS


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _asked(rows: DataFrame) -> DataFrame:
    return rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")


def _top(metric: str, k: int = 5) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = _vectors(spark, folder)
        hits = retrieval.exact_top_k(_asked(rows), rows.select("id", "vector"), k, metric)
        return hits.select("query_id", "rank", "id", F.round("score", 6).alias("score"))

    return run


def unit_norms(spark: SparkSession, folder: str) -> DataFrame:
    """Lengths before and after normalising."""
    rows = table(spark, folder, "chunk_vectors").select("id", "embedding")
    return rows.where("embedding is not null").select("id", F.round(norm(F.col("embedding")), 5).alias("before"), F.round(norm(normalise(F.col("embedding"))), 5).alias("after"))


def search_with_payload(spark: SparkSession, folder: str) -> DataFrame:
    """Hits with columns fetched after scoring."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "lang", F.lit(None).cast("string").alias("preview"))
    return retrieval.with_payload(_top("IP")(spark, folder), docs, ["lang", "preview", "page_number"])


def search_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """Search among the rows of one label, which are fewer than asked for."""
    rows = _vectors(spark, folder)
    hits = retrieval.exact_top_k(_asked(rows), rows.where("label = 3").select("id", "vector"), 1000)
    return hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.max("rank").alias("last_rank"))


def ivf_all_lists(spark: SparkSession, folder: str) -> DataFrame:
    """An inverted file of which every list is visited finds what the exact search finds."""
    rows = _vectors(spark, folder).select("id", "vector")
    index = retrieval.InvertedFile.fit(rows, lists=16)
    return index.search(_asked(rows), rows, 5, probes=16).select("query_id", "rank", "id", F.round("score", 6).alias("score"))


def ivf_four_lists(spark: SparkSession, folder: str) -> DataFrame:
    """An inverted file of which as many lists are visited as a recall of 0.9 takes; the name is from when there were four."""
    rows = _vectors(spark, folder).select("id", "vector")
    return retrieval.InvertedFile.fit(rows).search(_asked(rows), rows, 10)


def _judged(rows: DataFrame, graded: bool = False) -> DataFrame:
    """Judgements of each asked vector: the same label is relevant, graded also the next one."""
    q = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("label").alias("l"))
    labels = rows.select(F.col("id").alias("doc_id"), "label")
    if not graded:
        return q.join(labels, q["l"] == labels["label"]).select("query_id", "doc_id")
    wanted = q.select("query_id", F.explode(F.array(F.struct(F.col("l").alias("label"), F.lit(2).alias("grade")), F.struct((F.col("l") + 1).alias("label"), F.lit(1).alias("grade")))).alias("w"))
    return wanted.select("query_id", "w.label", "w.grade").join(labels, "label").select("query_id", "doc_id", "grade")


def _ranked(spark: SparkSession, folder: str, metric: str = "IP") -> DataFrame:
    return _top(metric, 10)(spark, folder).select("query_id", "rank", F.col("id").cast("string").alias("doc_id"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def evaluate_per_query(spark: SparkSession, folder: str) -> DataFrame:
    """All metrics of each query."""
    return _rounded(evaluation.per_query(_ranked(spark, folder), _judged(_vectors(spark, folder))))


def evaluate_graded(spark: SparkSession, folder: str) -> DataFrame:
    """nDCG with grades of each query."""
    found = evaluation.per_query(_ranked(spark, folder), _judged(_vectors(spark, folder), True), graded=True)
    return _rounded(found.select("query_id", *[f"ndcg_at_{k}" for k in KS], "precision_at_10"))


def evaluate_means(spark: SparkSession, folder: str) -> DataFrame:
    """Means over the evaluated queries."""
    return _rounded(evaluation.averages(evaluation.per_query(_ranked(spark, folder), _judged(_vectors(spark, folder)))))


def evaluate_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Queries with results, evaluated and skipped; those of label 0 have no judgements."""
    rows = _vectors(spark, folder)
    return evaluation.coverage(_ranked(spark, folder), _judged(rows.where("label <> 0")))


def doc_id_truthy(spark: SparkSession, folder: str) -> DataFrame:
    """Ids resolved by truth value: an id of 0 falls through and later ranks move up."""
    hits = _top("IP", 10)(spark, folder).select("query_id", "rank", "id", F.lit(None).cast("bigint").alias("alt_id"), F.lit(None).cast("bigint").alias("chunk_id"))
    return evaluation.resolved_ids(hits)


def _truth(spark: SparkSession, folder: str) -> DataFrame:
    """Judgements derived from page chunks: each asks with its preview for itself and the chunk after it; some repeat an id, have none or a blank text."""
    key = F.col("id").cast("string")
    ids = F.when(F.col("id") % 7 == 0, F.array().cast("array<string>")).when(F.col("id") % 5 == 0, F.array(key, key)).when(F.col("id") % 13 != 0, F.array(key, (F.col("id") + 1).cast("string")))
    text = F.when(F.col("id") % 11 == 0, "  ").otherwise(F.col("metadata.preview"))
    return table(spark, folder, "pdf_chunks").select(F.concat(F.lit("q"), key).alias("query_id"), text.alias("query_text"), ids.alias("relevant_doc_ids"), F.col("id").alias("pos"), F.col("metadata.page_number").alias("page"))


def qrels_last_wins(spark: SparkSession, folder: str) -> DataFrame:
    """Judgements where those of even pages come again later with another text."""
    truth = _truth(spark, folder)
    again = truth.where("page % 2 = 0").select("query_id", F.concat(F.lit("again "), "query_text").alias("query_text"), "relevant_doc_ids", (F.col("pos") + 10_000_000_000).alias("pos"))
    return ground_truth.last_wins(truth.drop("page").unionByName(again)).select("query_id", F.md5("query_text").alias("digest"), F.size("relevant_doc_ids").alias("relevant"))


def qrels_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Figures of the judgements."""
    return _rounded(ground_truth.statistics(_truth(spark, folder)))


def qrels_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Validation of each query."""
    return ground_truth.validation(_truth(spark, folder))


def qrels_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Judgements as pairs."""
    return ground_truth.qrels(_truth(spark, folder))


def qrels_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Judgements from comma-separated ids."""
    rows = _truth(spark, folder).select("query_id", "query_text", F.concat(F.lit(" , "), F.array_join("relevant_doc_ids", " , "), F.lit(",")).alias("relevant_docs"))
    return ground_truth.from_batch(rows).select("query_id", F.md5("query_text").alias("digest"), F.array_join("relevant_doc_ids", "|").alias("ids"))


def text_search(spark: SparkSession, folder: str) -> DataFrame:
    """Page chunks for the texts of the evaluation queries, by hashed words."""
    words = embedding.create("hash", dimension=64)
    items = embedding.embed(table(spark, folder, "eval_items").select(F.col("item_id").alias("query_id"), "query_text"), F.col("query_text"), words)
    pages = embedding.embed(spread(table(spark, folder, "pdf_chunks").select("id", "content")), F.col("content"), words)
    hits = retrieval.exact_top_k(items.select("query_id", "vector"), pages.select("id", "vector"), 5)
    return hits.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


def text_search_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """From query texts to mean metrics: embed, search, evaluate."""
    words = embedding.create("hash", dimension=256)
    items = embedding.embed(table(spark, folder, "eval_items").select(F.col("item_id").alias("query_id"), "query_text", "relevant_doc_ids"), F.col("query_text"), words)
    pages = embedding.embed(spread(table(spark, folder, "pdf_chunks").select("id", "content")), F.col("content"), words)
    hits = retrieval.exact_top_k(items.select("query_id", "vector"), pages.select("id", "vector"), 10)
    judged = items.select("query_id", F.explode("relevant_doc_ids").alias("doc_id"))
    found = evaluation.per_query(hits.select("query_id", "rank", F.col("id").cast("string").alias("doc_id")), judged)
    return _rounded(evaluation.averages(found))


def language_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """Lengths of code with a line for its language."""
    language = F.col("metadata.document_specific_metadata.language")
    return table(spark, folder, "code_chunks").select("id", F.md5(with_language(F.col("content"), language)).alias("digest"))


def collection_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of a collection of all section chunks, in order of file, chunk and content, after 1000 rows that are there."""
    rows = table(spark, folder, "word_chunks").select("metadata.source_file", "metadata.chunk_id", "content", F.array().cast("array<float>").alias("vector"))
    return shaped(rows, first_id=1000).select("id", "source_file", "chunk_id", F.length("content").alias("size"))


def collection_all_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of a collection of the chunks of all three tables with their vectors."""
    fields = ["id", "metadata.source_file", "metadata.chunk_id", "content"]
    pages, sections, code = (table(spark, folder, name).select(*fields) for name in ("pdf_chunks", "word_chunks", "code_chunks"))
    vectors = table(spark, folder, "chunk_vectors").select("id", F.col("embedding").alias("vector"))
    rows = pages.unionByName(sections).unionByName(code).join(vectors, "id", "left").drop("id")
    return shaped(rows).select("id", "source_file", "chunk_id", F.length("content").alias("size"))


RUNS = ("ip", "l2", "short")


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    """Mean metrics of three runs: inner product, distance, and inner product of the first 16 numbers."""
    rows = _vectors(spark, folder)
    judged = _judged(rows)
    short = rows.select("id", F.slice("vector", 1, 16).alias("vector"))
    found = {
        "ip": _ranked(spark, folder), "l2": _ranked(spark, folder, "L2"),
        "short": retrieval.exact_top_k(_asked(short), short, 10).select("query_id", "rank", F.col("id").cast("string").alias("doc_id")),
    }
    parts = [
        evaluation.averages(evaluation.per_query(hits, judged)).select(F.lit(name).alias("experiment"), F.lit(i).alias("position"), "metric", F.round("value", 6).alias("value"))
        for i, (name, hits) in enumerate(found.items())
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def compare_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of three runs side by side, as formatted for the file."""
    return comparison.csv_lines(comparison.pivoted(_runs(spark, folder), RUNS), RUNS)


def compare_best_flags(spark: SparkSession, folder: str) -> DataFrame:
    """The best runs of each metric."""
    return comparison.marked(_runs(spark, folder))


def compare_best(spark: SparkSession, folder: str) -> DataFrame:
    """The best run by nDCG at 5."""
    return comparison.best_experiment(_runs(spark, folder))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "exact_topk_ip": _top("IP"), "exact_topk_l2": _top("L2"), "exact_topk_cosine": _top("COSINE"), "unit_norms": unit_norms,
    "search_with_payload": search_with_payload, "search_filtered": search_filtered, "ivf_all_lists": ivf_all_lists, "ivf_four_lists": ivf_four_lists,
    "evaluate_per_query": evaluate_per_query, "evaluate_graded": evaluate_graded, "evaluate_means": evaluate_means, "evaluate_coverage": evaluate_coverage,
    "doc_id_truthy": doc_id_truthy, "qrels_last_wins": qrels_last_wins, "qrels_statistics": qrels_statistics, "qrels_validation": qrels_validation,
    "qrels_pairs": qrels_pairs, "qrels_batch": qrels_batch, "text_search": text_search, "text_search_evaluation": text_search_evaluation,
    "language_prefix": language_prefix, "collection_ids": collection_ids, "collection_all_ids": collection_all_ids, "compare_pivot": compare_pivot, "compare_best_flags": compare_best_flags,
    "compare_best": compare_best,
}

_SCORES = {
    "IP": ("list_inner_product({q}, {x})", "DESC"),
    "L2": ("power(list_distance({q}, {x}), 2)", "ASC"),
    "COSINE": ("list_cosine_similarity({q}, {x})", "DESC"),
}


def _hits(metric: str, k: int, where: str = "true", slice_: str = "") -> str:
    score, order = _SCORES[metric]
    score = score.format(q=f"(q.embedding{slice_})::DOUBLE[]", x=f"(e.embedding{slice_})::DOUBLE[]")
    return f"""SELECT * FROM (
        SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({score}, 9) {order}, e.vec_id) AS rank, e.vec_id AS id, {score} AS score
        FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND {where}) WHERE rank <= {k}"""


def _top_sql(metric: str, k: int = 5) -> str:
    return f"SELECT query_id, rank, id, round(score, 6) AS score FROM ({_hits(metric, k)})"


_QRELS = "SELECT q.vec_id AS query_id, d.vec_id AS doc_id, 1.0 AS grade FROM embeddings q JOIN embeddings d ON q.label = d.label WHERE q.vec_id % 20 = 0"
_GRADED = "SELECT q.vec_id AS query_id, d.vec_id AS doc_id, CASE WHEN d.label = q.label THEN 2.0 ELSE 1.0 END AS grade FROM embeddings q JOIN embeddings d ON d.label IN (q.label, q.label + 1) WHERE q.vec_id % 20 = 0"


def _metrics_sql(hits: str, judged: str) -> str:
    per_k = ", ".join(
        f"""round(h{k} / {k}.0, 6) AS precision_at_{k}, round(h{k} / n, 6) AS recall_at_{k},
        round(CASE WHEN h{k} > 0 THEN 2 * (h{k} / {k}.0) * (h{k} / n) / (h{k} / {k}.0 + h{k} / n) ELSE 0 END, 6) AS f1_at_{k},
        CASE WHEN h{k} > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_rate_at_{k}, round(g{k} / i{k}, 6) AS ndcg_at_{k}"""
        for k in KS
    )
    sums = ", ".join(f"sum(CASE WHEN rank <= {k} THEN rel ELSE 0 END)::DOUBLE AS h{k}, sum(CASE WHEN rank <= {k} THEN coalesce(grade, 0) / log2(rank + 1) ELSE 0 END)::DOUBLE AS g{k}" for k in KS)
    ideal = ", ".join(f"sum(CASE WHEN p <= {k} THEN grade / log2(p + 1) ELSE 0 END)::DOUBLE AS i{k}" for k in KS)
    return f"""
        WITH hits AS ({hits}), judged AS ({judged}),
        ideal AS (SELECT query_id, count(*)::DOUBLE AS n, {ideal} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS p FROM judged) GROUP BY 1),
        marked AS (SELECT h.query_id, rank, grade, (grade IS NOT NULL)::INT AS rel FROM hits h LEFT JOIN judged j ON j.query_id = h.query_id AND j.doc_id = h.id),
        counted AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank) AS cum FROM marked),
        sums AS (SELECT query_id, count(*) AS num_retrieved, min(CASE WHEN rel = 1 THEN rank END) AS first, sum(CASE WHEN rel = 1 THEN cum / rank::DOUBLE END) AS pr, {sums} FROM counted GROUP BY 1)
        SELECT query_id, {per_k}, round(coalesce(1.0 / first, 0), 6)::DOUBLE AS mrr, round(coalesce(pr / n, 0), 6) AS map, num_retrieved, n::BIGINT AS num_relevant
        FROM sums JOIN ideal USING (query_id)"""


def _means_sql(hits: str, judged: str = _QRELS) -> str:
    raw = _metrics_sql(hits, judged)
    for k in KS:  # means are taken before rounding
        raw = raw.replace(f"round(h{k} / {k}.0, 6)", f"(h{k} / {k}.0)").replace(f"round(h{k} / n, 6)", f"(h{k} / n)").replace(f"round(g{k} / i{k}, 6)", f"(g{k} / i{k})")
    raw = raw.replace("ELSE 0 END, 6) AS f1", "ELSE 0 END, 15) AS f1").replace("round(coalesce(1.0 / first, 0), 6)", "coalesce(1.0 / first, 0)").replace("round(coalesce(pr / n, 0), 6)", "coalesce(pr / n, 0)")
    parts = " UNION ALL ".join(f"SELECT '{m}' AS metric, round(avg({m}), 6) AS value FROM m" for m in evaluation.metric_names())
    return f"WITH m AS ({raw}) {parts}"


_RUNS_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS experiment, {i} AS position, metric, value FROM ({_means_sql(hits)})"
    for i, (name, hits) in enumerate({"ip": _hits("IP", 10), "l2": _hits("L2", 10), "short": _hits("IP", 10, slice_="[1:16]")}.items())
)
#: Unit vectors of hashed words in single precision, as the embedder gives them.
_HASHED = """SELECT {key}, list_transform(c, lambda x: (x / greatest(sqrt(list_inner_product(c, c))::FLOAT::DOUBLE, 1e-12))::FLOAT::DOUBLE) AS v FROM (
    SELECT {key}, list_transform(range({size}), lambda i: len(list_filter(ps, lambda p: p = i))::DOUBLE) AS c FROM (
    SELECT {key}, list_transform(list_filter(regexp_split_to_array(lower({text}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % {size}) AS ps FROM {table} WHERE {text} IS NOT NULL))"""


def _text_hits(size: int, k: int) -> str:
    q, x = _HASHED.format(key="item_id", text="query_text", table="eval_items", size=size), _HASHED.format(key="id", text="content", table="pdf_chunks", size=size)
    return f"""SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
        SELECT item_id AS query_id, id, round(list_inner_product(q.v, x.v), 9) AS score FROM ({q}) q, ({x}) x)) WHERE rank <= {k}"""


_TEXT_QRELS = "SELECT query_id, doc_id, 1.0 AS grade FROM (SELECT DISTINCT item_id AS query_id, try_cast(unnest(relevant_doc_ids) AS BIGINT) AS doc_id FROM eval_items)"
_TRUTH_SQL = """SELECT 'q' || id AS query_id, CASE WHEN id % 11 = 0 THEN '  ' ELSE metadata.preview END AS query_text, metadata.page_number AS page,
    CASE WHEN id % 7 = 0 THEN []::VARCHAR[] WHEN id % 5 = 0 THEN [id::VARCHAR, id::VARCHAR] WHEN id % 13 <> 0 THEN [id::VARCHAR, (id + 1)::VARCHAR] END AS relevant_doc_ids FROM pdf_chunks"""

SQL: dict[str, str] = {
    "exact_topk_ip": _top_sql("IP"),
    "exact_topk_l2": _top_sql("L2"),
    "exact_topk_cosine": _top_sql("COSINE"),
    "ivf_all_lists": _top_sql("IP"),
    "unit_norms": """SELECT id, round(sqrt(coalesce(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 0)), 5) AS before,
        CASE WHEN coalesce(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 0) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS after FROM chunk_vectors WHERE embedding IS NOT NULL""",
    "search_with_payload": f"SELECT h.*, d.lang, substr(d.text, 1, 200) AS preview FROM ({_top_sql('IP')}) h LEFT JOIN documents d ON d.doc_id = h.id",
    "search_filtered": f"SELECT query_id, count(*) AS hits, max(rank) AS last_rank FROM ({_hits('IP', 1000, 'e.label = 3')}) GROUP BY 1",
    "evaluate_per_query": _metrics_sql(_hits("IP", 10), _QRELS),
    "evaluate_graded": f"SELECT query_id, {', '.join(f'ndcg_at_{k}' for k in KS)}, precision_at_10 FROM ({_metrics_sql(_hits('IP', 10), _GRADED)})",
    "evaluate_means": _means_sql(_hits("IP", 10)),
    "evaluate_coverage": """SELECT count(*) AS total_queries, count(*) FILTER (label <> 0) AS queries_evaluated, count(*) FILTER (label = 0) AS queries_skipped
        FROM embeddings WHERE vec_id % 20 = 0""",
    "doc_id_truthy": f"SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, id::VARCHAR AS doc_id FROM ({_hits('IP', 10)}) WHERE id <> 0",
    "qrels_last_wins": f"SELECT query_id, md5(CASE WHEN page % 2 = 0 THEN 'again ' || query_text ELSE query_text END) AS digest, len(relevant_doc_ids)::INT AS relevant FROM ({_TRUTH_SQL})",
    "qrels_statistics": f"""SELECT count(*) AS num_queries, sum(coalesce(len(relevant_doc_ids), 0))::BIGINT AS total_relevant, round(avg(coalesce(len(relevant_doc_ids), 0)), 6) AS avg_relevant,
        min(coalesce(len(relevant_doc_ids), 0))::INT AS min_relevant, max(coalesce(len(relevant_doc_ids), 0))::INT AS max_relevant, 0::BIGINT AS queries_with_metadata FROM ({_TRUTH_SQL})""",
    "qrels_validation": f"""SELECT query_id, coalesce({strip_sql("query_text")} = '', true) AS blank_text, coalesce(len(relevant_doc_ids), 0) = 0 AS no_relevant,
        coalesce(len(list_distinct(relevant_doc_ids)) < len(relevant_doc_ids), false) AS repeated_relevant, coalesce({strip_sql("query_text")} <> '', false) AS valid FROM ({_TRUTH_SQL})""",
    "qrels_pairs": f"SELECT DISTINCT query_id, doc_id FROM (SELECT query_id, unnest(relevant_doc_ids) AS doc_id FROM ({_TRUTH_SQL})) WHERE doc_id IS NOT NULL",
    "qrels_batch": f"SELECT query_id, md5({strip_sql('query_text')}) AS digest, coalesce(array_to_string(relevant_doc_ids, '|'), '') AS ids FROM ({_TRUTH_SQL}) WHERE {strip_sql('query_text')} <> ''",
    "text_search": f"SELECT query_id, rank, id, round(score, 6) AS score FROM ({_text_hits(64, 5)})",
    "text_search_evaluation": _means_sql(_text_hits(256, 10), _TEXT_QRELS),
    "language_prefix": """SELECT id, md5(CASE WHEN metadata.document_specific_metadata.language IS NOT NULL THEN '# Language: ' || metadata.document_specific_metadata.language || chr(10) || content
        ELSE content END) AS digest FROM code_chunks""",
    "collection_ids": """SELECT 999 + row_number() OVER (ORDER BY metadata.source_file NULLS FIRST, metadata.chunk_id NULLS FIRST, content NULLS FIRST) AS id, metadata.source_file AS source_file,
        metadata.chunk_id::BIGINT AS chunk_id, length(content)::INT AS size FROM word_chunks""",
    "collection_all_ids": """SELECT row_number() OVER (ORDER BY f NULLS FIRST, c NULLS FIRST, content NULLS FIRST) - 1 AS id, f AS source_file, c::BIGINT AS chunk_id, length(content)::INT AS size FROM (
        SELECT metadata.source_file AS f, metadata.chunk_id AS c, content FROM pdf_chunks UNION ALL SELECT metadata.source_file, metadata.chunk_id, content FROM word_chunks
        UNION ALL SELECT metadata.source_file, metadata.chunk_id, content FROM code_chunks)""",
    "compare_pivot": f"""SELECT metric, {", ".join(f"printf('%.4f', max(CASE WHEN experiment = '{r}' THEN value END)) AS {r}" for r in RUNS)} FROM ({_RUNS_SQL}) GROUP BY 1""",
    "compare_best_flags": f"SELECT experiment, metric, value, value = max(value) OVER (PARTITION BY metric) AND value > 0 AS is_best FROM ({_RUNS_SQL})",
    "compare_best": f"SELECT experiment, metric, value FROM ({_RUNS_SQL}) WHERE metric = 'ndcg_at_5' ORDER BY value DESC, position LIMIT 1",
}
