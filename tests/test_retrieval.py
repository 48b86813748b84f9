import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexicarta.functions.vectors import cosine, dot, norm, normalise, squared_distance
from lexicarta.operators import comparison, embedding, evaluation, ground_truth, retrieval, statistics
from tests.conftest import rows


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(120, 6)), 3)
    x[7] = x[3]  # a tie
    data = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    return x, spark.createDataFrame([*data, (900, None), (901, [1.0]), (None, [9.0] * 6)], "id bigint, vector array<float>")


@pytest.mark.parametrize("metric", retrieval.METRICS)
def test_exact_search(spark, vectors, metric):
    x, df = vectors
    x = x.astype(np.float32).astype(np.float64)
    q = df.where("id < 10").select(F.col("id").alias("query_id"), "vector")
    for block in (3, 100):
        got = rows(retrieval.exact_top_k(q, df, 4, metric, query_block=block), "query_id", "rank", "id")
        want = []
        for i in range(10):
            s = {"IP": x @ x[i], "L2": -((x - x[i]) ** 2).sum(1), "COSINE": x @ x[i] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[i])}[metric]
            want += [(i, r + 1, int(j)) for r, j in enumerate(np.lexsort((np.arange(len(x)), -np.round(s, 9)))[:4])]
        assert got == sorted(want, key=repr)


def test_search_edges(spark, vectors):
    _, df = vectors
    q = df.where("id < 2").select(F.col("id").alias("query_id"), "vector")
    assert retrieval.exact_top_k(q, df.where("id < 3"), 10).count() == 6
    assert retrieval.exact_top_k(q.where("false"), df, 3).count() == 0
    assert retrieval.exact_top_k(q, df.where("false"), 3).count() == 0
    with pytest.raises(ValueError):
        retrieval.exact_top_k(q, df, 3, "HAMMING")
    plan = retrieval.exact_top_k(q, df, 3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_inverted_file(spark, vectors):
    _, df = vectors
    rows_ = df.where("size(vector) = 6")
    q = rows_.where("id < 10").select(F.col("id").alias("query_id"), "vector")
    index = retrieval.InvertedFile.fit(rows_, lists=6)
    exact = set(rows(retrieval.exact_top_k(q, rows_, 5), "query_id", "id"))
    assert set(rows(index.search(q, rows_, 5, probes=6), "query_id", "id")) == exact
    recalls = [len(exact & set(rows(index.search(q, rows_, 5, probes=p), "query_id", "id"))) for p in (1, 3, 6)]
    assert recalls == sorted(recalls)


def test_inverted_file_reaches_recall_by_itself(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 24))
    x[::3] = 2 + 0.2 * rng.normal(size=(500, 24))  # a third in one dense group
    rows_ = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(9000, [1.0])], "id bigint, vector array<float>")
    q = rows_.where("id % 10 = 0 and id < 9000").select(F.col("id").alias("query_id"), "vector")
    index = retrieval.InvertedFile.fit(rows_.where("id < 9000"))
    assert len(index.centres) > 16
    for metric in retrieval.METRICS:
        exact = set(rows(retrieval.exact_top_k(q, rows_, 10, metric), "query_id", "id"))
        got = set(rows(index.search(q, rows_, 10, metric=metric, block=16), "query_id", "id"))
        assert len(exact & got) >= 0.9 * len(exact)
    assert index.probes_for(q, rows_, 10, "L2") < len(index.centres)


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = df.select(dot("a", "b"), norm("a"), squared_distance("a", "b"), cosine("a", "b"), normalise(F.col("a"))).collect()
    assert [tuple(r) for r in got] == [(3.0, 5.0, 20.0, 0.6, [0.6, 0.8]), (0.0, 0.0, 2.0, None, [0.0, 0.0])]


def metrics(spark, found, relevant, ks=(1, 3, 5)):
    hits = spark.createDataFrame([("q", i, d) for i, d in enumerate(found, 1)], "query_id string, rank bigint, doc_id string")
    graded = isinstance(relevant, dict)
    judged = [("q", d, float(relevant[d]) if graded else 1.0) for d in relevant]
    out = evaluation.per_query(hits, spark.createDataFrame(judged, "query_id string, doc_id string, grade double"), ks, graded).collect()
    return out[0].asDict() if out else None


def test_metric_definitions(spark):
    m = metrics(spark, ["a"], ["a"])
    assert (m["precision_at_5"], m["recall_at_5"], m["mrr"], m["ndcg_at_5"]) == (0.2, 1.0, 1.0, 1.0)
    m = metrics(spark, ["a", "a"], ["a"], (2,))
    assert (m["precision_at_2"], m["recall_at_2"]) == (1.0, 2.0)
    m = metrics(spark, ["x", "a", "y", "b"], ["a", "b", "c"])
    assert m["map"] == pytest.approx((1 / 2 + 2 / 4) / 3) and m["mrr"] == 0.5 and m["hit_rate_at_1"] == 0.0
    m = metrics(spark, ["a", "b"], {"a": 1, "b": 3}, (2,))
    assert m["ndcg_at_2"] == pytest.approx((1 + 3 / math.log2(3)) / (3 + 1 / math.log2(3)))
    m = metrics(spark, ["a"], {"a": 0}, (1,))
    assert (m["precision_at_1"], m["ndcg_at_1"]) == (1.0, 0.0)
    m = metrics(spark, ["a"], ["a"], (0,))
    assert [m[f"{n}_at_0"] for n in ("precision", "recall", "f1", "hit_rate", "ndcg")] == [0.0] * 5
    assert metrics(spark, ["a"], []) is None and metrics(spark, [], ["a"]) is None


def test_means_skip_queries_without_judgements(spark):
    hits = spark.createDataFrame([("q1", 1, "a"), ("q2", 1, "b"), ("q3", 1, "c")], "query_id string, rank bigint, doc_id string")
    qrels = spark.createDataFrame([("q1", "a"), ("q2", "x"), ("q9", "a"), ("q3", None)], "query_id string, doc_id string")
    means = dict(rows(evaluation.averages(evaluation.per_query(hits, qrels))))
    assert means["mrr"] == 0.5 and len(means) == 22
    assert rows(evaluation.coverage(hits, qrels)) == [(3, 2, 1)]


def test_ids_by_truth_value(spark):
    hits = spark.createDataFrame([("q", 1, 0, None, None), ("q", 2, 7, None, None), ("q", 3, 0, None, 0), ("q", 4, None, 5, 2)], "query_id string, rank bigint, id bigint, alt_id bigint, chunk_id bigint")
    assert rows(evaluation.resolved_ids(hits)) == [("q", 1, "7"), ("q", 2, "0"), ("q", 3, "5")]
    assert rows(evaluation.resolved_ids(hits, "coalesce")) == [("q", 1, "0"), ("q", 2, "7"), ("q", 3, "0"), ("q", 4, "5")]


def test_ground_truth(spark):
    data = [("a", "x", ["1", "1", None], 0), ("a", "y", ["2"], 3), ("b", " ", [], 1), ("c", None, None, 2), (None, "z", ["1"], 4)]
    entries = spark.createDataFrame(data, "query_id string, query_text string, relevant_doc_ids array<string>, pos int")
    truth = ground_truth.last_wins(entries)
    assert rows(truth) == [("a", "y", ["2"]), ("b", " ", []), ("c", None, None)]
    assert rows(ground_truth.validation(truth)) == [("a", False, False, False, True), ("b", True, True, False, False), ("c", True, True, False, False)]
    assert ground_truth.is_valid(truth).first()[0] is False and ground_truth.is_valid(truth.where("false")).first()[0] is False
    assert rows(ground_truth.statistics(truth)) == [(3, 1, 1 / 3, 0, 1, 0)]
    assert rows(ground_truth.statistics(truth.where("false"))) == [(0, 0, 0.0, 0, 0, 0)]
    assert rows(ground_truth.qrels(entries)) == [("a", "1"), ("a", "2"), (None, "1")]
    assert rows(ground_truth.add_queries(truth, truth.where("query_id = 'a'").selectExpr("query_id", "'new' as query_text", "relevant_doc_ids")), "query_id", "query_text")[0] == ("a", "new")
    batch = spark.createDataFrame([("q", " t ", " 1,, 2 "), ("r", "t", None), ("", "t", "1"), ("s", None, "1")], "query_id string, query_text string, relevant_docs string")
    assert rows(ground_truth.from_batch(batch)) == [("q", "t", ["1", "2"]), ("r", "t", [])]
    assert ground_truth.template(spark, 3).count() == 3


def test_comparison(spark):
    data = [("x", 0, "ndcg_at_5", 0.5), ("y", 1, "ndcg_at_5", 0.5), ("y", 1, "mrr", 0.0), ("z", 2, "mrr", 0.0)]
    runs = spark.createDataFrame(data, "experiment string, position int, metric string, value double")
    assert rows(comparison.best_experiment(runs)) == [("x", "ndcg_at_5", 0.5)]
    assert rows(comparison.best_experiment(runs, "nothing"), "metric") == [("mrr",)]
    assert comparison.best_experiment(runs.where("false")).count() == 0
    assert rows(comparison.csv_lines(comparison.pivoted(runs, ["x", "y", "z"]), ["x", "y", "z"])) == [("mrr", "0.0000", "0.0000", "0.0000"), ("ndcg_at_5", "0.5000", "0.5000", "0.0000")]
    assert rows(comparison.marked(runs), "experiment", "metric", "is_best") == [("x", "ndcg_at_5", True), ("y", "mrr", False), ("y", "ndcg_at_5", True), ("z", "mrr", False)]


def test_statistics(spark):
    df = spark.createDataFrame([("text", 4), (None, None), ("text", 8)], "k string, n int")
    assert rows(statistics.chunk_statistics(df, F.col("k"), F.col("n"))) == [("text", 2, 12, 6.0, 200 / 3), ("unknown", 1, 0, 0.0, 100 / 3), (None, 3, 12, 4.0, 100.0)]
    assert rows(statistics.chunk_statistics(df.where("false"), F.col("k"), F.col("n"))) == [(None, 0, 0, 0.0, 0.0)]


def test_embedding(spark):
    df = spark.createDataFrame([(1, "Alpha beta alpha", "go"), (2, "", None), (3, None, None)], "id int, t string, lang string")
    got = {r.id: r.vector for r in embedding.embed(df, F.col("t"), embedding.create("hash", dimension=8)).collect()}
    assert np.linalg.norm(got[1]) == pytest.approx(1) and got[2] == [0.0] * 8 and got[3] is None
    code = {r.id: r.vector for r in embedding.embed(df, F.col("t"), embedding.create("hash", "code", dimension=8), F.col("lang")).collect()}
    assert code[1] != got[1] and code[2] == got[2]
    with pytest.raises(ValueError):
        embedding.create("nobody")


def test_index_by_name(spark, tmp_path):
    import numpy as np

    from lexicarta.settings import StoreSettings

    rng = np.random.default_rng(8)
    x = np.concatenate([c + 0.3 * rng.normal(size=(60, 8)) for c in rng.normal(size=(10, 8))])
    corpus = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, vector array<float>")
    asked = corpus.where("id % 20 = 0").selectExpr("id as query_id", "vector")
    exact = set(rows(retrieval.search_by(StoreSettings(), asked, corpus, 5), "query_id", "id"))
    assert set(rows(retrieval.search_by(StoreSettings(index="HNSW"), asked, corpus, 5), "query_id", "id")) == exact
    assert len(exact & set(rows(retrieval.search_by(StoreSettings(index="IVF"), asked, corpus, 5), "query_id", "id"))) >= 0.9 * len(exact)
    stored = retrieval.InvertedFile.fit(corpus, 12).store(corpus, str(tmp_path / "ivf"))
    again = retrieval.InvertedFile.load(spark, str(tmp_path / "ivf"))
    assert np.allclose(stored.centres, again.centres)
    got = set(rows(retrieval.search_by(StoreSettings(index="IVF", probes=12), asked, corpus, 5, again), "query_id", "id"))
    assert got == exact
    few = again.search(asked.where("query_id = 0"), corpus, 5, 2)
    assert few.count() == 5
    with pytest.raises(ValueError):
        retrieval.search_by(StoreSettings(index="Tree"), asked, corpus)


def test_many_rows_and_ties_keep_the_lesser_ids(spark):
    # more rows than a block of a task, most of them tied
    corpus = spark.range(0, 20_000, numPartitions=3).selectExpr("id", "array(cast(id % 7 as float), 1f) as vector")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0])], "query_id bigint, vector array<float>")
    got = rows(retrieval.exact_top_k(asked, corpus, 4), "query_id", "rank", "id")
    assert got == [(1, r, 6 + 7 * (r - 1)) for r in range(1, 5)] + [(2, r, 7 * (r - 1)) for r in range(1, 5)]
    blocks = rows(retrieval.exact_top_k(asked, corpus, 4, query_block=1), "query_id", "rank", "id")
    assert blocks == got


def test_nested_payload_is_read_again(spark):
    df = spark.createDataFrame([(1, '{"a": [1, 2]}'), (2, "no json {"), (3, None)], "id bigint, boxes string")
    got = retrieval.reparsed(df, ["boxes", "missing"]).selectExpr("id", "try_variant_get(boxes, '$.a[1]', 'int') as a", "try_variant_get(boxes, '$', 'string') as t", "boxes is null as gone")
    found = {r.id: (r.a, r.t, r.gone) for r in got.collect()}
    assert found[1][0] == 2 and found[2] == (None, "no json {", False) and found[3] == (None, None, True)
