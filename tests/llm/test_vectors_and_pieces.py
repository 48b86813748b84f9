import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexicarta.llm.similar_vectors import Settings, most_similar, similar_pairs
from lexicarta.llm.splitting import cut_points, split_oversized
from tests.conftest import rows


def neighbours(x, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -9)
    return np.lexsort((np.tile(np.arange(len(x)), (len(x), 1)), -np.round(s, 7)), axis=1)[:, :k], s


def test_recall_against_exact_search(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    x = (centres[rng.integers(0, 30, 900)] + 0.3 * rng.normal(size=(900, 16))).astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, e array<float>")
    s = Settings(dimension=16, parts=4, cell=40, probes=8, sample=500, group=4, block=200)
    got = most_similar(df, F.col("id"), F.col("e"), 5, s)
    want, _ = neighbours(x, 5)
    exact = {(i, int(j)) for i, r in enumerate(want) for j in r}
    assert len(exact & set(rows(got, "id", "other"))) >= 0.9 * len(exact)
    assert got.groupBy("id").count().where("count <> 5").count() == 0


@pytest.mark.parametrize(("n", "group", "block"), [(1500, 48, 8192), (6000, 3, 700)])
def test_recall_in_a_dense_third(spark, n, group, block):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 16))
    x[::3] = rng.normal(size=16) * 4 + 0.5 * rng.normal(size=(len(x[::3]), 16))
    x = x.astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, e array<float>")
    s = Settings(dimension=16, parts=4, cell=n // 20, probes=2, sample=400, asked=600, group=group, block=block)
    got = set(rows(most_similar(df, F.col("id"), F.col("e"), 5, s), "id", "other"))
    want, _ = neighbours(x, 5)
    for part in (range(0, n, 3), range(1, n, 3)):
        assert sum((i, int(j)) in got for i in part for j in want[i]) >= 0.9 * 5 * len(part)


def test_no_vector_is_sent_to_each_group_that_asks_its_cell(spark):
    from lexicarta.runtime import ensure_checkpoint_dir

    n, store = 4000, spark.sparkContext._jsc.sc().statusStore()
    x = np.random.default_rng(6).normal(size=(n, 64)).astype(np.float32).astype(np.float64)  # without near neighbours, so that most cells are asked
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, e array<float>")
    before = store.executorSummary("driver").totalShuffleWrite()
    got = set(rows(most_similar(df, F.col("id"), F.col("e"), 5, Settings(group=2)), "id", "other"))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    # the shelves once, and here all vectors are in the sample that the centroids are fitted on; a third query-sized part is the answers
    assert (store.executorSummary("driver").totalShuffleWrite() - before) / (n * 4 * 64) < 8
    want, _ = neighbours(x, 5)
    assert sum((i, int(j)) in got for i, r in enumerate(want) for j in r) >= 0.9 * want.size
    files = spark._jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark) + "/files-*")
    assert not files.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(files)  # the shelves are gone


def test_unusable_and_equal_vectors(spark):
    v = [1.0, 0.0, 0.0, 0.0]
    data = [(i, v) for i in range(8)] + [(8, [2.0, 0.0, 0.0, 0.0]), (9, [1.0, 1.0, 0.0, 0.0]), (None, v), (20, None), (21, [0.0] * 4), (22, [1.0]), (23, []), (24, [1.0, None, 0.0, 0.0]), (25, [float("nan")] * 4)]
    df = spark.createDataFrame(data, "id bigint, e array<float>").withColumn("cls", F.lit(1))
    got = most_similar(df, F.col("id"), F.col("e"), 5, Settings(dimension=4, parts=2, sample=100))
    found = {}
    for i, other in rows(got, "id", "other"):
        found.setdefault(i, []).append(other)
    assert sorted(found) == list(range(10))
    assert sorted(found[0]) == [1, 2, 3, 4, 5] and sorted(found[8]) == [0, 1, 2, 3, 4] and sorted(found[9]) == [0, 1, 2, 3, 4]
    assert (0, 9) not in rows(similar_pairs(got, 0.85))
    assert most_similar(df.where("id > 19"), F.col("id"), F.col("e"), 5, Settings(dimension=4, parts=2)).count() == 0


def test_many_cells_are_fitted_in_two_levels_and_grouped():
    from lexicarta.llm.similar_vectors import _coarse, _grouped

    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = _coarse(x, 1500, rng)
    assert 1300 < len(centres) < 1700 and np.allclose(np.linalg.norm(centres, axis=1), 1, atol=1e-3)
    counts = rng.integers(0, 9, len(centres))
    counts[7] = 5000  # a hot cell is a group with few others
    group = _grouped(centres, counts, 400)
    sums = np.bincount(group, counts)
    assert sorted(np.unique(group)) == list(range(group.max() + 1))
    assert all(n <= 400 or (group == g).sum() == 1 for g, n in enumerate(sums)) and len(sums) < 60


TEXT = st.lists(st.sampled_from(["word", "longerword", ". ", ", ", "\n", "\n\n", " ", "x" * 30, "é", "😀"]), min_size=0, max_size=200).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(1, 120), st.integers(0, 119))
def test_pieces_hold_the_text_within_the_limit(text, limit, overlap):
    overlap = min(overlap, limit - 1)
    pieces = cut_points(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(b - a <= limit for a, b, _ in pieces)
    for (_, stop, _), (start, after, _) in zip(pieces, pieces[1:]):
        assert start == max(0, stop - overlap) and after > stop
    again = "".join(text[(a if n == 0 else pieces[n - 1][1]) : b] for n, (a, b, _) in enumerate(pieces))
    assert again == text


def test_pieces_end_at_the_strongest_boundary():
    text = ("word " * 15 + "end. ") * 3 + "\n\n" + ("word " * 15 + "end. ") * 3
    (_, stop, name), *_ = cut_points(text, 300, 20)
    assert name == "paragraph" and text[:stop].endswith("\n\n")
    assert [b for *_, b in cut_points("x" * 100, 40, 0)] == ["none", "none", "end"]
    assert len(cut_points("a " * 100, 101, 0)) == 2  # no more pieces than needed


def test_full_width_marks_are_boundaries():
    text = ("文" * 20 + "，" + "字" * 20 + "。」") * 30
    pieces = cut_points(text, 300, 20)
    assert {b for *_, b in pieces[:-1]} == {"sentence"} and all(text[:stop].endswith("。」") for _, stop, _ in pieces[:-1])
    clauses = cut_points(("文" * 20 + "，") * 30, 300, 20)
    assert {b for *_, b in clauses[:-1]} == {"clause"}


@pytest.mark.parametrize("place", [5, 40, 110, 199])
def test_a_boundary_far_from_the_target_is_found(place):
    text = "x" * (place - 1) + " " + "y" * (300 - place)
    pieces = cut_points(text, 200, 10)
    assert (place, "word") in [(stop, b) for _, stop, b in pieces]
    assert all(b - a <= 200 for a, b, _ in pieces)


def test_no_piece_ends_inside_a_run_that_could_be_avoided():
    text = " ".join("w" * 70 for _ in range(20))
    assert {b for *_, b in cut_points(text, 100, 0)} == {"word", "end"}


def test_only_rows_over_the_limit_of_their_kind(spark):
    data = [(1, "a" * 11, "text"), (2, "a" * 10, "text"), (3, "a" * 11, None), (4, None, "text"), (5, "a" * 99, "other"), (6, "a" * 11, "nolimit"), (7, "", "text"), (8, "😀" * 10, "text")]
    df = spark.createDataFrame(data, "id bigint, content string, kind string").withColumn("max_chars", F.lit(1))
    limits = spark.createDataFrame([("text", 10, 3), ("other", 50, 50), ("nolimit", None, None)], "chunk_type string, max_chars int, overlap_chars int")
    got = split_oversized(df, F.col("id"), F.col("content"), F.col("kind"), limits)
    assert [r[0] for r in rows(got.where("piece = 0"), "id")] == [1, 3, 5]
    assert got.where("length(content) > 50").count() == 0 and got.where("stop - start <> length(content)").count() == 0


@pytest.mark.parametrize("size", [0, 1, 5])
def test_short_texts_are_one_piece(size):
    assert cut_points("x" * size, 5, 2) == [(0, size, "end")]
