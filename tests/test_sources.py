import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lexicarta.operators.embedding import HashEmbedder
from lexicarta.settings import Settings, top_k
from lexicarta.sources import docx, files, jsonfiles
from lexicarta.sources.collection import Collection, inferred_schema, shaped
from lexicarta.streaming.append import append_stream, late_chunks, stream_chunks
from tests.conftest import rows

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def word_file():
    body = (
        '<w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>one </w:t><w:tab/><w:t>two</w:t></w:r></w:p>'
        "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>"
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.py").write_text("pass\n")
    (tmp_path / "a/y.docx").write_bytes(word_file())
    (tmp_path / "broken.docx").write_bytes(b"no")
    (tmp_path / "Z.PY").write_text("pass")
    (tmp_path / "n.txt").write_text("x")
    assert sorted(r.path.rpartition("/")[2] for r in files.discover(spark, str(tmp_path)).collect()) == ["broken.docx", "x.py", "y.docx"]
    assert files.discover(spark, str(tmp_path), ["code"], fold_case=True).count() == 2
    assert files.discover(spark, str(tmp_path), ["nothing"]).count() == 0
    assert rows(files.source_texts(spark, str(tmp_path)), "extension", "code") == [(".py", "pass"), (".py", "pass\n")]
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", True).load(str(tmp_path))
    got = files.extract(found, docx.blocks, docx.BLOCKS)
    assert rows(got.where("error is null"), "idx", "kind", "style", "text", "cells") == [
        (0, "paragraph", "Heading 1", "Top", None), (1, "paragraph", "Normal", "one \ttwo", None), (2, "table", None, None, [["a", ""]]),
    ]
    assert got.where("error is not null").select("error").first()[0].startswith("BadZipFile")


def test_json_files(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"queries": [{"query_id": "a", "query_text": "é"}]}), encoding="utf-8")
    queries = jsonfiles.read_queries(spark, str(tmp_path / "q.json"))
    assert rows(queries) == [("a", "é")]
    assert rows(jsonfiles.inline_queries(spark, ["x", "y"])) == [("q1", "x"), ("q2", "y")]
    hits = spark.createDataFrame([("a", 2, 5, 0.5), ("a", 1, 9, 0.7)], "query_id string, rank bigint, id bigint, score double")
    jsonfiles.write_results(hits, queries, str(tmp_path / "r"), {"k": "v"})
    assert rows(jsonfiles.read_results(spark, str(tmp_path / "r")), "query_id", "rank", "id", "score") == [("a", 1, 9, 0.7), ("a", 2, 5, 0.5)]
    truth = spark.createDataFrame([("a", "t", ["1"])], "query_id string, query_text string, relevant_doc_ids array<string>")
    jsonfiles.write_judgements(truth, str(tmp_path / "t/g.json"))
    (tmp_path / "bare.json").write_text(json.dumps([{"query_id": "b", "query_text": "u", "relevant_doc_ids": [3]}]))
    for name, want in (("t/g.json", ("a", "t", ["1"])), ("bare.json", ("b", "u", ["3"]))):
        assert rows(jsonfiles.read_judgements(spark, str(tmp_path / name)), "query_id", "query_text", "relevant_doc_ids") == [want]
    (tmp_path / "bad.json").write_text("7")
    with pytest.raises(ValueError):
        jsonfiles.read_judgements(spark, str(tmp_path / "bad.json"))
    chunks = spark.createDataFrame([("c", ("f", None))], "content string, metadata struct<source_file: string, page_number: int>")
    jsonfiles.write_chunks(chunks, str(tmp_path / "c"))
    assert '"page_number":null' in "".join(p.read_text() for p in (tmp_path / "c").glob("part-*"))
    assert jsonfiles.read_chunks(spark, str(tmp_path / "c"), "source_file string, page_number int").collect() == chunks.collect()


def test_collections(spark, tmp_path):
    store = Collection(spark, str(tmp_path / "c"))
    assert "error" in store.statistics() and not store.delete()
    data = [(f"f{i % 3}", i, f"text {i}", [3.0, 4.0], {"a": i}) for i in range(20)]
    df = spark.createDataFrame(data, "source_file string, chunk_id int, content string, vector array<float>, more map<string,int>")
    assert store.ingest(df) == 20 and store.ingest(df.where("chunk_id < 5")) == 25
    got = store.read()
    assert [r[0] for r in rows(got, "id")] == sorted(range(25), key=repr)
    first = got.where("id < 20").orderBy("id").select("source_file", "chunk_id").collect()
    assert first == sorted(first) and got.first().vector == pytest.approx([0.6, 0.8])
    assert dict(got.dtypes)["more"] == "string" and store.statistics()["dimension"] == 2
    assert store.ingest(df.where("chunk_id < 5"), replace=True) == 5
    assert store.delete() and not store.exists()
    assert shaped(df.where("false")).count() == 0
    assert inferred_schema(df)["chunk_id"] == "bigint" and list(inferred_schema(df))[:4] == ["id", "vector", "content", "preview"]


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    rows_ = spark.createDataFrame([("f", 0, "a b"), ("f", 1, "c")], "source_file string, chunk_id int, content string")
    rows_.write.parquet(source)
    store = Collection(spark, str(tmp_path / "out"))
    stream = stream_chunks(spark, source, "source_file string, chunk_id int, content string")
    for _ in range(2):  # the second run finds nothing new
        append_stream(stream, HashEmbedder(8), store, str(tmp_path / "state")).awaitTermination()
        assert store.read().count() == 2
    times = spark.createDataFrame([("2024-01-01 10:00:00", None), ("2024-01-01 11:00:00", "text")], "t string, chunk_type string").select(F.to_timestamp("t").alias("extracted_at"), "chunk_type")
    assert rows(late_chunks(times), "chunk_type", "chunks") == [("text", 2)]


def test_settings(tmp_path):
    s = Settings(data=tmp_path / "data")
    assert s.chunks_path() == tmp_path / "data/chunks/experiment" and s.chunks_path("chunks/x") == s.chunks_path("x")
    assert s.chunks_path(str(tmp_path)) == tmp_path and s.chunks_path("data/chunks/x") == tmp_path / "data/chunks/x"
    assert s.with_store("file", metric="L2").store("file").metric == "L2" and top_k(0, s.store("file")) == 5 == top_k(None, s.store("file"))
    with pytest.raises(ValueError):
        s.store("none")


def test_ids_of_a_large_collection_have_no_gaps(spark, tmp_path):
    store = Collection(spark, str(tmp_path / "large"))
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    made = spark.range(0, 300_000, numPartitions=16).select(
        F.concat(F.lit("file-"), F.pmod(F.xxhash64("id"), F.lit(999)).cast("string")).alias("source_file"), F.pmod(F.hash("id"), F.lit(50)).cast("int").alias("chunk_id"),
        F.md5(F.col("id").cast("string")).alias("content"), F.array(F.rand(3).cast("float"), F.lit(1.0).cast("float")).alias("vector"),
    )
    for n in (1, 2):
        assert store.ingest(made) == 300_000 * n
        found = store.read().agg(F.count("id"), F.countDistinct("id"), F.min("id"), F.max("id")).first()
        assert tuple(found) == (300_000 * n, 300_000 * n, 0, 300_000 * n - 1)
    first = store.read().where("id < 300000").orderBy("id").select("source_file", "chunk_id", "content").limit(2000).collect()
    assert first == sorted(first)


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    store = Collection(spark, str(tmp_path / "once"))
    batch = lambda a, b: spark.range(a, b).select(F.lit("f").alias("source_file"), F.col("id").cast("int").alias("chunk_id"), F.lit("x").alias("content"), F.array(F.lit(1.0).cast("float")).alias("vector"))
    assert store.ingest_once(batch(0, 10), "s-0") == 10
    assert store.ingest_once(batch(0, 10), "s-0") == 10
    assert store.ingest_once(batch(10, 15), "s-1") == 15
    # the rows are there, but the writer ended before it noted so
    (tmp_path / "once" / "_batches" / "s-1.done").unlink()
    assert store.ingest_once(batch(10, 15), "s-1") == 15
    # the writer ended before any row was there
    (tmp_path / "once" / "_batches" / "s-2.first-15").touch()
    assert store.ingest_once(batch(15, 18), "s-2") == 18
    assert sorted(r.id for r in store.read().collect()) == list(range(18))
