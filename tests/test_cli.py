import json

from lexicarta.cli import main
from lexicarta.plans import pipeline


def test_from_chunks_to_scores(spark, tmp_path):
    chunks = [{"content": t, "metadata": {"source_file": "f", "chunk_id": i, "page_number": i, "chunk_type": "text", "text_length": len(t), "preview": t}} for i, t in enumerate(["red apple", "green pear", "blue plum"])]
    (tmp_path / "chunks.json").write_text(json.dumps(chunks))
    (tmp_path / "truth.json").write_text(json.dumps([{"query_id": "q1", "query_text": "x", "relevant_doc_ids": ["1"]}, {"query_id": "q1", "query_text": "green pear", "relevant_doc_ids": ["2", "1"]}]))
    place = str(tmp_path / "collection")
    assert main(["ingest", str(tmp_path / "chunks.json"), place]) == 0
    assert main(["query", place, str(tmp_path / "results"), "--query", "a green pear", "--top-k", "2"]) == 0
    assert main(["evaluate", str(tmp_path / "truth.json"), str(tmp_path / "results"), "--k", "1", "2", "--csv", str(tmp_path / "csv")]) == 0
    lines = "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*")).splitlines()
    assert "precision_at_1,1.0000" in lines and "recall_at_1,0.5000" in lines and "mrr,1.0000" in lines
    assert main(["evaluate", str(tmp_path / "truth.json"), str(tmp_path / "results"), "--k", "1", "2", "--save", str(tmp_path / "saved")]) == 0
    saved = json.loads((tmp_path / "saved" / "results.json").read_text())
    assert saved["k_values"] == [1, 2] and saved["aggregate"]["mrr"] == 1.0 and saved["summary"] == {"queries_evaluated": 1, "total_queries": 1} and list(saved["per_query"]) == ["q1"]
    assert main(["compare", str(tmp_path / "saved" / "results.json"), str(tmp_path / "none.json"), "--csv", str(tmp_path / "side.csv")]) == 0
    side = (tmp_path / "side.csv").read_text().splitlines()
    assert side[0] == "Metric,results" and "mrr,1.0000" in side and side[-2] == "Metadata" and side[-1].startswith("results,1,")
    assert main(["compare", str(tmp_path / "none.json")]) == 1
    assert main(["query", place, str(tmp_path / "results2"), "--query", "a green pear", "--index", "IVF"]) == 0
    assert main(["truth", str(tmp_path / "t.json"), "--number", "3"]) == 0
    assert json.loads((tmp_path / "t.json").read_text())["metadata"] == {"num_queries": 3, "format_version": "1.0"}
    (tmp_path / "batch.csv").write_text('query_id,query_text,relevant_docs\nq1,green pear,"2, 1"\n,blank,3\n')
    assert main(["truth", str(tmp_path / "b.json"), "--batch", str(tmp_path / "batch.csv")]) == 0
    assert json.loads((tmp_path / "b.json").read_text())["queries"] == [{"query_id": "q1", "query_text": "green pear", "relevant_doc_ids": ["2", "1"]}]
    (tmp_path / "bad.json").write_text("1")
    assert main(["evaluate", str(tmp_path / "bad.json"), str(tmp_path / "results")]) == 1


def test_from_files_to_chunks(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    body = "\n".join(f"    x{i} = {i}" for i in range(30))
    (folder / "a.py").write_text(f"import os\n\ndef f():\n{body}\n")
    (folder / "b.php").write_text("<?php\n" + "\n".join(f"echo {i};" for i in range(400)))
    (folder / "c.docx").write_bytes(b"broken")
    (folder / "d.pdf").write_bytes(b"page one|page two")
    (folder / "e.txt").write_text("not asked for")
    assert main(["chunk", str(folder), str(tmp_path / "out"), "--types", "code", "word"]) == 0
    found = [json.loads(line) for p in (tmp_path / "out").glob("part-*") for line in p.read_text().splitlines()]
    names = sorted({c["metadata"]["source_file"].rpartition("/")[2] for c in found})
    assert names == ["a.py", "b.php"] and all(c["metadata"]["text_length"] == len(c["content"]) or c["metadata"]["source_file"].endswith("a.py") for c in found)
    reader = lambda content: [{"page_number": i, "text": t} for i, t in enumerate(content.decode().split("|"), 1)]
    chunks, outcomes = pipeline.chunk_folder(spark, str(folder), read_pages=reader)
    got = {r.source_file.rpartition("/")[2]: (r.file_type, r.error is not None, r.chunks) for r in outcomes.collect()}
    assert got["d.pdf"] == ("pdf", False, 2) and got["c.docx"] == ("word", True, 0) and got["a.py"][2] >= 1 and got["b.php"][2] >= 2 and len(got) == 4
    assert {r.content for r in chunks.where("metadata.source_file like '%pdf'").collect()} == {"page one", "page two"}
