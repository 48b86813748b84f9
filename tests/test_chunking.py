import random

import pytest
from pyspark.sql import functions as F

from lexicarta.functions.text import listed_ids, markdown_table, stem, strip
from lexicarta.operators import code_elements, packing, pdf_pages, word_sections
from tests.conftest import rows


def packed(parts, most):
    if len("\n\n".join(parts)) <= most:
        return [parts] if parts else []
    out, cur, n = [], [], 0
    for p in parts:
        if cur and n + len(p) > most:
            out.append(cur)
            cur, n = [], 0
        cur.append(p)
        n += len(p)
    return [*out, cur] if cur else out


def lined(parts, most):
    out, cur, n = [], [], 0
    for p in parts:
        cur.append(p)
        n += len(p) + 1
        if n >= most:
            out.append(cur)
            cur, n = [], 0
    return [*out, cur] if cur else out


def test_packers_against_plain_loops(spark):
    rng = random.Random(4)
    data = [(i, ["x" * rng.choice([0, 3, 400, 600, 2000]) for _ in range(rng.randint(0, 9))]) for i in range(60)]
    data += [(100, ["a" * 600, "b" * 400]), (101, ["a" * 10, "b" * 2000, "c" * 10]), (102, ["z" * 1499]), (103, [])]
    df = spark.createDataFrame([*data, (104, None)], "key int, parts array<string>")
    got = {}
    for r in packing.pack_paragraphs(df, F.col("key"), F.col("parts"), 1000).collect():
        got.setdefault(r.key, {})[r.chunk_id] = (r.content, r.is_continuation)
    want = {k: {i: ("\n\n".join(g), i > 0) for i, g in enumerate(packed(p, 1000))} for k, p in data if packed(p, 1000)}
    assert got == want
    got = {}
    for r in packing.pack_lines(df, F.col("key"), F.col("parts"), 1500).collect():
        got.setdefault(r.key, []).append((r.chunk_id, r.content, r.line_start, r.line_end))
    for key, parts in data:
        groups = lined(parts, 1500)
        expected = [
            (i, "\n".join(g), i * 1500 // 80, len(parts) if sum(len(x) + 1 for x in g) < 1500 else (i + 1) * 1500 // 80) for i, g in enumerate(groups)
        ]
        assert sorted(got.get(key, [])) == expected


def test_text_functions(spark):
    df = spark.createDataFrame([(" \x1c a b \n", "x/y.tar.gz", " a, ,b ,"), (None, None, None), ("", "noext", "")], "t string, p string, ids string")
    out = df.select(strip(F.col("t")).alias("s"), stem(F.col("p")).alias("stem"), listed_ids(F.col("ids")).alias("ids"))
    assert out.collect() == [("a b", "y.tar", ["a", "b"]), (None, None, None), ("", "noext", [])]
    tables = spark.createDataFrame([([["a", None], ["1", "2"]],), ([["h"]],), ([],), (None,)], "rows array<array<string>>").select(markdown_table(F.col("rows")).alias("m"))
    assert [r.m for r in tables.collect()] == ["| a |  |\n| --- | --- |\n| 1 | 2 |", "| h |\n| --- |", "", ""]


def test_sections_and_their_chunks(spark):
    blocks = [
        ("d", 0, "paragraph", "Normal", "before", None, False), ("d", 1, "paragraph", "Heading 2", "  ", None, True), ("d", 2, "paragraph", "List Bullet", " item ", None, False),
        ("d", 3, "paragraph", "Normal", " ", None, True), ("d", 4, "table", None, None, [[" h ", None], ["1", "2"]], False), ("d", 5, "paragraph", "Title", "T", None, False),
        ("d", 6, "paragraph", "Normal", "x" * 700, None, False), ("d", 7, "paragraph", "Normal", "y" * 700, None, False), ("e", 0, "paragraph", None, None, None, None),
    ]
    df = spark.createDataFrame(blocks, "source_file string, idx int, kind string, style string, text string, cells array<array<string>>, has_image boolean")
    found = word_sections.sections(df)
    assert rows(found, "source_file", "section", "heading", "heading_level", "style_name", "image_count", "has_lists") == [
        ("d", 0, "(Document Start)", 0, "Normal", 0, False), ("d", 1, "(Untitled Section)", 2, "Heading 2", 1, True), ("d", 2, "T", 1, "Title", 0, False),
    ]
    got = word_sections.section_chunks(found, 1000).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.page_number, r.chunk_type, r.content[:22]) for r in got] == [
        (0, 1, "text", "before"), (1, 2, "text", "# (Untitled Section)\n\n"), (2, 2, "table", "# (Untitled Section)\n\n"), (3, 2, "image_heavy_page", "# (Untitled Section)\n\n"),
        (4, 3, "text", "# T\n\n" + "x" * 17), (5, 3, "text", "y" * 22),
    ]
    assert got[2].content.endswith("## Table 1\n\n| h |  |\n| --- | --- |\n| 1 | 2 |")
    assert [(r.is_continuation, r.parent_section) for r in got[4:]] == [(False, None), (True, "T")]


def test_page_routes(spark):
    img = lambda x: [(0.0, 0.0, x, 10.0)]
    pages = [
        ("f", 0, " t ", [], 0, img(1.5), 1, 10.0, 10.0, "seen"), ("f", 1, " t ", [], 0, img(1.6), 1, 10.0, 10.0, "seen"), ("f", 2, "t", [[["a"], ["b"]]], 1, img(9.0), 0, 10.0, 10.0, "seen"),
        ("f", 3, "  ", [[]], 2, None, 3, 10.0, 10.0, None), ("f", 4, None, None, None, None, None, 0.0, 0.0, None), ("f", 5, "t", [], 0, img(9.0), 1, 0.0, 10.0, None),
    ]
    schema = "source_file string, page_number int, text string, tables array<array<array<string>>>, num_tables int, images array<struct<x0: double, y0: double, x1: double, y1: double>>, num_images int, page_width double, page_height double, vision_text string"
    got = pdf_pages.page_chunks(spark.createDataFrame(pages, schema))
    assert [(r.chunk_type, r.content, r.is_vision_processed) for r in got.orderBy("page_number").collect()] == [
        ("mixed", "t", False), ("image_heavy_page", "seen", True), ("table", "t\n\n\n\n--- Tables ---\n\n\n| a |\n| --- |\n| b |", False),
        ("mixed", "", False), ("text", "", False), ("mixed", "t", False),
    ]
    assert rows(pdf_pages.file_summary(got)) == [("f", 6, 1, 1, 3, 1, 3, 6)]


CODE = """import os
from a import b

class A(object):
    def one(self):
        if x == 1 :
            return while_
# comment
    def two(self):
        pass

def late():
    pass
"""


def test_code_elements(spark):
    df = spark.createDataFrame([("p/m.py", ".py", CODE), ("n.py", ".py", None), ("x.c", ".c", "int f() {}"), ("J.java", ".java", "public class J {\n  public int go(int a) {\n  }\n}")], "source_file string, extension string, code string")
    got = code_elements.elements(df).where("source_file like '%py' or source_file like '%java'").select("source_file", F.explode("code_elements").alias("e")).select("source_file", "e.*")
    assert rows(got) == sorted([
        ("J.java", 0, 2, "function", "J", None),
        ("J.java", 1, 1, "function", "go", None),
        ("p/m.py", 3, 10, "class", "A", None),
        ("p/m.py", 4, 7, "method", "one", "A"),
        ("p/m.py", 8, 10, "method", "two", "A"),
        ("p/m.py", 11, 13, "method", "late", "A"),  # a class is never closed
    ], key=repr)
    chunks = code_elements.code_chunks(df, least=30).where("extension = '.py'").orderBy("chunk_id").collect()
    assert [(c.chunk_id, c.element_type, c.element_name) for c in chunks] == [(0, "class", "A"), (1, "method", "one"), (2, "method", "two")]  # small ones are lost
    assert chunks[1].content.startswith("class A(object):\nimport os\nfrom a import b\n\n    def one(self):")
    assert chunks[1].complexity_score == 2


@pytest.mark.parametrize(("code", "score"), [("a", 1), (" if  if(x) else  for", 4), (" if if ", 2)])
def test_complexity(spark, code, score):
    assert spark.createDataFrame([(code,)], "c string").select(code_elements.complexity(F.col("c"))).first()[0] == score
