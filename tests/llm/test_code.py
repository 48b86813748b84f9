import pytest
from pyspark.sql import functions as F

from lexicarta.llm.function_docs import documented_functions, pairs, running_text
from lexicarta.llm.source_origin import file_origins
from tests.conftest import rows

DOC = "Reads every row of the table twice."

CASES = [
    ("a.py", f'def f(a,\n      b):\n    """{DOC}"""\n    return 1\n', ["f"]),
    ("a.py", f"async def f(a) -> int:\n    r'''\n    {DOC}\n\n    :param a: x\n    '''\n", ["f"]),
    ("a.py", f"def f():\n    x = 1\n    '''{DOC}'''\n", []),
    ("a.py", f"# {DOC}\ndef f():\n    pass\n", []),
    ("a.py", f"T = '''\ndef g():\n    \"\"\"{DOC}\"\"\"\n'''\n", []),
    ("a.py", f"@decorated(1)\ndef f(): '{DOC}'\n", ["f"]),
    ("a.js", f"// {DOC}\nconst f = async (a, b) => {{\n  g(a);\n}};\n", ["f"]),
    ("a.js", f"/** {DOC} */\nexport default function f(a) {{}}\n", ["f"]),
    ("a.js", f"/** {DOC} */\n\nfunction f(a) {{}}\n", []),
    ("a.js", f"/* {DOC} */\nmodule.exports.f = function (a) {{ return 1; }}\n", ["f"]),
    ("a.js", f"// {DOC}\nif (a) {{\n}}\n// {DOC}\nf(a);\n", []),
    ("a.js", f"let x = 1; // {DOC}\nfunction f() {{}}\n", []),
    ("a.js", f"// function g() {{}} {DOC}\n", []),
    ("a.ts", f"class A {{\n  /** {DOC} */\n  @Input()\n  public async f<T>(a: T): Promise<void> {{\n  }}\n}}\n", ["f"]),
    ("a.ts", f"// {DOC}\nexport const f = (a: number): number => a + 1;\n", ["f"]),
    ("A.java", f"  /**\n   * {DOC}\n   * @param a b\n   */\n  @Override\n  public static <T> List<T> f(int a) throws E {{\n  }}\n", ["f"]),
    ("A.java", f"  // {DOC}\n  return f(a) {{\n", []),
    ("a.cpp", f"// {DOC}\nstatic inline std::vector<int> A::f(int a) const {{\n}}\n", ["f"]),
    ("a.c", f"/* {DOC} */\nint f(int a);\n", []),
    ("a.go", f"// {DOC}\nfunc (r *T) F(a int) (int, error) {{\n}}\n", ["F"]),
    ("a.rs", f"/// {DOC}\n#[inline]\npub(crate) async fn f<'a>(x: &'a str) -> Result<(), E> where T: X {{\n}}\n", ["f"]),
    ("a.rb", f"# {DOC}\ndef self.f?(a)\nend\n", ["f?"]),
    ("a.php", f"<?php\n/** {DOC} */\n#[Pure]\npublic static function f($a) {{\n}}\n", ["f"]),
    ("a.txt", f"// {DOC}\nfunction f() {{}}\n", []),
]


@pytest.mark.parametrize(("path", "code", "names"), CASES)
def test_functions_with_documentation(path, code, names):
    assert [row[0] for row in documented_functions(code, path, None) if row[3] >= 4] == names


@pytest.mark.parametrize(
    ("raw", "name", "text"),
    [
        ("/** Open the kiln heading. */", "openKilnHeading", ""),
        ("# Opens files. Pack the terminal", "pack_terminal", "Opens files."),
        ("/**\n * Real words stand here.\n * ------\n * @param a first\n *   more of it\n * @return b\n */", "f", "Real words stand here."),
        ("// TODO: write this up some day\n// and more of it", "f", ""),
        ("// eslint-disable-next-line no-unused-vars", "f", ""),
        ("// codecheck: ignore line length", "f", ""),
        ("// return compute(a, 3);\n// x = x + 6;", "f", ""),
        ("# Reads a file: the name comes first.", "f", "Reads a file: the name comes first."),
    ],
)
def test_running_text(raw, name, text):
    assert running_text(raw, name) == text


def test_python_sections():
    assert running_text('"""Adds two numbers up.\n\n    Args:\n        a: the first number of all\n    Returns:\n        their whole sum\n    """', "f", True) == "Adds two numbers up."


def test_pairs_of_rows(spark):
    data = [(1, CASES[0][1], "x.py", None), (2, None, "x.py", None), (3, "", "x.py", None), (4, CASES[0][1], None, "Python"), (5, CASES[0][1], None, None), (5, CASES[0][1], "y.py", "java")]
    df = spark.createDataFrame(data, "id bigint, content string, f string, l string")
    got = pairs(df, F.col("id"), F.col("content"), F.col("f"), F.col("l"))
    assert rows(got, "id", "function_name", "language", "documentation") == [(i, "f", "python", DOC) for i in (1, 4, 5)]
    assert got.first().code.startswith("def f(a,")


def body(seed, n=12):
    return "\n".join(f"    v{i} = compute(a{seed}, {seed * 1000 + i * 7})\n    w{i} = lookup(v{i}, {seed * 31 + i})" for i in range(n))


def test_origins(spark):
    library = f"def load(x):\n{body(77)}\n"
    files = {
        ("r1", "r1/src/own.py"): f"def own(x):\n{body(1)}\n",
        ("r1", "r1/lib/copy.py"): library,
        ("r2", "r2/app/renamed.py"): library.replace("compute", "calc").replace("a77", "other") + "# a patch\n",
        ("r3", "r3/min.js"): "!function(e,t){" + "".join(f"var a{i % 9}=e[t]|b;c(d,{i});" for i in range(60)) + "}()",
        ("r3", "r3/blob.py"): "T = [\n" + ", ".join(str(i * 37 % 256) for i in range(400)) + "]\n",
        ("r3", "r3/made.go"): "// Code generated by maker. DO NOT EDIT.\npackage a\n",
        ("r3", "r3/free.go"): "// The report below is generated by hand; edit freely.\npackage a\n",
        ("r3", "r3/banner.py"): "B = '# Code generated by this tool. DO NOT EDIT.'\n" + body(5),
        ("r4", "r4/x_pb2.py"): f"def pb(x):\n{body(6)}\n",
        ("r4", "r4/vendor/one/one.js"): "// one v1.2.3\n// (c) the authors, see upstream LICENSE\nfunction a() {}\n",
        ("r4", "r4/vendor_portal/own.js"): "// the portal of our vendors\nfunction a() {}\n",
        ("r4", "r4/empty.py"): "",
        ("r4", "r4/null.py"): None,
    }
    # units speak by their siblings: another file of each form elsewhere
    siblings = {
        ("r3", "r3/other.min.js"): "!function(e,t){" + "".join(f"var c{i % 7}=x[t]|b;d(c,{i + 3});" for i in range(50)) + "}()",
        ("r6", "r6/rows.py"): "R = [\n" + ", ".join(str(i * 11 % 199) for i in range(300)) + "]\n",
        ("r5", "r5/made.py"): "# Code generated by another-tool. DO NOT EDIT.\n" + body(8),
        ("r6", "r6/y_pb2.py"): f"def pb(x):\n{body(9)}\n",
        ("r5", "r5/external/two/two.js"): "// two v3.4.5\n// (c) the authors, see upstream LICENSE\nfunction b(c, d) {}\n",
    }
    unique = "# This module was automatically generated by hand-rolled scripts, and any local changes to it will be lost.\n"
    data = [(r, p, c) for (r, p), c in (files | siblings).items()] * 2 + [("r9", None, "x"), ("r9", "r9/lone.py", unique + body(10))]
    df = spark.createDataFrame(data, "repo string, path string, code string").withColumn("file", F.lit(1))
    got = file_origins(df, F.col("code"), F.col("path"), F.lit(None).cast("string"), F.col("repo"))
    kinds = {r.source_file.partition("/")[2]: [k for k in ("generated", "minified", "vendored", "blob") if r[k]] for r in got.collect()}
    assert kinds == {
        "src/own.py": [], "lib/copy.py": ["vendored"], "app/renamed.py": ["vendored"], "min.js": ["minified"], "blob.py": ["blob"], "made.go": ["generated"], "free.go": [],
        "banner.py": [], "x_pb2.py": ["generated"], "vendor/one/one.js": ["vendored"], "vendor_portal/own.js": [], "empty.py": [], "null.py": [],
        "other.min.js": ["minified"], "rows.py": ["blob"], "made.py": ["generated"], "y_pb2.py": ["generated"], "external/two/two.js": ["vendored"], "lone.py": [],
    }
    assert file_origins(df.where("false"), F.col("code"), F.col("path"), F.col("repo"), F.col("repo")).count() == 0


def test_large_files_just_over_the_threshold_are_linked(spark):
    import numpy as np

    data = []
    for seed in (1, 4, 11, 22):  # a common share of 0.606 of some 12,000 shingles each, but under 0.6 of the 4,096 least
        n = np.random.default_rng(seed).permutation(900_000)[: 6000 - 2264] + 100_000
        data += [(r, f"{r}/f{seed}.py", "\n".join(f"value = {i} ;" for i in numbers)) for r, numbers in (("r1", n[:3000]), ("r2", [*n[:2264], *n[3000:]]))]
    df = spark.createDataFrame(data, "repo string, path string, code string")
    got = file_origins(df, F.col("code"), F.col("path"), F.lit(None).cast("string"), F.col("repo"))
    assert got.where("vendored").count() == 8


def test_families_within_a_repository_are_generated(spark):
    shape = lambda name: f"class {name}:\n" + "".join(f"    def get_{name}_{i}(self):\n        return self.rows[{i}].{name}\n" for i in range(9))
    data = [("r", f"r/{n}.py", shape(n)) for n in ("alpha", "beta", "gamma")] + [("q", f"q/{n}.py", f"def {n}(x):\n{body(i)}") for i, n in enumerate("xyz")]
    df = spark.createDataFrame(data, "repo string, path string, code string")
    got = file_origins(df, F.col("code"), F.col("path"), F.lit(None).cast("string"), F.col("repo"))
    assert sorted(r.source_file for r in got.where("generated").collect()) == ["r/alpha.py", "r/beta.py", "r/gamma.py"]
    assert got.where("not hand_written and not generated").count() == 0


def _one_bucket(batches):
    import pyarrow as pa

    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[1]] * b.num_rows, pa.list_(pa.int64()))], names=["cls", "buckets"])


def test_links_behind_a_foreign_hub_are_found(spark, monkeypatch):
    from lexicarta.llm import source_origin as so
    from lexicarta.llm.near_duplicates import components

    # every file shares one scaffold; each second one from 2 on also shares more with the file before it
    scaffold = list(range(70))
    parts = {f: sorted(scaffold + [1000 + 100 * (f // 2 if f > 1 else 50 + f) + i for i in range(10)] + [100_000 + 100 * f + i for i in range(18)]) for f in range(12)}
    classes = spark.createDataFrame([(f, 0, g) for f, g in parts.items()], "cls bigint, kind int, shingles array<int>")
    monkeypatch.setattr(so, "_buckets", _one_bucket)
    for small, turns in ((64, 12), (2, 12), (2, 1)):
        got = dict(rows(components(so.links(classes, 0.65, small, turns)), "cls", "root"))
        assert got == {f: f // 2 * 2 for f in range(2, 12)}


def test_links_against_brute_force(spark):
    import numpy as np

    from lexicarta.llm import source_origin as so

    rng = np.random.default_rng(3)
    sets = []
    for family in range(60):
        base = rng.choice(50_000, 120, replace=False) + family * 100_000
        for _ in range(3):
            kept = rng.choice(base, int(rng.integers(80, 120)), replace=False)
            sets.append(sorted({*kept.tolist(), *(rng.choice(50_000, int(rng.integers(0, 30))) + 90_000_000).tolist()}))
    classes = spark.createDataFrame([(i, 0, g) for i, g in enumerate(sets)], "cls bigint, kind int, shingles array<int>")
    got = {tuple(sorted(r)) for r in rows(so.links(classes, 0.6), "cls_a", "cls_b")}
    true = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len({*sets[i]} & {*sets[j]}) >= 0.6 * len({*sets[i]} | {*sets[j]})}
    assert got <= true and len(got) >= 0.9 * len(true) > 20
