import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_registered_queries_have_unique_names_and_known_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_imports_without_the_training_data_package(tmp_path):
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, *_):\n"
        "        if name.startswith('lexicarta.llm'): raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'p2_found' in e.queries() and not any(n.startswith(('p1_', 'p3_')) for n in e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_outside_imports_the_training_data_package():
    for path in (ROOT / "lexicarta").rglob("*.py"):
        if "llm" not in path.parts:
            assert "lexicarta.llm" not in path.read_text()


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    import pytest

    from lexicarta.runtime import ensure_checkpoint_dir

    def session(master, named=None):
        made = []
        undefined = SimpleNamespace(isDefined=lambda: False)
        sc = SimpleNamespace(
            master=master, getConf=lambda: SimpleNamespace(get=lambda *_: named), setCheckpointDir=made.append,
            _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: undefined)),
        )
        return SimpleNamespace(sparkContext=sc), made

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            ensure_checkpoint_dir(session(master)[0])
        spark, made = session(master, "hdfs:///shared")
        assert ensure_checkpoint_dir(spark) == "hdfs:///shared" and made == ["hdfs:///shared"]
    spark, made = session("local[4]")
    assert made == [ensure_checkpoint_dir(spark)]
