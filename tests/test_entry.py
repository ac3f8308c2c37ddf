import importlib.util
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from cathodyne.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("gone", [["cathodyne/llm"], ["cathodyne/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_registry_without_optional_parts(tmp_path, gone):
    root = Path(entry.__file__).parent
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=lambda d, names: [n for n in names if os.path.relpath(os.path.join(d, n), root) in [*gone, ".git", "tests"] or n == "__pycache__"])
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(*sorted(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}  # the original folder must not be found
    env |= {"PYTHONPATH": os.path.dirname(os.path.dirname(spec.origin))} if (spec := importlib.util.find_spec("public_tokenizers")) else {}
    names = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, check=True).stdout.split()
    assert set(QUERIES) <= set(names) and "pipeline" not in names
    assert any(n.startswith("op") for n in names) == (gone == ["corpus_pipeline.py"] and os.path.isdir(root / "cathodyne/llm"))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{DATA}/lineitem.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(want.fetchall())


def test_operators_that_cannot_be_imported_leave_the_rest(tmp_path):
    """An operator's missing library takes the operators out, and nothing else."""
    root = Path(entry.__file__).parent
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "tests", "__pycache__"))
    (copy / "cathodyne/llm").mkdir(exist_ok=True)
    (copy / "cathodyne/llm/__init__.py").write_text("import a_library_that_is_not_there\n")
    (copy / "cathodyne/llm/queries.py").write_text("QUERIES, ORACLE_SQL = {}, {}\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(*e.queries())"
    names = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, check=True).stdout.split()
    assert set(names) == set(QUERIES)
