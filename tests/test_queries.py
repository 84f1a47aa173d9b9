"""Every query of the engine against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from trajspark import catalog


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for path in glob.glob(f"{small}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    clean = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else v
    return sorted((tuple(map(clean, r)) for r in frame.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, small, name):
    found = catalog.QUERIES[name](spark, small).toPandas()
    if name in catalog.ORACLES:
        expected = duck.sql(catalog.ORACLES[name]).df()
        assert sorted(found.columns) == sorted(expected.columns)
        assert rows(found) == rows(expected)
    else:
        assert len(found) > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())


def test_imports_without_the_corpus_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "trajspark", tmp_path / "trajspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'resource_card' in q and not any(k.startswith('op1') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True, timeout=120)
    rest = [sys.executable, "-m", "pytest", "-q", "-x", "-p", "no:cacheprovider", "tests/test_sequences.py", "tests/test_order.py"]
    subprocess.run(rest, cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True, timeout=600)


def test_only_absence_of_the_corpus_operators_is_passed_over(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    (tmp_path / "corpus_pipeline.py").write_text("import something_that_is_not_there\n")
    root = Path(__file__).resolve().parent.parent
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": f"{tmp_path}{os.pathsep}{root}"}, capture_output=True, timeout=120)
    assert run.returncode and b"something_that_is_not_there" in run.stderr
