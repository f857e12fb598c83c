import pytest

from compare import connect, differences
from quire import catalog

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, sf_dir, name):
    said, _ = differences(spark, con, catalog.queries()[name], SQL[name], sf_dir)
    assert not said


def test_entry_imports_and_lists():
    import __spark_entry__ as entry

    assert set(SQL) <= set(entry.queries())


def test_rest_works_without_the_llm_folders(tmp_path):
    """The driver deletes these folders and the pipeline; the pipeline alone may be left behind."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    for name in ("quire", "tests"):
        shutil.copytree(root / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path)
    say = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not [n for n in q if n.startswith('op')] and set(e.oracle_sql()) <= set(q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", say], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
    assert out.returncode == 0, out.stderr[-2000:]
