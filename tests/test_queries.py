"""Registered queries against their SQL, and the driver contract."""

import subprocess
import sys
from pathlib import Path

import pytest

from lodestack.plans import catalog

ROOT = Path(__file__).parents[1]


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(name, same):
    same(catalog.QUERIES[name], catalog.ORACLE_SQL[name])


def test_queries_without_sql_run(spark, small):
    for name in set(catalog.QUERIES) - set(catalog.ORACLE_SQL):
        assert catalog.QUERIES[name](spark, small).count() > 0, name


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_optional_parts(tmp_path):
    """The entry module works where the training-data operators are gone."""
    for p in ("__spark_entry__.py", "lodestack"):
        (tmp_path / p).symlink_to(ROOT / p) if p.endswith(".py") else __import__("shutil").copytree(ROOT / p, tmp_path / p, ignore=lambda d, names: [n for n in names if n in ("llm", "__pycache__")])
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    assert said.stdout.split() == [str(len(catalog.QUERIES)), str(len(catalog.ORACLE_SQL))]
