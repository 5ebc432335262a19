"""Every query with an SQL twin gives the twin's rows on the smallest tables."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_queries import plain

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for file in sorted(os.listdir(FOLDER)):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS FROM '{FOLDER}/{file}'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_twin(spark, db, name):
    ours = entry.queries()[name](spark, FOLDER).toPandas()
    theirs = db.execute(entry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_twin_has_a_query():
    from lumenframe.plans.catalog_sql import SQL

    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("pipeline", [True, False])
def test_the_rest_works_without_the_text_operators(tmp_path, pipeline):
    """With the subpackage away, with and without the pipeline's file, all other queries are there."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(os.path.join(root, "lumenframe"), tmp_path / "lumenframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for file in ["__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline else [])]:
        if os.path.exists(os.path.join(root, file)):
            shutil.copy(os.path.join(root, file), tmp_path)
    code = "import __spark_entry__ as e; print(sorted(e.queries()), sorted(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    from lumenframe.plans import catalog

    assert done.returncode == 0, done.stderr
    assert done.stdout.strip() == f"{sorted(catalog.QUERIES)} {sorted(catalog.sql())}"
