import importlib
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from kinweave.plans import catalog, checks
from kinweave.sources import shared

DIR = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DIR.exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in DIR.glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in found), key=lambda r: tuple((x is None, str(x)) for x in r))


QUERIES, ORACLE_SQL = catalog.QUERIES | checks.QUERIES, catalog.ORACLE_SQL | checks.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_and_sql_agree(spark, con, name):
    mark = shared.written()
    got = QUERIES[name](spark, str(DIR))
    want = con.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
    shared.sweep(mark)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - {"pair_features"}))
def test_learned_queries_score_every_row(spark, con, name):
    """Models have no SQL: a row for each labelled document or record, scores between 0 and 1, better for those that are marked."""
    got = QUERIES[name](spark, str(DIR)).toPandas()
    if name == "clean_records":
        assert len(got) == con.sql("SELECT count(*) FROM documents").fetchall()[0][0] and got["entity_id"].is_unique
        return
    assert len(got) == con.sql("SELECT count(*) FROM labels JOIN documents USING (doc_id)").fetchall()[0][0]
    assert got["p"].between(0, 1).all() and abs(got[got.y == 1].p.mean() - got[got.y == 0].p.mean()) > 0.05


def test_entry_works_without_the_corpus_operators(tmp_path):
    root = Path(catalog.__file__).parents[2]
    for name in ("kinweave", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(root / name) if name != "kinweave" else None
    (tmp_path / "kinweave").mkdir()
    for p in (root / "kinweave").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "kinweave" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'id_lists' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_every_sql_has_its_query():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
