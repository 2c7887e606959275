"""Every registered query against its SQL on the smallest tables, and the entry module's guard."""

from __future__ import annotations

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from scoreloom.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("orders", "events", "conversations", "embeddings"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name not in ORACLES:
        assert got
        return
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = [dict(zip(names, row)) for row in found.fetchall()]
    flat = lambda r: repr([r[c] for c in sorted(names)])
    assert sorted(map(flat, (r.asDict() for r in got))) == sorted(map(flat, want))


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_works_without_the_training_data_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in os.listdir(root):
        if name in ("scoreloom", "corpus_pipeline.py", ".git", "tests"):
            continue
        os.symlink(f"{root}/{name}", tmp_path / name)
    os.mkdir(tmp_path / "scoreloom")
    for name in os.listdir(f"{root}/scoreloom"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{root}/scoreloom/{name}", tmp_path / "scoreloom" / name)
    code = "import __spark_entry__ as e; assert not e.HAS_LLM and not e.HAS_PIPELINE; q = e.queries(); assert 'loan_view' in q and not any(n.startswith('op1') for n in q); assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""}).returncode == 0


def test_core_queries_stay_when_a_dependency_is_missing():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; q = e.queries(); assert not e.HAS_LLM and 'loan_view' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-B", "-c", code], cwd=root, capture_output=True).returncode == 0
