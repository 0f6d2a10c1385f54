"""Registered queries against their SQL twins on the smallest tables, and the entry point without optional parts."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from talkmill.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
#: Streams and models take their time; they have tests of their own.
SLOW = {"r01_rolling_history", "m02_keyword_model"}


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return float(x) if type(x).__name__ == "Decimal" else x


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_query_equals_sql(spark, tables, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = tables.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert ours == theirs


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_optional_parts(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    os.mkdir(tmp_path / "talkmill")
    for part in os.listdir(f"{root}/talkmill"):
        if part not in ("llm", "__pycache__"):
            os.symlink(f"{root}/talkmill/{part}", tmp_path / "talkmill" / part)
    os.symlink(f"{root}/__spark_entry__.py", tmp_path / "__spark_entry__.py")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'triage_disposition' in q and 'pipeline' not in q; assert not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"})
