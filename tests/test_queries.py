"""Registered queries against their SQL on the smallest tables, if these are there."""

import os

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
OWN = sorted(set(__spark_entry__.oracle_sql()) - {n for n in __spark_entry__.oracle_sql() if n.startswith("op")})


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the synthetic tables")
@pytest.mark.parametrize("name", OWN)
def test_query_equals_sql(spark, duck, name):
    c = duck
    a, b = __spark_entry__.queries()[name](spark, SF).toPandas(), c.sql(__spark_entry__.oracle_sql()[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns) and len(a) == len(b)
    a, b = (x[cols].astype(object).where(x[cols].notna(), None) for x in (a, b))
    key = lambda x: sorted((tuple(None if v is None else round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in x.itertuples(index=False)), key=str)
    assert key(a) == key(b)


def test_works_without_the_training_data_operators(tmp_path):
    """The entry point imports and lists its queries when the llm folders are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__file__).resolve().parents[1]
    shutil.copytree(top / "opalgrid", tmp_path / "opalgrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') for q in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0, out.stderr[-800:]
    assert out.stdout.split()[1] == "False" and int(out.stdout.split()[0]) > 100


def test_window_counts_do_not_carry_the_name_of_the_track_buffer():
    import __spark_entry__ as entry

    assert "windowed_counts" in entry.queries() and "l1_windowed_counts" not in entry.queries()
