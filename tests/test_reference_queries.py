"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from brindle import queries as own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6f}"
    return str([norm(y) for y in x]) if isinstance(x, (list, tuple)) else str(x)


@pytest.mark.parametrize("name", sorted(own.queries()))
def test_query_equals_its_sql(spark, duck, name):
    assert name in own.oracle_sql()
    frame = own.queries()[name](spark, SF)
    found = duck.execute(own.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(frame.columns) == sorted(names)
    wanted = sorted([norm(r[names.index(c)]) for c in sorted(names)] for r in found.fetchall())
    assert sorted([norm(r[c]) for c in sorted(names)] for r in frame.collect()) == wanted


def test_entry_without_the_optional_parts(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parent.parent
    shutil.copytree(root / "brindle", tmp_path / "brindle", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'load_filter' in e.queries() and not any(k.startswith('op') for k in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
