import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from corvanta.plans.oracle import ORACLES
from corvanta.plans.queries import QUERIES

ROOT = Path(__file__).resolve().parents[1]
SMALL = "/root/testdata/sf0.001"


def rows(columns, values):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(round(v[i], 6) if isinstance(v[i], float) else v[i] for i in at)) for v in values)


@pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(__spark_entry__.queries().keys() & __spark_entry__.oracle_sql().keys()))
def test_like_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    mine = __spark_entry__.queries()[name](spark, SMALL)
    other = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in other.description]
    assert sorted(names) == sorted(mine.columns)
    assert rows(mine.columns, [tuple(r) for r in mine.collect()]) == rows(names, other.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10


def test_each_sql_has_its_query():
    assert ORACLES.keys() <= QUERIES.keys() and __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_imports_without_the_llm_folder(tmp_path):
    for name in ("corvanta", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    (tmp_path / "corvanta").mkdir()
    for part in (ROOT / "corvanta").iterdir():
        if part.name not in ("llm", "__pycache__"):
            (tmp_path / "corvanta" / part.name).symlink_to(part)
    code = "import __spark_entry__ as e; names = set(e.queries()); assert 'keyword_search' in names and not any(n.startswith('op') or n == 'pipeline' for n in names), names; assert set(e.oracle_sql()) <= names"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_llm():
    for path in (ROOT / "corvanta").rglob("*.py"):
        if "llm" not in path.parts:
            assert "corvanta.llm" not in path.read_text(), path
