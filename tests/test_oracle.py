"""Every query that has SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from rankloom.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "benchmark conversations documents embeddings pages".split()


def shown(rows):
    return sorted(tuple(repr(float(v)) if isinstance(v, float) else repr(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = ", ".join(f'"{c}"' for c in df.columns)
    assert shown(tuple(r) for r in df.collect()) == shown(duck.sql(f"select {columns} from ({SQL[name]})").fetchall())


def test_entry_imports_without_the_optional_part(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/rankloom", tmp_path / "rankloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); assert 'bm25_search' in n and not any(x.startswith('op') for x in n); assert set(e.oracle_sql()) <= set(n)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
