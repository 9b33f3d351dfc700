"""Every registered query of the library's own operators against its SQL, and the contract's guard."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from graphloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(f"select {', '.join(columns)} from ({registry.oracle_sql()[name]})").fetchall()
    key = lambda rows: sorted(tuple(str(plain(v)) for v in r) for r in rows)
    assert key(df.select(*columns).collect()) == key(found)


def test_the_rest_stands_without_the_subpackage(tmp_path):
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'sparql_chain_bgp' in q and not any(n.startswith('op1') or n == 'pipeline' for n in q); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True)


def test_other_missing_modules_are_errors(tmp_path):
    root = Path(__file__).resolve().parents[1]
    code = "import sys; sys.modules['numpy.linalg'] = None\nsys.modules['public_tokenizers'] = None\ntry:\n    import __spark_entry__\nexcept ImportError as e:\n    sys.exit(0)\nsys.exit(1)"
    if (root / "corpus_pipeline.py").exists():
        subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
