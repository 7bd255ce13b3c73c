"""The catalogue as the driver sees it: every oracle has a query, results agree on the small tables, and the core stands alone."""

import glob
import math
import os
import subprocess
import sys
from collections import Counter

import pytest

import __spark_entry__ as catalogue
from tests.conftest import SMALL

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
GROUPS = sorted({n.partition("_")[0] for n in catalogue.oracle_sql()})


@pytest.fixture(scope="module")
def sql():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("SET timezone='UTC'")
    for p in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (bytes, bytearray)):
        return v.hex()
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else plain(list(v.values())) if isinstance(v, dict) else v


@pytest.mark.parametrize("group", GROUPS)
def test_queries_equal_their_sql(spark, sql, group):
    """Every query that has SQL, by whole tables."""
    queries, wrong = catalogue.queries(), []
    for name, text in catalogue.oracle_sql().items():
        if name.partition("_")[0] == group:
            got = queries[name](spark, SMALL)
            r = sql.execute(text)
            cols = [d[0] for d in r.description]
            assert sorted(got.columns) == sorted(cols), name
            want = Counter(str([plain(dict(zip(cols, row))[c]) for c in sorted(cols)]) for row in r.fetchall())
            if Counter(str([plain(row[c]) for c in sorted(cols)]) for row in got.collect()) != want:
                wrong.append(name)
    assert not wrong


def test_catalogue():
    queries, oracles = catalogue.queries(), catalogue.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 300 and len(set(queries) - set(oracles)) < 16
    assert catalogue.OPTIONAL == ["fluxnest.llm.queries"]


def test_entry(spark):
    assert catalogue.entry(spark).columns == ["rec_id", "entity", "imp_index", "deal_index"]


def test_core_imports_nothing_of_the_corpus_package():
    code = "import sys, importlib; sys.modules['fluxnest.llm'] = None; import __spark_entry__ as e; [importlib.import_module(m) for m in e.MODULES]; print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) > 200
    for folder, _, files in os.walk(os.path.join(ROOT, "fluxnest")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert "fluxnest.llm" not in open(os.path.join(folder, f)).read() and "from ..llm" not in open(os.path.join(folder, f)).read()
