"""Every query against its SQL on the smallest tables, and the driver contract."""

import importlib.util
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
CORE = [m for m in entry._modules() if ".llm" not in m.__name__]


def plain(v):
    if v is None or v != v:
        return "-"
    if isinstance(v, float):
        return f"{v:.9g}"
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


@pytest.mark.parametrize("name", [k for m in CORE for k in m.QUERIES])
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name not in entry.oracle_sql():
        return
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_core_does_not_need_llm():
    root = os.path.dirname(entry.__file__)
    for folder, _, names in os.walk(os.path.join(root, "codequarry")):
        if os.path.basename(folder) == "llm":
            continue
        for n in names:
            if n.endswith(".py"):
                text = open(os.path.join(folder, n)).read()
                assert "llm" not in [w for line in text.split("\n") if line.lstrip().startswith(("import ", "from ")) for w in line.replace(".", " ").split()], n
    assert importlib.util.find_spec("codequarry") is not None


def test_workers_find_the_package_from_elsewhere(tmp_path):
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    code = f"import sys; sys.path.insert(0, {root!r}); import __spark_entry__ as e\nfrom pyspark.sql import SparkSession\ns = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\nprint('ROWS', e.queries()['p7_found'](s, {DATA!r}).count())"
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "ROWS" in out.stdout, out.stderr[-1500:]
