"""The driver's contract: names, SQL and results of the catalogue at a small size."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"
TABLES = [p.stem for p in Path(DATA).glob("*.parquet")]


def test_queries_are_listed_without_a_session():
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q))"], cwd=ROOT, capture_output=True, text=True)
    assert said.returncode == 0 and int(said.stdout) >= 50, said.stderr


def plain(rows):
    return sorted(repr(tuple(round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v for v in r)) for r in rows)


def names():
    from folioscope.plans import catalog

    return sorted(catalog.ORACLES)


@pytest.mark.parametrize("name", names())
def test_catalogue_against_sql(spark, name):
    from folioscope.plans import catalog

    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    result = con.execute(catalog.ORACLES[name])
    found = [d[0] for d in result.description]
    assert sorted(found) == columns
    want = [tuple(r[found.index(c)] for c in columns) for r in result.fetchall()]
    assert plain(got) == plain(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
