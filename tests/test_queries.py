import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

import __spark_entry__ as entry  # noqa: E402
from compare import rows, views  # noqa: E402

DATA = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    return views(str(DATA))


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, str(DATA))
    got = rows(df.columns, df.collect())
    if name in entry.oracle_sql():
        rel = duck.execute(entry.oracle_sql()[name])
        assert got == rows([c[0] for c in rel.description], rel.fetchall())


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
