"""Every query with an oracle gives the rows of its SQL; the entry runs."""

import math

import duckdb
import pytest

from framelake.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda v: "null" if v is None or isinstance(v, float) and math.isnan(v) else f"{v + 0.0:.6g}" if isinstance(v, float) else str(v)
    return sorted(names), sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    found = duck.execute(ORACLES[name])
    want = normal(found.fetchall(), [c[0] for c in found.description])
    assert normal([tuple(r) for r in got.collect()], got.columns) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql(spark, name):
    for row in QUERIES[name](spark, SF).collect():
        value = row["ms_ssim"] if name == "ms_ssim" else row["vmaf"] / 100
        assert 0 <= value <= 1


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
