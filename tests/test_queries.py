import pytest

import __spark_entry__
from oracle import connect, same
from pricewell.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal_to_sql(spark, con, name):
    same(QUERIES[name](spark, SF), con, ORACLES[name])


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(QUERIES) <= set(__spark_entry__.queries())


def test_filters_reach_the_scan(spark):
    plan = QUERIES["price_timeseries"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.split("\n") if "FileScan" in x or "Scan parquet" in x)
    assert "GreaterThanOrEqual(l_shipdate" in scan and "l_tax" not in scan


def test_every_part_gets_brand_suggestions(spark):
    parts = spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_name", "p_type").collect()
    words = lambda x: {t for t in "".join(c if c.isalnum() else " " for c in x.lower()).split() if len(t) > 2}
    brands = {r.p_type: words(r.p_type) for r in parts}
    want = set()
    for r in parts:
        own = words(f"{r.p_name} {r.p_type}")
        best = sorted((-len(own & w), b) for b, w in brands.items() if own & w)[:5]
        want |= {(r.p_partkey, b, -n) for n, b in best}
    got = [(r.p_partkey, r.brand, r.score) for r in QUERIES["brand_suggestions"](spark, SF).collect()]
    assert len(got) == len(want) and set(got) == want
    assert {k for k, _, _ in got} == {r.p_partkey for r in parts}
