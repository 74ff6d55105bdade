"""The plans that the library's queries must have, whatever the data."""

import os
import re

import pytest

from cellgrid.plans import registry

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


def plan(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def test_points_need_one_shuffle_and_no_python(spark):
    got = plan(registry.QUERIES["agg_basic"](spark, SMALL))
    assert len(re.findall(r"\bExchange hashpartitioning", got)) == 1
    assert not re.search("Python|Arrow|Pandas|Join", got)
    read = re.search(r"ReadSchema: struct<([^>]*)>", got)[1]
    assert "l_extendedprice" in read and "l_shipdate" not in read and "l_discount" not in read


def test_assignment_is_narrow(spark):
    got = plan(registry.QUERIES["assign_points_multi_nside"](spark, SMALL))
    assert "Exchange" not in got and not re.search("Python|Arrow|Pandas", got)


def test_median_and_mad_share_the_shuffle(spark):
    got = plan(registry.QUERIES["agg_robust"](spark, SMALL))
    assert len(re.findall(r"\bExchange hashpartitioning", got)) == 1


def test_filters_reach_the_scan(spark):
    from cellgrid.sources import observations

    df = observations.read_observations(spark, f"{SMALL}/orders.parquet", ["o_totalprice"], source_id="o_orderkey", where="o_orderstatus == 'F' & o_totalprice > 1000")
    got = plan(df)
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(o_orderstatus,F\)", got) and "GreaterThan(o_total" in got
    assert "o_orderdate" not in re.search(r"ReadSchema: struct<([^>]*)>", got)[1]


def test_no_query_has_a_cross_join(spark):
    for name in ("overlap_report", "validate_sidecar_report", "raster_lookup", "viz_equalize", "geo_join_dense"):
        got = plan(registry.QUERIES[name](spark, SMALL))
        assert "CartesianProduct" not in got, name


def method_size(df):
    """The largest generated method, in bytes; the JVM interprets those of over 8000."""
    seen = df._jdf.queryExecution().executedPlan()
    text = df.sparkSession._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenString(seen)
    return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", text)))


@pytest.mark.parametrize("nside", [1, 2, 8, 64, 1024, 8192, 1 << 29])
@pytest.mark.parametrize("order", ["nested", "ring"])
def test_assignment_is_compiled(spark, nside, order):
    from cellgrid.operators import assign

    obs = spark.read.parquet(f"{SMALL}/lineitem.parquet").selectExpr("l_orderkey AS source_id", "l_extendedprice AS lon", "l_quantity AS lat")
    assert method_size(assign.assign_points(obs, nside, order=order)) < 8000

