import math

from cellgrid.functions import healpix
from cellgrid.operators import assign, geo, quality
from cellgrid.plans import more
from cellgrid.sources import observations


def test_cell_size():
    area = 4 * math.pi / healpix.npix_of(32)
    assert abs(healpix.cell_diameter(32) - math.degrees(2 * math.sqrt(area / math.pi))) < 1e-12


def test_sphere_angles(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0000000001), (0.0, -1.0, 0.0), (1.0, 0.0, 0.0)], "x double, y double, z double")
    got = [(r["theta"], r["phi"]) for r in healpix.sphere_angles(df).collect()]
    want = [(0.0, 0.0), (math.pi / 2, 3 * math.pi / 2), (math.pi / 2, 0.0)]
    assert all(abs(a - b) < 1e-12 for g, w in zip(got, want) for a, b in zip(g, w))


def test_longitudes(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(-190.0,), (180.0,), (360.0,), (725.0,)], "lon double")
    assert [r[0] for r in df.select(healpix.normal_lon(F.col("lon"), "0_360")).collect()] == [170.0, 180.0, 0.0, 5.0]
    assert [r[0] for r in df.select(healpix.normal_lon(F.col("lon"), "-180_180")).collect()] == [170.0, -180.0, 0.0, 5.0]


def test_valid_box(spark):
    rows = [([{"lon": 1.0, "lat": 2.0}],), ([{"lon": 361.0, "lat": 2.0}],), ([],), (None,), ([{"lon": None, "lat": 2.0}],)]
    df = spark.createDataFrame(rows, "vertices array<struct<lon: double, lat: double>>")
    assert [r[0] for r in df.select(geo.valid_box()).collect()] == [True, False, False, False, False]


def test_rolled_up(spark):
    side = spark.createDataFrame([(0, 17, 1.0), (0, 18, 1.0), (1, 40, 1.0)], "source_id long, healpix_id long, weight double")
    assert sorted((r["source_id"], r["healpix_id"]) for r in assign.rolled_up(side, 2).collect()) == [(0, 1), (1, 2)]


def test_footprint_stats(spark):
    rows = [([{"lon": 0.0, "lat": 0.0}, {"lon": 2.0, "lat": 2.0}],), ([{"lon": 4.0, "lat": 3.0}, {"lon": 6.0, "lat": 3.0}],), ([],)]
    got = quality.footprint_stats(spark.createDataFrame(rows, "vertices array<struct<lon: double, lat: double>>"), 100).first()
    assert (got["total"], got["lon_mean"], got["lon_std"], got["lat_max"]) == (2, 3.0, 2.0, 3.0)


def test_file_stats_and_schema(spark, tmp_path):
    spark.range(10).repartition(2).selectExpr("id * 1D AS lon", "id * 2D AS lat").write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    got = quality.file_stats(df).collect()
    assert len(got) == 2 and sum(r["rows"] for r in got) == 10 and max(r["lat_max"] for r in got) == 18.0
    assert observations.schema_text(df).splitlines() == ["lon: double", "lat: double"]
    assert observations.head(df, 3).count() == 3


def test_suggestion():
    assert quality.suggest_convention({"lon_min": -5.0}) == "-180_180" and quality.suggest_convention({"lon_min": 0.0}) == "0_360"


def prices(spark, tmp_path, flags):
    """Line items whose sum of prices needs more digits than a double keeps on the way, and that sum by flag, from
    whole cents in the queries' units."""
    cents = "id * 7919 % 10499991 + 100000000"
    items = spark.range(0, 400_000, 1, 3).selectExpr("id AS l_orderkey", "1 AS l_linenumber", "id AS l_partkey", f"({cents}) / 100D AS l_extendedprice", "1D AS l_quantity", f"element_at(array({flags}), cast(id % 3 + 1 AS int)) AS l_returnflag")
    items.write.parquet(str(tmp_path / "lineitem.parquet"))
    found = {}
    for k in range(400_000):
        found[k % 3] = found.get(k % 3, 0) + (k * 7919 % 10499991 + 100000000) * 100
    return found


def test_sums_of_partitioned_tables_are_exact(spark, tmp_path):
    want = prices(spark, tmp_path, "'A', 'N', 'R'")
    got = more.write_partitioned(spark, str(tmp_path))
    assert {r["flag"]: r["v"] for r in got.collect()} == dict(zip("ANR", (want[k] for k in range(3))))


def test_exact_sum_of_what_no_decimal_holds(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a", 1e300), ("a", 1.0), ("b", float("inf")), ("c", None), ("d", 0.1), ("d", 0.2), ("d", None)], "k string, v double")
    got = {r["k"]: r["s"] for r in df.groupBy("k").agg(more.exact_sum("v").alias("s")).collect()}
    assert got == {"a": 1e300, "b": float("inf"), "c": None, "d": 0.3}
    assert math.isnan(spark.createDataFrame([(float("nan"),)], "v double").agg(more.exact_sum("v").alias("s")).first()["s"])
    assert df.limit(0).agg(more.exact_sum("v").alias("s"), F.count("v")).first()["s"] is None


def test_sum_of_a_single_file_is_exact(spark, tmp_path):
    want = prices(spark, tmp_path, "'A', 'N', 'R'")
    got = more.write_single_file(spark, str(tmp_path)).first()
    assert (got["files"], got["n"], got["v"]) == (1, 400_000, sum(want.values()))
