import math

import pytest
from pyspark.sql import functions as F

from cellgrid.operators import assign as S
from cellgrid.operators import psf


def test_points_and_bounds(spark):
    rows = [(0, 0.0, 0.0), (1, 45.0, 0.0), (2, 90.0, 0.0), (3, 361.0, 0.0), (4, 10.0, 91.0), (5, None, 1.0), (6, math.nan, 1.0), (7, 360.0, 90.0)]
    obs = spark.createDataFrame(rows, "source_id long, lon double, lat double")
    got = S.assign_points(obs, 32)
    assert sorted(r["source_id"] for r in got.collect()) == [0, 1, 2, 7]
    assert S.drop_report(obs).first().asDict() == {"total": 8, "dropped": 4, "percent": 50.0}


def test_multi_is_nested(spark):
    obs = spark.range(300).selectExpr("id AS source_id", "id * 1.19D AS lon", "id * 0.59D - 88D AS lat")
    many = S.assign_points_multi(obs, [2, 16])
    for n in (2, 16):
        a = {(r["source_id"], r["healpix_id"]) for r in many.filter(F.col("nside") == n).collect()}
        assert a == {(r["source_id"], r["healpix_id"]) for r in S.assign_points(obs, n).collect()}


def square(x, y, size=1.0):
    return [(x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y)]


def footprints(spark, rows):
    return spark.createDataFrame([(i, [{"lon": float(x), "lat": float(y)} for x, y in v] if v is not None else None) for i, v in rows], "source_id long, vertices array<struct<lon: double, lat: double>>")


def test_footprints(spark):
    obs = footprints(spark, [(0, square(0, 0, 20)), (1, square(45.2, 45.2, 0.01)), (2, []), (3, None), (4, square(359.5, 0)), (5, [(1.0, math.nan)])])
    fuzzy = S.assign_footprints(obs, 16).collect()
    assert {r["source_id"] for r in fuzzy} == {0, 1}
    many = [r["healpix_id"] for r in fuzzy if r["source_id"] == 0]
    assert len(many) == len(set(many)) == 4
    strict = {r["source_id"]: r["healpix_id"] for r in S.assign_footprints(obs, 16, "strict").collect()}
    assert strict[0] == min(many) and set(strict) == {0, 1}
    assert [r["source_id"] for r in S.assign_footprints(obs, 16, "strict", several="drop").collect()] == [1]
    with pytest.raises(ValueError):
        S.assign_footprints(obs, 16, "exact")


def test_antimeridian(spark):
    obs = footprints(spark, [(0, [(179.0, 0.0), (-179.0, 2.0), (179.0, 0.0)]), (1, square(10, 10))])
    got = {r["source_id"]: [(p["lon"], p["lat"]) for p in r["v"]] for r in obs.select("source_id", S.repair_antimeridian().alias("v")).collect()}
    assert (180.0, 1.0) in got[0] and (-180.0, 1.0) in got[0] and got[1] == square(10, 10)
    rings = [{"lon": x, "lat": 0.0, "ring": k} for x, k in ((170.0, 0), (171.0, 0), (170.0, 0), (-170.0, 1), (-171.0, 1), (-170.0, 1))]
    apart = spark.createDataFrame([(0, rings)], "source_id long, vertices array<struct<lon: double, lat: double, ring: int>>")
    assert [p["lon"] for p in apart.select(S.repair_antimeridian(rings=True).alias("v")).first()["v"]] == [r["lon"] for r in rings]


def test_footprint_weights(spark):
    obs = footprints(spark, [(0, square(45, 45, 8)), (1, square(45.2, 45.2, 0.01))])
    plain = {(r["source_id"], r["healpix_id"]) for r in S.assign_footprints(obs, 16).collect()}
    got = {(r["source_id"], r["healpix_id"]): r["weight"] for r in S.assign_footprints(obs, 16, data=psf.gaussian(5.0)).collect()}
    assert set(got) == plain and all(0 < w < 1 for w in got.values()) and len(set(got.values())) > 2
    twice = S.assign_footprints(obs, 16, data=psf.gaussian(5.0), cell=psf.gaussian(5.0), combine="sum").collect()
    assert all(abs(r["weight"] - 2 * got[r["source_id"], r["healpix_id"]]) < 1e-12 for r in twice)
    strict = {r["source_id"]: r["weight"] for r in S.assign_footprints(obs, 16, "strict", data=psf.gaussian(5.0)).collect()}
    assert strict[0] == 1.0 and strict[1] == got[next(k for k in got if k[0] == 1)]


def test_centroids(spark):
    obs = footprints(spark, [(0, [(0, 0), (4, 0), (4, 2), (0, 2)]), (1, [(1, 1), (3, 3)]), (2, [(5, 6)])])
    got = {r["source_id"]: (r["c"]["lon"], r["c"]["lat"]) for r in obs.select("source_id", S.centroid(F.col("vertices")).alias("c")).collect()}
    assert got == {0: (2.0, 1.0), 1: (2.0, 2.0), 2: (5.0, 6.0)}


def test_weights(spark):
    one = spark.createDataFrame([(1, 1, 3.0, 4.0)], "source_id long, healpix_id long, dx double, dy double")
    g = psf.spread_function("gaussian", 5.0)
    got = one.select(*[psf.pair_weight(F.col("dx"), F.col("dy"), g, None, how).alias(how) for how in psf.COMBINE]).first()
    e = math.exp(-0.5)
    assert all(abs(got[k] - v) < 1e-12 for k, v in {"multiply": e, "sum": e + 1, "min": e, "max": 1.0}.items())
    with pytest.raises(ValueError):
        psf.spread_function("box")
    with pytest.raises(ValueError):
        psf.pair_weight(F.lit(1.0), F.lit(1.0), psf.gaussian(None))
    side = spark.createDataFrame([(1, 7, 1.0), (2, 7, 3.0), (1, 8, 2.0)], "source_id long, healpix_id long, weight double")
    cells = {(r["source_id"], r["healpix_id"]): r["weight"] for r in psf.normalised(side).collect()}
    assert cells == {(1, 7): 0.25, (2, 7): 0.75, (1, 8): 1.0}
    assert abs(sum(r["weight"] for r in psf.normalised(side, "source").collect()) - 2) < 1e-12
    centres = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0)], "source_id long, lon double, lat double")
    grid = spark.createDataFrame([(7, 0.0, 0.0), (8, 0.0, 0.0)], "healpix_id long, lon double, lat double")
    got = {(r["source_id"], r["healpix_id"]): r["weight"] for r in psf.weighted(side, centres, grid, g, normalise=False).collect()}
    assert got[1, 7] == 1 and abs(got[2, 7] - e) < 1e-12
