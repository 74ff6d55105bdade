import pytest

from cellgrid.functions import healpix as H


def test_published_cells(spark):
    rows = [(272.40450, 5.186568, 7943), (71.77686, -60.939438, 8287), (54.23045, 5.613894, 5819), (324.49740, -41.672714, 11685)]
    df = spark.createDataFrame(rows, "lon double, lat double, want long")
    assert H.with_cell(df, "lon", "lat", 32).filter("healpix_id != want").count() == 0


def test_published_rings(spark):
    got = H.nested_to_ring(spark.range(10).withColumnRenamed("id", "c"), "c", 2, "r").orderBy("c")
    assert [r["r"] for r in got.collect()] == [13, 5, 4, 0, 15, 7, 6, 1, 17, 9]
    assert H.nested_to_ring(spark.createDataFrame([(1130,)], "c long"), "c", 16, "r").first()["r"] == 1504
    assert H.with_cell(spark.createDataFrame([(0.0, 0.0)], "lon double, lat double"), "lon", "lat", 16, "ring").first()["healpix_id"] == 1440


@pytest.mark.parametrize("nside", [1, 2, 8])
def test_rings_and_back(spark, nside):
    grid = spark.range(12 * nside * nside).withColumnRenamed("id", "c")
    ring = H.nested_to_ring(grid, "c", nside, "r").toPandas()
    assert sorted(ring["r"]) == list(range(12 * nside * nside))
    back = H.ring_to_nested(spark.createDataFrame(ring), "r", nside, "b")
    assert back.filter("b != c").count() == 0


def test_centres_and_corners(spark):
    corners = H.with_corner_degrees(H.with_corners(spark.range(1).withColumnRenamed("id", "c"), "c", 32)).first()
    want = [(45, 2.38802), (43.59375, 1.19375), (45, 0), (46.40625, 1.19375)]
    for k, (lon, lat) in enumerate(want):
        assert abs(corners[f"lon_{k}"] - lon) < 1e-5 and abs(corners[f"lat_{k}"] - lat) < 1e-5


def test_missing_points(spark):
    df = spark.createDataFrame([(None, 1.0), (float("nan"), 1.0), (10.0, 95.0), (float("inf"), 0.0), (10.0, 90.0)], "lon double, lat double")
    assert [r["healpix_id"] is None for r in H.with_cell(df, "lon", "lat", 4).collect()] == [True, True, True, True, False]


def test_grid_numbers():
    assert H.npix_of(4) == 192 and H.nside_of(768) == 8
    for bad in (0, 3, -4, 2.0, "4", True):
        assert not H.is_nside(bad)
        with pytest.raises(ValueError):
            H.check_nside(bad)
    with pytest.raises(ValueError):
        H.nside_of(100)
    assert H.check_convention("minus_plus180") == "-180_180"
    with pytest.raises(ValueError):
        H.check_convention("east")


def test_parent(spark):
    df = spark.createDataFrame([(272.40450, 5.186568)], "lon double, lat double")
    fine = H.with_cell(df, "lon", "lat", 32).first()["healpix_id"]
    assert H.with_cell(df, "lon", "lat", 8).first()["healpix_id"] == fine >> 4
