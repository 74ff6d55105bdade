import json

import pytest

from cellgrid import cli
from cellgrid.operators import quality
from cellgrid.sources import metadata as M
from cellgrid.sources import observations as O


def test_filter_text():
    assert O.filter_text("b != '3' & a == 2") == "b != '3'  AND  a = 2"
    assert O.filter_text('x in [1, 2] and s == "q==r"') == "x in (1, 2) and s = 'q==r'"
    assert O.filter_text("a[0] > 3 & b not in ['x', 'y[0]'] & c[1] in [m[2], 4]") == "a[0] > 3  AND  b not in ('x', 'y[0]')  AND  c[1] in (m[2], 4)"


def test_detect():
    assert O.detect_lonlat(["id", "center_Longitude", "lat_center", "geometry"]) == ("center_Longitude", "lat_center")
    assert O.detect_lonlat(["a"]) == (None, None)
    assert O.exact_lonlat(["Lon", "LAT"]) == ("Lon", "LAT")
    with pytest.raises(ValueError, match="lon"):
        O.exact_lonlat(["lon_center", "lat"])


def test_names():
    assert M.nside_in_name("a_nside-64_x") == 64 and M.nside_in_name("nside32.parquet") == 32
    assert M.nside_in_name("nside-32_nside-64") is None and M.nside_in_name("none") is None
    side = M.sidecar_path("/d/sample.parquet", "fuzzy", 32)
    assert side.name == "sample.cell-healpix_assignment-fuzzy_nside-32_order-nested.parquet"
    assert M.aggregate_path("/d/sample.parquet", side, dense=True).name == "sample-aggregated-densified.cell-healpix_assignment-fuzzy_nside-32_order-nested.parquet"
    fields = M.name_fields(side.name)
    assert fields["mode"] == "fuzzy" and fields["nside"] == "32"
    assert M.resolve_nside(None, None, 768, "x") == 8 and M.resolve_nside(None, None, 5, "nside-16") == 16
    with pytest.raises(ValueError):
        M.resolve_nside(None, None, None, "x")


def test_meta(tmp_path):
    meta = M.GridMeta(4, mode="strict", lon_convention="minus_plus180", file_type="sidecar", extra={"processing": {"input_file": "/x/a.parquet"}})
    assert meta.npix == 192 and meta.lon_convention == "-180_180"
    with pytest.raises(AssertionError):
        M.GridMeta(4, npix=5)
    with pytest.raises(ValueError):
        M.GridMeta(5)
    path = tmp_path / "a.side.parquet"
    M.write_json(meta, M.companion(path))
    back = M.read_meta(path)
    assert (back.nside, back.mode, back.lon_convention, back.file_type) == (4, "strict", "-180_180", M.Stage.SIDECAR)
    assert M.GridMeta.from_dict({"nside": 2, "order": "ring"}).order == "ring"
    assert M.check_file_type(path, "sidecar") and not M.check_file_type(path, "aggregate")
    with pytest.raises(ValueError):
        M.check_file_type(path, "aggregate", strict=True)
    with pytest.raises(ValueError):
        M.read_meta(tmp_path / "none.parquet")
    assert M.check_sidecar_source(path, "/y/a.parquet")
    with pytest.raises(ValueError):
        M.check_sidecar_source(path, "/y/b.parquet")
    assert M.check_compatible(meta, M.GridMeta(4, mode="strict")) and not M.check_compatible(meta, meta)
    with pytest.raises(ValueError):
        M.check_compatible(meta, M.GridMeta(8))


def test_validate(spark):
    side = spark.createDataFrame([(0, 100, 0.6), (0, 101, 0.4), (1, 100, 1.0)], "source_id long, healpix_id long, weight double")
    found = quality.check_sidecar(side, M.GridMeta(4, mode="fuzzy"))
    assert found["valid"] and found["stats"]["n_sources"] == 2 and found["stats"]["n_cells"] == 2 and not found["warnings"]
    bad = spark.createDataFrame([(0, 100, 1.5), (1, 500, -0.1)], "source_id long, healpix_id long, weight double")
    assert len(quality.check_sidecar(bad, M.GridMeta(4), strict=False)["errors"]) == 2
    with pytest.raises(AssertionError):
        quality.check_sidecar(side, M.GridMeta(4, mode="strict"))
    m = spark.createDataFrame([(0, 2), (1, 7)], "healpix_id long, n_sources long")
    assert quality.check_aggregate(m, M.GridMeta(4))["stats"]["cells_of_more"] == 1
    with pytest.raises(AssertionError):
        quality.check_aggregate(m.unionAll(m), M.GridMeta(4))
    with pytest.raises(AssertionError):
        quality.check_aggregate(m, M.GridMeta(4), expected=["v_mean"])
    assert not quality.check_aggregate(m.drop("healpix_id"), M.GridMeta(4), strict=False)["valid"]


def test_row_ids_over_files(spark, tmp_path):
    spark.range(10).repartition(3).selectExpr("id AS v").write.parquet(str(tmp_path / "in"))
    got = O.read_observations(spark, str(tmp_path / "in"), where="v >= 0")
    assert sorted(r["source_id"] for r in got.collect()) == list(range(10))
    few = O.read_observations(spark, str(tmp_path / "in"), where="v == 3").collect()
    assert [r["source_id"] for r in got.filter("v = 3").collect()] == [few[0]["source_id"]]
    with pytest.raises(KeyError):
        O.read_observations(spark, str(tmp_path / "in"), ["x"])


def test_command_line(spark, tmp_path, capsys):
    path = tmp_path / "obs.parquet"
    spark.range(200).selectExpr("id AS source_id", "id * 1.79D AS lon", "id * 0.89D - 89D AS lat", "id * 1D AS v").write.parquet(str(path))
    run = lambda *a: cli.main([str(x) for x in a], spark)
    assert run("sidecar", path, "--nside", "2,4") == 0
    assert run("sidecar", path, "--nside", "2") == 2  # it is there
    assert run("stats", path, "--save") == 0 and json.loads((tmp_path / "obs.geo_stats.json").read_text())["total"] == 200
    assert [r["nside"] for r in O.list_sidecars(path)] == [2, 4] and O.find_sidecar(path, 4).exists()
    capsys.readouterr()
    assert run("aggregate", path, "--columns", "v", "--list", "--stats") == 0 and [r["rows"] for r in json.loads(capsys.readouterr().out)] == [200, 200]
    assert run("schema", path, "--rows", 2) == 0
    told = json.loads(capsys.readouterr().out)
    assert "v: double" in told["columns"] and len(told["rows"]) == 2 and sum(int(x.split(": ")[1].split()[0]) for x in told["files"]) == 200
    assert run("aggregate", path, "--columns", "v", "--densify", "--dry-run") == 0
    assert run("aggregate", path, "--columns", "v", "--filter", "v > 5") == 0
    out = M.aggregate_path(path, O.find_sidecar(path, 2))
    assert spark.read.parquet(str(out)).count() == spark.read.parquet(str(O.find_sidecar(path, 2))).select("healpix_id").distinct().count()
    df, meta = O.load_map(spark, out)
    assert meta.nside == 2 and "v_mean" in df.columns
    with pytest.raises(ValueError):
        O.load_only_map(spark, tmp_path)
    with pytest.raises(FileNotFoundError):
        O.load_only_map(spark, tmp_path, "*.none")
    assert run("accumulate", path, "--columns", "v", "--nside", 2, "--state-output", tmp_path / "state_v001.parquet") == 0
    assert run("finalize", tmp_path / "state_v001.parquet", "--columns", "v", "--output", tmp_path / "final.parquet", "--densify") == 0
    assert spark.read.parquet(str(tmp_path / "final.parquet")).count() == 48
    assert run("geoparquet", out, tmp_path / "geo.parquet") == 0
    assert run("geoparquet", tmp_path / "obs.parquet", tmp_path / "geo2.parquet") == 2
    assert "Traceback" not in capsys.readouterr().err


def test_remote_paths(spark, tmp_path):
    """Metadata, listings, footers and caches on a file system that only Spark opens."""
    from cellgrid.operators import assign, geo
    from cellgrid.sources import places

    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.store.link./in", f"file://{tmp_path}")
    root = "viewfs://store/in"
    obs = spark.createDataFrame([(k, k * 7.0 % 360, k * 3.0 % 90) for k in range(50)], "source_id long, lon double, lat double")
    obs.write.parquet(f"{root}/obs.parquet")
    for nside in (4, 8):
        path = M.sidecar_path(f"{root}/obs.parquet", "fuzzy", nside)
        assert str(path).startswith(f"{root}/obs.cell-healpix")
        O.write_table(assign.assign_points(obs, nside), path, M.GridMeta(nside, mode="fuzzy", file_type="sidecar"))
    found = O.list_sidecars(f"{root}/obs.parquet", spark=spark)
    assert [(r["nside"], r["rows"]) for r in found] == [(4, 50), (8, 50)]
    assert str(O.find_sidecar(f"{root}/obs.parquet", 8)) == found[1]["path"]
    geo.manage_cache(spark, "generate", [2], folder=f"{root}/cache")
    assert geo.cell_polygons(spark, 2, cache="require", cache_dir=f"{root}/cache").count() == 48
    assert geo.manage_cache(spark, "list", folder=f"{root}/cache")[0]["bytes"] > 0
    assert geo.manage_cache(spark, "clean", [2], folder=f"{root}/cache") == [{"nside": 2, "removed": True}]
    out = geo.to_geoparquet(spark.createDataFrame([(1, 2.0)], "healpix_id long, v double"), f"{root}/map.parquet", 2)
    assert places.read_geoparquet(spark, out)[0].count() == 1 and places.footer(places.part_files(out)[0])["columns"] == ["healpix_id", "v", "geometry"]
    assert places.place("file:///a/b").as_posix() == "/a/b" and places.place("s3a://b/c.parquet").with_name("d") == places.Remote("s3a://b/d")
    assert "rows in" in O.file_text(f"{root}/obs.parquet")


def test_command_line_weights(spark, tmp_path, capsys):
    path = str(tmp_path / "obs.parquet")
    spark.createDataFrame([(k, k * 7.0 - 180, k * 3.0 % 90) for k in range(50)], "source_id long, center_longitude double, center_latitude double").write.parquet(path)
    assert cli.main(["sidecar", path, "--nside", "4", "--no-bounds", "--data-psf", "gaussian", "--cell-psf", "gaussian", "--psf-combine", "sum", "-y"], spark) == 0
    side = spark.read.parquet(json.loads(capsys.readouterr().out)[0])
    sums = {round(r["s"], 9) for r in side.groupBy("healpix_id").agg({"weight": "sum"}).toDF("c", "s").collect()}
    assert side.count() == 50 and sums == {1.0}
    assert cli.main(["sidecar", path, "--nside", "4", "--no-bounds", "--data-psf", "gaussian", "--cell-psf", "gaussian", "--psf-combine", "sum", "--no-psf-normalise", "-y"], spark) == 0
    assert {r["weight"] for r in spark.read.parquet(json.loads(capsys.readouterr().out)[0]).collect()} == {2.0}


def test_samples(spark):
    rows = spark.range(1000).selectExpr("id % 100 AS k")
    some = O.sample(rows, 0.3, key="k")
    n = {r["k"]: r["count"] for r in some.groupBy("k").count().collect()}
    assert 10 < len(n) < 55 and set(n.values()) == {10} and 200 < O.sample(rows, 0.3, seed=1).count() < 400
    with pytest.raises(ValueError):
        O.sample(rows, 1.5)
