import json
import struct

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cellgrid.functions.healpix import RANGES
from cellgrid.operators import display, geo
from cellgrid.sources import places
from cellgrid.sources.metadata import GridMeta
from cellgrid.sources.observations import cells


@pytest.fixture
def home(tmp_path, monkeypatch):
    for name in ("CELLGRID_CACHE", "CELLGRID_CONFIG", "XDG_CACHE_HOME", "XDG_CONFIG_HOME"):
        monkeypatch.delenv(name, raising=False)
    monkeypatch.setenv("HOME", str(tmp_path))
    return tmp_path


def test_wkb(spark):
    rows = geo.cell_polygons(spark, 2).collect()
    assert len(rows) == 48
    for r in rows:
        ring = geo.read_wkb(bytes(r["geometry"]))
        assert ring == [{"lon": r[f"lon_{k % 4}"], "lat": r[f"lat_{k % 4}"], "ring": 0} for k in range(5)]
        lons = [p["lon"] for p in ring]
        assert max(lons) - min(lons) <= 180
    rings = struct.pack("<BII", 1, 3, 2) + 2 * (struct.pack("<I", 3) + struct.pack("<6d", 1, 2, 3, 4, 1, 2))
    blobs = [struct.pack("<BI2d", 1, 1, 5.0, 6.0), None, b"", rings, rings[:-9], b"no geometry", struct.pack("<BII", 1, 3, 1 << 31)]
    got = [r["v"] for r in spark.createDataFrame([(b,) for b in blobs], "geometry binary").select(geo.wkb_vertices().alias("v")).collect()]
    assert [(p["lon"], p["lat"], p["ring"]) for p in got[0]] == [(5.0, 6.0, None)]
    assert got[1] is None and got[2] == [] and got[4:] == [None, None, None]
    assert [(p["lon"], p["ring"]) for p in got[3]] == [(1.0, 0), (3.0, 0), (1.0, 0), (1.0, 1), (3.0, 1), (1.0, 1)]


def test_double_bits(spark):
    values = [0.0, 1.0, -1.0, 0.1, -179.99999999, 360.0, 1e-9, 2.0**-30, 123456.789, 45.00000000000001]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = geo._double_hex(df, ["x"]).collect()
    assert [r["_h_x"].lower() for r in got] == [struct.pack("<d", v).hex() for v in values]


def test_cache(spark, home):
    with pytest.raises(ValueError):
        geo.cell_polygons(spark, 2, cache="maybe")
    with pytest.raises(ValueError):
        geo.cell_polygons(spark, 2, cache="require")
    assert geo.manage_cache(spark, "generate", [2]) == [{"nside": 2, "made": True}]
    assert geo.manage_cache(spark, "generate", [2]) == [{"nside": 2, "made": False}]
    assert geo.manage_cache(spark, "verify", [2])[0]["valid"] and not geo.manage_cache(spark, "verify", [4])[0]["valid"]
    assert [r["name"] for r in geo.manage_cache(spark, "list")] == ["nside_002_nest_spherical.parquet"]
    assert geo.cell_polygons(spark, 2, cache="require").count() == 48
    part = geo.grid_angles(cells(spark, 20), 2)
    geo.save_grid(part, 2)
    with pytest.raises(ValueError):
        geo.cell_polygons(spark, 2, cache="require")
    ids = spark.createDataFrame([(3,), (30,)], "healpix_id long")
    assert geo.cell_polygons(spark, 2, ids=ids, cache="use").count() == 2
    assert geo.cell_polygons(spark, 2, cache="use").count() == 48
    holed = part.withColumn("phi_0", F.lit(float("nan")))
    assert geo.verify_grid(holed, 2)["nulls"] == 20 and not geo.verify_grid(part.drop("phi_0"), 2)["valid"]
    with pytest.raises(ValueError):
        geo.save_grid(part.drop("phi_0"), 2)
    assert geo.manage_cache(spark, "clean", [2]) == [{"nside": 2, "removed": True}]
    with pytest.raises(ValueError):
        geo.manage_cache(spark, "burn")


def test_folders_and_settings(home, monkeypatch):
    assert geo.cache_dir() == home / ".cache" / "cellgrid"
    monkeypatch.setenv("XDG_CACHE_HOME", str(home / "x"))
    assert geo.cache_dir() == home / "x" / "cellgrid"
    path = geo.init_settings()
    with pytest.raises(FileExistsError):
        geo.init_settings()
    path.write_text("[cellgrid]\ncache_dir = /somewhere\nodd = 1\n")
    assert str(geo.cache_dir()) == "/somewhere"
    monkeypatch.setenv("CELLGRID_CACHE", str(home / "own"))
    assert geo.cache_dir() == home / "own" and geo.cache_dir("/given").as_posix() == "/given"
    assert geo.grid_name(64, "ring") == "nside_064_ring_spherical.parquet"


def test_geoparquet(spark, tmp_path):
    m = spark.createDataFrame([(0, 1.5), (5, 2.5)], "healpix_id long, v double")
    path = geo.to_geoparquet(m, tmp_path / "m.parquet", 2)
    got = spark.read.parquet(str(path))
    assert got.count() == 2 and got.columns == ["healpix_id", "v", "geometry"]
    assert json.loads(pq.read_schema(next(path.glob("*.parquet"))).metadata[b"geo"])["primary_column"] == "geometry"
    shapes, description = places.read_geoparquet(spark, path)
    assert description["columns"]["geometry"]["encoding"] == "WKB" and shapes.filter("size(vertices) = 5").count() == 2
    m.write.parquet(str(tmp_path / "plain.parquet"))
    with pytest.raises(ValueError):
        places.read_geoparquet(spark, tmp_path / "plain.parquet")
    with pytest.raises(FileExistsError):
        geo.to_geoparquet(m, path, 2)
    assert spark.read.parquet(str(geo.to_geoparquet(m, path, 2, dense=True, overwrite=True))).count() == 48
    with pytest.raises(ValueError):
        geo.to_geoparquet(m, tmp_path / "x.parquet", meta=GridMeta(2, file_type="sidecar"))
    with pytest.raises(ValueError):
        geo.check_map_input(tmp_path / "x.json")


def test_raster_and_tiff(spark, tmp_path):
    m = cells(spark, 48).withColumn("v", F.col("healpix_id") * 1.0)
    got = geo.raster(m, "v", 2, width=8, height=5)
    assert got.count() == 40 and got.filter("value IS NULL").count() == 0
    path = geo.write_geotiff(m, "v", tmp_path / "m.tif", 2, width=8, height=5)
    data = path.read_bytes()
    assert data[:4] == b"II*\0" and len(data) > 8 * 5 * 4
    first = struct.unpack_from("<f", data, len(data) - 160)[0]
    assert first == got.filter("row = 0 AND col = 0").first()["value"]
    with pytest.raises(KeyError):
        geo.raster(m, "x", 2)
    assert geo.epsg("EPSG:4326") == geo.epsg(4326) == (4326, b"") and geo.epsg(None) == (32767, b"") and geo.epsg("Moon 2000") == (32767, b"Moon 2000|")
    named = geo.write_geotiff(m, "v", tmp_path / "n.tif", 2, width=8, height=5, bits=64, crs="Moon 2000").read_bytes()
    assert b"Moon 2000|" in named and struct.unpack_from("<d", named, len(named) - 320)[0] == first
    assert struct.pack("<4H", 2048, 0, 1, 4326) in geo.write_geotiff(m, "v", tmp_path / "e.tif", 2, width=8, height=5, crs=4326).read_bytes()


def test_display(spark):
    rows = [(i, float(i)) for i in range(100)] + [(100, None), (101, float("nan"))]
    m = spark.createDataFrame(rows, "healpix_id long, v double")
    shown, span = display.prepare(m, "v", cutoff=10)
    got = {r["healpix_id"]: r["display"] for r in shown.collect()}
    assert got[100] is None and got[101] is None
    assert all(got[i] <= got[i + 1] for i in range(99)) and span == (pytest.approx(9.9), pytest.approx(89.1))
    plain, span = display.prepare(m, "v", equalize=False)
    assert span == (0.0, 99.0) and plain.filter("display != v").count() == 0
    assert display.check_cutoff(5) == (5.0, 95.0)
    for bad in (60, (1, 2, 3), (-1, 5), (50, 20)):
        with pytest.raises(ValueError):
            display.check_cutoff(bad)
    assert RANGES["0_360"] == (0.0, 360.0)


def test_equalise_follows_ranks(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    values = rng.normal(size=2000) ** 3
    m = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "healpix_id long, v double")
    got = {r["healpix_id"]: r["display"] for r in display.equalised(m, "v").collect()}
    hist, edges = np.histogram(values, bins=256)
    want = np.interp(values, (edges[:-1] + edges[1:]) / 2, hist.cumsum() / hist.sum())
    assert max(abs(got[i] - want[i]) for i in range(2000)) < 1e-9
