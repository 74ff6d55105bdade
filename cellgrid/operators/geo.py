"""Cells as polygons: corners, WKB, GeoParquet, a cache of grids, and resampling to a raster."""

from __future__ import annotations

import configparser
import json
import logging
import os
import struct
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.functions.healpix import check_convention, check_nside, check_order, npix_of, unwrapped, with_cell, with_corner_degrees, with_corners
from cellgrid.sources.metadata import GridMeta, Stage, read_meta, resolve_nside
from cellgrid.sources.observations import cells
from cellgrid.sources.places import place, remove, size, stamp

log = logging.getLogger(__name__)

THETA_PHI = [f"{a}_{k}" for a in ("theta", "phi") for k in range(4)]


# --- polygons --------------------------------------------------------------------------------------------------------


def _reversed_hex(h: Column) -> Column:
    return F.concat(*[F.substring(h, 2 * k + 1, 2) for k in range(7, -1, -1)])


def _double_hex(df: DataFrame, names: list[str]) -> DataFrame:
    """Little-endian hexadecimal of doubles, from their sign, exponent and fraction, with built-in functions."""
    for c in names:
        a = F.abs(F.col(c))
        df = df.withColumn("_a", a).withColumn("_e", F.when(F.col("_a") > 0, F.floor(F.log2("_a"))).cast("int"))
        # the logarithm may be off by one at powers of two
        df = df.withColumn("_e", F.when(F.pow(F.lit(2.0), F.col("_e").cast("double")) > F.col("_a"), F.col("_e") - 1).when(F.pow(F.lit(2.0), (F.col("_e") + 1).cast("double")) <= F.col("_a"), F.col("_e") + 1).otherwise(F.col("_e")))
        scaled = F.col("_a") / F.pow(F.lit(2.0), F.greatest(F.col("_e"), F.lit(-1000)).cast("double"))
        bits = F.when(F.col("_a") > 0, (F.col("_e").cast("long") + 1023) * F.lit(1 << 52) + ((scaled - 1.0) * F.lit(float(1 << 52))).cast("long")).otherwise(F.lit(0).cast("long"))
        signed = F.when(F.col(c) < 0, bits.bitwiseOR(F.lit(-(1 << 63)))).otherwise(bits)
        df = df.withColumn(f"_h_{c}", _reversed_hex(F.lpad(F.hex(signed), 16, "0"))).drop("_a", "_e")
    return df


def with_wkb(df: DataFrame, name: str = "geometry") -> DataFrame:
    """Adds the closed polygon of lon_0..3 and lat_0..3 as little-endian WKB."""
    names = [f"{a}_{k}" for k in range(4) for a in ("lon", "lat")]
    df = _double_hex(df, names)
    ring = [F.col(f"_h_{c}") for c in names] + [F.col("_h_lon_0"), F.col("_h_lat_0")]
    head = F.lit("01" + "03000000" + "01000000" + "05000000")
    return df.withColumn(name, F.unhex(F.concat(head, *ring))).drop(*[f"_h_{c}" for c in names])


def wkb_vertices(geometry: str = "geometry") -> Column:
    """The vertices of WKB polygons, multipolygons and points, as an array of (lon, lat, ring), the ring's number within
    the geometry (points: null). Null for a blob that is no WKB."""

    @F.pandas_udf("array<struct<lon:double,lat:double,ring:int>>")
    def parse(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None else sound_wkb(bytes(b)))

    return parse(F.col(geometry))


def sound_wkb(blob: bytes) -> list[dict] | None:
    """What `read_wkb` gives, or None for a blob that is cut off or something else."""
    try:
        return read_wkb(blob)
    except (struct.error, IndexError, RecursionError):
        return None


def read_wkb(blob: bytes) -> list[dict]:
    """Vertices of a point, line, polygon or a collection of them; dimensions beyond two are skipped."""
    out: list[dict] = []
    rings = 0

    def one(at: int) -> int:
        nonlocal rings
        end = "<" if blob[at] == 1 else ">"
        (kind,) = struct.unpack_from(f"{end}I", blob, at + 1)
        at += 5
        extra = (kind & 0x80000000 != 0) + (kind & 0x40000000 != 0)
        if kind & 0x20000000:
            at += 4
        kind &= 0x0FFFFFFF
        extra += (0, 1, 1, 2)[kind // 1000 % 4]
        kind %= 1000

        def points(at: int, n: int, ring: int | None = None) -> int:
            step = 8 * (2 + extra)
            if at + n * step > len(blob):
                raise IndexError(at)
            for k in range(at, at + n * step, step):
                x, y = struct.unpack_from(f"{end}dd", blob, k)
                out.append({"lon": x, "lat": y, "ring": ring})
            return at + n * step

        if kind == 1:
            return points(at, 1)
        if not 2 <= kind <= 7:
            raise IndexError(at)
        (n,) = struct.unpack_from(f"{end}I", blob, at)
        at += 4
        if kind == 2:
            rings += 1
            return points(at, n, rings - 1)
        for _ in range(n):
            if kind == 3:
                (m,) = struct.unpack_from(f"{end}I", blob, at)
                rings += 1
                at = points(at + 4, m, rings - 1)
            else:
                at = one(at)
        return at

    if blob:
        one(0)
    return out


def valid_box(vertices: str = "vertices") -> Column:
    """Not empty, longitudes within -180..360 and latitudes within -90..90."""
    v = F.col(vertices)
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda p: F.coalesce(p["lon"].between(-180.0, 360.0) & p["lat"].between(-90.0, 90.0), F.lit(False))), F.lit(False))


def grid_angles(ids: DataFrame, nside: int, order: str = "nested") -> DataFrame:
    """(healpix_id, theta_0..3, phi_0..3)"""
    return with_corners(ids.select(F.col("healpix_id").cast("long").alias("healpix_id")), "healpix_id", nside, order).select("healpix_id", *THETA_PHI)


def polygons(angles: DataFrame, convention: str = "0_360", fix_antimeridian: bool = True) -> DataFrame:
    """(healpix_id, lon_0..3, lat_0..3, geometry) of rows of `grid_angles`."""
    degrees = with_corner_degrees(angles, check_convention(convention)).drop(*THETA_PHI)
    return with_wkb(unwrapped(degrees) if fix_antimeridian else degrees)


def cell_polygons(spark: SparkSession, nside: int, order: str = "nested", convention: str = "0_360", ids: DataFrame | None = None, fix_antimeridian: bool = True, cache: str = "off", cache_dir: str | None = None) -> DataFrame:
    """The polygons of all cells, or of those in `ids`. cache: `use` takes what the cache has and computes the rest,
    `require` wants all from there (else ValueError), `off` ignores it."""
    check_nside(nside)
    check_order(order)
    if cache not in ("use", "require", "off"):
        raise ValueError(f"cache must be use, require or off, not {cache!r}")
    wanted = cells(spark, npix_of(nside)) if ids is None else ids.select(F.col("healpix_id").cast("long").alias("healpix_id")).distinct()
    held = None if cache == "off" else load_grid(spark, nside, order, cache_dir)
    if cache == "require":
        if held is None:
            raise ValueError(f"no cached grid for nside {nside}, order {order}")
        if not wanted.join(held, "healpix_id", "left_anti").isEmpty():
            raise ValueError(f"the cached grid for nside {nside}, order {order} lacks cells")
    if held is None:
        angles = grid_angles(wanted, nside, order)
    else:
        angles = held.join(wanted, "healpix_id", "left_semi")
        if cache == "use":
            angles = angles.unionByName(grid_angles(wanted.join(held, "healpix_id", "left_anti"), nside, order))
    return polygons(angles, convention, fix_antimeridian)


def with_geometry(cell_map: DataFrame, nside: int, order: str = "nested", convention: str = "0_360", dense: bool = False, **kw) -> DataFrame:
    """A map with its cells' polygons; dense: all cells of the grid."""
    spark = cell_map.sparkSession
    keyed = cell_map.withColumn("healpix_id", F.col("healpix_id").cast("long"))
    shapes = cell_polygons(spark, nside, order, convention, None if dense else keyed, **kw).select("healpix_id", "geometry")
    return shapes.join(keyed, "healpix_id", "left" if dense else "inner").select(*[c for c in keyed.columns], "geometry")


def to_geoparquet(cell_map: DataFrame, path: str | Path, nside: int | None = None, meta: GridMeta | None = None, order: str | None = None, convention: str | None = None, dense: bool = False, overwrite: bool = False, source: str = "", **kw) -> Path:
    """A GeoParquet folder with WKB polygons: the `geo` description is in the footer of each of its files."""
    if meta and meta.file_type not in (Stage.AGGREGATE, Stage.FINALIZE):
        raise ValueError(f"a map is needed, not a file of stage {meta.file_type.value}")
    path = place(path)
    if path.exists() and not overwrite:
        raise FileExistsError(path)
    nside = resolve_nside(nside, meta, None, source or path.name)
    order = order or (meta.order if meta else "nested")
    convention = convention or (meta.lon_convention if meta else "0_360")
    geo = {"version": "1.0.0", "primary_column": "geometry", "columns": {"geometry": {"encoding": "WKB", "geometry_types": ["Polygon"], "crs": None}}}
    out = with_geometry(cell_map, nside, order, convention, dense, **kw)
    out.write.mode("overwrite" if overwrite else "error").parquet(str(path))
    stamp(path, {"geo": json.dumps(geo)})
    return path


def check_map_input(path: str | Path) -> GridMeta:
    """The metadata of a map file; ValueError for other files and stages."""
    path = place(path)
    if path.suffix != ".parquet":
        raise ValueError(f"{path} is not a Parquet file")
    meta = read_meta(path)
    if meta.file_type not in (Stage.AGGREGATE, Stage.FINALIZE):
        raise ValueError(f"{path} is of stage {meta.file_type.value}, a map is needed")
    return meta


# --- cache and settings ------------------------------------------------------------------------------------------------


def config_dir(given: str | None = None, app: str = "cellgrid") -> Path:
    """From the caller, else CELLGRID_CONFIG, XDG_CONFIG_HOME or the home folder."""
    return _folder(given, "CELLGRID_CONFIG", "XDG_CONFIG_HOME", ".config", app)


def cache_dir(given: str | None = None, app: str = "cellgrid") -> Path:
    """From the caller, else CELLGRID_CACHE, the settings file, XDG_CACHE_HOME or the home folder."""
    if not given and not os.environ.get("CELLGRID_CACHE") and (set_ := load_settings().get("cache_dir")):
        return place(set_).expanduser()
    return _folder(given, "CELLGRID_CACHE", "XDG_CACHE_HOME", ".cache", app)


def _folder(given: str | None, own: str, xdg: str, home: str, app: str) -> Path:
    if given or os.environ.get(own):
        return place(given or os.environ[own]).expanduser()
    base = os.environ.get(xdg)
    return (Path(base) if base and Path(base).is_absolute() else Path.home() / home) / app


SETTINGS = {"cache_dir": "", "default_order": "nested", "default_convention": "0_360"}


def load_settings(folder: str | None = None) -> dict:
    path = config_dir(folder) / "settings.ini"
    found = dict(SETTINGS)
    if path.exists():
        parser = configparser.ConfigParser()
        try:
            parser.read(path)
        except configparser.Error as e:
            log.warning("%s can't be read: %s", path, e)
            return found
        for key, text in parser["cellgrid"].items() if parser.has_section("cellgrid") else ():
            if key in found:
                found[key] = text
            else:
                log.warning("unknown setting %s in %s", key, path)
    return found


def init_settings(folder: str | None = None, force: bool = False) -> Path:
    path = config_dir(folder) / "settings.ini"
    if path.exists() and not force:
        raise FileExistsError(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    parser = configparser.ConfigParser()
    parser["cellgrid"] = SETTINGS
    with path.open("w") as f:
        parser.write(f)
    return path


def grid_name(nside: int, order: str) -> str:
    return f"nside_{nside:03d}_{'nest' if check_order(order) == 'nested' else 'ring'}_spherical.parquet"


def load_grid(spark: SparkSession, nside: int, order: str = "nested", folder: str | None = None) -> DataFrame | None:
    path = cache_dir(folder) / grid_name(nside, order)
    return spark.read.parquet(str(path)) if path.exists() else None


def save_grid(angles: DataFrame, nside: int, order: str = "nested", folder: str | None = None) -> Path:
    if missing := [c for c in ("healpix_id", *THETA_PHI) if c not in angles.columns]:
        raise ValueError(f"a grid needs the columns {missing}")
    path = cache_dir(folder) / grid_name(nside, order)
    angles.select("healpix_id", *THETA_PHI).write.mode("overwrite").parquet(str(path))
    return path


def verify_grid(angles: DataFrame, nside: int) -> dict:
    """{valid, rows, nulls, least, greatest}: rows, columns, missing values and the range of ids, in one pass."""
    if missing := [c for c in ("healpix_id", *THETA_PHI) if c not in angles.columns]:
        return {"valid": False, "missing": missing}
    bad = F.lit(False)
    for c in THETA_PHI:
        bad = bad | F.col(c).isNull() | F.isnan(c)
    s = angles.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("healpix_id").alias("cells"), F.count_if(bad).alias("nulls"), F.min("healpix_id").alias("least"), F.max("healpix_id").alias("greatest")).first().asDict()
    n = npix_of(nside)
    return {"valid": s["rows"] == s["cells"] == n and not s["nulls"] and s["least"] == 0 and s["greatest"] == n - 1, **s}


def manage_cache(spark: SparkSession, action: str, nsides: list[int] | None = None, order: str = "nested", folder: str | None = None, force: bool = False) -> list[dict]:
    """list, generate, verify, clean, info or config."""
    root = cache_dir(folder)
    if action == "config":
        return [{"cache_dir": str(root), "config_dir": str(config_dir()), **load_settings()}]
    if action in ("list", "info"):
        found = sorted(root.glob("nside_*_spherical.parquet")) if root.exists() else []
        return [{"name": p.name, "bytes": size(p)} for p in found]
    if action not in ("generate", "verify", "clean"):
        raise ValueError(f"unknown action {action!r}")
    done = []
    for n in nsides or []:
        path = root / grid_name(check_nside(n), order)
        if action == "generate":
            made = force or not path.exists()
            if made:
                save_grid(grid_angles(cells(spark, npix_of(n)), n, order), n, order, str(root))
            done.append({"nside": n, "made": made})
        elif action == "verify":
            held = load_grid(spark, n, order, str(root))
            done.append({"nside": n, **(verify_grid(held, n) if held is not None else {"valid": False, "missing": path.name})})
        else:
            there = path.exists()
            if there:
                remove(path)
            done.append({"nside": n, "removed": there})
    return done


# --- raster ----------------------------------------------------------------------------------------------------------


def raster(cell_map: DataFrame, column: str, nside: int, order: str = "nested", width: int = 1440, height: int = 720) -> DataFrame:
    """(row, col, lon, lat, value): the map at the points of an equirectangular grid, edges included, north first.
    Numbers beyond the grid meet no point."""
    if column not in cell_map.columns:
        raise KeyError(f"no column {column} in {cell_map.columns}")
    if "healpix_id" not in cell_map.columns:
        raise KeyError("no column healpix_id")
    points = cell_map.sparkSession.range(width * height).selectExpr(f"cast(id div {width} AS int) AS row", f"cast(id % {width} AS int) AS col")
    points = points.selectExpr("*", f"-180D + 360D * col / {max(width - 1, 1)}D AS lon", f"90D - 180D * row / {max(height - 1, 1)}D AS lat")
    located = with_cell(points, "lon", "lat", nside, order, known=True)
    values = cell_map.select(F.col("healpix_id").cast("long").alias("healpix_id"), F.col(column).cast("double").alias("value"))
    return located.join(values, "healpix_id", "left").select("row", "col", "lon", "lat", "value")


def epsg(crs: str | int | None) -> tuple[int, bytes]:
    """The code of a coordinate system (32767: of its own kind) and its description, ended as the format wants it."""
    text = str(crs or "").strip()
    number = text.upper().removeprefix("EPSG:")
    if number.isdigit() and 0 < int(number) < 32767:
        return int(number), b""
    return 32767, f"{text}|".encode("ascii", "replace") if text else b""


def write_geotiff(cell_map: DataFrame, column: str, path: str | Path, nside: int, order: str = "nested", width: int = 1440, height: int = 720, bits: int = 32, crs: str | int | None = None) -> Path:
    """The raster as an uncompressed GeoTIFF of 32- or 64-bit floats in degrees. The image, of a fixed size, is
    gathered on the driver. crs: an EPSG code of a geographic system, or a name that is written as its description."""
    import numpy as np

    image = np.full((height, width), np.nan, f"<f{bits // 8}")
    rows = raster(cell_map, column, nside, order, width, height).filter("value IS NOT NULL").select("row", "col", "value").toPandas()
    image[rows["row"].to_numpy(), rows["col"].to_numpy()] = rows["value"].to_numpy()
    pixel = struct.pack("<3d", 360 / max(width - 1, 1), 180 / max(height - 1, 1), 0)
    corner = struct.pack("<6d", 0, 0, 0, -180, 90, 0)
    code, label = epsg(crs)
    described = [(2049, 34737, len(label), 0)] if label else []
    keys = struct.pack("<4H", 1, 1, 0, 3 + len(described)) + b"".join(struct.pack("<4H", *k) for k in [(1024, 0, 1, 2), (1025, 0, 1, 2), (2048, 0, 1, code), *described])
    nodata = b"nan\0"
    # The tags and types of the TIFF format.
    short, long_, double, ascii_ = 3, 4, 12, 2
    entries = [(256, long_, 1, width), (257, long_, 1, height), (258, short, 1, bits), (259, short, 1, 1), (262, short, 1, 1), (273, long_, 1, "image"), (277, short, 1, 1), (278, long_, 1, height), (279, long_, 1, image.nbytes), (339, short, 1, 3), (33550, double, 3, pixel), (33922, double, 6, corner), (34735, short, len(keys) // 2, keys), *([(34737, ascii_, len(label) + 1, label + b"\0")] if label else []), (42113, ascii_, 4, nodata)]
    base = 8 + 2 + 12 * len(entries) + 4
    blobs, where = b"", {}
    for tag, _, _, v in entries:
        if isinstance(v, bytes) and len(v) > 4:
            where[tag] = base + len(blobs)
            blobs += v
    out = struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", len(entries))
    for tag, kind, n, v in entries:
        packed = v if isinstance(v, bytes) and len(v) <= 4 else struct.pack("<I", where[tag] if tag in where else base + len(blobs) if v == "image" else v)
        out += struct.pack("<HHI", tag, kind, n) + packed
    Path(path).write_bytes(out + struct.pack("<I", 0) + blobs + image.tobytes())
    return Path(path)
