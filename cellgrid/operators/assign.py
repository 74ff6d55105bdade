"""Assignment of observations to cells: the sidecar (source_id, healpix_id, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.functions.healpix import RANGES, check_convention, check_nside, parent, unwrapped, with_cell, with_corner_degrees, with_corners
from cellgrid.operators.psf import Spread, pair_weight
from cellgrid.sources.observations import number

MODES = ("fuzzy", "strict")


def in_bounds(lon: Column, lat: Column, convention: str) -> Column:
    """Both finite and within the convention's range, edges included."""
    lo, hi = RANGES[check_convention(convention)]
    return F.coalesce(lon.between(lo, hi) & lat.between(-90.0, 90.0), F.lit(False))


def assign_points(obs: DataFrame, nside: int, lon: str = "lon", lat: str = "lat", convention: str = "0_360", source_id: str = "source_id", order: str = "nested", weight: Column | None = None) -> DataFrame:
    """The cell of each point within bounds; others are dropped. A point lies in one cell, whatever the mode."""
    rows = obs.select(F.col(source_id).cast("long").alias("source_id"), number(lon).alias("lon"), number(lat).alias("lat"), (F.lit(1.0) if weight is None else weight).cast("double").alias("weight"))
    rows = rows.filter(in_bounds(F.col("lon"), F.col("lat"), convention))
    return with_cell(rows, "lon", "lat", nside, order, known=True).select("source_id", "healpix_id", "weight")


def assign_points_multi(obs: DataFrame, nsides: list[int], **kw) -> DataFrame:
    """(nside, source_id, healpix_id, weight) for several resolutions: one assignment at the finest, whose nested
    numbers give all coarser cells by a shift."""
    finest = max(check_nside(n) for n in nsides)
    fine = assign_points(obs, finest, **kw)
    levels = F.array(*[F.struct(F.lit(n).alias("nside"), F.lit(2 * (finest.bit_length() - n.bit_length())).alias("shift")) for n in sorted(set(nsides))])
    return fine.withColumn("l", F.explode(levels)).select(F.col("l.nside").alias("nside"), "source_id", F.expr("shiftright(healpix_id, l.shift)").alias("healpix_id"), "weight")


def repair_antimeridian(vertices: str = "vertices", rings: bool = False) -> Column:
    """Vertices (lon, lat) with the points where an edge of over 180 degrees crosses the antimeridian, on both sides, at
    the linear latitude. rings: the vertices are (lon, lat, ring), and no edge leads from one ring to the next."""
    v = F.col(vertices)
    point = lambda lon, lat, like: F.struct(lon.alias("lon"), lat.alias("lat"), *([like["ring"].alias("ring")] if rings else []))
    ring = F.transform(F.sequence(F.lit(1), F.size(v) - 1), lambda i: F.struct(F.element_at(v, i).alias("a"), F.element_at(v, i + 1).alias("b")))

    def crossing(e: Column) -> Column:
        a, b = e["a"], e["b"]
        step = b["lon"] - a["lon"]
        east = step < 0  # over the line eastwards
        to = F.when(east, step + 360.0).otherwise(step - 360.0)
        edge = F.when(east, F.lit(180.0)).otherwise(F.lit(-180.0))
        lat = a["lat"] + (b["lat"] - a["lat"]) * (edge - a["lon"]) / to
        both = F.array(point(a["lon"], a["lat"], a), point(edge, lat, a), point(-edge, lat, a))
        over = (F.abs(step) > 180.0) & (a["ring"] == b["ring"]) if rings else F.abs(step) > 180.0
        return F.when(over, both).otherwise(F.array(point(a["lon"], a["lat"], a)))

    return F.when(F.size(v) > 1, F.concat(F.flatten(F.transform(ring, crossing)), F.array(point(F.element_at(v, -1)["lon"], F.element_at(v, -1)["lat"], F.element_at(v, -1))))).otherwise(F.transform(v, lambda p: point(p["lon"], p["lat"], p)))


def assign_footprints(obs: DataFrame, nside: int, mode: str = "fuzzy", vertices: str = "vertices", convention: str = "0_360", source_id: str = "source_id", several: str = "least", fix_antimeridian: bool = False, data: Spread | None = None, cell: Spread | None = None, combine: str = "multiply") -> DataFrame:
    """Cells of footprints, arrays of (lon, lat) or (lon, lat, ring) over all rings. fuzzy: the distinct cells of the
    vertices. strict: the one cell; where there are several, the least (several="least") or none (several="drop").

    A footprint with a vertex out of bounds is dropped, as are null and empty ones. A footprint of a single vertex is a
    point and held to the same bounds, since out of them it has no cell of its own in the convention.

    data, cell: point spread functions that weigh a cell by the distance of its centroid from the footprint's, in degrees
    and the shorter way around; without them all weights are 1, as they are in strict mode where several cells are met.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    lo, hi = RANGES[check_convention(convention)]
    rows = obs.select(F.col(source_id).cast("long").alias("source_id"), F.col(vertices).alias("vertices"))
    rows = rows.filter(F.coalesce((F.size("vertices") > 0) & F.forall("vertices", lambda p: F.coalesce(p["lon"].between(lo, hi) & p["lat"].between(-90.0, 90.0), F.lit(False))), F.lit(False)))
    rings = "ring" in rows.schema["vertices"].dataType.elementType.names
    centres = rows.select("source_id", centroid(F.col("vertices"), rings).alias("c")).groupBy("source_id").agg(F.min("c").alias("_source"))
    if fix_antimeridian:
        rows = rows.withColumn("vertices", repair_antimeridian(rings=rings))
    points = rows.select("source_id", F.explode("vertices").alias("p")).select("source_id", F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat"))
    cells = with_cell(points, "lon", "lat", nside, known=True).select("source_id", "healpix_id")
    if mode == "fuzzy":
        found = cells.distinct()
    else:
        found = cells.groupBy("source_id").agg(F.min("healpix_id").alias("healpix_id"), F.max("healpix_id").alias("_top"))
        found = found.filter("healpix_id = _top") if several == "drop" else found
    if data is None and cell is None:
        return found.select("source_id", "healpix_id", F.lit(1.0).alias("weight"))
    at = with_cell_centroid(found.join(centres, "source_id"), "healpix_id", nside)
    east = F.pmod(F.col("_source.lon") - F.col("_cell.lon") + 180.0, F.lit(360.0)) - 180.0
    weight = pair_weight(east, F.col("_source.lat") - F.col("_cell.lat"), data, cell, combine)
    return at.select("source_id", "healpix_id", (F.when(F.col("healpix_id") != F.col("_top"), 1.0).otherwise(weight) if mode == "strict" else weight).alias("weight"))


def centroid(vertices: Column, rings: bool = False) -> Column:
    """(lon, lat): the centroid of a polygon's area in the plane of longitude and latitude, or, where that is none, the
    mean of its vertices. rings: no edge leads from one ring to the next."""
    n = F.size(vertices)
    edges = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.element_at(vertices, i).alias("a"), F.element_at(vertices, F.when(i < n, i + 1).otherwise(F.lit(1))).alias("b")))
    zero = F.lit(0.0)

    def add(s: Column, e: Column) -> Column:
        a, b = e["a"], e["b"]
        cross = a["lon"] * b["lat"] - b["lon"] * a["lat"]
        if rings:
            cross = F.when(a["ring"].eqNullSafe(b["ring"]), cross).otherwise(0.0)
        return F.struct((s["area"] + cross).alias("area"), (s["x"] + cross * (a["lon"] + b["lon"])).alias("x"), (s["y"] + cross * (a["lat"] + b["lat"])).alias("y"), (s["mx"] + a["lon"]).alias("mx"), (s["my"] + a["lat"]).alias("my"))

    def finish(s: Column) -> Column:
        flat = F.abs(s["area"]) <= 1e-12
        return F.struct(F.when(flat, s["mx"] / n).otherwise(s["x"] / (s["area"] * 3.0)).alias("lon"), F.when(flat, s["my"] / n).otherwise(s["y"] / (s["area"] * 3.0)).alias("lat"))

    return F.aggregate(edges, F.struct(*[zero.alias(k) for k in ("area", "x", "y", "mx", "my")]), add, finish)


def with_cell_centroid(df: DataFrame, cell: str, nside: int) -> DataFrame:
    """Adds _cell, the centroid of a nested cell's polygon in degrees."""
    df = unwrapped(with_corner_degrees(with_corners(df, cell, nside)))
    df = df.withColumns({f"_x{k}": F.expr(f"lon_{k} * lat_{(k + 1) % 4} - lon_{(k + 1) % 4} * lat_{k}") for k in range(4)})
    df = df.withColumn("_area", F.expr("3D * (_x0 + _x1 + _x2 + _x3)"))
    middle = lambda c: F.expr("(" + " + ".join(f"_x{k} * ({c}_{k} + {c}_{(k + 1) % 4})" for k in range(4)) + ") / _area").alias(c)
    df = df.withColumn("_cell", F.struct(middle("lon"), middle("lat")))
    return df.drop("_area", *[f"_x{k}" for k in range(4)], *[f"{a}_{k}" for a in ("theta", "phi", "lon", "lat") for k in range(4)])


def drop_report(obs: DataFrame, lon: str = "lon", lat: str = "lat", convention: str = "0_360") -> DataFrame:
    """One row: how many points there are and how many are out of bounds."""
    good = in_bounds(number(lon), number(lat), convention)
    return obs.agg(F.count(F.lit(1)).alias("total"), F.count_if(~good).alias("dropped")).withColumn("percent", F.try_divide(F.col("dropped") * 100.0, F.col("total")))


def rolled_up(sidecar: DataFrame, levels: int) -> DataFrame:
    """A sidecar at a resolution `levels` coarser."""
    return sidecar.withColumn("healpix_id", parent("healpix_id", levels)).distinct()
