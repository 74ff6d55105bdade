"""Data-quality reports of sidecars and maps, and statistics of positions."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.functions.healpix import RANGES, check_convention
from cellgrid.sources.metadata import GridMeta
from cellgrid.sources.observations import number

log = logging.getLogger(__name__)

WEIGHT_TOLERANCE = 0.01


def sidecar_report(sidecar: DataFrame, npix: int) -> DataFrame:
    """One row of counts: rows, sources, cells, nulls, cells out of the grid, bad weights, sources of several cells, and
    the range of the sources' weight sums."""
    has_weight = "weight" in sidecar.columns
    rows = sidecar.select("source_id", F.col("healpix_id").cast("long").alias("healpix_id"), (F.col("weight") if has_weight else F.lit(1.0)).alias("weight"))
    per_source = rows.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("healpix_id").alias("cells"),
        F.sum("weight").alias("weight"),
        F.count_if(F.col("healpix_id").isNull() | F.col("source_id").isNull()).alias("nulls"),
        F.count_if((F.col("healpix_id") < 0) | (F.col("healpix_id") >= npix)).alias("outside"),
        F.count_if((F.col("weight") < 0) | (F.col("weight") > 1) | F.col("weight").isNull()).alias("bad_weights"),
    )
    sources = per_source.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("n_rows"),
        F.count("source_id").alias("n_sources"),
        F.coalesce(F.sum("nulls"), F.lit(0)).alias("n_null"),
        F.coalesce(F.sum("outside"), F.lit(0)).alias("n_outside"),
        F.coalesce(F.sum("bad_weights"), F.lit(0)).alias("n_bad_weight"),
        F.count_if(F.col("cells") > 1).alias("n_multi"),
        F.min("weight").alias("least_weight_sum"),
        F.max("weight").alias("greatest_weight_sum"),
        (F.max("source_id") - F.min("source_id") + 1 == F.count("source_id")).alias("contiguous"),
    )
    return sources.join(rows.agg(F.countDistinct("healpix_id").alias("n_cells")))  # one row each


def check_sidecar(sidecar: DataFrame, meta: GridMeta, strict: bool = True) -> dict:
    """{valid, errors, warnings, stats}; strict: AssertionError if there is an error."""
    if missing := [c for c in ("source_id", "healpix_id") if c not in sidecar.columns]:
        result = {"valid": False, "errors": [f"missing columns {missing}"], "warnings": [], "stats": {}}
    else:
        s = sidecar_report(sidecar, meta.npix).first().asDict()
        errors = [m for bad, m in ((s["n_null"], f"{s['n_null']} null ids"), (s["n_outside"], f"{s['n_outside']} cells beyond {meta.npix}"), (s["n_bad_weight"], f"{s['n_bad_weight']} weights out of 0..1"), (meta.mode == "strict" and s["n_multi"], f"{s['n_multi']} sources in several cells in strict mode")) if bad]
        warnings = []
        if s["n_rows"] and "weight" in sidecar.columns and (abs(s["least_weight_sum"] - 1) > WEIGHT_TOLERANCE or abs(s["greatest_weight_sum"] - 1) > WEIGHT_TOLERANCE):
            warnings.append(f"weights of a source sum to {s['least_weight_sum']:.3f} to {s['greatest_weight_sum']:.3f}")
        if s["n_rows"] and not s["contiguous"]:
            warnings.append("source ids have gaps")
        if not s["n_rows"]:
            warnings.append("the sidecar is empty")
        result = {"valid": not errors, "errors": errors, "warnings": warnings, "stats": s}
    if strict and not result["valid"]:
        raise AssertionError("; ".join(result["errors"]))
    return result


def aggregate_report(cell_map: DataFrame, npix: int) -> DataFrame:
    """One row of counts over a map's cells."""
    n = F.col("n_sources") if "n_sources" in cell_map.columns else F.lit(None).cast("long")
    c = F.col("healpix_id").cast("long")
    return cell_map.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(c).alias("n_cells"),
        F.count_if(c.isNull()).alias("n_null"),
        F.count_if((c < 0) | (c >= npix)).alias("n_outside"),
        F.count_if(n < 0).alias("n_negative"),
        F.min(n).alias("least_sources"),
        F.max(n).alias("greatest_sources"),
        F.sum(n).alias("all_sources"),
        F.count_if(n == 1).alias("cells_of_1"),
        F.count_if(n.between(2, 5)).alias("cells_of_2_5"),
        F.count_if(n > 5).alias("cells_of_more"),
    )


def check_aggregate(cell_map: DataFrame, meta: GridMeta, expected: list[str] | None = None, strict: bool = True) -> dict:
    """{valid, errors, warnings, stats}; strict: AssertionError if there is an error."""
    errors, warnings, s = [], [], {}
    if "healpix_id" not in cell_map.columns:
        errors.append("missing column healpix_id")
    else:
        s = aggregate_report(cell_map, meta.npix).first().asDict()
        errors += [m for bad, m in ((s["n_null"], f"{s['n_null']} null cells"), (s["n_outside"], f"{s['n_outside']} cells beyond {meta.npix}"), (s["n_rows"] - s["n_null"] - s["n_cells"], "a cell has several rows"), (s["n_negative"], "negative n_sources")) if bad]
        if "n_sources" not in cell_map.columns:
            warnings.append("no column n_sources")
        if not s["n_rows"]:
            warnings.append("the map is empty")
        elif s["n_rows"] == meta.npix:
            s["dense"] = True
    if expected and (missing := [c for c in expected if c not in cell_map.columns]):
        errors.append(f"missing columns {missing}")
    result = {"valid": not errors, "errors": errors, "warnings": warnings, "stats": s}
    for w in warnings:
        log.warning(w)
    if strict and errors:
        raise AssertionError("; ".join(errors))
    return result


def geo_stats(obs: DataFrame, lon: str = "lon", lat: str = "lat", convention: str | None = None) -> DataFrame:
    """One row: all and kept points, and least, greatest, mean and sample deviation of the kept positions. Longitudes
    are kept from the range's start up to, not including, its end."""
    x, y = number(lon), number(lat)
    good = x.isNotNull() & y.isNotNull() & y.between(-90.0, 90.0)
    if convention:
        lo, hi = RANGES[check_convention(convention)]
        good = good & (x >= lo) & (x < hi)
    rows = obs.select(F.when(good, x).alias("x"), F.when(good, y).alias("y"))
    parts = [f(c).alias(f"{name}_{label}") for c, name in (("x", "lon"), ("y", "lat")) for f, label in ((F.min, "min"), (F.max, "max"), (F.avg, "mean"), (F.stddev_samp, "std"))]
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count("x").alias("kept"), *parts)


def footprint_stats(obs: DataFrame, rows: int, vertices: str = "vertices") -> DataFrame:
    """The same of the centres of the first `rows` footprints, with the population's deviation."""
    mean = lambda f: F.aggregate(vertices, F.lit(0.0), lambda a, p: a + p[f]) / F.size(vertices)
    centres = obs.filter(F.size(vertices) > 0).limit(rows).select(mean("lon").alias("x"), mean("lat").alias("y"))
    parts = [f(c).alias(f"{name}_{label}") for c, name in (("x", "lon"), ("y", "lat")) for f, label in ((F.min, "min"), (F.max, "max"), (F.avg, "mean"), (F.stddev_pop, "std"))]
    return centres.agg(F.count(F.lit(1)).alias("total"), *parts)


def suggest_convention(stats: dict) -> str:
    """The convention that the longitudes' range tells."""
    return "-180_180" if (stats["lon_min"] or 0) < 0 else "0_360"


def cells_per_source(sidecar: DataFrame) -> DataFrame:
    """(cells, sources): how many sources lie in how many cells."""
    return sidecar.groupBy("source_id").agg(F.countDistinct("healpix_id").alias("cells")).groupBy("cells").agg(F.count(F.lit(1)).alias("sources"))


def coverage(cell_map: DataFrame, min_count: int = 1, n: str = "n_sources") -> DataFrame:
    return cell_map.agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col(n) >= min_count).alias("valid_cells"), F.sum(n).alias("observations"))


def file_stats(obs: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Rows and bounding box of each file."""
    return obs.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("rows"), F.min(lon).alias("lon_min"), F.max(lon).alias("lon_max"), F.min(lat).alias("lat_min"), F.max(lat).alias("lat_max"))
