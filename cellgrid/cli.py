"""Command line: sidecar, aggregate, accumulate, finalize, geoparquet, cache, stats."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cellgrid.functions.healpix import is_nside, normal_lon
from cellgrid.operators import aggregate, assign, geo, psf, quality
from cellgrid.sources import metadata, observations
from cellgrid.sources.metadata import GridMeta, Stage
from cellgrid.streaming import state

log = logging.getLogger("cellgrid")


def session() -> SparkSession:
    return SparkSession.builder.appName("cellgrid").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _nsides(text: str) -> list[int]:
    found = [int(x) for x in text.split(",")]
    if bad := [n for n in found if not is_nside(n)]:
        raise argparse.ArgumentTypeError(f"not powers of two: {bad}")
    return found


def _names(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cellgrid", description=__doc__)
    p.add_argument("--verbose", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)

    s = sub.add_parser("sidecar", help="assign observations to cells")
    s.add_argument("input")
    s.add_argument("--nside", type=_nsides, required=True)
    s.add_argument("--mode", choices=assign.MODES, default="fuzzy")
    s.add_argument("--lon-convention", default="0_360")
    s.add_argument("--lon")
    s.add_argument("--lat")
    s.add_argument("--geometry", help="WKB column; footprints are assigned by their vertices")
    s.add_argument("--several", choices=("least", "drop"), default="least")
    s.add_argument("--output-dir")
    s.add_argument("--single-file", action="store_true")
    s.add_argument("--no-bounds", action="store_true", help="keep points of any longitude")
    for what in ("data", "cell"):
        s.add_argument(f"--{what}-psf", choices=("none", "gaussian"), default="none")
        s.add_argument(f"--{what}-psf-sigma", type=float, default=2.0, help="in degrees")
    s.add_argument("--psf-combine", choices=sorted(psf.COMBINE), default="multiply")
    s.add_argument("--no-psf-normalise", action="store_true", help="weights need not sum to one in a cell")
    s.add_argument("-y", "--overwrite", action="store_true")

    s = sub.add_parser("stats", help="statistics of positions")
    s.add_argument("input")
    s.add_argument("--lon")
    s.add_argument("--lat")
    s.add_argument("--lon-convention")
    s.add_argument("--geometry", help="WKB column; of the centres of its first footprints")
    s.add_argument("--sample-size", type=int, default=10_000, help="how many of those")
    s.add_argument("--save", action="store_true")

    s = sub.add_parser("schema", help="columns, what the footers tell, and the first rows")
    s.add_argument("input")
    s.add_argument("--rows", type=int, default=0)

    s = sub.add_parser("aggregate", help="reduce observations per cell")
    s.add_argument("input")
    s.add_argument("--columns", type=_names, required=True)
    s.add_argument("--aggs", type=_names, default=list(aggregate.DEFAULT))
    s.add_argument("--sidecar-index", default="all", help="all, or numbers of the listing")
    s.add_argument("--list", action="store_true")
    s.add_argument("--stats", action="store_true", help="with --list: rows and cells of each sidecar")
    s.add_argument("--filter")
    s.add_argument("--min-count", type=int, default=1)
    s.add_argument("--sentinel", type=float, default=observations.SENTINEL)
    s.add_argument("--densify", action="store_true")
    s.add_argument("--sidecar-dir")
    s.add_argument("--output-dir")
    s.add_argument("--stop-on-error", action="store_true")
    s.add_argument("--dry-run", action="store_true")
    s.add_argument("-y", "--overwrite", action="store_true")

    s = sub.add_parser("accumulate", help="add a batch to a state")
    s.add_argument("input")
    s.add_argument("--columns", type=_names, required=True)
    s.add_argument("--sidecar")
    s.add_argument("--nside", type=int)
    s.add_argument("--mode", choices=assign.MODES, default="fuzzy")
    s.add_argument("--state-input")
    s.add_argument("--state-output", required=True)
    s.add_argument("--filter")
    s.add_argument("--no-sketch", action="store_true")

    s = sub.add_parser("finalize", help="statistics of a state")
    s.add_argument("state")
    s.add_argument("--columns", type=_names, required=True)
    s.add_argument("--output", required=True)
    s.add_argument("--percentiles", default="25,50,75")
    s.add_argument("--min-count", type=int, default=1)
    s.add_argument("--densify", action="store_true")
    s.add_argument("--geotiff-column")
    s.add_argument("--crs", help="EPSG code or name for the GeoTIFF")
    s.add_argument("-y", "--overwrite", action="store_true")

    s = sub.add_parser("geoparquet", help="a map with its cells' polygons")
    s.add_argument("input")
    s.add_argument("output")
    s.add_argument("--nside", type=int)
    s.add_argument("--order")
    s.add_argument("--lon-convention")
    s.add_argument("--dense", action="store_true")
    s.add_argument("--cache", choices=("use", "require", "off"), default="off")
    s.add_argument("-y", "--overwrite", action="store_true")

    s = sub.add_parser("cache", help="the cache of grids")
    s.add_argument("action", choices=("list", "generate", "verify", "clean", "info", "config"))
    s.add_argument("--nside", type=_nsides, default=[])
    s.add_argument("--order", default="nested")
    s.add_argument("--cache-dir")
    s.add_argument("--force", action="store_true")
    return p


def _lonlat(a: argparse.Namespace, columns: list[str]) -> tuple[str, str]:
    """The columns given, else those of a known name, else those whose names hold a known part."""
    if a.lon and a.lat:
        return a.lon, a.lat
    try:
        return observations.exact_lonlat(columns)
    except ValueError:
        lon, lat = observations.detect_lonlat(columns)
        if lon is None or lat is None:
            raise
        return lon, lat


def run_sidecar(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    obs = observations.read_observations(spark, a.input)
    lon, lat = (None, None) if a.geometry else _lonlat(a, obs.columns)
    spreads = {k: psf.spread_function(kind, sigma) for k, kind, sigma in (("data", a.data_psf, a.data_psf_sigma), ("cell", a.cell_psf, a.cell_psf_sigma)) if kind != "none"}
    made = []
    for nside in a.nside:
        if a.geometry:
            side = assign.assign_footprints(obs.withColumn("vertices", geo.wkb_vertices(a.geometry)), nside, a.mode, convention=a.lon_convention, several=a.several, fix_antimeridian=True, combine=a.psf_combine, **spreads)
        else:
            centre = psf.pair_weight(F.lit(0.0), F.lit(0.0), combine=a.psf_combine, **spreads) if spreads else None
            points = obs.withColumn(lon, normal_lon(observations.number(lon), a.lon_convention)) if a.no_bounds else obs
            side = assign.assign_points(points, nside, lon, lat, a.lon_convention, weight=centre)
        if spreads and not a.no_psf_normalise:
            side = psf.normalised(side)
        meta = GridMeta(nside, mode=a.mode, lon_convention=a.lon_convention, file_type=Stage.SIDECAR, extra={"processing": {"input_file": str(a.input)}})
        path = metadata.sidecar_path(a.input, a.mode, nside, a.output_dir)
        observations.write_table(side, path, meta, "overwrite" if a.overwrite else "error", a.single_file)
        made.append(str(path))
    return made


def run_stats(spark: SparkSession, a: argparse.Namespace) -> dict:
    obs = spark.read.parquet(a.input)
    if a.geometry:
        found = quality.footprint_stats(obs.withColumn("vertices", geo.wkb_vertices(a.geometry)), a.sample_size).first().asDict()
    else:
        found = quality.geo_stats(obs, *_lonlat(a, obs.columns), a.lon_convention).first().asDict()
    found["suggested_convention"] = quality.suggest_convention(found)
    if a.save:
        metadata.stats_path(a.input).write_text(json.dumps(found, indent=2))
    return found


def run_schema(spark: SparkSession, a: argparse.Namespace) -> dict:
    df = spark.read.parquet(a.input)
    rows = [r.asDict(recursive=True) for r in observations.head(df, a.rows).collect()] if a.rows else []
    return {"columns": observations.schema_text(df).splitlines(), "files": observations.file_text(a.input).splitlines(), "rows": rows}


def run_aggregate(spark: SparkSession, a: argparse.Namespace) -> list[dict]:
    found = observations.list_sidecars(a.input, a.sidecar_dir, spark if a.list and a.stats else None)
    if a.list:
        return found
    chosen = list(range(len(found))) if a.sidecar_index == "all" else [int(x) for x in a.sidecar_index.split(",")]
    if bad := [i for i in chosen if not 0 <= i < len(found)]:
        raise ValueError(f"there are {len(found)} sidecars, not {bad}")
    done = []
    for i in chosen:
        row = found[i]
        path = metadata.aggregate_path(a.input, row["path"], a.output_dir, a.densify)
        status = {"sidecar": row["path"], "output": str(path), "status": "planned"}
        done.append(status)
        if a.dry_run:
            continue
        try:
            metadata.check_sidecar_source(row["path"], a.input)
            obs = observations.read_observations(spark, a.input, where=a.filter)
            got = aggregate.aggregate_by_sidecar(obs, spark.read.parquet(row["path"]), a.columns, tuple(a.aggs), a.min_count, sentinel=a.sentinel)
            if a.densify:
                got = aggregate.densify(got, row["nside"])
            meta = GridMeta(row["nside"], row["order"], mode=row["mode"], file_type=Stage.AGGREGATE, extra={"processing": {"input_file": str(a.input)}, "processing_params": {"aggs": a.aggs, "min_count": a.min_count, "filter": a.filter}})
            observations.write_table(got.orderBy("healpix_id"), path, meta, "overwrite" if a.overwrite else "error")
            status["status"] = "done"
        except Exception as e:
            status["status"] = f"failed: {e}"
            if a.stop_on_error:
                raise
            log.error("%s: %s", row["path"], e)
    return done


def run_accumulate(spark: SparkSession, a: argparse.Namespace) -> dict:
    side_path = a.sidecar or observations.find_sidecar(a.input, a.nside, a.mode)
    if side_path is None:
        raise FileNotFoundError(f"no sidecar for {a.input}")
    side = spark.read.parquet(str(side_path))
    meta = metadata.read_meta(side_path, side)
    before = None
    if a.state_input:
        before, old = state.load_state(spark, a.state_input)
        for warning in metadata.check_compatible(old, meta):
            log.warning(warning)
    batch = observations.read_observations(spark, a.input)
    after = state.accumulate(batch, side, a.columns, before, not a.no_sketch, a.filter)
    state.save_state(after, a.state_output, meta)
    return state.progress(spark.read.parquet(a.state_output), before)


def run_finalize(spark: SparkSession, a: argparse.Namespace) -> str:
    held, meta = state.load_state(spark, a.state)
    wanted = [float(x) for x in _names(a.percentiles)]
    if wanted and held.filter("sketch IS NOT NULL").isEmpty():
        log.warning("the state has no sketches; percentiles are left out")
        wanted = []
    got = state.finalize(held, a.columns, wanted, a.min_count)
    if a.densify:
        got = aggregate.densify(got, meta.nside)
    out = GridMeta(meta.nside, meta.order, mode=meta.mode, lon_convention=meta.lon_convention, file_type=Stage.FINALIZE)
    observations.write_table(got.orderBy("healpix_id"), a.output, out, "overwrite" if a.overwrite else "error")
    if a.geotiff_column:
        geo.write_geotiff(spark.read.parquet(a.output), a.geotiff_column, f"{a.output}.tif", meta.nside, meta.order, crs=a.crs)
    return a.output


def run_geoparquet(spark: SparkSession, a: argparse.Namespace) -> str:
    meta = geo.check_map_input(a.input)
    got = spark.read.parquet(a.input)
    return str(geo.to_geoparquet(got, a.output, a.nside, meta, a.order, a.lon_convention, a.dense, a.overwrite, Path(a.input).name, cache=a.cache))


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    logging.basicConfig(level=logging.DEBUG if a.verbose else logging.INFO, format="%(levelname)s %(message)s")
    spark = spark or session()
    run = {"sidecar": run_sidecar, "stats": run_stats, "schema": run_schema, "aggregate": run_aggregate, "accumulate": run_accumulate, "finalize": run_finalize, "geoparquet": run_geoparquet, "cache": lambda s, a: geo.manage_cache(s, a.action, a.nside, a.order, a.cache_dir, a.force)}[a.command]
    try:
        print(json.dumps(run(spark, a), indent=2, default=str))
    except (ValueError, KeyError, OSError, AssertionError, AnalysisException) as e:
        log.error("%s: %s", type(e).__name__, e)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
