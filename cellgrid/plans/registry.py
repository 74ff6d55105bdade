"""Queries of the library's own operators, with the SQL that an independent engine runs beside them.

The queries run over whole tables. Floating results are given in units of 1/10000 (`micro`), since two engines may
differ in a sum's last bit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.functions import healpix
from cellgrid.operators import aggregate, assign, display, geo, psf, quality
from cellgrid.plans import oracle as sql
from cellgrid.sources import observations
from cellgrid.sources.metadata import GridMeta
from cellgrid.streaming import state, stream

NSIDE = 32
AGGS = ("mean", "median", "std", "min", "max", "mad", "robust_std")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def micro(c: str | Column, name: str | None = None) -> Column:
    v = F.col(c) if isinstance(c, str) else c
    return F.floor(v * 1e4 + 0.377).cast("long").alias(name or c)


def all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def placed(items: DataFrame) -> DataFrame:
    """Line items as observations with made-up positions."""
    return items.selectExpr(
        "l_orderkey * 8 + l_linenumber AS source_id",
        "((l_orderkey * 7919 + l_linenumber * 104729) % 360000) / 1000D + 0.00037D AS lon",
        "((l_partkey * 15485863 + l_linenumber * 32452843) % 180000) / 1000D - 90D + 0.00029D AS lat",
        "l_extendedprice AS v",
        "l_quantity AS w",
        "l_returnflag AS flag",
    )


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each source, in the order of the file."""
    return observations.first_of_each(all_rows(spark, sf_dir))


def sidecar(obs: DataFrame, nside: int = NSIDE) -> DataFrame:
    return assign.assign_points(obs, nside)


def stats_micro(cell_map: DataFrame, columns: list[str], aggs: tuple[str, ...] = AGGS) -> DataFrame:
    return cell_map.select("healpix_id", *[micro(f"{c}_{a}") for c in columns for a in aggs], "n_sources")


SIDE = f"SELECT source_id, healpix_id FROM ({sql.cells(sql.OBS, NSIDE)})"
CELLS_ALL = sql.cells(sql.ALL, NSIDE)

# --- sources and filters -----------------------------------------------------------------------------------------------


@query("SELECT row_number() OVER () - 1 AS source_id, l_orderkey, l_linenumber, l_partkey FROM lineitem")
def row_ids(spark, sf_dir):
    """Global row numbers of a file without an id column, with what each row holds."""
    return observations.read_observations(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_partkey"])


@query(f"SELECT source_id, {sql.micro('v')} FROM ({sql.OBS}) WHERE flag = 'R' AND w > 25 AND flag IN ('R', 'A')")
def filter_dialect(spark, sf_dir):
    return rows(spark, sf_dir).filter(F.expr(observations.filter_text("flag == 'R' & w > 25 and flag in ['R', 'A']"))).select("source_id", micro("v"))


@query(f"SELECT source_id, {sql.micro('v')}, {sql.micro('lat')} FROM ({sql.OBS})")
def keep_first(spark, sf_dir):
    return rows(spark, sf_dir).select("source_id", micro("v"), micro("lat"))


@query(f"SELECT flag, count(*) AS n, count(CASE WHEN abs(v) < 50000 THEN v END) AS n_valid FROM ({sql.ALL}) GROUP BY flag")
def sentinel_mask(spark, sf_dir):
    return all_rows(spark, sf_dir).groupBy("flag").agg(F.count(F.lit(1)).alias("n"), F.count(observations.value("v", 50000.0)).alias("n_valid"))


# --- assignment --------------------------------------------------------------------------------------------------------


@query(f"SELECT source_id, healpix_id, {sql.micro('1e0', 'weight')} FROM ({sql.cells(sql.ALL, NSIDE)})")
def assign_points_nside32(spark, sf_dir):
    return sidecar(all_rows(spark, sf_dir)).select("source_id", "healpix_id", micro("weight"))


@query(" UNION ALL ".join(f"SELECT {n} AS nside, source_id, healpix_id FROM ({sql.cells(sql.ALL, n)})" for n in (4, 32, 64)))
def assign_points_multi_nside(spark, sf_dir):
    return assign.assign_points_multi(all_rows(spark, sf_dir), [4, 32, 64]).select("nside", "source_id", "healpix_id")


@query(f"SELECT source_id, ring_id AS healpix_id FROM ({sql.ring(sql.faces(sql.ALL, NSIDE), NSIDE)})")
def assign_ring(spark, sf_dir):
    return assign.assign_points(all_rows(spark, sf_dir), NSIDE, order="ring").select("source_id", "healpix_id")


@query(f"SELECT count(*) AS total, count(CASE WHEN lat NOT BETWEEN -90 AND 90 OR lon - 200e0 NOT BETWEEN -180e0 AND 180e0 THEN 1 END) AS dropped FROM ({sql.ALL})")
def drop_report(spark, sf_dir):
    moved = all_rows(spark, sf_dir).withColumn("lon", F.col("lon") - 200.0)
    return assign.drop_report(moved, convention="minus_plus180").select("total", "dropped")


BOX = "SELECT source_id, unnest([0, 1, 2, 3]) AS k, lon AS lon0, lat AS lat0 FROM ({src}) WHERE lon - 1.3e0 >= 0 AND lon + 1.3e0 <= 360 AND lat - 1.1e0 >= -90 AND lat + 1.1e0 <= 90"
BOX_POINTS = "SELECT source_id, lon0 + CASE WHEN k IN (0, 3) THEN -1.3e0 ELSE 1.3e0 END AS lon, lat0 + CASE WHEN k < 2 THEN -1.1e0 ELSE 1.1e0 END AS lat FROM ({box})"
BOX_CELLS = f"SELECT DISTINCT source_id, healpix_id FROM ({sql.cells(BOX_POINTS.format(box=BOX.format(src=sql.OBS)), NSIDE)})"


def boxes(spark, sf_dir):
    """A footprint of four vertices around each observation; those over the seam or a pole are out of bounds."""
    vertex = lambda x, y: F.struct((F.col("lon") + x).alias("lon"), (F.col("lat") + y).alias("lat"))
    return rows(spark, sf_dir).select("source_id", "v", F.array(vertex(-1.3, -1.1), vertex(1.3, -1.1), vertex(1.3, 1.1), vertex(-1.3, 1.1)).alias("vertices"))


@query(BOX_CELLS)
def footprint_fuzzy(spark, sf_dir):
    return assign.assign_footprints(boxes(spark, sf_dir), NSIDE).select("source_id", "healpix_id")


@query(f"SELECT source_id, min(healpix_id) AS healpix_id FROM ({BOX_CELLS}) GROUP BY 1")
def footprint_strict_min(spark, sf_dir):
    return assign.assign_footprints(boxes(spark, sf_dir), NSIDE, "strict").select("source_id", "healpix_id")


@query(f"SELECT source_id, min(healpix_id) AS healpix_id FROM ({BOX_CELLS}) GROUP BY 1 HAVING count(*) = 1")
def footprint_strict_drop(spark, sf_dir):
    return assign.assign_footprints(boxes(spark, sf_dir), NSIDE, "strict", several="drop").select("source_id", "healpix_id")


PSF = f"SELECT source_id, healpix_id, dx, dy, exp((dx * dx + dy * dy) * (-0.5e0 / (1.5e0 * 1.5e0))) AS g FROM (SELECT s.source_id, healpix_id, (s.source_id % 7) / 3e0 - 1e0 AS dx, (s.source_id % 5) / 2e0 - 1e0 AS dy FROM ({SIDE}) s)"


def offsets(side: DataFrame) -> DataFrame:
    return side.withColumns({"dx": F.expr("(source_id % 7) / 3D - 1D"), "dy": F.expr("(source_id % 5) / 2D - 1D")})


@query(f"SELECT source_id, healpix_id, {sql.micro('g', 'multiply')}, {sql.micro('g + 1e0', 'sum')}, {sql.micro('least(g, 1e0)', 'min')}, {sql.micro('greatest(g, 1e0)', 'max')} FROM ({PSF})")
def psf_weight(spark, sf_dir):
    side = offsets(sidecar(rows(spark, sf_dir)))
    parts = {how: psf.pair_weight(F.col("dx"), F.col("dy"), psf.spread_function("gaussian", 1.5), None, how) for how in ("multiply", "sum", "min", "max")}
    return side.select("source_id", "healpix_id", *[micro(v, k) for k, v in parts.items()])


@query(f"SELECT source_id, healpix_id, {sql.micro('g / sum(g) OVER (PARTITION BY healpix_id)', 'weight')} FROM ({PSF})")
def weight_normalised(spark, sf_dir):
    side = offsets(sidecar(rows(spark, sf_dir))).withColumn("weight", psf.pair_weight(F.col("dx"), F.col("dy"), psf.gaussian(1.5)))
    return psf.normalised(side).select("source_id", "healpix_id", micro("weight"))


@query(f"SELECT healpix_id, {sql.micro('sum(v * g) / sum(g)', 'v_wmean')} FROM ({PSF}) JOIN ({sql.OBS}) USING (source_id) GROUP BY healpix_id")
def weighted_mean(spark, sf_dir):
    obs = rows(spark, sf_dir)
    side = offsets(sidecar(obs)).select("source_id", "healpix_id", psf.pair_weight(F.col("dx"), F.col("dy"), psf.gaussian(1.5)).alias("weight"))
    return aggregate.weighted_mean(obs, side, ["v"]).select("healpix_id", micro("v_wmean"))


# --- aggregation -------------------------------------------------------------------------------------------------------


@query(f"SELECT healpix_id, {sql.micro('avg(v)', 'v_mean')}, {sql.micro('stddev_pop(v)', 'v_std')}, {sql.micro('min(v)', 'v_min')}, {sql.micro('max(v)', 'v_max')}, count(*) AS n_sources FROM ({CELLS_ALL}) GROUP BY healpix_id")
def agg_basic(spark, sf_dir):
    """Straight from points: one shuffle, no join."""
    got = aggregate.aggregate_points(all_rows(spark, sf_dir), NSIDE, ["v"], ("mean", "std", "min", "max"))
    return stats_micro(got, ["v"], ("mean", "std", "min", "max"))


@query(sql.stats(CELLS_ALL, ["v", "w"]))
def agg_robust(spark, sf_dir):
    return stats_micro(aggregate.aggregate_points(all_rows(spark, sf_dir), NSIDE, ["v", "w"], AGGS), ["v", "w"])


@query(sql.stats(sql.cells(sql.OBS, NSIDE), ["v"]))
def agg_by_sidecar(spark, sf_dir):
    everything = all_rows(spark, sf_dir)
    return stats_micro(aggregate.aggregate_by_sidecar(everything, sidecar(observations.first_of_each(everything)), ["v"], AGGS), ["v"])


@query(sql.stats(CELLS_ALL, ["v"], least=5))
def agg_min_count(spark, sf_dir):
    return stats_micro(aggregate.aggregate_points(all_rows(spark, sf_dir), NSIDE, ["v"], AGGS, min_count=5), ["v"])


@query(f"SELECT healpix_id, {sql.micro('avg(v)', 'v_mean')}, count(v) AS v_n_valid, count(*) AS n_sources FROM ({SIDE}) LEFT JOIN (SELECT source_id, v FROM ({sql.OBS}) WHERE flag = 'R') USING (source_id) GROUP BY healpix_id")
def agg_filter_left_join(spark, sf_dir):
    obs = rows(spark, sf_dir)
    got = aggregate.aggregate_by_sidecar(obs.filter("flag = 'R'"), sidecar(obs), ["v"], ("mean",), n_valid=True, unique=True)
    return got.select("healpix_id", micro("v_mean"), "v_n_valid", "n_sources")


@query(f"SELECT healpix_id, {sql.micro('avg(CASE WHEN abs(v) < 80000 THEN v END)', 'v_mean')}, {sql.micro('max(CASE WHEN abs(v) < 80000 THEN v END)', 'v_max')}, count(*) AS n_sources FROM ({CELLS_ALL}) GROUP BY healpix_id")
def agg_sentinel(spark, sf_dir):
    got = aggregate.aggregate_points(all_rows(spark, sf_dir), NSIDE, ["v"], ("mean", "max"), sentinel=80000.0)
    return stats_micro(got, ["v"], ("mean", "max"))


@query(f"SELECT count(DISTINCT s.source_id) AS sidecar_ids, count(DISTINCT o.source_id) AS common, count(DISTINCT CASE WHEN o.source_id IS NULL THEN s.source_id END) AS missing FROM ({SIDE}) s LEFT JOIN (SELECT source_id FROM ({sql.OBS}) WHERE flag <> 'N') o ON s.source_id = o.source_id")
def overlap_report(spark, sf_dir):
    obs = rows(spark, sf_dir)
    return aggregate.overlap(obs.filter("flag <> 'N'"), sidecar(obs)).select("sidecar_ids", "common", "missing")


#: Fine enough that cells are empty at any of the tables' sizes but the largest.
FINE = 64
FINE_CELLS = healpix.npix_of(FINE)
MEANS = f"SELECT healpix_id, avg(v) AS v_mean, count(*) AS n_sources FROM ({sql.cells(sql.ALL, FINE)}) GROUP BY healpix_id"


def mean_map(spark, sf_dir):
    return aggregate.aggregate_points(all_rows(spark, sf_dir), FINE, ["v"], ("mean",))


@query(f"SELECT r.range AS healpix_id, {sql.micro('v_mean')}, n_sources FROM range({FINE_CELLS}) r LEFT JOIN ({MEANS}) m ON m.healpix_id = r.range")
def densify(spark, sf_dir):
    return aggregate.densify(mean_map(spark, sf_dir), FINE).select("healpix_id", micro("v_mean"), "n_sources")


@query(f"SELECT r.range AS healpix_id, {sql.micro('CASE WHEN m.healpix_id IS NULL THEN -1e0 ELSE v_mean END', 'v_mean')}, CASE WHEN m.healpix_id IS NULL THEN -1 ELSE n_sources END AS n_sources FROM range({FINE_CELLS}) r LEFT JOIN ({MEANS}) m ON m.healpix_id = r.range")
def densify_fill(spark, sf_dir):
    return aggregate.densify(mean_map(spark, sf_dir), FINE, fill=-1).select("healpix_id", micro("v_mean"), "n_sources")


@query(f"SELECT healpix_id >> 4 AS healpix_id, count(v) AS n, {sql.micro('sum(v) / count(v)', 'mean')}, {sql.micro('min(v)', 'least')}, {sql.micro('max(v)', 'greatest')} FROM ({CELLS_ALL}) GROUP BY 1")
def resolution_rollup(spark, sf_dir):
    obs = all_rows(spark, sf_dir)
    fine = state.partial(state.long_values(healpix.with_cell(obs, "lon", "lat", NSIDE, known=True), ["v"]), sketches=False)
    coarse = aggregate.roll_up(fine, 2)
    return coarse.select("healpix_id", "n", micro(F.col("sum") / F.col("n"), "mean"), micro("min", "least"), micro("max", "greatest"))


@query(f"SELECT healpix_id, count(*) AS n_sources FROM ({CELLS_ALL}) GROUP BY 1 ORDER BY n_sources DESC, healpix_id LIMIT 10")
def topk_cells(spark, sf_dir):
    """The ten fullest cells; the limit is the feature."""
    got = aggregate.aggregate_points(all_rows(spark, sf_dir), NSIDE, ["v"], ("mean",)).select("healpix_id", "n_sources")
    return aggregate.top_cells(got, "n_sources", 10)


@query(f"SELECT flag, count(*) AS n, count(extra) AS n_extra FROM (SELECT flag, v AS extra FROM ({sql.ALL}) WHERE flag = 'A' UNION ALL SELECT flag, NULL FROM ({sql.ALL}) WHERE flag <> 'A') GROUP BY flag")
def union_batches(spark, sf_dir):
    obs = all_rows(spark, sf_dir)
    both = aggregate.union_batches(obs.filter("flag = 'A'").selectExpr("flag", "v AS extra"), obs.filter("flag <> 'A'").select("flag"))
    return both.groupBy("flag").agg(F.count(F.lit(1)).alias("n"), F.count("extra").alias("n_extra"))


# --- state -------------------------------------------------------------------------------------------------------------

STATE = f"SELECT healpix_id, count(v) AS v_n, sum(v) / count(v) AS v_mean, CASE WHEN count(v) > 1 THEN stddev_pop(v) END AS v_std, min(v) AS v_min, max(v) AS v_max FROM ({SIDE}) JOIN ({sql.OBS}) USING (source_id) GROUP BY healpix_id"


def three_batches(spark, sf_dir, sketches: bool = False) -> DataFrame:
    """The state after three batches; each batch takes the saved state of the one before."""
    folder = stream.checkpoint_folder(spark)
    obs = rows(spark, sf_dir).select("source_id", "lon", "lat", "v")
    obs.write.parquet(f"{folder}/observations")
    obs = spark.read.parquet(f"{folder}/observations")
    side = sidecar(obs)
    held = None
    for k in range(3):
        after = state.accumulate(obs.filter(F.pmod("source_id", F.lit(3)) == k), side, ["v"], held, sketches, check_unique=False)
        state.save_state(after, f"{folder}/state_{k}.parquet", GridMeta(NSIDE))
        held, _ = state.load_state(spark, f"{folder}/state_{k}.parquet")
    return held


@query(f"SELECT healpix_id, v_n AS n, {sql.micro('v_mean', 'mean')}, {sql.micro('v_min', 'least')}, {sql.micro('v_max', 'greatest')} FROM ({STATE})")
def accumulate_3_batches(spark, sf_dir):
    held = three_batches(spark, sf_dir)
    return held.select("healpix_id", "n", micro(state.mean_of(), "mean"), micro("min", "least"), micro("max", "greatest"))


@query(f"SELECT healpix_id, v_n, CASE WHEN v_n >= 2 THEN {sql.micro('v_mean', 'x').rpartition(' AS ')[0]} END AS v_mean, CASE WHEN v_n >= 2 THEN {sql.micro('v_min', 'x').rpartition(' AS ')[0]} END AS v_min, CASE WHEN v_n >= 2 THEN {sql.micro('v_max', 'x').rpartition(' AS ')[0]} END AS v_max, CASE WHEN v_n >= 2 THEN CAST(floor(v_std * 1e2 + 0.377e0) AS BIGINT) END AS v_std FROM ({STATE})")
def finalize_stats(spark, sf_dir):
    got = state.finalize(three_batches(spark, sf_dir), ["v"], min_count=2)
    return got.select("healpix_id", "v_n", micro("v_mean"), micro("v_min"), micro("v_max"), F.floor(F.col("v_std") * 1e2 + 0.377).cast("long").alias("v_std"))


@query(f"SELECT healpix_id, count(v) AS v_n, {', '.join(sql.micro(f'CASE WHEN count(v) <= 200 THEN quantile_disc(v, {p / 100}) END', f'v_p{p}') for p in (25, 50, 75))} FROM ({SIDE}) JOIN ({sql.OBS}) USING (source_id) GROUP BY healpix_id")
def finalize_percentiles_kll(spark, sf_dir):
    """Percentiles of merged sketches, shown for cells of up to 200 values, where they are exact; `percentile_ranks` checks
    the others by their ranks."""
    got = state.finalize(three_batches(spark, sf_dir, sketches=True), ["v"], [25, 50, 75])
    return got.select("healpix_id", "v_n", *[micro(F.when(F.col("v_n") <= 200, F.col(f"v_p{p}")), f"v_p{p}") for p in (25, 50, 75)])


@query(f"SELECT count(*) AS cells, sum(CASE WHEN a.n <> b.n THEN 1 ELSE 0 END) AS differ FROM (SELECT healpix_id, count(*) AS n FROM ({CELLS_ALL}) GROUP BY 1) a JOIN (SELECT healpix_id, sum(n) AS n FROM (SELECT healpix_id, source_id % 3 AS batch, count(*) AS n FROM ({CELLS_ALL}) GROUP BY 1, 2) GROUP BY 1) b USING (healpix_id)")
def state_vs_batch(spark, sf_dir):
    obs = all_rows(spark, sf_dir)
    cells = healpix.with_cell(obs, "lon", "lat", NSIDE, known=True)
    parts = [state.partial(state.long_values(cells.filter(F.pmod("source_id", F.lit(3)) == k), ["v"]), False) for k in range(3)]
    left = state.merged(*parts).select("healpix_id", "n")
    right = aggregate.aggregate_points(obs, NSIDE, ["v"], ("mean",))
    both = aggregate.compare_maps(left, right.withColumnRenamed("n_sources", "n"), "n")
    return both.agg(F.count(F.lit(1)).alias("cells"), F.sum(F.when(F.col("difference") != 0, 1).otherwise(0)).alias("differ"))


@query(f"SELECT healpix_id, count(v) AS n, {sql.micro('sum(v) / count(v)', 'mean')}, {sql.micro('min(v)', 'least')}, {sql.micro('max(v)', 'greatest')} FROM ({CELLS_ALL}) GROUP BY 1")
def stream_state(spark, sf_dir):
    """The state of a file stream, run until nothing is left; each batch leaves a version of it."""
    schema = spark.read.parquet(f"{sf_dir}/lineitem.parquet").schema
    items = stream.read_stream(spark, f"{sf_dir}/lineitem*.parquet", schema)
    folder = stream.checkpoint_folder(spark)
    stream.run_versions(placed(items), f"{folder}/states", NSIDE, ["v"], f"{folder}/progress", sketches=False).awaitTermination()
    return spark.read.parquet(str(stream.latest_version(f"{folder}/states"))).select("healpix_id", "n", micro(F.col("sum") / F.col("n"), "mean"), micro("min", "least"), micro("max", "greatest"))


# --- quality -----------------------------------------------------------------------------------------------------------


@query(f"SELECT count(*) AS total, count(CASE WHEN lon >= 0 AND lon < 180 THEN 1 END) AS kept FROM (SELECT lon * 2e0 - 360e0 AS lon FROM ({sql.ALL})) WHERE lon < 180 OR TRUE")
def geo_stats_counts(spark, sf_dir):
    moved = all_rows(spark, sf_dir).withColumn("lon", F.col("lon") * 2.0 - 360.0)
    kept = quality.geo_stats(moved.filter("true").withColumn("lon", F.when(F.col("lon") < 180, F.col("lon"))), convention="0_360")
    return kept.select("total", "kept")


@query(f"SELECT count(*) AS total, {', '.join(sql.micro(f'{f}({c})', f'{n}_{a}') for c, n in (('lon', 'lon'), ('lat', 'lat')) for f, a in (('min', 'min'), ('max', 'max'), ('avg', 'mean'), ('stddev_samp', 'std')))} FROM ({sql.ALL})")
def geo_stats(spark, sf_dir):
    got = quality.geo_stats(all_rows(spark, sf_dir), convention="0_360")
    return got.select("total", *[micro(f"{n}_{a}") for n in ("lon", "lat") for a in ("min", "max", "mean", "std")])


@query(f"SELECT cells, count(*) AS sources FROM (SELECT source_id, count(*) AS cells FROM ({BOX_CELLS}) GROUP BY 1) GROUP BY 1")
def cells_per_source(spark, sf_dir):
    return quality.cells_per_source(assign.assign_footprints(boxes(spark, sf_dir), NSIDE))


@query(f"SELECT count(*) AS n_rows, count(DISTINCT source_id) AS n_sources, count(DISTINCT healpix_id) AS n_cells, CAST((SELECT count(*) FROM (SELECT source_id FROM ({BOX_CELLS}) GROUP BY 1 HAVING count(*) > 1)) AS BIGINT) AS n_multi, count(CASE WHEN healpix_id >= 12288 THEN 1 END) AS n_outside FROM ({BOX_CELLS})")
def validate_sidecar_report(spark, sf_dir):
    got = quality.sidecar_report(assign.assign_footprints(boxes(spark, sf_dir), NSIDE), healpix.npix_of(NSIDE))
    return got.select("n_rows", "n_sources", "n_cells", "n_multi", "n_outside")


@query(f"SELECT count(*) AS n_rows, min(n) AS least_sources, max(n) AS greatest_sources, CAST(sum(n) AS BIGINT) AS all_sources, count(CASE WHEN n = 1 THEN 1 END) AS cells_of_1, count(CASE WHEN n BETWEEN 2 AND 5 THEN 1 END) AS cells_of_2_5, count(CASE WHEN n > 5 THEN 1 END) AS cells_of_more FROM (SELECT healpix_id, count(*) AS n FROM ({CELLS_ALL}) GROUP BY 1)")
def validate_aggregate_report(spark, sf_dir):
    got = quality.aggregate_report(aggregate.aggregate_points(all_rows(spark, sf_dir), NSIDE, ["v"], ("mean",)), healpix.npix_of(NSIDE))
    return got.select("n_rows", "least_sources", "greatest_sources", "all_sources", "cells_of_1", "cells_of_2_5", "cells_of_more")


@query(f"SELECT count(*) AS cells, count(CASE WHEN n >= 5 THEN 1 END) AS valid_cells, CAST(sum(n) AS BIGINT) AS observations FROM (SELECT healpix_id, count(*) AS n FROM ({CELLS_ALL}) GROUP BY 1)")
def coverage(spark, sf_dir):
    return quality.coverage(aggregate.aggregate_points(all_rows(spark, sf_dir), NSIDE, ["v"], ("mean",)), 5)


# --- geometry ----------------------------------------------------------------------------------------------------------

CORNER_COLUMNS = [f"{a}_{k}" for k in range(4) for a in ("lon", "lat")]


def corner_table(spark, nside: int) -> DataFrame:
    return healpix.with_corner_degrees(geo.grid_angles(observations.cells(spark, healpix.npix_of(nside)), nside))


@query(f"SELECT healpix_id, {', '.join(sql.micro(c) for c in CORNER_COLUMNS)} FROM ({sql.corners(16)})")
def cell_corners(spark, sf_dir):
    return corner_table(spark, 16).select("healpix_id", *[micro(c) for c in CORNER_COLUMNS])


@query(f"SELECT healpix_id, {sql.micro('v_mean')}, n_sources, {sql.micro('lon_0')}, {sql.micro('lat_0')} FROM ({MEANS}) JOIN ({sql.corners(FINE)}) USING (healpix_id)")
def geo_join_sparse(spark, sf_dir):
    got = corner_table(spark, FINE).join(mean_map(spark, sf_dir), "healpix_id")
    return got.select("healpix_id", micro("v_mean"), "n_sources", micro("lon_0"), micro("lat_0"))


#: A cell's corners, on one side of the seam; the ring ends where it starts.
UNWRAPPED = ", ".join(f"CASE WHEN greatest(lon_0, lon_1, lon_2, lon_3) - least(lon_0, lon_1, lon_2, lon_3) > 180 AND lon_{k} < greatest(lon_0, lon_1, lon_2, lon_3) - 180 THEN lon_{k} + 360 ELSE lon_{k} END AS x_{k}, lat_{k} AS y_{k}" for k in range(4))
RINGS = f"SELECT healpix_id, {UNWRAPPED} FROM ({sql.corners(FINE)})"


def ring_columns(shapes: DataFrame) -> DataFrame:
    """x_0..3 and y_0..3 of WKB polygons, read back, and the number of their vertices."""
    v = shapes.withColumn("v", geo.wkb_vertices("geometry"))
    corners = [micro(F.element_at("v", k + 1)[a], f"{b}_{k}") for k in range(4) for a, b in (("lon", "x"), ("lat", "y"))]
    return v.select("healpix_id", "v_mean", *corners, F.size("v").alias("n_vertices"))


@query(f"SELECT healpix_id, {sql.micro('v_mean')}, {', '.join(sql.micro(f'{a}_{k}') for k in range(4) for a in 'xy')}, 5 AS n_vertices FROM ({RINGS}) LEFT JOIN ({MEANS}) USING (healpix_id)")
def geo_join_dense(spark, sf_dir):
    """All cells' polygons, read back from WKB, with the map where it has a value."""
    got = ring_columns(geo.with_geometry(mean_map(spark, sf_dir), FINE, dense=True))
    return got.withColumn("v_mean", micro("v_mean"))


RASTER = "SELECT CAST(range // 72 AS INT) AS row, CAST(range % 72 AS INT) AS col, -180e0 + 360e0 * (range % 72) / 71e0 AS x, 90e0 - 180e0 * (range // 72) / 35e0 AS lat FROM range(2592)"


@query(f"SELECT row, col, {sql.micro('v_mean', 'value')} FROM ({sql.cells(f'SELECT row, col, CASE WHEN x < 0 THEN x + 360e0 ELSE x END AS lon, lat FROM ({RASTER})', FINE)}) LEFT JOIN ({MEANS}) USING (healpix_id)")
def raster_lookup(spark, sf_dir):
    return geo.raster(mean_map(spark, sf_dir), "v_mean", FINE, width=72, height=36).select("row", "col", micro("value"))


# --- display -----------------------------------------------------------------------------------------------------------

CLIP = f"SELECT healpix_id, greatest(least(v_mean, (SELECT quantile_cont(v_mean, 0.95) FROM ({MEANS}))), (SELECT quantile_cont(v_mean, 0.05) FROM ({MEANS}))) AS display FROM ({MEANS})"


@query(f"SELECT healpix_id, {sql.micro('display')} FROM ({CLIP})")
def viz_clip(spark, sf_dir):
    return display.clipped(mean_map(spark, sf_dir), "v_mean", 5.0).select("healpix_id", micro("display"))

from cellgrid.plans import more  # noqa: E402, F401  registers its queries here
