"""Further queries, each beside its SQL: reading and writing, names and metadata, polygons, weights, statistics.

What a query checks on the driver (names, rules, metadata) becomes a small table; the SQL computes the same from the
same literals, or lists the values that the rules give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.functions import healpix
from cellgrid.operators import aggregate, assign, display, geo, psf, quality
from cellgrid.plans import oracle as sql
from cellgrid.plans.registry import BOX, BOX_CELLS, BOX_POINTS, CELLS_ALL, FINE, FINE_CELLS, MEANS, NSIDE, RINGS, SIDE, all_rows, boxes, corner_table, mean_map, micro, query, ring_columns, rows, sidecar, three_batches
from cellgrid.sources import metadata, observations, places
from cellgrid.sources.metadata import GridMeta, Stage
from cellgrid.streaming import state, stream


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    folder = stream.checkpoint_folder(spark)
    places.place(folder).mkdir(parents=True, exist_ok=True)
    return folder


def table(spark: SparkSession, lines: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(lines, schema)


def exact_sum(c: str) -> Column:
    """The sum of a column of doubles as the double next to it, whatever the order of the rows: of decimals with ten
    places. Where a value is none (NaN, infinite, 1e18 or more), the sum of the doubles."""
    held = F.col(c).try_cast("decimal(28,10)")
    return F.when(F.count(held) == F.count(c), F.sum(held).cast("double")).otherwise(F.sum(c))


def values(columns: str, lines: list[tuple]) -> str:
    """SQL of a table of literals."""
    text = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).upper() if isinstance(x, bool) else repr(x)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, line)) + ')' for line in lines)}) AS t({columns})"


# --- scans and files ---------------------------------------------------------------------------------------------------


@query(f"SELECT o_orderkey AS source_id, {sql.micro('o_totalprice')} FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000")
def scan_pushdown(spark, sf_dir):
    got = observations.read_observations(spark, f"{sf_dir}/orders.parquet", ["o_totalprice"], "o_orderstatus == 'F' & o_totalprice > 1000", "o_orderkey")
    return got.select(F.col("o_orderkey").alias("source_id"), micro("o_totalprice"))


@query("SELECT l_returnflag AS flag, count(*) AS n, sum(l_orderkey) AS keys, TRUE AS spread FROM lineitem GROUP BY 1")
def scan_partitioned(spark, sf_dir):
    """Rows dealt into a given number of partitions."""
    got = observations.read_observations(spark, f"{sf_dir}/lineitem.parquet", ["l_returnflag"], source_id="l_orderkey", partitions=7)
    spread = got.rdd.getNumPartitions() == 7
    return got.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").cast("decimal(38,0)").alias("keys")).withColumn("spread", F.lit(spread))


@query("SELECT 100 AS n, count(*) AS found FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) HAVING count(*) >= 100")
def head_rows(spark, sf_dir):
    """A head of 100 rows (the limit is the feature), all of which the table has."""
    everything = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber")
    first = observations.head(everything, 100).withColumn("_head", F.lit(1))
    whole = everything.distinct().agg(F.count(F.lit(1)).alias("found"))
    return first.agg(F.count(F.lit(1)).cast("int").alias("n")).withColumn("k", F.lit(1)).join(whole.withColumn("k", F.lit(1)), "k").select("n", "found")


@query("SELECT column_name AS name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'DATE' THEN 'date' ELSE 'other' END AS type, (SELECT count(*) FROM lineitem) AS n_rows FROM (DESCRIBE lineitem)")
def schema_and_footer(spark, sf_dir):
    """The columns as they are printed, and the number of rows that the footers tell without a scan."""
    path = f"{sf_dir}/lineitem.parquet"
    lines = [x.split(": ") for x in observations.schema_text(spark.read.parquet(path)).splitlines()]
    n = sum(places.footer(f)["rows"] for f in places.part_files(path))
    known = ("bigint", "int", "double", "string", "date")
    return table(spark, [(c, t if t in known else "other", n) for c, t in lines], "name string, type string, n_rows long")


@query("SELECT range * 2 AS id FROM range(50)")
def sampled_all(spark, sf_dir):
    """A sample of all rows is the table, of none is empty, and by key whole keys are taken."""
    ids = spark.range(50).selectExpr("id * 2 AS id")
    twice = ids.unionByName(ids)
    half = observations.sample(twice, 0.5, key="id")
    whole_keys = half.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n != 2")
    return observations.sample(ids, 1.0, key="id").unionByName(observations.sample(ids, 0.0, key="id")).unionByName(whole_keys.select("id"))


@query(f"SELECT 1 AS files, count(*) AS n, {sql.micro('sum(v)', 'v')} FROM ({sql.ALL})")
def write_single_file(spark, sf_dir):
    path = f"{scratch(spark)}/one.parquet"
    observations.write_table(all_rows(spark, sf_dir).select("v"), path, single=True)
    return spark.read.parquet(path).agg(F.lit(len(places.part_files(path))).alias("files"), F.count(F.lit(1)).alias("n"), micro(exact_sum("v"), "v"))


@query(f"SELECT flag, count(*) AS n, {sql.micro('sum(v)', 'v')} FROM ({sql.ALL}) GROUP BY flag")
def write_partitioned(spark, sf_dir):
    """One file a partition, and nothing lost."""
    path = f"{scratch(spark)}/many.parquet"
    observations.write_table(all_rows(spark, sf_dir).select("v", "flag").repartition(5), path)
    assert len(places.part_files(path)) == 5
    return spark.read.parquet(path).groupBy("flag").agg(F.count(F.lit(1)).alias("n"), micro(exact_sum("v"), "v"))


@query(values("name, type, n_rows", [("source_id", "bigint", 0), ("healpix_id", "bigint", 0), ("weight", "double", 0)]))
def write_typed_empty(spark, sf_dir):
    """An empty sidecar keeps its columns' types on disk."""
    path = f"{scratch(spark)}/empty.parquet"
    nothing = all_rows(spark, sf_dir).withColumn("lat", F.lit(1000.0))
    observations.write_table(sidecar(nothing), path, GridMeta(NSIDE, file_type=Stage.SIDECAR))
    got = spark.read.parquet(path)
    return table(spark, [(f.name, f.dataType.simpleString(), got.count()) for f in got.schema], "name string, type string, n_rows int")


@query(f"SELECT 'lineitem.parquet' AS file, count(*) AS n, {', '.join(sql.micro(f'{f}({c})', f'{c}_{f}') for c in ('l_extendedprice', 'l_quantity') for f in ('min', 'max'))} FROM lineitem")
def per_file_stats(spark, sf_dir):
    got = quality.file_stats(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_extendedprice", "l_quantity")
    named = got.select(F.regexp_extract("file", r"([^/]+\.parquet)", 1).alias("file"), F.col("rows").alias("n"), "lon_min", "lon_max", "lat_min", "lat_max")
    return named.select("file", "n", micro("lon_min", "l_extendedprice_min"), micro("lon_max", "l_extendedprice_max"), micro("lat_min", "l_quantity_min"), micro("lat_max", "l_quantity_max"))


# --- sidecars on disk --------------------------------------------------------------------------------------------------


@query(" UNION ALL ".join(f"SELECT {n} AS nside, 'fuzzy' AS mode, 'nested' AS \"order\", count(*) AS rows, count(DISTINCT healpix_id) AS cells, {n} = 16 AS found FROM ({sql.cells(sql.OBS, n)})" for n in (8, 16)))
def sidecar_discovery(spark, sf_dir):
    """Sidecars written under their names, listed with their counts; one looked up by its nside."""
    folder = scratch(spark)
    obs = rows(spark, sf_dir)
    for n in (8, 16):
        observations.write_table(sidecar(obs, n), metadata.sidecar_path(f"{folder}/obs.parquet", "fuzzy", n), GridMeta(n, mode="fuzzy", file_type=Stage.SIDECAR))
    found = str(observations.find_sidecar(f"{folder}/obs.parquet", 16))
    listed = observations.list_sidecars(f"{folder}/obs.parquet", spark=spark)
    return table(spark, [(r["nside"], r["mode"], r["order"], r["rows"], r["cells"], r["path"] == found) for r in listed], "nside int, mode string, `order` string, rows long, cells long, found boolean")


@query(f"SELECT healpix_id, {sql.micro('v_mean')}, n_sources, TRUE AS ordered FROM ({MEANS})")
def map_on_disk(spark, sf_dir):
    """A map written in the order of its cells, loaded with its report, as the only one of its folder."""
    folder = scratch(spark)
    observations.write_table(mean_map(spark, sf_dir).orderBy("healpix_id"), f"{folder}/obs-aggregated.nside-{FINE}.parquet", GridMeta(FINE), single=False)
    got, meta = observations.load_only_map(spark, folder)
    placed = observations.with_position(got)
    assert meta.nside == FINE and meta.npix == FINE_CELLS
    files = placed.groupBy("_file").agg(F.min("healpix_id").alias("a"), F.max("healpix_id").alias("b"), F.count(F.lit(1)).alias("n")).orderBy("_file").collect()
    ordered = all(x["b"] < y["a"] for x, y in zip(files, files[1:]))
    return got.select("healpix_id", micro("v_mean"), "n_sources").withColumn("ordered", F.lit(ordered))


@query(f"SELECT healpix_id, count(v) AS n, {sql.micro('sum(v) / count(v)', 'mean')}, {sql.micro('min(v)', 'least')}, {sql.micro('max(v)', 'greatest')} FROM ({SIDE}) JOIN ({sql.OBS}) USING (source_id) GROUP BY healpix_id")
def state_on_disk(spark, sf_dir):
    """A state saved and loaded between batches, and through its JSON form."""
    folder = scratch(spark)
    obs = rows(spark, sf_dir)
    side = sidecar(obs)
    meta = GridMeta(NSIDE, file_type=Stage.ACCUMULATOR)
    state.save_state(state.accumulate(obs.filter("source_id % 2 = 0"), side, ["v"], None, False), f"{folder}/a.parquet", meta)
    held, before = state.load_state(spark, f"{folder}/a.parquet")
    assert metadata.check_compatible(before, meta) == []
    after = state.accumulate(obs.filter("source_id % 2 = 1"), side, ["v"], held, False)
    again = state.from_json_form(state.to_json_form(after))
    return again.select("healpix_id", "n", micro(state.mean_of(), "mean"), micro("min", "least"), micro("max", "greatest"))


@query(f"SELECT count(DISTINCT healpix_id) AS cells, count(*) AS observations, count(CASE WHEN source_id % 3 = 2 THEN 1 END) AS added FROM ({SIDE})")
def state_progress(spark, sf_dir):
    obs = rows(spark, sf_dir)
    side = sidecar(obs)
    parts = [state.accumulate(obs.filter(where), side, ["v"], None, False) for where in ("source_id % 3 != 2", "source_id % 3 = 2")]
    got = state.progress(state.merged(*parts), parts[0])
    return table(spark, [(got["cells"], got["observations"], got["added"])], "cells long, observations long, added long")


@query(f"SELECT count(*) > count(DISTINCT source_id) AS repeats, FALSE AS first_repeats, TRUE AS empty_refused, TRUE AS name_refused, TRUE AS column_refused FROM ({sql.ALL})")
def refusals(spark, sf_dir):
    """What is refused: repeated ids in a batch, an empty sidecar, an unknown aggregate, a missing column."""

    def refused(kind, f) -> bool:
        try:
            f()
        except kind:
            return True
        return False

    everything = all_rows(spark, sf_dir)
    first = rows(spark, sf_dir)
    side = sidecar(first)
    line = (
        refused(ValueError, lambda: state.accumulate(everything, side, ["v"], None, False)),
        refused(ValueError, lambda: state.accumulate(first, side, ["v"], None, False)),
        refused(ValueError, lambda: aggregate.aggregate_by_sidecar(first, side.limit(0), ["v"])),
        refused(ValueError, lambda: aggregate.aggregate_by_sidecar(first, side, ["v"], ("mode",))),
        refused(KeyError, lambda: aggregate.aggregate_by_sidecar(first, side, ["nothing"])),
    )
    return table(spark, [line], "repeats boolean, first_repeats boolean, empty_refused boolean, name_refused boolean, column_refused boolean")


# --- names, rules and metadata -----------------------------------------------------------------------------------------

NAMES = [
    ("obs.cell-healpix_assignment-fuzzy_nside-64_order-nested.parquet", 64, "fuzzy", "nested"),
    ("a_NSIDE=128.parquet", 128, None, None),
    ("a-nside_32_b.nside-32.parquet", 32, None, None),
    ("a.nside-8_nside-16.parquet", None, None, None),
    ("myside-16.parquet", None, None, None),
    ("nside512.parquet", 512, None, None),
    ("x.assignment-strict_order-ring.parquet", None, "strict", "ring"),
]


@query(f"SELECT name, nside, mode, \"order\", regexp_matches(name, '(?i)(^|[._-])nside') AS tells FROM ({values('name, nside, mode, \"order\"', NAMES)})")
def names_of_files(spark, sf_dir):
    """nside, mode and order that a file's name tells; two different nsides tell none."""
    lines = [(n, metadata.nside_in_name(n), metadata.name_fields(n).get("mode"), metadata.name_fields(n).get("order")) for n, *_ in NAMES]
    return table(spark, lines, "name string, nside int, mode string, `order` string").withColumn("tells", F.col("name").rlike(r"(?i)(^|[._-])nside"))


COLUMN_SETS = [
    ("lon,lat,v", "lon", "lat", "lon", "lat"),
    ("spot_lon,spot_lat", "spot_lon", "spot_lat", "spot_lon", "spot_lat"),
    ("Longitude_deg,Latitude_deg", "Longitude_deg", "Latitude_deg", None, None),
    ("X,Y", "X", "Y", "X", "Y"),
    ("easting,northing", "easting", "northing", None, None),
    ("a,b", None, None, None, None),
]


@query(values("columns, lon, lat, exact_lon, exact_lat", COLUMN_SETS))
def names_of_coordinates(spark, sf_dir):
    """Coordinate columns by parts of their names, and by whole names."""

    def exact(names: list[str]) -> tuple[str | None, str | None]:
        try:
            return observations.exact_lonlat(names)
        except ValueError:
            return None, None

    lines = [(c, *observations.detect_lonlat(c.split(",")), *exact(c.split(","))) for c, *_ in COLUMN_SETS]
    return table(spark, lines, "columns string, lon string, lat string, exact_lon string, exact_lat string")


@query("SELECT range AS n, range > 0 AND range & (range - 1) = 0 AS fits, CASE WHEN range > 0 AND range & (range - 1) = 0 THEN 12 * range * range END AS npix, CASE WHEN range > 0 AND range & (range - 1) = 0 THEN CAST(floor(degrees(2e0 * sqrt(4e0 * pi() / (12e0 * range * range) / pi())) * 1e4 + 0.377e0) AS BIGINT) END AS diameter, CASE WHEN range > 0 AND range & (range - 1) = 0 THEN range END AS back FROM range(0, 70)")
def numbers_of_cells(spark, sf_dir):
    """Which numbers are resolutions, their cells, the cells' diameter, and the way back from the number of cells."""
    import math

    lines = []
    for n in range(70):
        fits = healpix.is_nside(n)
        npix = healpix.npix_of(n) if fits else None
        lines.append((n, fits, npix, math.floor(healpix.cell_diameter(n) * 1e4 + 0.377) if fits else None, healpix.nside_of(npix) if fits else None))
    return table(spark, lines, "n long, fits boolean, npix long, diameter long, back long")


RECORDS = [("flat", 32, "nested", 12288, "fuzzy", "0_360", "sidecar", True), ("nested", 16, "ring", 3072, "strict", "-180_180", "aggregate", False), ("below", 8, "nested", 768, "fuzzy", "-180_180", "accumulator", True), ("column", 4, "nested", 192, "strict", "0_360", "finalize", True)]


@query(values("form, nside, \"order\", npix, mode, convention, stage, nest", RECORDS))
def metadata_forms(spark, sf_dir):
    """Records read from a flat form, the nested form, that below sidecar_metadata, and a cell column's metadata in
    Parquet; each written as JSON and read again."""
    folder = scratch(spark)
    forms = {
        "flat": {"nside": 32, "mode": "fuzzy", "file_type": "sidecar"},
        "nested": {"processing": {"stage": "aggregate"}, "healpix": {"nside": 16, "order": "ring", "mode": "strict"}, "coordinates": {"lon_convention": "minus_plus180"}},
        "below": {"processing": {"stage": "accumulator"}, "sidecar_metadata": {"healpix": {"nside": 8, "mode": "fuzzy"}, "coordinates": {"lon_convention": "-180_180"}}},
    }
    lines = []
    for form, d in forms.items():
        path = f"{folder}/{form}.parquet"
        metadata.write_json(GridMeta.from_dict(d), metadata.companion(path))
        assert metadata.check_file_type(path, GridMeta.from_dict(d).file_type) and not metadata.check_file_type(path, Stage.GEOSPATIAL)
        lines.append((form, metadata.read_meta(path)))
    own = GridMeta(4, mode="strict", file_type=Stage.FINALIZE)
    path = f"{folder}/column.parquet"
    own.on_columns(observations.cells(spark, 192)).write.parquet(path)
    lines.append(("column", metadata.read_meta(path, spark.read.parquet(path))))
    return table(spark, [(f, m.nside, m.order, m.npix, m.mode, m.lon_convention, m.file_type.value, m.nest) for f, m in lines], "form string, nside int, `order` string, npix int, mode string, convention string, stage string, nest boolean")


CUTOFFS = [("5", 5.0, 95.0), ("2,90", 2.0, 90.0), ("0", 0.0, 100.0), ("60", None, None), ("50,20", None, None), ("-1,5", None, None), ("1,101", None, None)]


@query(values("cutoff, lo, hi", CUTOFFS))
def cutoff_rules(spark, sf_dir):
    def pair(text: str) -> tuple[float | None, float | None]:
        parts = [float(x) for x in text.split(",")]
        try:
            return display.check_cutoff(parts[0] if len(parts) == 1 else tuple(parts))
        except ValueError:
            return None, None

    return table(spark, [(c, *pair(c)) for c, *_ in CUTOFFS], "cutoff string, lo double, hi double")


# --- positions ---------------------------------------------------------------------------------------------------------


@query(f"SELECT source_id, {sql.micro('x - 360e0 * floor(x / 360e0)', 'east')}, {sql.micro('(x + 180e0) - 360e0 * floor((x + 180e0) / 360e0) - 180e0', 'centred')} FROM (SELECT source_id, lon * 3e0 - 540e0 AS x FROM ({sql.ALL}))")
def longitudes(spark, sf_dir):
    far = all_rows(spark, sf_dir).withColumn("x", F.col("lon") * 3.0 - 540.0)
    return far.select("source_id", micro(healpix.normal_lon(F.col("x"), "0_360"), "east"), micro(healpix.normal_lon(F.col("x"), "-180_180"), "centred"))


@query(f"SELECT source_id, {sql.micro('90e0 - degrees(acos(greatest(-1e0, least(1e0, sin(radians(lat))))))', 'lat')}, {sql.micro('CASE WHEN p < 0 THEN degrees(p + 6.283185307179586e0) ELSE degrees(p) END', 'lon')} FROM (SELECT *, atan2(cos(radians(lat)) * sin(radians(lon)), cos(radians(lat)) * cos(radians(lon))) AS p FROM ({sql.ALL}))")
def vectors_to_angles(spark, sf_dir):
    """Unit vectors back to positions."""
    at = all_rows(spark, sf_dir)
    xyz = at.selectExpr("source_id", "cos(radians(lat)) * cos(radians(lon)) AS x", "cos(radians(lat)) * sin(radians(lon)) AS y", "sin(radians(lat)) AS z")
    got = healpix.sphere_angles(xyz)
    return got.select("source_id", micro(90.0 - F.degrees("theta"), "lat"), micro(F.degrees("phi"), "lon"))


@query(f"SELECT source_id, healpix_id, ring_id, healpix_id AS back, healpix_id >> 4 AS coarse FROM (SELECT source_id, healpix_id, ring_id FROM ({sql.cells(sql.OBS, NSIDE)}) JOIN (SELECT source_id, ring_id FROM ({sql.ring(sql.faces(sql.OBS, NSIDE), NSIDE)})) USING (source_id))")
def numberings(spark, sf_dir):
    """Nested to ring and back, and the parents two levels up."""
    side = sidecar(rows(spark, sf_dir)).select("source_id", "healpix_id")
    ringed = healpix.nested_to_ring(side, "healpix_id", NSIDE, "ring_id")
    return healpix.ring_to_nested(ringed, "ring_id", NSIDE, "back").withColumn("coarse", healpix.parent("healpix_id", 2))


@query(f"SELECT sum(CASE WHEN lon0 - 1.3e0 >= -180 AND lon0 + 1.3e0 <= 360 AND lat0 - 1.1e0 >= -90 AND lat0 + 1.1e0 <= 90 THEN 1 ELSE 0 END)::BIGINT AS valid, count(*) AS n FROM (SELECT lon AS lon0, lat AS lat0 FROM ({sql.OBS}))")
def boxes_valid(spark, sf_dir):
    return boxes(spark, sf_dir).agg(F.count_if(geo.valid_box()).alias("valid"), F.count(F.lit(1)).alias("n"))


#: Boxes of observations moved to the antimeridian, in longitudes from -180 to 180, and the points that a repair adds.
SEAM_BOX = f"SELECT source_id, lat AS lat0, CASE WHEN lon < 180 THEN 178e0 + lon / 90e0 ELSE lon / 90e0 - 182e0 END AS lon0 FROM ({sql.OBS}) WHERE lat BETWEEN -80 AND 80"
SEAM_WRAP = "CASE WHEN {x} >= 180e0 THEN {x} - 360e0 WHEN {x} < -180e0 THEN {x} + 360e0 ELSE {x} END"
SEAM_CORNERS = f"SELECT source_id, k, {SEAM_WRAP.format(x='x')} AS lon, lat FROM (SELECT source_id, k, lon0 + CASE WHEN k IN (0, 3, 4) THEN -1.3e0 ELSE 1.3e0 END AS x, lat0 + CASE WHEN k IN (0, 1, 4) THEN -1.1e0 ELSE 1.1e0 END AS lat FROM ({SEAM_BOX}), (SELECT unnest([0, 1, 2, 3, 4]) AS k))"
SEAM_EDGES = f"SELECT * FROM (SELECT source_id, k, lon, lat, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM ({SEAM_CORNERS}) WINDOW w AS (PARTITION BY source_id ORDER BY k)) WHERE abs(lon2 - lon) > 180"
SEAM_ADDED = f"SELECT source_id, side AS lon, lat + (lat2 - lat) * ((CASE WHEN lon2 < lon THEN 180e0 ELSE -180e0 END) - lon) / (CASE WHEN lon2 < lon THEN lon2 - lon + 360e0 ELSE lon2 - lon - 360e0 END) AS lat FROM ({SEAM_EDGES}), (SELECT unnest([180e0, -180e0]) AS side)"
SEAM_POINTS = f"SELECT source_id, CASE WHEN lon < 0 THEN lon + 360e0 ELSE lon END AS lon, lat FROM (SELECT source_id, lon, lat FROM ({SEAM_CORNERS}) UNION ALL ({SEAM_ADDED}))"


@query(f"SELECT DISTINCT source_id, healpix_id FROM ({sql.cells(SEAM_POINTS, NSIDE)})")
def footprint_antimeridian(spark, sf_dir):
    """Boxes over the antimeridian, closed rings with the crossing points added."""
    moved = rows(spark, sf_dir).filter("lat BETWEEN -80 AND 80").withColumn("lon0", F.when(F.col("lon") < 180, 178.0 + F.col("lon") / 90.0).otherwise(F.col("lon") / 90.0 - 182.0))

    def vertex(x: float, y: float):
        e = F.col("lon0") + x
        return F.struct(F.when(e >= 180.0, e - 360.0).when(e < -180.0, e + 360.0).otherwise(e).alias("lon"), (F.col("lat") + y).alias("lat"), F.lit(0).alias("ring"))

    shapes = moved.select("source_id", F.array(vertex(-1.3, -1.1), vertex(1.3, -1.1), vertex(1.3, 1.1), vertex(-1.3, 1.1), vertex(-1.3, -1.1)).alias("vertices"))
    return assign.assign_footprints(shapes, NSIDE, convention="-180_180", fix_antimeridian=True).select("source_id", "healpix_id")


# --- polygons ----------------------------------------------------------------------------------------------------------


@query(f"SELECT healpix_id, {sql.micro('v_mean')}, {', '.join(sql.micro(f'{a}_{k}') for k in range(4) for a in 'xy')}, 5 AS n_vertices, 'geometry' AS named FROM ({RINGS}) JOIN ({MEANS}) USING (healpix_id)")
def geoparquet_on_disk(spark, sf_dir):
    """A map as GeoParquet and back: the description comes from the footers, the corners from WKB."""
    path = geo.to_geoparquet(mean_map(spark, sf_dir), f"{scratch(spark)}/map.parquet", FINE)
    got, found = places.read_geoparquet(spark, path)
    return ring_columns(got.drop("vertices")).withColumn("v_mean", micro("v_mean")).withColumn("named", F.lit(found["primary_column"]))


@query(f"SELECT healpix_id, {sql.micro('v_mean')}, n_sources, {sql.micro('lon_0')}, {sql.micro('lat_2')} FROM ({MEANS}) LEFT JOIN ({sql.corners(FINE)}) USING (healpix_id)")
def map_left_geometry(spark, sf_dir):
    got = mean_map(spark, sf_dir).join(corner_table(spark, FINE), "healpix_id", "left")
    return got.select("healpix_id", micro("v_mean"), "n_sources", micro("lon_0"), micro("lat_2"))


@query(f"SELECT range AS healpix_id FROM range({FINE_CELLS}) ANTI JOIN (SELECT healpix_id FROM ({MEANS})) m ON m.healpix_id = range")
def cells_without_data(spark, sf_dir):
    return observations.cells(spark, FINE_CELLS).join(mean_map(spark, sf_dir), "healpix_id", "left_anti")


@query(f"SELECT healpix_id, {', '.join(sql.micro(f'{a}_{k}') for k in range(4) for a in ('lon', 'lat'))}, TRUE AS whole, TRUE AS refused FROM ({sql.corners(8)}) WHERE healpix_id % 3 = 0")
def grid_cache(spark, sf_dir):
    """A grid saved in the cache, verified, and the only source of some cells' corners; a grid that is not there is
    refused."""
    folder = scratch(spark)
    geo.manage_cache(spark, "generate", [8], folder=folder)
    whole = geo.manage_cache(spark, "verify", [8], folder=folder)[0]["valid"]
    try:
        geo.cell_polygons(spark, 16, cache="require", cache_dir=folder)
        refused = False
    except ValueError:
        refused = True
    got = geo.cell_polygons(spark, 8, ids=observations.cells(spark, 768).filter("healpix_id % 3 = 0"), cache="require", cache_dir=folder, fix_antimeridian=False)
    return got.select("healpix_id", *[micro(f"{a}_{k}") for k in range(4) for a in ("lon", "lat")]).withColumns({"whole": F.lit(whole), "refused": F.lit(refused)})


@query(values("stage, refused", [("sidecar", True), ("accumulator", True), ("aggregate", False), ("finalize", False), ("geospatial", True)]))
def stage_guard(spark, sf_dir):
    """Which files are taken for a map with polygons."""
    folder, lines = scratch(spark), []
    for stage in Stage:
        path = f"{folder}/{stage.value}.parquet"
        metadata.write_json(GridMeta(2, file_type=stage), metadata.companion(path))
        try:
            geo.check_map_input(path)
            lines.append((stage.value, False))
        except ValueError:
            lines.append((stage.value, True))
    return table(spark, lines, "stage string, refused boolean")


# --- weights -----------------------------------------------------------------------------------------------------------


def _shoelace(points: list[tuple[str, str]]) -> tuple[str, str]:
    """SQL of a polygon's centroid."""
    edges = list(zip(points, [*points[1:], points[0]]))
    cross = [f"(({a[0]}) * ({b[1]}) - ({b[0]}) * ({a[1]}))" for a, b in edges]
    area = " + ".join(cross)
    return tuple(f"(({' + '.join(f'{c} * (({a[i]}) + ({b[i]}))' for c, (a, b) in zip(cross, edges))}) / (({area}) * 3e0))" for i in range(2))


CELL_X, CELL_Y = _shoelace([(f"x_{k}", f"y_{k}") for k in range(4)])
CENTROIDS = f"SELECT healpix_id, {CELL_X} AS cx, {CELL_Y} AS cy FROM (SELECT healpix_id, {', '.join(f'CASE WHEN greatest(lon_0, lon_1, lon_2, lon_3) - least(lon_0, lon_1, lon_2, lon_3) > 180 AND lon_{k} < greatest(lon_0, lon_1, lon_2, lon_3) - 180 THEN lon_{k} + 360 ELSE lon_{k} END AS x_{k}, lat_{k} AS y_{k}' for k in range(4))} FROM ({sql.corners(NSIDE)}))"
SHIFT = "(lon - cx + 180e0 - 360e0 * floor((lon - cx + 180e0) / 360e0) - 180e0)"
BOX_WEIGHTS = f"SELECT source_id, healpix_id, exp(({SHIFT} * {SHIFT} + (lat - cy) * (lat - cy)) * (-0.5e0 / (1.5e0 * 1.5e0))) AS weight FROM ({BOX_CELLS}) JOIN ({sql.OBS}) USING (source_id) JOIN ({CENTROIDS}) USING (healpix_id)"


def _thousandths(c: str):
    return F.floor(F.col(c) * 1e3 + 0.377).cast("long").alias(c)


@query(f"SELECT source_id, healpix_id, CAST(floor(weight * 1e3 + 0.377e0) AS BIGINT) AS weight FROM ({BOX_WEIGHTS})")
def footprint_weights(spark, sf_dir):
    """Gaussian weights of footprints' cells by the distance of the centroids, made with the assignment."""
    got = assign.assign_footprints(boxes(spark, sf_dir), NSIDE, data=psf.gaussian(1.5))
    return got.select("source_id", "healpix_id", _thousandths("weight"))


@query(f"SELECT source_id, healpix_id, CAST(floor(weight / nullif(sum(weight) OVER (PARTITION BY healpix_id), 0) * 1e3 + 0.377e0) AS BIGINT) AS weight FROM (SELECT source_id, healpix_id, exp(((lon - cx) * (lon - cx) + (lat - cy) * (lat - cy)) * (-0.5e0 / (1.5e0 * 1.5e0))) AS weight FROM ({SIDE}) JOIN ({sql.OBS}) USING (source_id) JOIN (SELECT healpix_id, lon_2 AS cx, lat_2 AS cy FROM ({sql.corners(NSIDE)})) USING (healpix_id))")
def weights_attached(spark, sf_dir):
    """Weights added to a sidecar from tables of positions, normalised in each cell."""
    obs = rows(spark, sf_dir)
    at = corner_table(spark, NSIDE).select("healpix_id", F.col("lon_2").alias("lon"), F.col("lat_2").alias("lat"))
    return psf.weighted(sidecar(obs), obs, at, psf.gaussian(1.5)).select("source_id", "healpix_id", _thousandths("weight"))


@query(f"SELECT count(*) AS n_rows, CAST(floor(min(s) * 1e3 + 0.377e0) AS BIGINT) AS least_weight_sum, CAST(floor(max(s) * 1e3 + 0.377e0) AS BIGINT) AS greatest_weight_sum, min(source_id) + count(*) - 1 = max(source_id) AS contiguous FROM (SELECT source_id, sum(weight) AS s FROM ({BOX_WEIGHTS}) GROUP BY 1)")
def weight_sums(spark, sf_dir):
    """The range of the sources' weight sums, and whether their ids have gaps."""
    got = quality.sidecar_report(assign.assign_footprints(boxes(spark, sf_dir), NSIDE, data=psf.gaussian(1.5)), healpix.npix_of(NSIDE))
    return got.select(F.col("n_sources").alias("n_rows"), _thousandths("least_weight_sum"), _thousandths("greatest_weight_sum"), "contiguous")


# --- statistics --------------------------------------------------------------------------------------------------------

CENTRES = f"SELECT source_id, avg(lon) AS x, avg(lat) AS y FROM ({BOX_POINTS.format(box=BOX.format(src=sql.OBS))}) GROUP BY 1"


@query(f"SELECT count(*) AS total, {', '.join(sql.micro(f'{f}({c})', f'{n}_{a}') for c, n in (('x', 'lon'), ('y', 'lat')) for f, a in (('min', 'min'), ('max', 'max'), ('avg', 'mean')))} FROM ({CENTRES})")
def footprint_centres(spark, sf_dir):
    """Statistics of the footprints' centres, over all of them."""
    whole = boxes(spark, sf_dir).filter(F.forall("vertices", lambda p: p["lon"].between(0.0, 360.0) & p["lat"].between(-90.0, 90.0)))
    got = quality.footprint_stats(whole, 1 << 30)
    return got.select("total", *[micro(f"{n}_{a}") for n in ("lon", "lat") for a in ("min", "max", "mean")])


@query("SELECT 0 AS beyond, count(*) AS cells FROM (SELECT DISTINCT healpix_id FROM (" + SIDE + "))")
def percentile_ranks(spark, sf_dir):
    """How many cells have a sketch's percentile whose rank among the cell's values is off by over 0.05 (or one value)."""
    obs = rows(spark, sf_dir)
    got = state.finalize(three_batches(spark, sf_dir, sketches=True), ["v"], [25, 50, 75])
    each = sidecar(obs).join(obs.select("source_id", "v"), "source_id").join(got, "healpix_id")
    ranks = each.groupBy("healpix_id").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("v") < F.col(f"v_p{p}")).alias(f"a{p}") for p in (25, 50, 75)], *[F.count_if(F.col("v") <= F.col(f"v_p{p}")).alias(f"b{p}") for p in (25, 50, 75)])
    off = [F.greatest(F.col(f"a{p}") - F.col("n") * p / 100, F.col("n") * p / 100 - F.col(f"b{p}")) > F.greatest(F.lit(1.0), F.col("n") * 0.05) for p in (25, 50, 75)]
    return ranks.agg(F.count_if(off[0] | off[1] | off[2]).cast("int").alias("beyond"), F.count(F.lit(1)).alias("cells"))


EDGES = f"SELECT min(v_mean) AS lo, max(v_mean) AS hi, count(*) AS n FROM ({MEANS})"
BINNED = f"SELECT healpix_id, v_mean, lo, (hi - lo) / 256e0 AS width, n, least(255, CAST(floor((v_mean - lo) / ((hi - lo) / 256e0)) AS INT)) AS bin FROM ({MEANS}), ({EDGES})"
CDF = f"SELECT b AS bin, sum(coalesce(m, 0)) OVER (ORDER BY b) / (SELECT n FROM ({EDGES}))::DOUBLE AS f FROM (SELECT CAST(range AS INT) AS b FROM range(256)) LEFT JOIN (SELECT bin, count(*) AS m FROM ({BINNED}) GROUP BY 1) ON bin = b"
EQUALISED = f"SELECT healpix_id, f + (coalesce(g, f) - f) * least(greatest(spot - place, 0e0), 1e0) AS display FROM (SELECT healpix_id, (v_mean - lo) / width - 0.5e0 AS spot, least(255, greatest(0, CAST(floor((v_mean - lo) / width - 0.5e0) AS INT))) AS place FROM ({BINNED})) JOIN (SELECT bin, f, lead(f) OVER (ORDER BY bin) AS g FROM ({CDF})) ON bin = place"


@query(f"SELECT healpix_id, CAST(floor(display * 1e4 + 0.377e0) AS BIGINT) AS display FROM ({EQUALISED})")
def viz_equalize(spark, sf_dir):
    return display.equalised(mean_map(spark, sf_dir), "v_mean").select("healpix_id", micro("display"))
