"""Maps: observations joined to their cells and reduced per cell."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.functions.healpix import npix_of, parent, with_cell
from cellgrid.operators.quantiles import medians_and_mads
from cellgrid.sources.observations import SENTINEL, cells, first_of_each, value

log = logging.getLogger(__name__)

MAD_TO_STD = 1.4826


def _median(sorted_values: Column) -> Column:
    """Of a sorted array without nulls: the middle, or the mean of the two in the middle."""
    n = F.size(sorted_values)
    low, high = F.floor((n + 1) / 2).cast("int"), F.floor(n / 2 + 1).cast("int")
    return F.when(n > 0, (F.element_at(sorted_values, low) + F.element_at(sorted_values, high)) / 2)


def mad_of(values: Column) -> Column:
    """The median distance from the median, of an array; missing and infinite values do not count."""
    ordered = F.array_sort(F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))))
    return _median(F.array_sort(F.transform(ordered, lambda v: F.abs(v - _median(ordered)))))


def _distance_from(column: str) -> Callable[[Column], Column]:
    return lambda v: F.abs(v - F.col(column))


#: Aggregates of a column without missing values, by name. Those that need a group's values share one sorted array.
AGGREGATES: dict[str, Callable[[str], Column]] = {
    "mean": F.avg,
    "median": F.median,
    "std": F.stddev_pop,
    "min": F.min,
    "max": F.max,
}
ROBUST = ("mad", "robust_std")
DEFAULT = ("mean", "median", "std", "robust_std")


def check_aggregates(names: list[str] | tuple[str, ...]) -> None:
    known = [*AGGREGATES, *ROBUST]
    if bad := [n for n in names if n not in known]:
        raise ValueError(f"unknown aggregate {bad}; there are {sorted(known)}")


#: Rows of a cell up to which its values are sorted as one array.
ARRAY_ROWS = 1 << 20


def reduce_cells(joined: DataFrame, columns: list[str], aggs: tuple[str, ...] = DEFAULT, min_count: int = 1, key: str = "healpix_id", n_valid: bool = False, array_rows: int = ARRAY_ROWS, counted: DataFrame | None = None) -> DataFrame:
    """One row a cell: {column}_{aggregate} and n_sources, the number of rows with or without a value. Cells of fewer
    than `min_count` rows keep their count but no values.

    One shuffle: mean, std, min and max are combined before it, and the robust ones are taken from one sorted array of
    the cell's values in the same pass. Where robust ones are asked for, cells of more than `array_rows` rows, which the
    rows' count by cell tells first, are reduced without gathering them, to the same values. counted: a table with as many
    rows in each cell, where there is one that is cheaper to count.
    """
    check_aggregates(aggs)
    if min_count < 1:
        log.warning("min_count %s hides no cell", min_count)
    rows = joined.filter(F.col(key).isNotNull()) if joined.schema[key].nullable else joined
    robust = any(a in (*ROBUST, "median") for a in aggs)
    crowded = (rows if counted is None else counted).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > array_rows).select(key) if robust else None
    if crowded is None or crowded.isEmpty():
        return _by_arrays(rows, columns, aggs, min_count, key, n_valid)
    apart = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    crowded = crowded.repartition(apart)
    few = _by_arrays(rows.join(crowded, key, "left_anti"), columns, aggs, min_count, key, n_valid)
    return few.unionByName(_by_ranks(rows.join(crowded, key, "left_semi"), columns, aggs, min_count, key, n_valid))


def _by_ranks(rows: DataFrame, columns: list[str], aggs: tuple[str, ...], min_count: int, key: str, n_valid: bool) -> DataFrame:
    """The same for cells of any number of rows."""
    plain = [(c, a) for c in columns for a in aggs if a in AGGREGATES and a != "median"]
    counts = [F.count(c).alias(f"{c}_n_valid") for c in columns] if n_valid else []
    out = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_sources"), *[AGGREGATES[a](c).alias(f"{c}_{a}") for c, a in plain], *counts)
    for c in columns:
        middle = medians_and_mads(rows, [key], c).select(key, F.col("median").alias(f"_{c}_m"), F.col("mad").alias(f"_{c}_d"))
        out = out.join(middle, key, "left")
    return _shown(out, columns, aggs, min_count, key, n_valid)


def _by_arrays(rows: DataFrame, columns: list[str], aggs: tuple[str, ...], min_count: int, key: str, n_valid: bool) -> DataFrame:
    robust = any(a in (*ROBUST, "median") for a in aggs)
    made = [F.count(F.lit(1)).alias("n_sources")]
    for c in columns:
        made += [AGGREGATES[a](c).alias(f"{c}_{a}") for a in aggs if a in AGGREGATES and a != "median"]
        made += [F.array_sort(F.collect_list(c)).alias(f"_{c}")] * robust  # nulls are not collected
        made += [F.count(c).alias(f"{c}_n_valid")] * n_valid
    out = rows.groupBy(key).agg(*made)
    for c in columns if robust else []:
        middle = f"_{c}_m"
        out = out.withColumn(middle, _median(F.col(f"_{c}")))
        if any(a in ROBUST for a in aggs):
            out = out.withColumn(f"_{c}_d", _median(F.array_sort(F.transform(f"_{c}", _distance_from(middle)))))
    return _shown(out, columns, aggs, min_count, key, n_valid)


def _shown(out: DataFrame, columns: list[str], aggs: tuple[str, ...], min_count: int, key: str, n_valid: bool) -> DataFrame:
    exprs = []
    for c in columns:
        for a in aggs:
            v = F.col(f"_{c}_m") if a == "median" else F.col(f"_{c}_d") if a == "mad" else F.col(f"_{c}_d") * MAD_TO_STD if a == "robust_std" else F.col(f"{c}_{a}")
            exprs.append(F.when(F.col("n_sources") >= min_count, v).alias(f"{c}_{a}"))
        exprs += [F.col(f"{c}_n_valid")] * n_valid
    return out.select(key, *exprs, "n_sources")


def aggregate_by_sidecar(obs: DataFrame, sidecar: DataFrame, columns: list[str], aggs: tuple[str, ...] | None = None, min_count: int = 1, source_id: str = "source_id", cell: str = "healpix_id", sentinel: float | None = SENTINEL, order: list[str] | None = None, require_rows: bool = True, n_valid: bool = False, unique: bool = False) -> DataFrame:
    """The map of `columns`. Every row of the sidecar counts, also without an observation (left join); of observations
    with equal ids the first counts, in the order of the rows or of the columns `order`. unique: the ids are known to be unique, which saves a
    sort. ValueError for an unknown aggregate or an empty sidecar, KeyError for a missing column."""
    aggs = tuple(aggs or DEFAULT)
    check_aggregates(aggs)
    if missing := [c for c in columns if c not in obs.columns]:
        raise KeyError(f"no column {missing} in {obs.columns}")
    if source_id not in obs.columns:
        raise KeyError(f"no column {source_id} in {obs.columns}")
    if require_rows and sidecar.isEmpty():
        raise ValueError("the sidecar is empty")
    kept = obs if unique else first_of_each(obs, source_id, order)
    values = kept.select(F.col(source_id).cast("long").alias("source_id"), *[value(c, sentinel).alias(c) for c in columns])
    side = sidecar.select(F.col("source_id").cast("long").alias("source_id"), F.col(cell).cast("long").alias(cell))
    return reduce_cells(side.join(values, "source_id", "left"), columns, aggs, min_count, cell, n_valid, counted=side)


def aggregate_points(obs: DataFrame, nside: int, columns: list[str], aggs: tuple[str, ...] | None = None, lon: str = "lon", lat: str = "lat", convention: str = "0_360", min_count: int = 1, sentinel: float | None = SENTINEL, order: str = "nested") -> DataFrame:
    """The same map straight from points, without the join: each point lies in one cell, so its values can go along."""
    from cellgrid.operators.assign import in_bounds
    from cellgrid.sources.observations import number

    rows = obs.select(number(lon).alias("_lo"), number(lat).alias("_la"), *[value(c, sentinel).alias(c) for c in columns]).filter(in_bounds(F.col("_lo"), F.col("_la"), convention))
    return reduce_cells(with_cell(rows, "_lo", "_la", nside, order, known=True).select("healpix_id", *columns), columns, tuple(aggs or DEFAULT), min_count)


def weighted_mean(obs: DataFrame, sidecar: DataFrame, columns: list[str], sentinel: float | None = SENTINEL) -> DataFrame:
    """Means by the sidecar's weights, and the weights' sum over all rows."""
    values = obs.select("source_id", *[value(c, sentinel).alias(c) for c in columns])
    rows = sidecar.join(values, "source_id", "left")
    return rows.groupBy("healpix_id").agg(*[F.try_divide(F.sum(F.col(c) * F.col("weight")), F.sum(F.when(F.col(c).isNotNull(), F.col("weight")))).alias(f"{c}_wmean") for c in columns], F.sum("weight").alias("weight_sum"))


def densify(cell_map: DataFrame, nside: int, key: str = "healpix_id", fill: float | None = None) -> DataFrame:
    """All cells of the grid; those without a row get nulls, or `fill`. Numbers beyond the grid vanish."""
    grid = cells(cell_map.sparkSession, npix_of(nside)).withColumnRenamed("healpix_id", key)
    marked = cell_map.withColumn("_there", F.lit(True))
    out = grid.join(marked, key, "left")
    if fill is not None:
        out = out.select(key, *[F.when(F.col("_there").isNull(), F.lit(fill).cast(cell_map.schema[c].dataType)).otherwise(F.col(c)).alias(c) for c in cell_map.columns if c != key])
    return out.drop("_there")


def roll_up(state: DataFrame, levels: int) -> DataFrame:
    """Counts and moments at a coarser resolution, from (healpix_id, n, sum, sum_sq, min, max)."""
    out = state.withColumn("healpix_id", parent("healpix_id", levels))
    return out.groupBy("healpix_id").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.sum("sum_sq").alias("sum_sq"), F.min("min").alias("min"), F.max("max").alias("max"))


def overlap(obs: DataFrame, sidecar: DataFrame) -> DataFrame:
    """One row: distinct source ids on both sides, in common, and in the sidecar only."""
    a, b = sidecar.select("source_id").distinct(), obs.select("source_id").distinct()
    seen = a.join(b.withColumn("_there", F.lit(True)), "source_id", "left")
    one = seen.agg(F.count(F.lit(1)).alias("sidecar_ids"), F.count("_there").alias("common"), F.count_if(F.col("_there").isNull()).alias("missing"))
    return one.join(b.agg(F.count(F.lit(1)).alias("observation_ids")))  # one row each


def top_cells(cell_map: DataFrame, by: str, k: int = 10) -> DataFrame:
    return cell_map.orderBy(F.col(by).desc_nulls_last(), "healpix_id").limit(k)


def union_batches(*batches: DataFrame) -> DataFrame:
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return out


def compare_maps(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Cells of both maps with the difference of a column."""
    return a.select("healpix_id", F.col(column).alias("a")).join(b.select("healpix_id", F.col(column).alias("b")), "healpix_id").withColumn("difference", F.col("a") - F.col("b"))
