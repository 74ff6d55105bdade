"""Mergeable state of a map: counts, sums, squares, extremes and a quantile sketch, by cell and column."""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.sources.metadata import GridMeta, Stage
from cellgrid.sources.observations import filter_text, first_of_each, number, write_table

KEYS = ("healpix_id", "column")
SCHEMA = "healpix_id long, column string, n long, sum double, sum_sq double, min double, max double, sketch binary"


def long_values(joined: DataFrame, columns: list[str]) -> DataFrame:
    """(healpix_id, column, v), a row for each value; missing and infinite ones are null."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), number(c).alias("v")) for c in columns])
    return joined.select("healpix_id", F.explode(pairs).alias("p")).select("healpix_id", "p.column", "p.v")


def partial(values: DataFrame, sketches: bool = True) -> DataFrame:
    """The state of some values; all parts are combined before the shuffle."""
    v = F.col("v")
    sketch = F.expr("kll_sketch_agg_double(v)") if sketches else F.lit(None).cast("binary")
    rows = values.filter("healpix_id IS NOT NULL") if values.schema["healpix_id"].nullable else values
    made = rows.groupBy(*KEYS).agg(F.count("v").alias("n"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("sum"), F.coalesce(F.sum(v * v), F.lit(0.0)).alias("sum_sq"), F.min("v").alias("min"), F.max("v").alias("max"), *([sketch.alias("sketch")] if sketches else []))
    return made if sketches else made.withColumn("sketch", sketch)


def merged(*states: DataFrame) -> DataFrame:
    """One state of several."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), states)
    sums = rows.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.sum("sum_sq").alias("sum_sq"), F.min("min").alias("min"), F.max("max").alias("max"), F.expr("kll_merge_agg_double(sketch) FILTER (WHERE sketch IS NOT NULL)").alias("sketch"))
    return sums


def accumulate(batch: DataFrame, sidecar: DataFrame, columns: list[str], state: DataFrame | None = None, sketches: bool = True, where: str | None = None, check_unique: bool = True) -> DataFrame:
    """The state after a batch of observations, joined to its sidecar. ValueError where ids of the batch repeat."""
    if missing := [c for c in (*columns, "source_id") if c not in batch.columns]:
        raise KeyError(f"no column {missing} in {batch.columns}")
    rows = batch.filter(F.expr(filter_text(where))) if where else batch
    if check_unique:
        if not rows.groupBy("source_id").count().filter("count > 1").isEmpty():
            raise ValueError("source ids repeat in the batch")
    side = sidecar.select(F.col("source_id").cast("long").alias("source_id"), F.col("healpix_id").cast("long").alias("healpix_id"))
    joined = side.join(rows.select(F.col("source_id").cast("long").alias("source_id"), *columns), "source_id")
    new = partial(long_values(joined, columns), sketches)
    return new if state is None else merged(state, new)


def mean_of() -> Column:
    return F.try_divide("sum", "n")


def std_of() -> Column:
    """Of the population, from sums; null for fewer than two values."""
    mean = F.col("sum") / F.col("n")
    return F.when(F.col("n") > 1, F.sqrt(F.greatest(F.lit(0.0), F.col("sum_sq") / F.col("n") - mean * mean)))


def finalize(state: DataFrame, columns: list[str], percentiles: list[float] | None = None, min_count: int = 1) -> DataFrame:
    """One row a cell: {column}_n, _mean, _std, _min, _max and _p{percentile}. Columns with fewer than `min_count` values
    in a cell keep their count only; a column never seen in a cell counts 0."""
    names = [f"p{int(p)}" for p in percentiles or []]
    if len(set(names)) != len(names):
        raise ValueError(f"percentiles {percentiles} share a column name")
    enough = F.col("n") >= min_count
    stats = {"n": F.col("n"), "mean": F.when(enough, mean_of()), "std": F.when(enough, std_of()), "min": F.when(enough, F.col("min")), "max": F.when(enough, F.col("max"))}
    for name, p in zip(names, percentiles or []):
        stats[name] = F.when(enough & (F.col("n") > 0) & F.col("sketch").isNotNull(), F.expr(f"kll_sketch_get_quantile_double(sketch, {p / 100}D)"))
    rows = state.select("healpix_id", "column", *[v.alias(k) for k, v in stats.items()])
    wide = rows.groupBy("healpix_id").agg(*[(F.coalesce(F.max(F.when(F.col("column") == c, F.col(k))), F.lit(0)) if k == "n" else F.max(F.when(F.col("column") == c, F.col(k)))).alias(f"{c}_{k}") for c in columns for k in stats])
    return wide


def progress(state: DataFrame, before: DataFrame | None = None) -> dict:
    """Cells, observations (the greatest count of any column in each cell), and how many a batch added."""
    count = lambda s: s.groupBy("healpix_id").agg(F.max("n").alias("n")).agg(F.count(F.lit(1)).alias("cells"), F.coalesce(F.sum("n"), F.lit(0)).alias("observations")).first().asDict()
    now = count(state)
    return now | {"added": now["observations"] - (count(before)["observations"] if before is not None else 0)}


def save_state(state: DataFrame, path: str | Path, meta: GridMeta, mode: str = "error") -> Path:
    meta = GridMeta(meta.nside, meta.order, meta.npix, meta.mode, meta.lon_convention, Stage.ACCUMULATOR, meta.extra)
    return write_table(state, path, meta, mode)


def load_state(spark, path: str | Path) -> tuple[DataFrame, GridMeta]:
    from cellgrid.sources.metadata import read_meta

    df = spark.read.parquet(str(path))
    return df, read_meta(path, df)


def to_json_form(state: DataFrame) -> DataFrame:
    """(healpix_id, stats_json): a cell's columns as one JSON object."""
    one = F.struct("n", "sum", "sum_sq", "min", "max")
    return state.groupBy("healpix_id").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("column", one.alias("s")))))).alias("stats_json"))


def from_json_form(rows: DataFrame) -> DataFrame:
    kind = "map<string, struct<n: long, sum: double, sum_sq: double, min: double, max: double>>"
    out = rows.select(F.col("healpix_id").cast("long").alias("healpix_id"), F.explode(F.from_json("stats_json", kind)).alias("column", "s"))
    return out.select("healpix_id", "column", "s.*", F.lit(None).cast("binary").alias("sketch"))


def keep_first(batch: DataFrame, order: list[str] | None = None) -> DataFrame:
    return first_of_each(batch, "source_id", order)
