"""Weights by point spread functions, and their normalisation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Spread = Callable[[Column, Column], Column]
COMBINE: dict[str, Callable[[Column, Column], Column]] = {
    "multiply": lambda a, b: a * b,
    "sum": lambda a, b: a + b,
    "min": F.least,
    "max": F.greatest,
}


def gaussian(sigma: float | None) -> Spread:
    """exp(-r^2 / 2 sigma^2); ValueError on use without a sigma."""

    def spread(dx: Column, dy: Column) -> Column:
        if sigma is None:
            raise ValueError("a Gaussian needs a sigma")
        return F.exp((dx * dx + dy * dy) * F.lit(-0.5 / (sigma * sigma)))

    return spread


def spread_function(kind: str = "none", sigma: float | None = None) -> Spread:
    """By name: none (always 1) or gaussian."""
    if kind in ("none", None):
        return lambda dx, dy: F.lit(1.0)
    if kind == "gaussian":
        return gaussian(sigma)
    raise ValueError(f"point spread function must be none or gaussian, not {kind!r}")


def pair_weight(dx: Column, dy: Column, data: Spread | None = None, cell: Spread | None = None, combine: str = "multiply") -> Column:
    """The weight of a source and a cell from the distance of their centres; an absent function counts 1."""
    if combine not in COMBINE:
        raise ValueError(f"combine must be one of {sorted(COMBINE)}, not {combine!r}")
    one = lambda x, y: F.lit(1.0)
    return COMBINE[combine]((data or one)(dx, dy), (cell or one)(dx, dy)).cast("double")


def normalised(sidecar: DataFrame, by: str = "cell") -> DataFrame:
    """Weights that sum to one within each cell, or each source; rows without a key have no weight. The sums are combined
    before they are shuffled and then joined, so that a crowded cell is never gathered in a task; they pass an exchange of
    their own, as only then Spark splits the rows of such a cell in the join."""
    key = {"cell": "healpix_id", "source": "source_id"}[by]
    sums = sidecar.groupBy(key).agg(F.sum("weight").alias("_sum"))
    apart = int(sidecar.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sidecar.join(sums.repartition(apart), key, "left").withColumn("weight", F.try_divide("weight", "_sum")).select(*sidecar.columns)


def weighted(sidecar: DataFrame, sources: DataFrame, cells: DataFrame, data: Spread | None = None, cell: Spread | None = None, combine: str = "multiply", normalise: bool = True) -> DataFrame:
    """A sidecar with weights. sources: (source_id, lon, lat), cells: (healpix_id, lon, lat), the centres."""
    s = sources.select("source_id", F.col("lon").alias("_sx"), F.col("lat").alias("_sy"))
    c = cells.select("healpix_id", F.col("lon").alias("_cx"), F.col("lat").alias("_cy"))
    rows = sidecar.drop("weight").join(s, "source_id").join(c, "healpix_id")
    rows = rows.select("source_id", "healpix_id", pair_weight(F.col("_sx") - F.col("_cx"), F.col("_sy") - F.col("_cy"), data, cell, combine).alias("weight"))
    return normalised(rows) if normalise else rows
