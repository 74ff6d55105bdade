"""Maps made ready for display: histogram equalisation and percentile clipping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 256


def check_cutoff(cutoff: float | tuple[float, float] | None) -> tuple[float, float] | None:
    """A single p means (p, 100 - p); ValueError for values out of 0..100 or out of order."""
    if cutoff is None:
        return None
    pair = (cutoff, 100 - cutoff) if isinstance(cutoff, (int, float)) else tuple(cutoff)
    if len(pair) != 2:
        raise ValueError("a cutoff is one number or two")
    lo, hi = map(float, pair)
    if not (0 <= lo <= 100 and 0 <= hi <= 100):
        raise ValueError("a cutoff lies within 0..100")
    if lo >= hi:
        raise ValueError("the lower cutoff must be below the upper")
    return lo, hi


def _valid(column: str) -> Column:
    v = F.col(column).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def equalised(cell_map: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """Adds `display`: the share of values up to each one, by a histogram of equal bins whose cumulated counts are
    interpolated at the bins' centres. Only the histogram, of a fixed size, is joined to the rows."""
    rows = cell_map.withColumn("_v", _valid(column))
    edge = rows.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count("_v").alias("n")).first()
    if not edge["n"] or edge["lo"] == edge["hi"]:
        return rows.withColumn("display", F.when(F.col("_v").isNotNull(), F.lit(1.0))).drop("_v")
    lo, width = edge["lo"], (edge["hi"] - edge["lo"]) / bins
    place = F.least(F.floor((F.col("_v") - lo) / width), F.lit(bins - 1)).cast("int")
    counts = rows.filter("_v IS NOT NULL").groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    all_bins = cell_map.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left")
    upto = F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) / F.lit(float(edge["n"]))
    cdf = all_bins.select("bin", upto.alias("f"))  # `bins` rows
    cdf = cdf.select("bin", "f", F.lead("f").over(Window.orderBy("bin")).alias("g"))
    at = (F.col("_v") - lo) / width - 0.5
    lower = F.greatest(F.floor(at), F.lit(0)).cast("int")
    found = rows.withColumn("_at", at).withColumn("_bin", F.least(lower, F.lit(bins - 1))).join(F.broadcast(cdf), F.col("_bin") == F.col("bin"), "left")
    share = F.least(F.greatest(F.col("_at") - F.col("bin"), F.lit(0.0)), F.lit(1.0))
    return found.withColumn("display", F.when(F.col("_v").isNotNull(), F.col("f") + (F.coalesce("g", "f") - F.col("f")) * share)).drop("_v", "_at", "_bin", "bin", "f", "g")


def clipped(cell_map: DataFrame, column: str, cutoff: float | tuple[float, float] | None, out: str = "display") -> DataFrame:
    """The column limited to its percentiles."""
    pair = check_cutoff(cutoff)
    if pair is None:
        return cell_map.withColumn(out, _valid(column))
    lo, hi = _percentiles(cell_map, column, pair)
    limited = F.lit(None) if lo is None else F.greatest(F.least(_valid(column), F.lit(hi)), F.lit(lo))
    return cell_map.withColumn(out, F.when(_valid(column).isNotNull(), limited).cast("double"))


def _percentiles(cell_map: DataFrame, column: str, pair: tuple[float, float]) -> tuple[float | None, float | None]:
    found = cell_map.agg(F.percentile(_valid(column), F.array(F.lit(pair[0] / 100), F.lit(pair[1] / 100))).alias("p")).first()["p"]
    return tuple(found) if found else (None, None)


def prepare(cell_map: DataFrame, column: str, equalize: bool = True, cutoff: float | tuple[float, float] | None = None) -> tuple[DataFrame, tuple[float | None, float | None]]:
    """(map with `display`, the range of the original values within the cutoff)."""
    pair = check_cutoff(cutoff)
    shown = equalised(cell_map, column) if equalize else cell_map.withColumn("display", _valid(column))
    if pair:
        shown = clipped(shown, "display", pair)
    if pair:
        span = _percentiles(cell_map, column, pair)
    else:
        span = tuple(cell_map.agg(F.min(_valid(column)), F.max(_valid(column))).first())
    return shown, span
