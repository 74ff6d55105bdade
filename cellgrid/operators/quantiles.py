"""Exact medians of groups of any size, without gathering a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Error of the sketch that brackets a median, as a share of the group's rows, is 1 / ACCURACY at most.
ACCURACY = 10_000


def _apart(small: DataFrame) -> DataFrame:
    """An aggregate, with an exchange of its own: only then Spark splits the hot keys of a table it is joined to."""
    return small.repartition(int(small.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def medians(values: DataFrame, keys: list[str], value: str = "v", name: str = "median") -> DataFrame:
    """(keys, name): the middle value of each group, or the mean of the two in the middle; nulls don't count.

    A mergeable sketch brackets the median; then the values below the bracket are counted, and those within it are
    counted by value. Only the distinct values of a bracket, a few in ACCURACY of a group's, meet in one place.
    """
    rows = values.select(*keys, F.col(value).alias("_v")).filter("_v IS NOT NULL")
    share = 2.0 / ACCURACY
    sketch = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", [max(0.0, 0.5 - share), 0.5 + share], ACCURACY).alias("_p"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    # a few values have no error to speak of, but the sketch may then miss the second middle one
    small = F.col("_n") < 4 * ACCURACY
    bracket = sketch.select(*keys, "_n", F.when(small, F.col("_least")).otherwise(F.col("_p")[0]).alias("_lo"), F.when(small, F.col("_most")).otherwise(F.col("_p")[1]).alias("_hi"))
    placed = rows.join(_apart(bracket), keys).filter("_v <= _hi")
    at = F.when(F.col("_v") >= F.col("_lo"), F.col("_v"))  # null: all that is below, as one
    counts = placed.groupBy(*keys, at.alias("_at")).agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy(F.col("_at").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("_upto", upto)
    low, high = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1

    def of_rank(rank: Column) -> Column:
        return F.min(F.when(F.col("_upto") >= rank, F.col("_at")))

    return ranked.groupBy(*keys).agg(((of_rank(low) + of_rank(high)) / 2).alias(name))


def medians_and_mads(values: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """(keys, median, mad), the median distance from the median."""
    middle = medians(values, keys, value)
    far = values.join(_apart(middle), keys).withColumn("_far", F.abs(F.col(value) - F.col("median")))
    return middle.join(medians(far, keys, "_far", "mad"), keys)
