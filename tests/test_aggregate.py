import math

import pytest
from pyspark.sql import functions as F

from cellgrid.operators import aggregate as A


def frames(spark, ids, cells, **columns):
    names = list(columns)
    obs = spark.createDataFrame(list(zip(ids, *columns.values())), "source_id long, " + ", ".join(f"{n} double" for n in names))
    side = spark.createDataFrame([(i, c, 1.0) for i, c in cells], "source_id long, healpix_id long, weight double")
    return obs, side


def by_cell(df):
    return {r["healpix_id"]: r.asDict() for r in df.collect()}


def test_mean(spark):
    obs, side = frames(spark, [0, 1, 2, 3], [(0, 1), (1, 1), (2, 2), (3, 2)], v=[10.0, 20.0, 30.0, 40.0])
    got = by_cell(A.aggregate_by_sidecar(obs, side, ["v"], ["mean", "median", "min", "max"]))
    assert got[1]["v_mean"] == 15 and got[2]["v_mean"] == 35
    assert (got[1]["v_median"], got[1]["v_min"], got[1]["v_max"]) == (15, 10, 20)


def test_two_columns_and_defaults(spark):
    obs, side = frames(spark, [0, 1, 2], [(0, 1), (1, 1), (2, 2)], t=[10.0, 20.0, 30.0], p=[1000.0, 1010.0, 1020.0])
    df = A.aggregate_by_sidecar(obs, side, ["t", "p"])
    assert df.columns == ["healpix_id", *[f"{c}_{a}" for c in ("t", "p") for a in A.DEFAULT], "n_sources"]
    got = by_cell(df)
    assert got[1]["t_mean"] == 15 and got[1]["p_mean"] == 1005 and got[2]["t_std"] == 0


def test_min_count_missing_values_and_duplicates(spark):
    obs, side = frames(spark, [0, 1, 2], [(0, 1), (1, 1), (2, 2)], v=[10.0, 20.0, 30.0])
    got = by_cell(A.aggregate_by_sidecar(obs, side, ["v"], ["mean"], min_count=2))
    assert got[2]["v_mean"] is None and got[2]["n_sources"] == 1 and got[1]["v_mean"] == 15
    obs, side = frames(spark, [0, 1, 2, 3], [(i, 1) for i in range(4)], v=[10.0, math.nan, 30.0, None])
    got = by_cell(A.aggregate_by_sidecar(obs, side, ["v"], ["mean"], n_valid=True))[1]
    assert got["v_mean"] == 20 and got["n_sources"] == 4 and got["v_n_valid"] == 2
    obs, side = frames(spark, [0, 0, 1, 2], [(0, 1), (1, 1), (2, 2)], v=[10.0, 15.0, 20.0, 30.0], k=[1.0, 2.0, 3.0, 4.0])
    assert by_cell(A.aggregate_by_sidecar(obs, side, ["v"], ["mean"], order=["k"]))[1]["v_mean"] == 15
    obs, side = frames(spark, [0, 0, 1, 2], [(0, 1), (1, 1), (2, 2)], v=[15.0, 10.0, 20.0, 30.0])
    assert by_cell(A.aggregate_by_sidecar(obs, side, ["v"], ["mean"]))[1]["v_mean"] == 17.5


def test_first_in_the_order_of_the_files(spark, tmp_path):
    from cellgrid.sources import observations as O

    for name, rows in (("b", [(0, 1.0), (5, 2.0)]), ("a", [(0, 15.0), (0, 10.0), (1, 20.0)])):
        spark.createDataFrame(rows, "source_id long, v double").coalesce(1).write.parquet(str(tmp_path / name))
    read = spark.read.parquet(str(tmp_path / "b"), str(tmp_path / "a"))
    got = {r["source_id"]: r["v"] for r in O.first_of_each(read.select("source_id", "v")).collect()}
    assert got == {0: 15.0, 1: 20.0, 5: 2.0}
    assert {r["v"] for r in O.first_of_each(read.filter("v < 12")).collect()} == {10.0, 2.0}


@pytest.mark.parametrize("rows", [0, 3, 10**6])
def test_crowded_cells_have_the_same_values(spark, rows):
    """One cell holds most rows, many of them equal; with any bound of the arrays the map is the same."""
    import numpy as np

    rng = np.random.default_rng(3)
    data = [(1 if k % 9 else k % 5, float(v) if k % 11 else None, float(k % 7)) for k, v in enumerate(rng.normal(size=900) ** 3)] + [(1, 2.5, 2.5)] * 300
    joined = spark.createDataFrame(data, "healpix_id long, a double, b double")
    aggs = ("mean", "median", "std", "min", "max", "mad", "robust_std")
    got = by_cell(A.reduce_cells(joined, ["a", "b"], aggs, 2, n_valid=True, array_rows=rows))
    for cell in {r[0] for r in data}:
        own = [r for r in data if r[0] == cell]
        assert got[cell]["n_sources"] == len(own)
        for k, c in ((1, "a"), (2, "b")):
            v = np.array([r[k] for r in own if r[k] is not None])
            mad = np.median(np.abs(v - np.median(v)))
            want = {"mean": v.mean(), "median": np.median(v), "std": v.std(), "min": v.min(), "max": v.max(), "mad": mad, "robust_std": 1.4826 * mad, "n_valid": len(v)}
            assert all(abs(got[cell][f"{c}_{name}"] - x) < 1e-9 for name, x in want.items())


def test_median_of_a_large_group(spark):
    from cellgrid.operators import quantiles

    values = spark.range(200_001).selectExpr("0L AS g", "cast(pmod(id * 7919, 200001) AS double) AS v").unionByName(spark.range(100_000).selectExpr("1L AS g", "cast(id div 60000 AS double) AS v"))
    got = {r["g"]: (r["median"], r["mad"]) for r in quantiles.medians_and_mads(values, ["g"]).collect()}
    assert got == {0: (100_000.0, 50_000.0), 1: (0.0, 0.0)}


def test_sentinel(spark):
    obs, side = frames(spark, [0, 1, 2], [(i, 1) for i in range(3)], v=[1.0, 1e30, math.inf])
    assert by_cell(A.aggregate_by_sidecar(obs, side, ["v"], ["max"]))[1]["v_max"] == 1


def test_errors_and_no_overlap(spark):
    obs, side = frames(spark, [10, 11], [(0, 1), (1, 2)], v=[1.0, 2.0])
    with pytest.raises(ValueError, match="mean"):
        A.aggregate_by_sidecar(obs, side, ["v"], ["mode"])
    with pytest.raises(KeyError):
        A.aggregate_by_sidecar(obs, side, ["x"])
    with pytest.raises(ValueError, match="empty"):
        A.aggregate_by_sidecar(obs, side.limit(0), ["v"])
    got = by_cell(A.aggregate_by_sidecar(obs, side, ["v"], ["mean"]))
    assert {k: (v["v_mean"], v["n_sources"]) for k, v in got.items()} == {1: (None, 1), 2: (None, 1)}
    assert A.overlap(obs, side).first().asDict() == {"sidecar_ids": 2, "common": 0, "missing": 2, "observation_ids": 2}


@pytest.mark.parametrize(("values", "want"), [([1, 2, 3, 4, 5], 1.0), ([1, 2, 3, 4], 1.0), ([1, 2, math.nan, 4, 5], 1.5), ([1, 2, math.inf, 4, 5], 1.5), ([math.nan], None), ([], None), ([7], 0.0), ([3, 3, 3], 0.0), ([-5, -4, -3, -2, -1], 1.0)])
def test_mad(spark, values, want):
    df = spark.createDataFrame([([float(v) for v in values],)], "x array<double>")
    assert df.select(A.mad_of(F.col("x")).alias("m")).first()["m"] == want
    clean = [float(v) for v in values if math.isfinite(v)]
    if clean:
        got = A.reduce_cells(spark.createDataFrame([(1, v) for v in clean], "healpix_id long, v double"), ["v"], ("mad", "robust_std")).first()
        assert got["v_mad"] == want and abs(got["v_robust_std"] - want * 1.4826) < 1e-12


@pytest.mark.parametrize(("nside", "rows"), [(4, 192), (8, 768)])
def test_densify(spark, nside, rows):
    df = spark.createDataFrame([(0, 1.0), (5, 2.0), (10, None), (10**6, 9.0)], "healpix_id long, v double")
    got = A.densify(df, nside)
    assert got.count() == rows and got.agg(F.max("healpix_id")).first()[0] == rows - 1
    filled = {r["healpix_id"]: r["v"] for r in A.densify(df, nside, fill=-1.0).collect()}
    assert filled[0] == 1 and filled[10] is None and filled[1] == -1
    renamed = A.densify(df.withColumnRenamed("healpix_id", "cell"), nside, key="cell")
    assert renamed.columns == ["cell", "v"]


def test_points_agree_with_sidecar(spark):
    from cellgrid.operators.assign import assign_points

    obs = spark.range(500).selectExpr("id AS source_id", "(id * 7919 % 3600) / 10D + 0.03D AS lon", "(id * 104729 % 1800) / 10D - 90D + 0.02D AS lat", "id * 1.5D AS v")
    a = by_cell(A.aggregate_points(obs, 4, ["v"], ("mean", "mad")))
    b = by_cell(A.aggregate_by_sidecar(obs, assign_points(obs, 4), ["v"], ("mean", "mad"), unique=True))
    assert a == b


def test_weighted_mean(spark):
    obs, _ = frames(spark, [0, 1], [], v=[10.0, 20.0])
    side = spark.createDataFrame([(0, 1, 3.0), (1, 1, 1.0)], "source_id long, healpix_id long, weight double")
    assert A.weighted_mean(obs, side, ["v"]).first()["v_wmean"] == 12.5
