import math

import pytest
from pyspark.sql import functions as F

from cellgrid.operators.assign import assign_points
from cellgrid.sources.metadata import GridMeta
from cellgrid.streaming import state, stream


def points(spark, n=400):
    return spark.range(n).selectExpr("id AS source_id", "(id * 7919 % 3600) / 10D + 0.03D AS lon", "(id * 104729 % 1800) / 10D - 90D + 0.02D AS lat", "id * 1D AS v", "if(id % 3 = 0, NULL, id * 2D) AS w")


def table(df):
    return {(r["healpix_id"], r["column"]): (r["n"], r["sum"], r["min"], r["max"]) for r in df.collect()}


def test_batches_equal_one(spark):
    obs = points(spark)
    side = assign_points(obs, 2)
    whole = state.accumulate(obs, side, ["v", "w"])
    held = None
    for k in range(3):
        held = state.accumulate(obs.filter(F.col("source_id") % 3 == k), side, ["v", "w"], held)
    assert table(held) == table(whole)
    assert state.progress(whole) == {"cells": side.select("healpix_id").distinct().count(), "observations": 400, "added": 400}


def test_finalize(spark):
    rows = [(1, "v", 2, 30.0, 500.0, 10.0, 20.0, None), (2, "v", 1, 5.0, 25.0, 5.0, 5.0, None), (3, "w", 0, 0.0, 0.0, None, None, None)]
    held = spark.createDataFrame(rows, state.SCHEMA)
    got = {r["healpix_id"]: r.asDict() for r in state.finalize(held, ["v", "w"]).collect()}
    assert got[1]["v_mean"] == 15 and got[1]["v_std"] == 5 and got[1]["w_n"] == 0
    assert got[2]["v_std"] is None and got[2]["v_mean"] == 5
    assert got[3]["w_mean"] is None and got[3]["v_n"] == 0
    few = {r["healpix_id"]: r.asDict() for r in state.finalize(held, ["v"], min_count=2).collect()}
    assert few[2]["v_mean"] is None and few[2]["v_n"] == 1
    with pytest.raises(ValueError):
        state.finalize(held, ["v"], [2.5, 2.7])
    assert state.finalize(held.limit(0), ["v"]).count() == 0


def test_percentiles(spark):
    df = spark.range(101).selectExpr("1L AS healpix_id", "id * 1D AS v")
    got = state.finalize(state.partial(state.long_values(df, ["v"])), ["v"], [25, 50]).first()
    assert abs(got["v_p25"] - 25) <= 2 and abs(got["v_p50"] - 50) <= 2


def test_missing_and_repeated(spark):
    obs = spark.createDataFrame([(0, 1.0), (1, math.inf), (2, math.nan), (3, None)], "source_id long, v double")
    side = spark.createDataFrame([(i, 7) for i in range(4)], "source_id long, healpix_id long")
    row = state.accumulate(obs, side, ["v"]).first()
    assert (row["n"], row["sum"], row["max"]) == (1, 1.0, 1.0)
    with pytest.raises(ValueError):
        state.accumulate(obs.unionAll(obs), side, ["v"])
    with pytest.raises(KeyError):
        state.accumulate(obs, side, ["x"])
    assert state.accumulate(obs, side, ["v"], where="source_id == 9").count() == 0


def test_save_load_json(spark, tmp_path):
    obs = points(spark, 50)
    held = state.accumulate(obs, assign_points(obs, 2), ["v"])
    state.save_state(held, tmp_path / "state_v001.parquet", GridMeta(2, mode="fuzzy"))
    back, meta = state.load_state(spark, tmp_path / "state_v001.parquet")
    assert table(back) == table(held) and meta.file_type.value == "accumulator"
    assert table(state.from_json_form(state.to_json_form(held))) == table(held)


def test_streams(spark, tmp_path):
    obs = points(spark)
    obs.repartition(3).write.parquet(str(tmp_path / "in"))
    whole = table(state.accumulate(obs, assign_points(obs, 2), ["v"]))
    source = lambda: stream.read_stream(spark, str(tmp_path / "in"), obs.schema)
    stream.run_to_table(stream.streaming_state(source(), 2, ["v"]), "held", str(tmp_path / "c1")).awaitTermination()
    assert table(spark.table("held")) == whole
    stream.run_versions(source(), str(tmp_path / "versions"), 2, ["v"], str(tmp_path / "c2")).awaitTermination()
    last = stream.latest_version(tmp_path / "versions")
    assert last.name == "state_v000003" and table(spark.read.parquet(str(last))) == whole


def test_windows(spark, tmp_path):
    obs = points(spark, 60).withColumn("ts", F.timestamp_seconds(F.col("source_id") * 60))
    obs.write.parquet(str(tmp_path / "in"))
    got = stream.windowed_state(stream.read_stream(spark, str(tmp_path / "in"), obs.schema), "ts", "10 minutes", "1 minute", 1, ["v"])
    got.writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.sql("SELECT window.start AS s, sum(v_n) AS n FROM windows GROUP BY 1").collect()
    assert len(rows) == 6 and all(r["n"] == 10 for r in rows)
