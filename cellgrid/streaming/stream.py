"""The same state over streams of files."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cellgrid.functions.healpix import with_cell
from cellgrid.operators.assign import in_bounds
from cellgrid.sources.observations import number
from cellgrid.sources.places import place
from cellgrid.streaming.state import long_values, merged, partial


def checkpoint_folder(spark: SparkSession) -> str:
    """A new folder for a query's files, in the one that the session names in spark.checkpoint.dir; only a local session
    that names none, as in tests, gets one of this machine."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    return f"{named or tempfile.gettempdir()}/stream-{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def streaming_state(stream: DataFrame, nside: int, columns: list[str], lon: str = "lon", lat: str = "lat", convention: str = "0_360", sketches: bool = True) -> DataFrame:
    """The state of a stream of points as a streaming aggregation."""
    rows = stream.select(number(lon).alias("_lo"), number(lat).alias("_la"), *columns).filter(in_bounds(F.col("_lo"), F.col("_la"), convention))
    return partial(long_values(with_cell(rows, "_lo", "_la", nside, known=True).select("healpix_id", *columns), columns), sketches)


def run_to_table(state: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """All there is, in complete mode, into an in-memory table; for tests and small grids."""
    return state.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_versions(stream: DataFrame, folder: str, nside: int, columns: list[str], checkpoint: str, **kw) -> StreamingQuery:
    """A state table for each batch, merged with the one before: state_v000001, state_v000002 ... A batch that is run
    again overwrites its own version, so each is counted once."""

    def step(batch: DataFrame, number_: int) -> None:
        spark = batch.sparkSession
        new = streaming_state(batch, nside, columns, **kw)
        before = f"{folder}/state_v{number_:06d}"
        state = merged(spark.read.parquet(before), new) if number_ else new
        state.write.mode("overwrite").parquet(f"{folder}/state_v{number_ + 1:06d}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_state(stream: DataFrame, time: str, length: str, late: str, nside: int, columns: list[str], lon: str = "lon", lat: str = "lat", slide: str | None = None) -> DataFrame:
    """Counts, sums and extremes by cell and time window, with late rows up to `late` (an extension)."""
    placed = stream.withWatermark(time, late).filter(in_bounds(number(lon), number(lat), "0_360"))
    rows = with_cell(placed, lon, lat, nside, known=True)
    parts = [f(number(c)).alias(f"{c}_{label}") for c in columns for f, label in ((F.count, "n"), (F.sum, "sum"), (F.min, "min"), (F.max, "max"))]
    return rows.groupBy(F.window(time, length, slide) if slide else F.window(time, length), "healpix_id").agg(*parts)


def latest_version(folder: str | Path) -> Path | None:
    found = sorted(place(folder).glob("state_v*"))
    return found[-1] if found else None
