"""Reading observations, sidecars, maps and states."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellgrid.sources.metadata import GridMeta, Stage, companion, name_fields, nside_in_name, read_meta
from cellgrid.sources.places import footer, part_files, place

SENTINEL = 1e30

# Name parts of coordinate columns, in order of preference, and the exact names.
LON_PARTS = ("lon", "longitude", "long", "x", "easting")
LAT_PARTS = ("lat", "latitude", "y", "northing")
LON_NAMES = ("lon", "longitude", "spot_lon", "x")
LAT_NAMES = ("lat", "latitude", "spot_lat", "y")


def _lists(s: str, open_: list[bool]) -> str:
    """Brackets after `in` become parentheses; those of an array's element stay. open_: which of the brackets open so
    far are lists."""
    out = []
    for k, ch in enumerate(s):
        if ch == "[":
            open_.append(bool(re.search(r"\bin\s*$", s[:k], re.I)))
        is_list = ch in "[]" and open_ and open_[-1]
        out.append({"[": "(", "]": ")"}[ch] if is_list else ch)
        if ch == "]" and open_:
            open_.pop()
    return "".join(out)


def filter_text(text: str) -> str:
    """A row filter in SQL; `==`, `!=`, `&`, `|`, `~` and `in [...]` of the data-frame dialect are understood too."""
    open_: list[bool] = []
    parts = re.split(r"('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")", text)
    for i in range(0, len(parts), 2):
        s = re.sub(r"==", "=", parts[i])
        s = re.sub(r"&+", " AND ", s)
        s = re.sub(r"\|+", " OR ", s)
        parts[i] = _lists(re.sub(r"~\s*(?=[\w(])", " NOT ", s), open_)
    return "".join(f"'{p[1:-1]}'" if i % 2 and p[0] == '"' else p for i, p in enumerate(parts)).strip()


def with_row_ids(df: DataFrame, name: str = "source_id") -> DataFrame:
    """Adds each row's number over all files, in the order of file names: a file's offset plus the row's index in it.

    Only one count a file meets in one place, which is broadcast, as Spark's driver lists the files anyway; the rows stay
    where they are.
    """
    rows = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n")).select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(files), "_file").withColumn(name, (F.col("_before") + F.col("_row")).cast("long")).drop("_file", "_row", "_before")


def read_observations(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None, source_id: str = "source_id", partitions: int | None = None) -> DataFrame:
    """Observations with a `source_id`: the column if there is one, else the row number, given before any filter."""
    df = spark.read.parquet(path)
    if source_id in df.columns:
        df = df.withColumn(source_id, F.col(source_id).cast("long"))
    else:
        df = with_row_ids(df, source_id)
    if where:
        df = df.filter(F.expr(filter_text(where)))
    if columns is not None:
        missing = [c for c in columns if c not in df.columns]
        if missing:
            raise KeyError(f"no column {missing} in {df.columns}")
        df = df.select(source_id, *[c for c in columns if c != source_id])
    return df.repartition(partitions) if partitions else df


def number(c: str | Column) -> Column:
    """A value as a double; what is no number, NaN or infinite becomes null."""
    v = F.expr(f"try_cast(`{c}` AS double)") if isinstance(c, str) else c.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def value(c: str, sentinel: float | None = SENTINEL) -> Column:
    """A value column fit for aggregation: null for missing values and for those of the sentinel's size or more."""
    v = number(c)
    return v if sentinel is None else F.when(F.abs(v) < sentinel, v)


def with_position(df: DataFrame) -> DataFrame:
    """Adds _file and _row, a row's place: its file and number in it for rows read from files and then selected or
    filtered only, else its place in Spark's own order."""
    try:
        out = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        out.schema  # noqa: B018  resolves the names
        return out
    except AnalysisException:
        return df.withColumns({"_file": F.lit(""), "_row": F.monotonically_increasing_id()})


def first_of_each(df: DataFrame, key: str = "source_id", order: list[str] | None = None) -> DataFrame:
    """The first row of each key, in the order of the rows, or of the given columns. A key's rows are thinned to one a
    task before they meet."""
    rows = df if order else with_position(df)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*(order or ["_file", "_row"])))
    out = rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
    return out if order else out.drop("_file", "_row")


def sample(df: DataFrame, share: float, seed: int = 0, key: str | None = None) -> DataFrame:
    """A share of the rows, the same ones each time; with a key all rows of a value or none, by a hash of it."""
    if not 0 <= share <= 1:
        raise ValueError(f"the share must be from 0 to 1, not {share}")
    if key is None:
        return df.sample(withReplacement=False, fraction=share, seed=seed)
    return df.filter(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))


def detect_lonlat(columns: list[str]) -> tuple[str | None, str | None]:
    """The first columns whose names hold a known part, by the parts' order."""
    def find(parts: tuple[str, ...]) -> str | None:
        return next((c for p in parts for c in columns if p in c.lower() and c.lower() != "geometry"), None)

    return find(LON_PARTS), find(LAT_PARTS)


def exact_lonlat(columns: list[str]) -> tuple[str, str]:
    """The columns of a known name; ValueError that tells what would do."""
    lower = {c.lower(): c for c in reversed(columns)}
    lon, lat = (next((lower[n] for n in names if n in lower), None) for names in (LON_NAMES, LAT_NAMES))
    if lon is None or lat is None:
        raise ValueError(f"no longitude or latitude column among {columns}; name them {LON_NAMES} and {LAT_NAMES} or give their names")
    return lon, lat


def head(df: DataFrame, rows: int = 100) -> DataFrame:
    return df.limit(rows)


def file_text(path: str | Path) -> str:
    """What a file's or folder's footers tell without a scan: rows, row groups, writer and keys, a line for each file."""
    lines = []
    for name in part_files(path):
        f = footer(name)
        lines.append(f"{place(name).name}: {f['rows']} rows in {f['row_groups']} row groups of {f['bytes']} bytes, by {f['created_by']}, keys {sorted(f['values'])}")
    return "\n".join(lines)


def schema_text(df: DataFrame, metadata: bool = True) -> str:
    """The columns, a line each, with their metadata."""
    return "\n".join(f"{f.name}: {f.dataType.simpleString()}" + (f"  {json.dumps(f.metadata)}" if metadata and f.metadata else "") for f in df.schema)


def cells(spark: SparkSession, npix: int) -> DataFrame:
    """All cell numbers."""
    return spark.range(npix).withColumnRenamed("id", "healpix_id")


# --- finding files ---------------------------------------------------------------------------------------------------


def list_sidecars(observations: str | Path, folder: str | Path | None = None, spark: SparkSession | None = None) -> list[dict]:
    """The sidecars of a file, by nside and mode, from metadata or else from their names; with a session also their
    numbers of rows and cells."""
    path = place(observations)
    stem = path.name.removesuffix(".parquet")
    found = []
    for p in sorted(place(folder or path.parent).glob(f"{stem}.*.parquet")):
        fields = name_fields(p.name)
        try:
            meta = read_meta(p)
        except ValueError:
            meta = None
        nside = meta.nside if meta else nside_in_name(p.name)
        if nside is None or meta and meta.file_type != Stage.SIDECAR or "-aggregated" in p.name:
            continue
        row = {"path": str(p), "nside": nside, "mode": (meta.mode if meta else None) or fields.get("mode"), "order": meta.order if meta else fields.get("order", "nested")}
        if spark is not None:
            stats = spark.read.parquet(str(p)).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("healpix_id").alias("cells")).first()
            row |= stats.asDict()
        found.append(row)
    return sorted(found, key=lambda r: (r["nside"], r["mode"] or ""))


def find_sidecar(observations: str | Path, nside: int | None = None, mode: str = "fuzzy") -> Path | None:
    """The sidecar of a file beside it or in a folder `sidecars` there."""
    path = place(observations)
    for folder in (path.parent, path.parent / "sidecars"):
        for row in list_sidecars(path, folder) if folder.exists() else []:
            if row["mode"] == mode and nside in (None, row["nside"]):
                return place(row["path"])
    return None


def load_map(spark: SparkSession, path: str | Path, validate: bool = True, strict: bool = False) -> tuple[DataFrame, GridMeta]:
    """A map and its metadata; validate: the quality report must be clean (strict: warnings count too)."""
    from cellgrid.operators.quality import check_aggregate

    df = spark.read.parquet(str(path))
    meta = read_meta(path, df)
    if validate:
        check_aggregate(df, meta, strict=strict)
    return df, meta


def load_only_map(spark: SparkSession, folder: str | Path, pattern: str = "*-aggregated*.parquet", **kw) -> tuple[DataFrame, GridMeta]:
    """The one map in a folder that fits the pattern."""
    found = sorted(place(folder).glob(pattern))
    if not found:
        raise FileNotFoundError(f"no {pattern} in {folder}")
    if len(found) > 1:
        raise ValueError(f"several files fit {pattern}: {[p.name for p in found]}")
    return load_map(spark, found[0], **kw)


# --- writing ---------------------------------------------------------------------------------------------------------


def write_table(df: DataFrame, path: str | Path, meta: GridMeta | None = None, mode: str = "error", single: bool = False) -> Path:
    """A Parquet folder, with the metadata on the cell column and as JSON beside it. single: one file, which gathers
    the rows in one task and is for small tables."""
    out = meta.on_columns(df) if meta else df
    (out.coalesce(1) if single else out).write.mode(mode).parquet(str(path))
    if meta:
        from cellgrid.sources.metadata import write_json

        write_json(meta, companion(path))
    return place(path)
