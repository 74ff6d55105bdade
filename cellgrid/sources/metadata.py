"""Metadata of grid files: a record, its JSON companion, and checks between files."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field
from datetime import date, datetime
from enum import Enum
from pathlib import Path

from pyspark.sql import DataFrame

from cellgrid.functions.healpix import check_convention, check_nside, check_order, npix_of, nside_of
from cellgrid.sources.places import Remote, place


class Stage(str, Enum):
    """What a file holds."""

    SIDECAR = "sidecar"
    AGGREGATE = "aggregate"
    ACCUMULATOR = "accumulator"
    FINALIZE = "finalize"
    GEOSPATIAL = "geospatial"


@dataclass
class GridMeta:
    """nside, order and longitude convention of a file, with what made it."""

    nside: int
    order: str = "nested"
    npix: int | None = None
    mode: str | None = None
    lon_convention: str = "0_360"
    file_type: Stage = Stage.AGGREGATE
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        check_nside(self.nside)
        check_order(self.order)
        self.lon_convention = check_convention(self.lon_convention)
        self.file_type = Stage(self.file_type)
        if self.npix is None:
            self.npix = npix_of(self.nside)
        elif self.npix != npix_of(self.nside):
            raise AssertionError(f"npix {self.npix} does not fit nside {self.nside}")

    @property
    def nest(self) -> bool:
        return self.order == "nested"

    def to_dict(self) -> dict:
        """The nested form: processing, healpix, coordinates, processing_params."""
        own = asdict(self)
        extra = own.pop("extra")
        return {
            "processing": {"stage": self.file_type.value, **extra.get("processing", {})},
            "healpix": {"nside": self.nside, "order": self.order, "npix": self.npix, "mode": self.mode},
            "coordinates": {"lon_convention": self.lon_convention, **extra.get("coordinates", {})},
            "processing_params": extra.get("processing_params", {}),
            **{k: v for k, v in extra.items() if k not in ("processing", "coordinates", "processing_params")},
        }

    @classmethod
    def from_dict(cls, d: dict) -> GridMeta:
        """From the nested form, the same below `sidecar_metadata`, or a flat one; unknown keys stay in `extra`."""
        below = d.get("sidecar_metadata") or {}
        grid = below.get("healpix") or d.get("healpix") or d
        if "nside" not in grid:
            raise ValueError("metadata holds no nside")
        coordinates = below.get("coordinates") or d.get("coordinates") or {}
        convention = coordinates.get("lon_convention") or below.get("lon_convention") or d.get("lon_convention") or grid.get("lon_convention") or "0_360"
        kind = (d.get("processing") or {}).get("stage") or d.get("file_type") or grid.get("file_type") or Stage.AGGREGATE
        extra = {k: v for k, v in d.items() if k not in ("healpix", "nside", "order", "npix", "mode", "lon_convention", "file_type")}
        return cls(int(grid["nside"]), grid.get("order", "nested"), grid.get("npix"), grid.get("mode"), convention, kind, extra)

    def on_columns(self, df: DataFrame) -> DataFrame:
        """The DataFrame with this record as metadata of its cell column, which survives Parquet."""
        from pyspark.sql import functions as F

        name = "healpix_id"
        return df.withColumn(name, F.col(name).alias(name, metadata={"grid": _plain(self.to_dict())})) if name in df.columns else df


def _plain(x):
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [_plain(v) for v in x]
    if isinstance(x, Enum):
        return x.value
    if isinstance(x, (Path, Remote)):
        return str(x)
    if isinstance(x, (datetime, date)):
        return x.isoformat()
    if hasattr(x, "item"):
        return x.item()
    return x


def companion(path: str | Path) -> Path:
    """The JSON file beside a data file or folder."""
    path = place(path)
    return path.with_name(f"{path.name.removesuffix('.parquet')}.meta.json")


def write_json(record: GridMeta | dict, path: str | Path, validate: bool = True) -> Path:
    """Writes a record as JSON; validate: only what `GridMeta` can read again."""
    d = _plain(record.to_dict() if isinstance(record, GridMeta) else record)
    if validate:
        GridMeta.from_dict(d)
    place(path).write_text(json.dumps(d, indent=2, sort_keys=True))
    return place(path)


def read_meta(path: str | Path, df: DataFrame | None = None) -> GridMeta:
    """From the companion JSON, else from the cell column of `df`; ValueError where neither has any."""
    beside = companion(path)
    if beside.exists():
        return GridMeta.from_dict(json.loads(beside.read_text()))
    if df is not None and "healpix_id" in df.columns and (found := df.schema["healpix_id"].metadata.get("grid")):
        return GridMeta.from_dict(found)
    raise ValueError(f"no metadata for {path}: neither {beside.name} nor column metadata")


def check_file_type(path: str | Path, expected: Stage | str, strict: bool = False) -> bool:
    """Whether a file is of a stage; strict: ValueError if not or unknown."""
    try:
        found = read_meta(path).file_type
    except ValueError:
        if strict:
            raise
        return False
    if found != Stage(expected) and strict:
        raise ValueError(f"{path} is of stage {found.value}, not {Stage(expected).value}")
    return found == Stage(expected)


def check_sidecar_source(sidecar: str | Path, observations: str | Path, required: bool = False) -> bool:
    """Whether a sidecar was made from a file of the name of `observations`; without metadata True unless required."""
    beside = companion(sidecar)
    if not beside.exists():
        if required:
            raise ValueError(f"{sidecar} has no metadata")
        return True
    made_from = (json.loads(beside.read_text()).get("processing") or {}).get("input_file")
    if made_from is not None and place(made_from).name != place(observations).name:
        raise ValueError(f"{sidecar} was made from {place(made_from).name}, not {place(observations).name}")
    return True


def check_compatible(state: GridMeta, sidecar: GridMeta) -> list[str]:
    """Warnings; ValueError where nside, mode or order differ."""
    for name in ("nside", "mode", "order"):
        a, b = getattr(state, name), getattr(sidecar, name)
        if a is not None and b is not None and a != b:
            raise ValueError(f"{name} differs: state {a}, sidecar {b}")
    return [] if state.lon_convention == sidecar.lon_convention else [f"longitude conventions differ: state {state.lon_convention}, sidecar {sidecar.lon_convention}"]


# --- file names ------------------------------------------------------------------------------------------------------

# The forms in which a file name tells its nside, in any case.
_NSIDE = re.compile(r"(?:^|[._-])nside[=_-]?(\d+)", re.IGNORECASE)


def nside_in_name(name: str) -> int | None:
    """The nside that a file name tells; None if none or several different ones."""
    found = {int(x) for x in _NSIDE.findall(name)}
    return found.pop() if len(found) == 1 else None


def name_fields(name: str) -> dict[str, str]:
    """key-value_key-value parts of a file name; `assignment` is called mode."""
    fields = {}
    for part in re.split(r"[_.]", Path(name).name.removesuffix(".parquet")):
        key, dash, value = part.partition("-")
        if dash and key and value:
            fields["mode" if key == "assignment" else key] = value
    return fields


def sidecar_path(observations: str | Path, mode: str, nside: int, folder: str | Path | None = None) -> Path:
    path = place(observations)
    return (place(folder) if folder else path.parent) / f"{path.name.removesuffix('.parquet')}.cell-healpix_assignment-{mode}_nside-{nside}_order-nested.parquet"


def aggregate_path(observations: str | Path, sidecar: str | Path, folder: str | Path | None = None, dense: bool = False) -> Path:
    path, side = place(observations), place(sidecar)
    stem = path.name.removesuffix(".parquet")
    suffix = side.name.removesuffix(".parquet").removeprefix(f"{stem}.")
    return (place(folder) if folder else path.parent) / f"{stem}-aggregated{'-densified' if dense else ''}.{suffix}.parquet"


def stats_path(observations: str | Path) -> Path:
    path = place(observations)
    return path.with_name(f"{path.name.removesuffix('.parquet')}.geo_stats.json")


def resolve_nside(given: int | None, meta: GridMeta | None, rows: int | None, name: str) -> int:
    """From the caller, else metadata, else the number of rows, else the file's name."""
    if given:
        return check_nside(given)
    if meta:
        return meta.nside
    if rows is not None:
        try:
            return nside_of(rows)
        except ValueError:
            pass
    if (found := nside_in_name(name)) is not None:
        return check_nside(found)
    raise ValueError("nside is neither given nor to be found in metadata, row count or file name")
