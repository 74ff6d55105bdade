"""Paths on any file system that Spark reads, and what Parquet footers hold."""

from __future__ import annotations

import json
import shutil
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession


class Remote:
    """A path with a scheme (s3a://, hdfs://, viewfs:// ...), with the methods of pathlib that the library uses; Spark's
    own file systems do the work."""

    def __init__(self, text: str):
        self.scheme, _, rest = str(text).partition("://")
        self.rest = PurePosixPath(rest)

    def __str__(self) -> str:
        return f"{self.scheme}://{self.rest}"

    def __repr__(self) -> str:
        return f"Remote({str(self)!r})"

    def __eq__(self, other) -> bool:
        return str(self) == str(other)

    def __lt__(self, other) -> bool:
        return str(self) < str(other)

    def __hash__(self) -> int:
        return hash(str(self))

    def __truediv__(self, name) -> Remote:
        return Remote(f"{self.scheme}://{self.rest / str(name)}")

    @property
    def name(self) -> str:
        return self.rest.name

    @property
    def suffix(self) -> str:
        return self.rest.suffix

    @property
    def parent(self) -> Remote:
        return Remote(f"{self.scheme}://{self.rest.parent}")

    def with_name(self, name: str) -> Remote:
        return self.parent / name

    def expanduser(self) -> Remote:
        return self

    def _system(self):
        path = _jvm().org.apache.hadoop.fs.Path(str(self))
        return path.getFileSystem(_configuration()), path

    def exists(self) -> bool:
        system, path = self._system()
        return system.exists(path)

    def is_dir(self) -> bool:
        return self.exists() and self._status().isDirectory()

    def is_file(self) -> bool:
        return self.exists() and self._status().isFile()

    def _status(self):
        system, path = self._system()
        return system.getFileStatus(path)

    def mkdir(self, parents: bool = True, exist_ok: bool = True) -> None:
        system, path = self._system()
        system.mkdirs(path)

    def glob(self, pattern: str) -> list[Remote]:
        system, path = self._system()
        found = system.globStatus(_jvm().org.apache.hadoop.fs.Path(path, pattern)) or []
        return [Remote(s.getPath().toString()) for s in found]

    def read_text(self) -> str:
        system, path = self._system()
        stream = system.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_text(self, text: str) -> int:
        system, path = self._system()
        stream = system.create(path, True)
        try:
            return stream.write(bytearray(text.encode())) or len(text)
        finally:
            stream.close()


def place(path) -> Path | Remote:
    """A local path, or a remote one where there is a scheme other than file."""
    if isinstance(path, Remote):
        return path
    text = str(path)
    if text.startswith("file:"):
        return Path("/" + text[5:].lstrip("/"))
    return Remote(text) if "://" in text else Path(path)


def size(path: Path | Remote) -> int:
    """Bytes of a file, or of all files below a folder."""
    if isinstance(path, Remote):
        system, at = path._system()
        return system.getContentSummary(at).getLength()
    return sum(f.stat().st_size for f in path.rglob("*") if f.is_file()) if path.is_dir() else path.stat().st_size


def remove(path: Path | Remote) -> None:
    """Deletes a file, or a folder with all below it."""
    if isinstance(path, Remote):
        system, at = path._system()
        system.delete(at, True)
    elif path.is_dir():
        shutil.rmtree(path)
    else:
        path.unlink()


def _spark() -> SparkSession:
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("files need a session")
    return spark


def _jvm():
    return _spark()._jvm


def _configuration():
    return _spark()._jsc.hadoopConfiguration()


# --- footers ---------------------------------------------------------------------------------------------------------


def _hadoop(path):
    return _jvm().org.apache.hadoop.fs.Path(str(path))


def part_files(path) -> list[str]:
    """The Parquet files of a folder, or a file itself."""
    root = _hadoop(path)
    system = root.getFileSystem(_configuration())
    if not system.exists(root):
        raise FileNotFoundError(str(path))
    if system.getFileStatus(root).isFile():
        return [root.toString()]
    found = [s.getPath() for s in system.listStatus(root)]
    return sorted(p.toString() for p in found if p.getName().endswith(".parquet") and not p.getName().startswith(("_", ".")))


def footer(path) -> dict:
    """{rows, row_groups, bytes, created_by, columns, values} of one Parquet file, from its footer alone."""
    hadoop = _jvm().org.apache.parquet.hadoop
    reader = hadoop.ParquetFileReader.open(hadoop.util.HadoopInputFile.fromPath(_hadoop(path), _configuration()))
    try:
        found = reader.getFooter()
        own = found.getFileMetaData()
        blocks = list(found.getBlocks())
        columns = [f.getName() for f in own.getSchema().getFields()]
        return {"rows": reader.getRecordCount(), "row_groups": len(blocks), "bytes": sum(b.getTotalByteSize() for b in blocks), "created_by": own.getCreatedBy(), "columns": columns, "values": dict(own.getKeyValueMetaData())}
    finally:
        reader.close()


def stamp(path, values: dict[str, str]) -> int:
    """Adds key-value pairs to the footers of a folder's files; row groups are copied as they are, not decoded. Returns
    the number of files."""
    jvm, configuration = _jvm(), _configuration()
    hadoop = jvm.org.apache.parquet.hadoop
    files = part_files(path)
    for name in files:
        old = _hadoop(name)
        new = _jvm().org.apache.hadoop.fs.Path(old.getParent(), f"_{old.getName()}.stamped")
        source = hadoop.util.HadoopInputFile.fromPath(old, configuration)
        reader = hadoop.ParquetFileReader.open(source)
        own = reader.getFooter().getFileMetaData()
        schema, kept = own.getSchema(), jvm.java.util.HashMap(own.getKeyValueMetaData())
        reader.close()
        for k, v in values.items():
            kept.put(k, v)
        writer = hadoop.ParquetFileWriter(configuration, schema, new, hadoop.ParquetFileWriter.Mode.OVERWRITE)
        writer.start()
        writer.appendFile(source)
        writer.end(kept)
        system = old.getFileSystem(configuration)
        system.delete(old, False)
        system.rename(new, old)
    return len(files)


def geo_footer(path) -> dict | None:
    """What the footers say of geometry columns, as JSON under `geo`; None where they say nothing."""
    for name in part_files(path):
        if text := footer(name)["values"].get("geo"):
            return json.loads(text)
    return None


def read_geoparquet(spark: SparkSession, path, vertices: str | None = "vertices") -> tuple[DataFrame, dict]:
    """A GeoParquet file or folder and its geometry's description; vertices: the column that gets the primary geometry's
    vertices. ValueError for files without such a description and for encodings other than WKB."""
    from cellgrid.operators.geo import wkb_vertices

    geo = geo_footer(path)
    if geo is None:
        raise ValueError(f"{path} has no geo description")
    name = geo.get("primary_column", "geometry")
    encoding = (geo.get("columns") or {}).get(name, {}).get("encoding", "WKB")
    if encoding != "WKB":
        raise ValueError(f"geometry of {path} is encoded as {encoding}, not WKB")
    df = spark.read.parquet(str(path))
    return (df.withColumn(vertices, wkb_vertices(name)) if vertices else df), geo
