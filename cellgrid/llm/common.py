"""What the operators share: column choice, shared storage, text batches and packed exchanges."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import time
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stands for a null id inside the packed exchanges: larger than every id.
NULL_ID = np.iinfo(np.int64).max
#: Text that is turned into arrays at once.
CHUNK_BYTES = 1 << 20


#: Bytes of an Arrow batch; Spark's default of 64 MB, times its copies, is much for a worker that has 500 MB.
BATCH_BYTES = "4m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, found by position, so that other columns may have any names, equal ones too.

    Where the session leaves the size of Arrow batches at Spark's default, it becomes BATCH_BYTES.
    """
    if df.sparkSession.conf.get(_BATCH, "64MB") in ("64MB", "67108864b", "67108864"):
        df.sparkSession.conf.set(_BATCH, BATCH_BYTES)
    have = df.columns
    at = []
    for name in names:
        exact = [i for i, c in enumerate(have) if c == name] or [i for i, c in enumerate(have) if c.lower() == name.lower()]
        if not exact:
            raise KeyError(f"no column {name!r} in {have}")
        at.append(exact[0])
    plain = df.toDF(*[f"_c{i}" for i in range(len(have))])
    return plain.select(*[F.col(f"_c{i}").alias(name) for i, name in zip(at, names)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it in spark.checkpoint.dir; only a local session
    that names none, as in tests, gets one of this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "cellgrid-checkpoints"))
    return sc.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever Spark has it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """The same rows without their lineage, kept in the shared folder, about `rows` to a file.

    The executors hold the rows until they are written, so that they are made once and small tables become few files,
    however many tasks made them.
    """
    shared_folder(df.sparkSession)
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    files = max(1, -(-held.count() // rows))
    out = held.coalesce(files).checkpoint(eager=True)
    held.unpersist()
    return out


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffles behind tables that were cut. It does so when the driver's JVM collects garbage, of
    cached tables in one round and of what these were made from in a later one."""
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def splittable(small: DataFrame) -> DataFrame:
    """An aggregate that a table with hot keys is joined to. Spark splits a hot key's rows only where both sides of the
    join come straight from an exchange, so the aggregate gets one of its own."""
    return small.repartition(shuffle_partitions(small.sparkSession))


def cut_in_place(df: DataFrame) -> DataFrame:
    """The same for rows whose partitions and order matter: a file for each partition."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a few integers that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def few(df: DataFrame) -> DataFrame:
    """A table that was cut, as the small side of a join: broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """The bytes of all texts, counted."""
    return df.select(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def bucket_count(size: int, each: int, least: int = 256) -> int:
    """Buckets of about `each` bytes of text; more data means more buckets, not larger ones."""
    return max(least, -(-size // each))


def shuffle_partitions(spark: SparkSession, size: int = 0, each: int = 1 << 30) -> int:
    """The session's number of partitions, or more if `size` bytes of text need more of `each`."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


# --- words ---------------------------------------------------------------------------------------------------------


class WordHashes(dict):
    """64-bit hash of each word, remembered for the frequent ones; the memory is bounded by `most` words."""

    def __init__(self, most: int = 300_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def mix(a: np.ndarray, b, seed: int) -> np.ndarray:
    """A 64-bit hash of two arrays of 64-bit values (a finaliser of the murmur family)."""
    x = a * np.uint64(0x9E3779B97F4A7C15 + 2 * seed) + np.asarray(b).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return remix(x ^ np.uint64(seed))


def remix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: The last k bytes of a 64-bit word that belong to a word of the text, by k.
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


class Words(NamedTuple):
    """The words of some texts: runs of bytes other than ASCII white space."""

    #: The texts in a row, with some space after each.
    joined: bytes
    starts: np.ndarray
    sizes: np.ndarray
    #: 64-bit hashes.
    hashes: np.ndarray
    #: How many words each text has.
    counts: np.ndarray

    def word(self, i: int) -> bytes:
        return self.joined[self.starts[i] : self.starts[i] + self.sizes[i]]


def words_of(texts: list[bytes], lower: bool = False) -> Words:
    """lower: A-Z only."""
    joined = b" ".join(texts) + b" " * 9
    if lower:
        joined = joined.lower()
    buffer = np.frombuffer(joined, np.uint8)
    word = ~_SPACE[buffer]
    turns = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        turns = np.concatenate(([0], turns))
    starts, size = turns[::2], turns[1::2] - turns[::2]
    eights = np.ndarray((len(buffer) - 8,), "<u8", buffer=joined, strides=(1,))
    out = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    live, at, left = None, starts, size
    while len(at):
        value = eights[at] & _BYTES[np.minimum(left, 8)]
        mixed = ((out if live is None else out[live]) ^ value) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        more = np.flatnonzero(left > 8)
        if live is None:
            out, live = mixed, more
        else:
            out[live] = mixed
            live = live[more]
        at, left = at[more] + 8, left[more] - 8
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return Words(joined, starts, size, remix(out), np.diff(np.searchsorted(starts, ends), prepend=0))


def text_chunks(batch: pa.RecordBatch | pa.Table, id_at: int, text_at: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Ids (null: NULL_ID) and texts as UTF-8 (null: empty), about CHUNK_BYTES at a time; no text is cut."""
    ids = [NULL_ID if x is None else x for x in batch.column(id_at).to_pylist()]
    texts = batch.column(text_at)
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    start, n = 0, len(ids)
    lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    ends = np.cumsum(lengths)
    while start < n:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + CHUNK_BYTES, "right")))
        part = texts.slice(start, stop - start).cast(pa.large_binary()).to_pylist()
        yield ids[start:stop], [b"" if x is None else x for x in part]
        start = stop


# --- packed exchanges ----------------------------------------------------------------------------------------------


def narrow(values: np.ndarray) -> bytes:
    """Integers as bytes, in 4 bytes each where they fit; the first byte says which."""
    if len(values) and values.dtype == np.int64 and -(1 << 31) <= values.min() and values.max() < 1 << 31:
        return b"4" + values.astype("<i4").tobytes()
    return b"8" + values.astype("<i8").tobytes()


def widen(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<i4" if blob[:1] == b"4" else "<i8", offset=1).astype(np.int64)


def by_key(key: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The arrays' slices for each distinct key."""
    if not len(key):
        return
    order = np.argsort(key, kind="stable")
    key = key[order]
    arrays = tuple(a[order] for a in arrays)
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    for s, e in zip(starts, [*starts[1:], len(key)]):
        yield int(key[s]), [a[s:e] for a in arrays]


def block_of(id_col: str, text_col: str, blocks: int):
    """The block of each row, by a hash of id and text, so that rows of one id, or without any, share no block."""
    return F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)), F.lit(blocks)).cast("long")


def grouped_runs(batches: Iterable[pa.RecordBatch], key: int = 0) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows of sorted batches, run by run of the key column."""
    now, held = None, []
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        for s, e in zip(starts, [*starts[1:], len(keys)]):
            k = int(keys[s])
            if held and k != now:
                yield now, held
                held = []
            now = k
            held.append(batch.slice(s, e - s))
    if held:
        yield now, held


def blobs(parts: list[pa.RecordBatch], column: int) -> list[bytes]:
    return [x for p in parts for x in p.column(column).to_pylist()]


def local_ranks(keys: np.ndarray, seen: dict[int, int]) -> np.ndarray:
    """How many equal keys came before each; `seen` goes on from batch to batch."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(keys)))
    first = np.array([seen.get(int(k), 0) for k in ranked[starts]], np.int64)
    out = np.empty(len(keys), np.int64)
    out[order] = np.arange(len(keys)) - np.repeat(starts, sizes) + np.repeat(first, sizes)
    for k, f, n in zip(ranked[starts], first, sizes):
        seen[int(k)] = int(f + n)
    return out


def numbered_offsets(ranked: DataFrame, key: str, name: str) -> DataFrame:
    """Adds `name`, a gapless number from 0 within each `key` over the whole table.

    The rows carry the task that made them (`_task`) and their rank in it (`_rank`), so that no key is gathered in one
    task: only the tasks' counts meet, and each row looks up its task's offset.
    """
    before = Window.partitionBy(key).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranked.groupBy(key, "_task").agg(F.count(F.lit(1)).alias("_n")).select(key, "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return ranked.join(offsets, [key, "_task"]).withColumn(name, F.col("_offset") + F.col("_rank")).drop("_task", "_rank", "_offset")


def number_within(df: DataFrame, key: str, name: str) -> DataFrame:
    """Adds `name`, a gapless number from 0 within each value of the integer column `key`."""
    at = df.columns.index(key)
    schema = T.StructType([*df.schema.fields, T.StructField("_task", T.LongType()), T.StructField("_rank", T.LongType())])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            ranks = local_ranks(batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64), seen)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(ranks), task, np.int64)), pa.array(ranks)], [*batch.schema.names, "_task", "_rank"])

    return numbered_offsets(cut(df.mapInArrow(rank, schema)), key, name)
