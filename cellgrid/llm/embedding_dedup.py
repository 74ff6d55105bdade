"""Near-duplicate vectors by cross-polytope hashing.

A table hashes a vector by two pseudo-random rotations (three rounds of signs and a fast Hadamard transform each); the
name of the largest coordinate, with its sign, is a rotation's code. A vector enters the bucket of its two codes and,
as a second probe, the bucket in which the least certain code is replaced by its runner-up. Vectors that meet in a
bucket are compared by their exact cosine. With eight tables a pair of cosine 0.98 misses all with a probability of
about 1e-7 at 64 dimensions and 1e-5 at 768 and 1,024, and a nearer pair with less.

Equal vectors are one class with a multiplicity. Every pair of classes is counted in the first bucket that both share,
so counts need no second pass, and a bucket reports only counts and a spanning forest of its links, never pairs. Large
buckets are dealt into pairs of blocks, so a task holds two blocks at most.

Vectors are only compared if their labels are equal and not null and their sizes are equal. Vectors that are null,
empty or zero, or hold null or non-finite components, link with nothing and are their own component. Rows with equal
ids are separate vectors; a null id is larger than every id. An empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.common import NULL_ID, cut, grouped_runs, pick, shuffle_partitions, splittable
from cellgrid.llm.components import components

TABLES = 8
CODES = 2
#: Rows of a block; two blocks meet in a task.
BLOCK = 1500


def hadamard(y: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of the columns, in place; their size is a power of two."""
    size, n = y.shape
    step = 1
    while step < size:
        v = y.reshape(size // (2 * step), 2, step, n)
        low = v[:, 0] - v[:, 1]
        v[:, 0] += v[:, 1]
        v[:, 1] = low
        step *= 2
    return y


def bucket_keys(x: np.ndarray, tables: int = TABLES, seed: int = 20) -> np.ndarray:
    """[vector, table, probe]: the names of the two buckets of each table. Vectors of over 16,384 numbers don't fit."""
    n, d = x.shape
    size = max(2, 1 << (d - 1).bit_length())
    padded = np.zeros((size, n))
    padded[:d] = x.T
    out = np.empty((n, tables, 2), np.int32)
    rows = np.arange(n)
    for t in range(tables):
        best, other, gap = [], [], []
        for k in range(CODES):
            rng = np.random.default_rng((seed, t, k, size))
            y = padded.copy()
            for _ in range(3):
                y *= rng.choice((-1.0, 1.0), size)[:, None]
                hadamard(y)
            strength = np.abs(y)
            first = strength.argmax(axis=0)
            top = strength[first, rows].copy()
            strength[first, rows] = -1
            second = strength.argmax(axis=0)
            best.append(2 * first + (y[first, rows] > 0))
            other.append(2 * second + (y[second, rows] > 0))
            gap.append((top - strength[second, rows]) / np.maximum(top, 1e-300))
        base = 2 * size
        out[:, t, 0] = best[0] * base + best[1]
        swap = gap[0] <= gap[1]
        out[:, t, 1] = np.where(swap, other[0] * base + best[1], best[0] * base + other[1])
    return out


def unit(blobs: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _links(buckets: DataFrame, threshold: float, tables: int) -> DataFrame:
    """(node, links, u): how many vectors each class links with, and a spanning forest of each bucket's links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in grouped_runs(batches):
            rows = pa.Table.from_batches(parts)
            tab, key = rows.column("tab")[0].as_py(), rows.column("key")[0].as_py()
            side = rows.column("side").to_numpy()
            nodes, times = rows.column("node").to_pylist(), rows.column("times").to_numpy()
            x = unit(rows.column("x").to_pylist())
            n = len(nodes)
            inner = not (side == 1).any() or not (side == 0).any()
            codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), "<i4").reshape(n, tables, 2)
            links = np.zeros(n, np.int64)
            label = np.arange(n)
            us, vs = [], []
            for s in range(0, n, 256):
                near = x[s : s + 256] @ x.T >= threshold
                i, j = np.nonzero(near)
                i += s
                keep = i < j
                if rows.column("cross")[0].as_py() and not inner:
                    keep &= side[i] != side[j]
                elif rows.column("cross")[0].as_py():
                    keep &= False
                i, j = i[keep], j[keep]
                if not len(i):
                    continue
                first = np.zeros(len(i), bool)
                open_ = np.ones(len(i), bool)
                for t in range(tab + 1):  # the first table, and in it the least key, that the two share
                    a, b = codes[i, t], codes[j, t]
                    least = np.full(len(i), np.iinfo(np.int32).max)
                    for p in range(2):
                        for q in range(2):
                            least = np.where(a[:, p] == b[:, q], np.minimum(least, a[:, p]), least)
                    if t == tab:
                        first = open_ & (least == key)
                    open_ &= least == np.iinfo(np.int32).max
                i, j = i[first], j[first]
                np.add.at(links, i, times[j])
                np.add.at(links, j, times[i])
                us.append(i)
                vs.append(j)
            if not us:
                continue
            i, j = np.concatenate(us), np.concatenate(vs)
            while len(i):  # least labels, with jumps
                low = np.minimum(label[i], label[j])
                before = label.copy()
                np.minimum.at(label, label[i], low)
                np.minimum.at(label, label[j], low)
                np.minimum.at(label, i, low)
                np.minimum.at(label, j, low)
                label = label[label]
                if (label == before).all():
                    break
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array([nodes[k] for k in some], pa.binary()), pa.array(links[some]), pa.array([nodes[label[k]] for k in some], pa.binary())], ["node", "links", "u"])

    ordered = buckets.repartition(shuffle_partitions(buckets.sparkSession), "group").sortWithinPartitions("group")
    return ordered.select("group", "tab", "key", "side", "cross", "node", "times", "x", "codes").mapInArrow(run, "node binary, links long, u binary")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, tables: int = TABLES, block: int = BLOCK) -> DataFrame:
    """vectors: (id, embedding, label). Returns (id, n_links, component_id, kept), a row for each vector."""
    rows = pick(vectors, "id", "embedding", "label").withColumn("id", F.col("id").cast("long"))
    x = F.transform(F.col("embedding").cast("array<double>"), lambda v: v + F.lit(0.0))
    fit = F.col("label").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("x", lambda v: v != 0)
    rows = rows.select("id", "label", x.alias("x")).withColumn("fit", F.coalesce(fit, F.lit(False)))
    rows = rows.withColumn("node", F.when(F.col("fit"), F.unhex(F.md5(F.concat_ws(",", F.col("label").cast("string"), F.col("x").cast("array<string>")).cast("binary")))))
    classes = rows.filter("fit").groupBy("node").agg(F.min(F.coalesce("id", F.lit(int(NULL_ID)))).alias("id"), F.count(F.lit(1)).alias("times"), F.first("label").alias("label"), F.first("x").alias("x"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            # scaled by the largest component, so that squares neither overflow nor vanish
            vecs = [np.asarray(v, "<f8") for v in batch.column(4).to_pylist()]
            blobs = [(v / np.abs(v).max()).tobytes() for v in vecs]
            sizes = np.array([len(v) for v in vecs])
            codes: list[bytes] = [b""] * len(vecs)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                for at in range(0, len(rows), 1000):
                    part = rows[at : at + 1000]
                    for i, c in zip(part, bucket_keys(unit([blobs[i] for i in part]), tables)):
                        codes[i] = c.tobytes()
            keys = [np.frombuffer(c, "<i4") for c in codes]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(blobs, pa.binary()), pa.array(codes, pa.binary()), pa.array(keys, pa.list_(pa.int32()))], ["node", "id", "times", "space", "x", "codes", "keys"])

    space = F.xxhash64(F.col("label").cast("string"), F.size("x")).alias("space")
    classes = cut(classes.select("node", "id", "times", space, "x").mapInArrow(hashed, "node binary, id long, times long, space long, x binary, codes binary, keys array<int>"), 20_000)
    # a row for each class, table and probe; the vectors come along only where a bucket has several
    keyed = classes.select("space", "node", F.posexplode("keys").alias("at", "key")).select("space", (F.col("at") / 2).cast("int").alias("tab"), "key", "node")
    group = ["space", "tab", "key"]
    sizes = keyed.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    keyed = keyed.join(splittable(sizes), group).withColumn("blocks", F.ceil(F.col("n") / block).cast("long")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    other = keyed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    dealt = other.select(F.xxhash64("space", "tab", "key", low, high).alias("group"), "tab", "key", (F.col("own") == high).cast("int").alias("side"), (low != high).alias("cross"), "node")
    grouped = dealt.join(classes.select("node", "times", "x", "codes"), "node")
    found = cut(_links(grouped, threshold, tables))
    reached = components(found.select(F.col("node").alias("u"), F.col("u").alias("v")))
    labelled = classes.select("node", "id").join(reached, "node", "left").select("node", "id", F.coalesce("component", "node").alias("component"))
    least = labelled.groupBy("component").agg(F.min("id").alias("component_id"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = labelled.join(splittable(least), "component").join(classes.select("node", "times"), "node").join(counts, "node", "left").select("node", "component_id", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    joined = rows.select("id", "node").join(known, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.when(F.col("component_id") != int(NULL_ID), F.col("component_id")))
    return joined.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id").eqNullSafe(component), F.lit(True)).alias("kept"))
