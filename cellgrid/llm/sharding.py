"""Sharding by a k-d tree over document metadata.

Equal texts form one unit, which has a point (least id, size, language, source, each scaled to 0..1) and a weight, its
bytes. The tree splits every node along its widest dimension at the weighted quantile that gives each side its share of
the target bytes, until a leaf holds one shard's. The quantiles are found by distributed histograms that are refined until the cut falls between two
units, so nothing but a histogram of fixed size reaches the driver. Units of over a hundredth of a shard would tilt any
cut: these few (at most a hundred a shard) are dealt first, heaviest to the emptiest shard, and the tree's targets
allow for them. A unit larger than a shard is split by a hash of the id, since otherwise no law of equal bytes can hold.

Null text: as empty. Null ids, languages and sources are points of their own. An empty table gives an empty result;
rows with equal ids are placed one by one; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.common import cut, number_within, pick

#: The share of a shard's bytes from which a unit is dealt by its weight.
HEAVY = 0.01
BITS, STEP_BITS = 62, 12
DIMENSIONS = ("id", "size", "lang", "source")


def _unit_interval(c: Column) -> Column:
    return (F.xxhash64(c).cast("double") / F.lit(2.0**64)) + 0.5


def _points(units: DataFrame) -> DataFrame:
    """Adds k_<dimension>: 31 bits of the scaled value, then 31 bits of a hash that breaks ties."""
    edge = units.agg(F.min("id").alias("a"), F.max("id").alias("b"), F.min("size").alias("c"), F.max("size").alias("d")).first()
    lo, hi = float(edge["a"] or 0), float(edge["b"] or 0)
    small, large = float(edge["c"] or 1), float(edge["d"] or 1)
    scaled = {
        "id": (F.coalesce(F.col("id").cast("double"), F.lit(hi)) - lo) / max(hi - lo, 1.0),
        "size": F.log(F.col("size") / small) / max(math.log(large / small), 1e-9),
        "lang": _unit_interval(F.coalesce("lang", F.lit(""))),
        "source": _unit_interval(F.coalesce("source", F.lit(""))),
    }
    tie = F.pmod(F.xxhash64("unit", "part", F.lit("tie")), F.lit(1 << 31))
    for name, x in scaled.items():
        units = units.withColumn(f"x_{name}", x).withColumn(f"k_{name}", F.least(F.floor(x * (1 << 31)), F.lit((1 << 31) - 1)).cast("long") * F.lit(1 << 31) + tie)
    return units


def _node(cuts: dict[int, tuple[str, int]]) -> Column:
    """The node of the tree so far in which a point lies: children of n are 2n and 2n + 1."""
    node = F.lit(1)
    for level in range(max(cuts, default=0).bit_length()):
        own = [n for n in cuts if n >> level == 1]
        node = reduce(lambda other, n: F.when(node == n, F.lit(2 * n) + (F.col(f"k_{cuts[n][0]}") >= cuts[n][1]).cast("int")).otherwise(other), own, node)
    return node


def shape(shards: int) -> dict[int, int]:
    """How many shards each node of the tree stands for; a node of one is a leaf."""
    counts = {1: shards}
    for n in (x for level in range(shards.bit_length() + 1) for x in range(1 << level, 2 << level)):
        if counts.get(n, 1) > 1:
            counts[2 * n], counts[2 * n + 1] = (counts[n] + 1) // 2, counts[n] // 2
    return counts


def leaves_below(counts: dict[int, int], n: int) -> list[int]:
    """The leaves of a node, from left to right."""
    return [n] if counts[n] == 1 else leaves_below(counts, 2 * n) + leaves_below(counts, 2 * n + 1)


def tree(points: DataFrame, room: dict[int, float], counts: dict[int, int]) -> dict[int, tuple[str, int]]:
    """Cuts (dimension, first key of the right side) of all inner nodes; room: the bytes that each leaf may still take."""
    cuts: dict[int, tuple[str, int]] = {}
    for level in range(max(counts).bit_length() - 1):
        inner = [n for n in counts if n >> level == 1 and counts[n] > 1]
        noded = points.withColumn("node", _node(cuts))
        wide = noded.filter(F.col("node").isin(inner)).groupBy("node").agg(F.sum("weight").alias("w"), *[F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("weight") * F.col(f"x_{d}") ** 2) / F.sum("weight") - (F.sum(F.col("weight") * F.col(f"x_{d}")) / F.sum("weight")) ** 2)).alias(d) for d in DIMENSIONS]).collect()
        open_: dict[int, dict] = {}
        for r in wide:
            n = r["node"]
            left, right = (sum(room[x] for x in leaves_below(counts, child)) for child in (2 * n, 2 * n + 1))
            open_[n] = {"dim": max(DIMENSIONS, key=lambda d: (r[d], d)), "goal": r["w"] * (left / (left + right) if left + right > 0 else 0.5), "below": 0.0, "lo": 0, "shift": BITS}
        for n in inner:
            if n not in open_:
                cuts[n] = ("id", 1 << BITS)  # no unit is there
        while open_:
            expr = lambda of: reduce(lambda other, n: F.when(F.col("node") == n, of(open_[n])).otherwise(other), open_, F.lit(None))  # noqa: E731, B023
            key = expr(lambda o: F.col(f"k_{o['dim']}"))
            shift = {n: max(0, o["shift"] - STEP_BITS) for n, o in open_.items()}
            low = next(iter(shift.values()))  # all nodes of a level are refined in step
            within = noded.withColumn("key", key).filter((F.col("key") >= expr(lambda o: F.lit(o["lo"]))) & (F.col("key") < expr(lambda o: F.lit(o["lo"] + (1 << o["shift"])))))
            bins = within.groupBy("node", F.shiftright("key", low).alias("bin")).agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n"), F.min("key").alias("first"), F.max("key").alias("last")).collect()
            for n in list(open_):
                o = open_[n]
                below, done = o["below"], None
                for b in sorted((b for b in bins if b["node"] == n), key=lambda b: b["bin"]):
                    if below + b["w"] >= o["goal"]:
                        if b["first"] == b["last"] or low == 0:  # one unit: the nearer side of it
                            done = b["first"] if o["goal"] - below < b["w"] / 2 else b["last"] + 1
                        else:
                            o |= {"below": below, "lo": b["bin"] << low, "shift": low}
                        break
                    below += b["w"]
                else:
                    done = o["lo"] + (1 << o["shift"])
                if done is not None:
                    cuts[n] = (o["dim"], done)
                    del open_[n]
    return cuts


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """docs: (id, text, lang, source). Returns (id, size, text_crc32, shard, slot). A node of the tree stands for a number
    of shards and gives each side its half of them, until one is left, whose bytes are the target."""
    if shards < 1:
        raise ValueError("there must be a shard")
    counts = shape(shards)
    leaves = leaves_below(counts, 1)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = pick(docs, "id", "text", "lang", "source").select(F.col("id").cast("long"), "lang", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("unit"))
    rows = cut(rows)
    units = rows.groupBy("unit").agg(F.sum("size").alias("weight"), F.first("size").alias("size"), F.min("id").alias("id"), F.min("lang").alias("lang"), F.min("source").alias("source"))
    target = (rows.agg(F.sum("size").alias("s")).first()["s"] or 0) / shards
    # a unit above the target is split into parts of an eighth of it
    units = units.withColumn("parts", F.when(F.col("weight") > target, F.ceil(F.col("weight") * 8 / max(target, 1.0))).otherwise(F.lit(1)).cast("int"))
    whole = cut(units)
    split = {bytes(r["unit"]): r["parts"] for r in whole.filter("parts > 1").select("unit", "parts").collect()}  # fewer than `shards`
    part = reduce(lambda other, u: F.when(F.col("unit") == F.lit(u), F.pmod(F.xxhash64("id", "lang", "source"), F.lit(split[u]))).otherwise(other), split, F.lit(0)).cast("long")
    parted = rows.withColumn("part", part)
    if split:
        atoms = parted.groupBy("unit", "part").agg(F.sum("size").alias("weight"), F.first("size").alias("size"), F.min("id").alias("id"), F.min("lang").alias("lang"), F.min("source").alias("source"))
    else:
        atoms = whole.drop("parts").withColumn("part", F.lit(0).cast("long"))
    points = cut(_points(atoms))
    heavy = points.filter(F.col("weight") > HEAVY * target).select("unit", "part", "weight").collect()  # 1 / HEAVY a shard at most
    load = [0.0] * shards
    dealt = []
    for r in sorted(heavy, key=lambda r: (-r["weight"], bytes(r["unit"]), r["part"])):
        at = min(range(shards), key=lambda s: (load[s], s))
        load[at] += r["weight"]
        dealt.append((bytes(r["unit"]), r["part"], at))
    light = points.filter(F.col("weight") <= HEAVY * target)
    cuts = tree(light, {leaf: max(0.0, target - x) for leaf, x in zip(leaves, load)}, counts)
    number = F.element_at(F.create_map(*[F.lit(x) for s, leaf in enumerate(leaves) for x in (leaf, s)]), _node(cuts))
    placed = light.select("unit", "part", number.cast("int").alias("shard"))
    if dealt:
        placed = placed.unionByName(docs.sparkSession.createDataFrame(dealt, "unit binary, part long, shard int"))
    found = parted.join(placed, ["unit", "part"]).select("id", "size", "text_crc32", "shard")
    return number_within(found, "shard", "slot").select("id", "size", "text_crc32", "shard", "slot")
