"""Near-duplicate documents by MinHash with tensored tables.

A document's set is its distinct word shingles. Two small collections of signatures are computed, each of n
signatures of three minhashes. A table is a pair, one signature of either collection, so n² tables of six minhashes
cost only 6 * n minhashes instead of 6 * n². The threshold sets n (12 for 0.85, 16 for 0.80) so that a pair exactly at
it misses all tables with a probability of MISSED at most; nearer pairs with less.

Signatures that no other set has are dropped before tables are formed, first of one collection and then, of the sets
that are left, of the other; so a document without relatives stays n small rows. Sets in a table are first compared with
one leader, and linked sets become components. Then the sets that meet members of other components in a table are
compared with these too, except within the largest component: so no link between components is lost, while a table of
many alike sets costs a line of comparisons and not a square. Before full sets travel for that, a sketch (a byte of every
minhash) and the sets' sizes tell which can be linked at all; a linked pair fails that test with SKETCH_MISSED at most.
Every link is confirmed on the full sets.

Only the texts of sets that meet another in a table are read again. Their ids are broadcast if there are at most
`common.BROADCAST_ROWS` of them, and joined by a shuffle if there are more.

Equal sets are one node. Null texts and texts without words have empty sets, link with nothing and are their own
component. Rows with equal ids are separate documents; a null id is larger than every id. An empty table gives an empty
result; other columns are ignored. Shingles are compared by 64-bit hashes, sets of them are named by 128-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.common import NULL_ID, blobs, cut, few, grouped_runs, mix, pick, release, remix, shuffle_partitions, splittable, text_chunks, words_of
from cellgrid.llm.components import components

PARTS = 12
PER_PART = 3
#: The probability at most of missing a pair at the threshold.
MISSED = 2.2e-5
#: The probability at most that the sketches of a pair at the threshold look too different.
SKETCH_MISSED = 1e-6
#: Sets of a block, and shingles of all its sets, about; two blocks meet in a task.
BLOCK, BLOCK_SHINGLES = 300, 1 << 17


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, joined, and where each text's begin (and the end)."""
    _, _, _, flat, counts = words_of(texts, lower=True)
    owner = np.repeat(np.arange(len(texts)), counts)
    rows, values = [], []
    n = len(flat) - words + 1
    if n > 0:
        whole = owner[:n] == owner[words - 1 :]
        value = flat[:n]
        for k in range(1, words):
            value = mix(value, flat[k : k + n], k)
        rows.append(owner[:n][whole])
        values.append(value[whole])
    for i in np.flatnonzero((counts > 0) & (counts < words)):
        rows.append(np.array([i]))
        values.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(texts[i].lower().split()))], np.uint64))
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    fresh = np.concatenate(([True], (row[1:] != row[:-1]) | (value[1:] != value[:-1])))
    row, value = row[fresh], value[fresh]
    return value, np.searchsorted(row, np.arange(len(texts) + 1))


def parts_for(percent: int) -> int:
    """Signatures of a collection, PARTS at least: a pair is missed if either collection has none in common."""
    alike = (max(percent, 1) / 100) ** PER_PART
    return PARTS if alike >= 1 else max(PARTS, int(np.ceil(np.log(MISSED / 2) / np.log1p(-alike))))


def _factors(parts: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(31)
    n = 2 * parts * PER_PART
    return rng.integers(1 << 63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(1 << 63, size=n, dtype=np.uint64)


def signatures(values: np.ndarray, starts: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """[set, part]: the first half of the parts is one collection, the second the other. Sets must not be empty."""
    return minhashes(values, starts, parts)[0]


def minhashes(values: np.ndarray, starts: np.ndarray, parts: int = PARTS) -> tuple[np.ndarray, np.ndarray]:
    """The signatures, and a sketch of a byte of each minhash."""
    factors, masks = _factors(parts)
    out = np.zeros((len(starts) - 1, 2 * parts), np.uint64)
    sketch = np.zeros((len(starts) - 1, 2 * parts * PER_PART), np.uint8)
    for k in range(2 * parts * PER_PART):
        least = np.minimum.reduceat((values ^ masks[k]) * factors[k], starts[:-1])
        sketch[:, k] = (remix(least) & np.uint64(255)).astype(np.uint8)
        out[:, k // PER_PART] = remix(out[:, k // PER_PART] * np.uint64(0x9E3779B97F4A7C15) + least)
    return out, sketch


def least_agreement(n: int, percent: int) -> int:
    """Of n minhashes, how many a pair at the threshold shares at least, but for SKETCH_MISSED."""
    p, tail = percent / 100, 0.0
    if p >= 1:
        return n
    for k in range(n + 1):
        tail += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if tail > SKETCH_MISSED:
            return k
    return n


def _measure(docs: DataFrame, words: int, parts: int) -> DataFrame:
    """docs: (id, text, others). (id, n_shingles, node, sketch, parts, others)"""
    others = docs.schema.fields[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids, texts in text_chunks(batch, 0, 1):
                values, starts = shingle_sets(texts, words)
                sizes = np.diff(starts)
                some = np.flatnonzero(sizes)
                node, drawn, sig = [None] * len(ids), [None] * len(ids), [None] * len(ids)
                if len(some):
                    got, sketch = minhashes(values, np.append(starts[some], len(values)), parts)
                    for i, s, d in zip(some, got.view(np.int64), sketch):
                        node[i] = xxhash.xxh3_128_digest(values[starts[i] : starts[i + 1]].tobytes())
                        drawn[i], sig[i] = d.tobytes(), s
                part = batch.slice(at, len(ids))
                columns = [part.column(0), pa.array(sizes.astype(np.int64)), pa.array(node, pa.binary()), pa.array(drawn, pa.binary()), pa.array(sig, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*columns, *part.columns[2:]], ["id", "n_shingles", "node", "sketch", "parts", *part.schema.names[2:]])
                at += len(ids)

    return docs.mapInArrow(run, ", ".join(["id long, n_shingles long, node binary, sketch binary, parts array<long>", *[f"{f.name} {f.dataType.simpleString()}" for f in others]]))


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(node, set): the sorted shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in text_chunks(batch, 0, 1):
                values, starts = shingle_sets(texts, words)
                sets = [values[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["node", "set"])

    return docs.mapInArrow(run, "node binary, set binary")


def _shared(rows: DataFrame) -> DataFrame:
    """rows: (num, sig). Those whose signature another set has, with the number of sets that have it."""
    several = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    return rows.join(splittable(several), "sig").select("num", "sig", "c")


def _members(nodes: DataFrame, parts: int) -> DataFrame:
    """(num, one, two, w, n, sketch): of each set that has signatures of both collections in common with others, these
    signatures, a weight that is large for sets amid many others, and what tells links."""
    one = cut(_shared(nodes.select("num", F.explode(F.slice("parts", 1, parts)).alias("sig"))))
    left = nodes.select("num", F.slice("parts", parts + 1, parts).alias("parts")).join(one.select("num").distinct(), "num", "left_semi")
    two = _shared(cut(left.select("num", F.explode("parts").alias("sig"))))
    flagged = one.withColumn("first", F.lit(True)).unionByName(two.withColumn("first", F.lit(False)))
    lists = flagged.groupBy("num").agg(F.collect_list(F.when(F.col("first"), F.col("sig"))).alias("one"), F.collect_list(F.when(~F.col("first"), F.col("sig"))).alias("two"), F.sum("c").alias("w"))  # 2 * parts at most
    return cut(lists.filter("size(two) > 0").join(nodes.select("num", "n", "sketch"), "num"))


def _tables(members: DataFrame) -> DataFrame:
    """(num, w, one, key): the tables of each set, a pair of signatures of either collection."""
    halves = members.select("num", "w", F.explode("one").alias("one"), "two")
    return halves.select("num", "w", "one", F.explode("two").alias("two")).select("num", "w", "one", F.xxhash64("one", "two").alias("key"))


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs: (u, v), few of many u. The linked ones."""
    left = sets.select(F.col("num").alias("u"), F.col("set").alias("a"))
    right = sets.select(F.col("num").alias("v"), F.col("set").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                if len(a) > len(b):
                    a, b = b, a
                common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(b) else 0
                linked.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(linked, pa.bool_()))

    return pairs.join(right, "v").join(left, "u").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _alike(pairs: DataFrame, members: DataFrame, percent: int, n: int) -> DataFrame:
    """Of the pairs (u, v) those that sizes and sketches don't rule out."""
    most = least_agreement(n, percent)
    own = lambda k: members.select(F.col("num").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
    near = pairs.join(own("u"), "u").join(own("v"), "v").filter(F.expr(f"100 * least(nu, nv) >= {percent} * greatest(nu, nv)"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, n) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array((a == b).sum(1) >= most, pa.bool_()))

    return near.select("u", "v", "su", "sv").mapInArrow(run, "u long, v long")


def _dealt(open_: DataFrame) -> DataFrame:
    """open_: (one, num, component, n), sets in tables of several components. Any link between components has an end
    outside the largest component of its signature, so a signature's sets are dealt into blocks of those by blocks of
    all; few outsiders make a line of blocks and not a square. Returns (group, num, component, side, one)."""
    sizes = open_.groupBy("one", "component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"))
    groups = sizes.groupBy("one").agg(F.max_by("component", "m").alias("main"), F.sum("m").alias("all"), F.max("m").alias("top"), F.sum("s").alias("total"), F.max_by("s", "m").alias("most"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    blocks = lambda n, s: F.ceil(F.greatest(n / BLOCK, s / BLOCK_SHINGLES)).cast("long")
    counted = groups.select("one", "main", blocks(F.col("all") - F.col("top"), F.col("total") - F.col("most")).alias("rows"), blocks(F.col("all"), F.col("total")).alias("cols"))
    dealt = open_.join(splittable(counted), "one")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    members = dealt.withColumn("row", every("rows")).withColumn("col", F.pmod(F.xxhash64("num"), F.col("cols"))).withColumn("side", F.lit(0))
    outside = dealt.filter("component != main").withColumn("row", F.pmod(F.xxhash64("num", F.lit("row")), F.col("rows"))).withColumn("col", every("cols")).withColumn("side", F.lit(1))
    return members.unionByName(outside).select(F.xxhash64("one", "row", "col").alias("group"), "num", "component", "side", "one")


def _by_group(rows: DataFrame) -> DataFrame:
    return rows.repartition(shuffle_partitions(rows.sparkSession), "group").sortWithinPartitions("group")


def _possible(dealt: DataFrame, members: DataFrame, percent: int, n: int) -> DataFrame:
    """The rows of a group that may be linked with another of it: sizes and sketches allow it, and they share a table.
    Of the groups in which two sets meet, that of their least signature answers for them."""
    most = least_agreement(n, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in grouped_runs(batches):
            rows = pa.Table.from_batches(held)
            component, side, size = (rows.column(k).to_numpy() for k in ("component", "side", "n"))
            sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, n)
            one = rows.column("ones").to_pylist()
            two = rows.column("twos").to_pylist()
            key = rows.column("one")[0].as_py()
            inside, needed = np.flatnonzero(side == 0), np.zeros(len(side), bool)
            for i in np.flatnonzero(side == 1):
                fits = 100 * np.minimum(size[inside], size[i]) >= percent * np.maximum(size[inside], size[i])
                near = inside[fits & (component[inside] != component[i])]
                near = near[(sketch[near] == sketch[i]).sum(1) >= most]
                if len(near):
                    first, second = set(one[i]), set(two[i])
                    near = [j for j in near.tolist() if min(first.intersection(one[j]), default=None) == key and not second.isdisjoint(two[j])]
                    needed[near] = True
                    needed[i] |= len(near) > 0
            if needed.any():
                chosen = rows.filter(pa.array(needed)).select(["group", "num", "component", "side"]).combine_chunks()
                yield from chosen.to_batches()

    rows = dealt.join(members.select("num", F.col("one").alias("ones"), F.col("two").alias("twos"), "n", "sketch"), "num")
    return _by_group(rows.select("group", "num", "component", "side", "one", "ones", "twos", "n", "sketch")).mapInArrow(run, "group long, num long, component long, side int")


def _rest(open_: DataFrame, members: DataFrame, sets: DataFrame, percent: int, n: int) -> DataFrame:
    """Links between components, a spanning forest of each block's: (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in grouped_runs(batches):
            side = np.array(blobs(held, 3))
            node, component, blob = (blobs(held, k) for k in (1, 2, 4))
            inside, probes = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(inside) or not len(probes):
                continue
            _, label = np.unique(component, return_inverse=True)
            alphabet, flat = np.unique(np.frombuffer(b"".join(blob[i] for i in inside), "<u8"), return_inverse=True)
            sizes = np.fromiter((len(blob[i]) // 8 for i in inside), np.int64, len(inside))
            starts = np.cumsum(sizes) - sizes
            root = list(range(int(label.max()) + 1))

            def find(x: int, root=root) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            us, vs = [], []
            mark = np.zeros(len(alphabet), np.int64)
            for i in probes:
                own = np.frombuffer(blob[i], "<u8")
                at = np.minimum(np.searchsorted(alphabet, own), len(alphabet) - 1)
                at = at[alphabet[at] == own]
                mark[at] = 1
                common = np.add.reduceat(mark[flat], starts)
                mark[at] = 0
                linked = 100 * common >= percent * (len(own) + sizes - common)
                for j in inside[linked & (label[inside] != label[i])]:
                    x, y = find(int(label[i])), find(int(label[j]))
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        us.append(node[i])
                        vs.append(node[j])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    possible = _possible(_dealt(open_), members, percent, n)
    rows = possible.join(sets, "num").select("group", "num", "component", "side", "set")
    return _by_group(rows).mapInArrow(run, "u long, v long")


def _labelled(docs: DataFrame, words: int, percent: int, parts: int) -> DataFrame:
    """docs: (id, text, others). Returns (id, n_shingles, component, least, others) of each row: its component (null for
    an empty set) and the least id of that (null ids as NULL_ID)."""
    spark = docs.sparkSession
    others = docs.columns[2:]
    held = _measure(docs, words, parts).persist(StorageLevel.MEMORY_AND_DISK)
    rows = cut(held.drop("sketch", "parts"))
    distinct = held.filter("node is not null").groupBy("node").agg(F.min(F.coalesce("id", F.lit(int(NULL_ID)))).alias("id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("parts").alias("parts"))
    nodes = cut(distinct.withColumn("num", F.monotonically_increasing_id()))
    held.unpersist()
    release(spark)
    members = _members(nodes, parts)
    sketch = 2 * parts * PER_PART
    tables = _tables(members)
    # of a table the member that meets most others leads: copies tend to be near it
    leaders = tables.groupBy("key").agg(F.max(F.struct("w", "num")).alias("lead"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("key", F.col("lead.num").alias("u"))
    met = tables.select("key", F.col("num").alias("v")).join(splittable(leaders), "key").filter("u != v").select("u", "v").distinct()
    first = cut(_alike(met, members, percent, sketch))
    wanted = cut(nodes.join(members.select("num"), "num").select("num", "node", "id"))
    texts = docs.select("id", "text").join(few(wanted.select(F.col("id").alias("wanted")).distinct()), F.coalesce("id", F.lit(int(NULL_ID))) == F.col("wanted"), "left_semi")
    found = _sets(texts, words).join(few(wanted.select("num", "node")), "node").groupBy("num").agg(F.first("set").alias("set"))
    sets = cut(found, 5_000)
    release(spark)
    links = cut(_compared(first, sets, percent))
    label = components(links, "num")
    # what the leaders have not joined: members of different components that meet in a table
    placed = tables.join(label, "num", "left").select("key", "one", "num", F.coalesce("component", "num").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a != b").select("key")
    open_ = cut(placed.join(splittable(mixed), "key").select("one", "num", "component").distinct().join(members.select("num", "n"), "num"))
    label = components(links.unionByName(_rest(open_, members, sets, percent, sketch)), "num")
    known = nodes.join(label, "num", "left").select("node", "id", F.coalesce("component", "num").alias("component"))
    least = known.groupBy("component").agg(F.min("id").alias("least"))
    known = known.join(splittable(least), "component").select("node", "component", "least")
    release(spark)
    return rows.join(known, "node", "left").select("id", "n_shingles", "component", F.when(F.col("node").isNull(), F.coalesce("id", F.lit(int(NULL_ID)))).otherwise(F.col("least")).alias("least"), *others)


def _is_kept():
    return F.coalesce("id", F.lit(int(NULL_ID))) == F.col("least")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, parts: int | None = None) -> DataFrame:
    """docs: (id, text). Links documents with 100 * intersection >= percent * union of their sets. Returns (id,
    n_shingles, component_id, kept), a row for each document; component_id is the least id that links can reach."""
    docs = pick(docs, "id", "text").select(F.col("id").cast("long"), "text")
    got = _labelled(docs, words, int(percent), parts or parts_for(int(percent)))
    return got.select("id", "n_shingles", F.when(F.col("least") != int(NULL_ID), F.col("least")).alias("component_id"), _is_kept().alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs: rows with doc_id and text among their columns. One document of every group of linked ones, that with the
    least id, unchanged; of several with that id, one. Documents with an empty set stay, but for rows of the same id and
    text, of which one stays.

    The rows that go are known by id and two hashes of the text. They are broadcast if there are at most `common.BROADCAST_ROWS`,
    so that texts stay where they are; with more, texts are joined to them by a shuffle.
    """
    names = docs.columns
    hashes = {"_a": F.xxhash64("text"), "_b": F.xxhash64(F.lit(1), F.col("text"))}
    plain = docs.select(F.col("doc_id").cast("long").alias("id"), "text").withColumns(hashes)
    got = cut(_labelled(plain, words, int(percent), parts_for(int(percent))))
    one = F.coalesce(F.col("component"), F.xxhash64("id", "_a", "_b"))
    staying = got.filter(_is_kept()).select(F.col("component").isNull().alias("empty"), one.alias("one"), F.coalesce("id", F.lit(int(NULL_ID))).alias("id"), "_a", "_b")
    several = staying.groupBy("empty", "one").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("_a", "_b")).alias("best")).filter("c > 1").drop("c")
    again = staying.join(splittable(several), ["empty", "one"]).select("id", "_a", "_b", (F.col("best") == F.struct("_a", "_b")).alias("_again"))
    gone = got.filter(~_is_kept()).select(F.coalesce("id", F.lit(int(NULL_ID))).alias("id"), "_a", "_b", F.lit(False).alias("_again"))
    marks = cut(gone.unionByName(again).distinct().withColumnRenamed("id", "_id"))
    keyed = docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NULL_ID))), **hashes})
    marked = keyed.join(few(marks), ["_id", "_a", "_b"], "left")
    stays = marked.filter("_again is null").select(*names)
    if marks.filter("_again").isEmpty():  # no repeated rows, so no second look at the texts
        return stays
    return stays.unionByName(marked.filter("_again").dropDuplicates(["_id", "_a", "_b"]).select(*names))
