"""Substring dedup by recompression.

Words are renamed in rounds as in recompression of words: a round first replaces each run of equal symbols by a name
for (symbol, length), then splits the alphabet into a left and a right half by a hash of the names and replaces each
pair left-right by a name for the pair. A name is a hash of the round and of what it replaces, so all workers name
alike without asking each other. Equal stretches of text get equal symbols but for a few at their borders; every symbol
therefore carries its context, the words from which it follows.

Rounds go on until a text is one symbol (or DEEP of them are done). High symbols, which stand for two windows' words or
more, reveal long repeats: documents exchange them by 96 bits of a hash of the words they stand for, which verifies them,
and where a document with a smaller id has the same symbol, all windows within it are known to be repeated.

For shorter repeats and the borders of long ones, low symbols serve as anchors: of the symbols of the second round whose
context lies within a window, the one whose context has the least hash is the window's anchor, so equal windows have
equal anchors, and neighbouring windows mostly share one. Anchors travel with the high symbols; those that only one
document has end there. Windows with a shared anchor that no high symbol has settled are then exchanged themselves, by
128-bit hashes of their words, which confirms or refutes the repeat. The document with the least id of all that have a
window always sends it, since no symbol can settle it there. A window that also starts in a document with a smaller id
is removed with all its words.

The exchanges pack their entries into arrays by buckets: a symbol, anchor or window enters once for each block of
documents that has it, so a passage that a third of all documents share costs a bucket an entry a block. Blocks of
documents and buckets have a bounded size; more data means more of them.

Null text: no words. Texts with fewer words than a window lose nothing. Rows with equal ids are separate documents that
don't take words from each other, as neither id is smaller; a null id is larger than every id. An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.common import block_of, blobs, bucket_count, by_key, cut, grouped_runs, mix, narrow, pick, release, remix, shuffle_partitions, text_bytes, text_chunks, widen, words_of

WINDOW = 13
#: Rounds whose symbols are anchors, and all rounds.
ROUNDS, DEEP = 2, 48
#: Text of a block of documents and of a bucket of anchors, in bytes.
BLOCK_BYTES = 16 << 20


class Powers:
    """Powers of an odd number and of its inverse, modulo 2^64."""

    def __init__(self, base: int):
        self.factors = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            self.up, self.down = (np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, f)))) for f in self.factors)
        return self.up[:n], self.down[:n]


_FIRST, _SECOND = Powers(0x9E3779B97F4A7C15), Powers(0xD1342543DE82EF95)


class Spans:
    """Hashes of any stretches of a text's words, each from two sums."""

    def __init__(self, words: np.ndarray, powers: Powers):
        up, self.down = powers(len(words) + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[:-1], dtype=np.uint64)))

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return remix((self.sums[hi] - self.sums[lo]) * self.down[lo])


def joined_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes with a separator before each text and after the last, and the separators' places."""
    _, _, _, hashes, counts = words_of(texts)
    breaks = np.concatenate(([0], np.cumsum(counts + 1)))
    flat = np.zeros(len(hashes) + len(breaks), np.uint64)
    inside = np.ones(len(flat), bool)
    inside[breaks] = False
    flat[inside] = hashes
    return flat, breaks


def rounds(words: np.ndarray, breaks: np.ndarray, n_rounds: int = ROUNDS, contexts: int = ROUNDS) -> Iterator[tuple[np.ndarray, ...]]:
    """Of every round: the symbols; of each the first word of its context and the word after that (up to the round
    `contexts`, then None); its own first word, and whether the round made it. All places rise. Ends where each text is
    one symbol."""
    name = words
    own = lo = np.arange(len(words))
    hi = own + 1
    apart = np.zeros(len(words), bool)  # separators stay alone in all rounds
    apart[breaks] = True
    yield name, lo, hi, own, np.ones(len(words), bool)
    for k in range(1, n_rounds + 1):
        if len(name) <= 2 * len(breaks) and not (~apart[1:] & ~apart[:-1]).any():
            return
        if k > contexts:
            lo = hi = None
        # runs: a run is whole only if its neighbours are known
        same = name[1:] == name[:-1]
        same &= ~(apart[1:] | apart[:-1])
        made = np.zeros(len(name), bool)
        if same.any():
            start = np.flatnonzero(np.concatenate(([True], ~same)))
            size = np.diff(np.append(start, len(name)))
            made = size > 1
            if lo is not None:
                lo, hi = lo[np.maximum(start - 1, 0)], hi[np.minimum(start + size, len(name) - 1)]
            name, apart, own = name[start], apart[start], own[start]
            name[made] = mix(name[made], size[made], 2 * k)
        else:
            name = name.copy()
            if lo is not None:
                lo, hi = np.concatenate((lo[:1], lo[:-1])), np.concatenate((hi[1:], hi[-1:]))
        # pairs of a left and a right symbol
        right = (name * np.uint64(0x9E3779B97F4A7C15 + 2 * k) >> np.uint64(63)).astype(bool)
        left = ~(right | apart)
        right &= ~apart
        first = np.flatnonzero(left[:-1] & right[1:])
        if lo is not None:
            after, before = np.concatenate((hi[1:], hi[-1:])), np.concatenate((lo[:1], lo[:-1]))
            hi, lo = np.where(left, after, hi), np.where(right, before, lo)
        name[first] = mix(name[first], name[first + 1], 2 * k + 1)
        made[first] = True
        keep = np.ones(len(name), bool)
        keep[first + 1] = False
        name, apart, own, made = name[keep], apart[keep], own[keep], made[keep]
        if lo is not None:
            lo, hi = lo[keep], hi[keep]
        yield name, lo, hi, own, made


def starts_of_windows(breaks: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows start, and the text of each."""
    counts = np.diff(breaks) - 1
    n = np.maximum(counts - window + 1, 0)
    owner = np.repeat(np.arange(len(counts)), n)
    first = np.repeat(breaks[:-1] + 1 - np.concatenate(([0], np.cumsum(n)[:-1])), n)
    return first + np.arange(len(owner)), owner


class Parsed(NamedTuple):
    """What the rounds make of some texts: the low rounds, and the places of the high symbols' words."""

    low: list[tuple[np.ndarray, np.ndarray]]
    first: np.ndarray
    last: np.ndarray


def parsed(words: np.ndarray, breaks: np.ndarray, least: int, n_rounds: int = ROUNDS, deep: int = DEEP) -> Parsed:
    """least: the words that a high symbol stands for at least."""
    low, first, last = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, (_, lo, hi, own, made) in enumerate(rounds(words, breaks, deep, n_rounds)):
        if k <= n_rounds:
            low.append((lo, hi))
        end = np.append(own[1:], len(words))
        high = made & (end - own >= least)
        first.append(own[high])
        last.append(end[high])
    return Parsed(low, np.concatenate(first), np.concatenate(last))


def anchors(words: np.ndarray, low: list[tuple[np.ndarray, np.ndarray]], starts: np.ndarray, window: int) -> np.ndarray:
    """The anchor of each window: a hash of a symbol's context. low: of the low rounds, the contexts' places."""
    out = np.zeros(len(starts), np.uint64)
    spans = Spans(words, _FIRST)
    left = np.ones(len(starts), bool)  # windows without an anchor yet
    for k, (lo, hi) in reversed(list(enumerate(low))):
        own = starts[left]
        if not len(own):
            break
        # the symbols whose context starts in the window or after, less those whose context ends beyond it
        first = np.cumsum(np.bincount(lo, minlength=len(words) + 1))[own - 1]
        last = np.cumsum(np.bincount(hi, minlength=len(words) + 2))[own + window]
        fits = last > first
        least = remix(spans(lo, hi) ^ np.uint64(k))
        size = np.where(fits, last - first, 1)
        step = 1
        got = np.full(len(own), np.iinfo(np.uint64).max)
        first, last = np.minimum(first, len(least) - 1), np.minimum(last, len(least))
        while step <= size.max(initial=1):
            now = np.flatnonzero(fits & (size >= step) & (size < 2 * step))
            got[now] = np.minimum(least[first[now]], least[last[now] - step])
            least = np.minimum(least, np.concatenate((least[step:], np.full(min(step, len(least)), np.iinfo(np.uint64).max))))
            step *= 2
        where = np.flatnonzero(left)
        out[where[fits]] = got[fits]
        left[where[fits]] = False
    return out


def span_hashes(words: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each stretch of words."""
    return Spans(words, _FIRST)(first, last), Spans(remix(words ^ np.uint64(0x5851F42D4C957F2D)), _SECOND)(first, last)


def window_hashes(words: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    return span_hashes(words, starts, starts + window)


class Known:
    """Hashes of word stretches (one whole, half of another) with the least id of the documents that have them."""

    def __init__(self, names: np.ndarray, halves: np.ndarray, least: np.ndarray):
        order = np.lexsort((halves, names))
        self.names, self.halves, self.least = names[order], halves[order], least[order]
        same = np.flatnonzero(np.append(self.names[1:] != self.names[:-1], True)) if len(names) else np.zeros(0, np.int64)
        self.twins = int(np.diff(same, prepend=-1).max(initial=1))  # different stretches with one whole hash

    def earlier(self, names: np.ndarray, halves: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which of the stretches a document with a smaller id has."""
        if not len(self.names) or not len(names):
            return np.zeros(len(names), bool)
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        for _ in range(self.twins - 1):
            after = np.minimum(at + 1, len(self.names) - 1)
            at = np.where((self.names[at] == names) & (self.halves[at] != halves) & (self.names[after] == names), after, at)
        return (self.names[at] == names) & (self.halves[at] == halves) & (self.least[at] < ids)


def settled(flat: np.ndarray, first: np.ndarray, last: np.ndarray, ids: np.ndarray, known: Known, window: int) -> np.ndarray:
    """For each word whether the window that starts there lies in a high symbol that an earlier document has."""
    a, b = span_hashes(flat, first, last)
    hit = known.earlier(a, _half(b), ids)
    edge = np.zeros(len(flat) + 1, np.int64)
    np.add.at(edge, first[hit], 1)
    np.add.at(edge, last[hit] - window + 1, -1)
    return np.cumsum(edge)[:-1] > 0


def _half(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(0xFFFFFFFF)).astype("<u4")


def _blob(x: np.ndarray) -> bytes:
    return x.tobytes() if x.dtype != np.int64 else narrow(x)


def _packed(key: np.ndarray, block: int | None, *arrays: np.ndarray) -> Iterator[tuple]:
    """A row for each key, with the block that sends it: hashes as bytes, ids narrowed."""
    for k, slices in by_key(key, *arrays):
        yield (k, block, *map(_blob, slices))


def _rows(rows: list[tuple], columns: int) -> pa.RecordBatch:
    names = ["key", "block", *[f"a{i}" for i in range(columns)]]
    types = [pa.int64(), pa.int64(), *[pa.binary()] * columns]
    parts = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(p, t) for p, t in zip(parts, types)], names)


def _schema(columns: int) -> str:
    return "key long, block long" + "".join(f", a{i} binary" for i in range(columns))


def _extremes(ids: np.ndarray, *names: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct names with the least and greatest id of each."""
    order = np.lexsort(names[::-1])
    names = tuple(x[order] for x in names)
    edge = np.flatnonzero(np.concatenate(([True], np.logical_or.reduce([x[1:] != x[:-1] for x in names]))))
    return (*[x[edge] for x in names], np.minimum.reduceat(ids[order], edge), np.maximum.reduceat(ids[order], edge))


def _u64(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts), "<u8")


def _ids(parts: list[bytes]) -> np.ndarray:
    return np.concatenate([widen(b) for b in parts])


def _blocks(parts: list[pa.RecordBatch]) -> np.ndarray:
    return np.repeat(np.array(blobs(parts, 1), np.int64), [len(x) // 8 for x in blobs(parts, 2)])


def _by_bucket(df: DataFrame, partitions: int) -> DataFrame:
    return df.repartition(partitions, "key").sortWithinPartitions("key")


def _texts(table: pa.Table) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    for ids, texts in text_chunks(table, table.column_names.index("id"), table.column_names.index("text")):
        yield np.array(ids, np.int64), texts


def _send_symbols(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """(key, block, a0 ... a5): a block's anchors, once each, and which of them several of its documents have; its high
    symbols, once each, with the least and greatest id that has them; by bucket of the hash."""

    def run(table: pa.Table) -> pa.Table:
        low, high = [], []
        for ids, texts in _texts(table):
            flat, breaks = joined_words(texts)
            starts, owner = starts_of_windows(breaks, window)
            if len(starts):
                made = parsed(flat, breaks, 2 * window)
                names = anchors(flat, made.low, starts, window)
                fresh = np.concatenate(([True], (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])))
                low.append((names[fresh], ids[owner[fresh]]))
                a, b = span_hashes(flat, made.first, made.last)
                high.append((a, _half(b), ids[np.searchsorted(breaks, made.first, "right") - 1]))
        rows = []
        if low:
            block = table.column("block")[0].as_py()
            names, ids = (np.concatenate(x) for x in zip(*low))
            names, least, most = _extremes(ids, names)
            rows += [(*r, *[b""] * 4) for r in _packed((names % np.uint64(buckets)).astype(np.int64), block, names, (least < most).astype(np.uint8))]
            a, half, ids = (np.concatenate(x) for x in zip(*high))
            if len(a):
                a, half, least, most = _extremes(ids, a, half)
                rows += [(k, own, b"", b"", *r) for k, own, *r in _packed((a % np.uint64(buckets)).astype(np.int64), block, a, half, least, most)]
        return pa.Table.from_batches([_rows(rows, 6)])

    return docs.groupBy("block").applyInArrow(run, _schema(6))


def _shared_symbols(sent: DataFrame, partitions: int) -> DataFrame:
    """(key, block, a0 ... a3): the anchors of a block that more than one document has, and its high symbols that a
    document with a smaller id than one of its own has, with the least id; key is the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in grouped_runs(batches):
            table = pa.Table.from_batches(parts)
            blocks = table.column("block").to_numpy()
            column = lambda k: table.column(f"a{k}").to_pylist()
            rows = []
            blobs_ = column(0)
            names, several = _u64(blobs_), np.frombuffer(b"".join(column(1)), np.uint8)
            block = np.repeat(blocks, [len(x) // 8 for x in blobs_])
            if len(names):
                order = np.argsort(names, kind="stable")
                names, block, several = names[order], block[order], several[order]
                edge = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
                size = np.diff(np.append(edge, len(names)))
                shared = np.repeat((size > 1) | (np.maximum.reduceat(several, edge) > 0), size)
                rows += [(*r, *[b""] * 3) for r in _packed(block[shared], None, names[shared])]
            blobs_ = column(2)
            a, half = _u64(blobs_), np.frombuffer(b"".join(column(3)), "<u4")
            block = np.repeat(blocks, [len(x) // 8 for x in blobs_])
            if len(a):
                low, high = (_ids([x for x in column(k) if x]) for k in (4, 5))
                order = np.lexsort((half, a))
                a, half, block, low, high = (x[order] for x in (a, half, block, low, high))
                edge = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (half[1:] != half[:-1]))))
                least = np.repeat(np.minimum.reduceat(low, edge), np.diff(np.append(edge, len(a))))
                later = high > least
                rows += [(k, own, b"", *r) for k, own, *r in _packed(block[later], None, a[later], half[later], least[later])]
            if rows:
                yield _rows(rows, 4)

    return _by_bucket(sent, partitions).mapInArrow(run, _schema(4))


def _known(table: pa.Table, columns: tuple[str, str, str]) -> Known:
    names, halves, least = (table.column(c).to_pylist() for c in columns)
    some = [x for x in least if x]
    return Known(_u64(names), np.frombuffer(b"".join(halves), "<u4"), _ids(some) if some else np.zeros(0, np.int64))


def _send_windows(docs: DataFrame, shared: DataFrame, window: int, buckets: int) -> DataFrame:
    """(key, block, a0, a1, a2, a3): a block's windows with a shared anchor that no high symbol settles, once each, with
    the least and greatest id that has it; by bucket of the window."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, held = [], []
        if left.num_rows and right.num_rows:
            shared_anchors = np.sort(_u64(right.column("a0").to_pylist()))
            symbols = _known(right, ("a1", "a2", "a3"))
            for ids, texts in _texts(left):
                flat, breaks = joined_words(texts)
                starts, owner = starts_of_windows(breaks, window)
                if len(starts):
                    made = parsed(flat, breaks, 2 * window)
                    near = np.isin(anchors(flat, made.low, starts, window), shared_anchors)
                    near &= ~settled(flat, made.first, made.last, ids[np.searchsorted(breaks, made.first, "right") - 1], symbols, window)[starts]
                    held.append((*window_hashes(flat, starts[near], window), ids[owner[near]]))
        if held:
            a, b, ids = (np.concatenate(x) for x in zip(*held))
            if len(a):
                a, b, low, high = _extremes(ids, a, b)
                rows = list(_packed((a % np.uint64(buckets)).astype(np.int64), left.column("block")[0].as_py(), a, b, low, high))
        return pa.Table.from_batches([_rows(rows, 4)])

    return docs.groupBy("block").cogroup(shared.groupBy("key")).applyInArrow(run, _schema(4))


def _later_windows(sent: DataFrame, partitions: int) -> DataFrame:
    """(key, block, a0, a1, a2): a block's windows that start in a document with a smaller id than one of the block's, one
    hash and half of the other, with the least id of all; key is the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in grouped_runs(batches):
            a, b, block = _u64(blobs(parts, 2)), _u64(blobs(parts, 3)), _blocks(parts)
            low, high = _ids(blobs(parts, 4)), _ids(blobs(parts, 5))
            order = np.lexsort((b, a))
            a, b, block, low, high = (x[order] for x in (a, b, block, low, high))
            edge = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
            least = np.repeat(np.minimum.reduceat(low, edge), np.diff(np.append(edge, len(a))))
            later = high > least
            if later.any():
                yield _rows(list(_packed(block[later], None, a[later], _half(b[later]), least[later])), 3)

    return _by_bucket(sent, partitions).mapInArrow(run, _schema(3))


def _stays(table: pa.Table, right: pa.Table, window: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """Of a block's documents: texts, which words are covered, where each text's words begin, and how many it loses.
    right: what is known of the block's windows (`high` false) and high symbols."""
    high = right.column("high")
    windows, symbols = (_known(right.filter(mask), ("a0", "a1", "a2")) for mask in (pc.invert(high), high))
    for ids, texts in _texts(table):
        flat, breaks = joined_words(texts)
        starts, owner = starts_of_windows(breaks, window)
        gone = np.zeros(len(flat) + 1, np.int64)
        if len(starts) and right.num_rows:
            a, b = window_hashes(flat, starts, window)
            hit = windows.earlier(a, _half(b), ids[owner])
            if len(symbols.names):
                made = parsed(flat, breaks, 2 * window)
                hit |= settled(flat, made.first, made.last, ids[np.searchsorted(breaks, made.first, "right") - 1], symbols, window)[starts]
            removed = starts[hit]
            gone[removed] += 1
            gone[removed + window] -= 1
        covered = np.cumsum(gone)[:-1] > 0
        total = np.concatenate(([0], np.cumsum(covered)))
        yield texts, covered, breaks, total[breaks[1:]] - total[breaks[:-1]]


def _kept(text: bytes, covered: np.ndarray) -> str:
    return b" ".join(compress(text.split(), (~covered).tolist())).decode("utf-8", "replace")


def _later(docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """The documents with their blocks, and what is known of each block's windows and high symbols: (key, high, a0, a1,
    a2). The symbols are cut off, so that what their exchange took is free before windows travel; the two stages behind
    them take the same rows by the same blocks, so Spark deals the documents out once for both."""
    size = text_bytes(docs)
    blocks, partitions = bucket_count(size, BLOCK_BYTES), shuffle_partitions(docs.sparkSession, size)
    blocked = docs.withColumn("block", block_of("id", "text", blocks))
    shared = cut(_shared_symbols(_send_symbols(blocked.select("id", "text", "block"), window, blocks), partitions))
    release(docs.sparkSession)
    windows = _later_windows(_send_windows(blocked, shared, window, blocks), partitions).select("key", F.lit(False).alias("high"), "a0", "a1", "a2")
    symbols = shared.filter(F.octet_length("a1") > 0).select("key", F.lit(True).alias("high"), F.col("a1").alias("a0"), F.col("a2").alias("a1"), F.col("a3").alias("a2"))
    return blocked, windows.unionByName(symbols)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs: (id, text). Removes every word covered by a window of `window` words that also starts in a document with a
    smaller id. Returns (id, n_words, n_removed, text), a row for each document."""
    docs = pick(docs, "id", "text").select(F.col("id").cast("long"), "text")
    blocked, later = _later(docs, window)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n_words, n_removed, kept = [], [], []
        for texts, covered, breaks, lost in _stays(left, right, window):
            n_words += (np.diff(breaks) - 1).tolist()
            n_removed += lost.tolist()
            kept += [_kept(t, covered[a + 1 : b]) for t, a, b in zip(texts, breaks[:-1], breaks[1:])]
        return pa.table({"id": left.column("id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "text": pa.array(kept, pa.string())})

    return blocked.groupBy("block").cogroup(later.groupBy("key")).applyInArrow(run, "id long, n_words long, n_removed long, text string")


def cut_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs: rows with doc_id, text and n_chars among their columns. The same rows without the repeats; a text that
    loses nothing stays as it is, others become their kept words joined by one space, with n_chars to match."""
    names = docs.columns
    rows = docs.withColumnRenamed("doc_id", "id")
    blocked, later = _later(rows, window)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        old_text, old_size = left.column("text").to_pylist(), left.column("n_chars").to_pylist()
        text, size, at = [], [], 0
        for texts, covered, breaks, lost in _stays(left, right, window):
            for k, (t, n) in enumerate(zip(texts, lost.tolist())):
                text.append(_kept(t, covered[breaks[k] + 1 : breaks[k + 1]]) if n else old_text[at])
                size.append(len(text[-1]) if n else old_size[at])
                at += 1
        new = {"doc_id": left.column("id"), "text": pa.array(text, pa.string()), "n_chars": pa.array(size, pa.int64())}
        return pa.table({c: new[c] if c in new else left.column(c) for c in names})

    return blocked.groupBy("block").cogroup(later.groupBy("key")).applyInArrow(run, docs.schema)
