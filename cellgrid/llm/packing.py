"""Best-fit packing of documents into sequences of a fixed number of tokens.

Documents are tokenised whole, ended with a separator id and cut into pieces only where they are longer than a
sequence. The histogram of piece lengths (at most `capacity` numbers, whatever the corpus) is all that the driver sees:
there a configuration linear program (a variable for each way to fill a sequence) is solved by multiplicative weights.
Each round prices the lengths by how little of their demand is covered yet and finds the dearest fillings by bounded
knapsack dynamic programs. Their amounts are rounded down to whole sequences; the pieces left are placed by best fit,
longest first. `plan` tells the share that the program placed and the lower bound. Pieces then take the slots of their
length by a gapless number, without any group being gathered.

Null text: as empty, a piece that is the separator only. Null ids stay null; rows with equal ids are packed one by one;
an empty table gives an empty result; other columns are ignored, but for one that `by` names: then pieces of different
values of it (null is one) never share a sequence. Each value has a histogram, and a plan that is made in a task of its
own, so the driver sees at most `capacity` numbers for each value.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.common import cut, local_ranks, numbered_offsets, pick, text_chunks, words_of

CAPACITY = 2048
ROUNDS = 24
#: Knapsacks of a round, and the share of the tokens that is left to best fit.
KNAPSACKS, REST = 8, 0.04
#: How the price of a length falls as it is covered, how much more a long one costs, and how prices differ by knapsack.
FALL, LONG, NOISE = 0.1, 0.05, 0.01
#: Of lengths up to this share of a sequence, half is kept back for the gaps that best fit finds.
SHORT = 0.1


#: A word of Latin letters that have one code point each, with marks after it: its letters and its marks are tokenised apart.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")


class WordIds:
    """Token ids of words. The tokenizer never joins over white space, so a text's ids are its words' ids in a row; nor
    over the border of letters and marks, so most new words need only their letters' ids, which are remembered too.

    Words are looked up by hash in a table with one place for a word: a new word takes an older one's place. Ids stand
    in a row in a pool; when it is full, all start anew. So the memory is bounded.
    """

    BITS = 20
    POOL = 1 << 23

    def __init__(self, path: str, separator: int, most_runs: int = 400_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.most_runs, self.separator = Tokenizer.from_file(path), most_runs, separator
        self.runs: dict[str, bytes] = {"": b""}
        self.plain = self._plain(path)
        self._empty()

    def _empty(self) -> None:
        self.tag = np.zeros(1 << self.BITS, np.uint64)
        self.start = np.zeros(1 << self.BITS, np.int64)
        self.length = np.zeros(1 << self.BITS, np.int64)
        self.pool = np.zeros(1 << 20, "<u4")
        self.pool[0], self.used = self.separator, 1

    def _plain(self, path: str):
        """A tokenizer for runs of lower-case letters or of marks, set between spaces, without the normal form and the
        splitting that these don't need; None where an example shows that the whole one treats them otherwise."""
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        plain = Tokenizer.from_file(path)
        suffix = getattr(plain.model, "end_of_word_suffix", None)
        if not suffix:
            return None
        plain.normalizer = normalizers.Sequence([])
        plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False)])
        self.ends = np.zeros(plain.get_vocab_size() + 1, bool)
        self.ends[[i for x, i in plain.get_vocab().items() if x.endswith(suffix)]] = True
        whole = self.tokenizer.encode("Grün Été,. a! çé.", add_special_tokens=False).ids
        return plain if whole == plain.encode("grün été ,. a ! çé .", add_special_tokens=False).ids else None

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_runs(self, runs: list[str], at_once: int = 64) -> list[bytes]:
        groups = [runs[k : k + at_once] for k in range(0, len(runs), at_once)]
        out: list[bytes] = []
        for group, got in zip(groups, self.plain.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(got.ids, "<u4")
            stops = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(stops) != len(group):
                out += self._encode(group)
                continue
            whole, start = ids.tobytes(), 0
            for stop in stops.tolist():
                out.append(whole[start:stop])
                start = stop
        return out

    def _learn(self, texts: list[str]) -> list[bytes]:
        """The ids of some words, as bytes."""
        got: list[bytes | None] = [None] * len(texts)
        split, other = [], []
        for i, text in enumerate(texts):
            m = _SIMPLE.fullmatch(text) if self.plain else None
            if m is None:
                other.append(i)
            else:
                split.append((i, m[1].lower(), m[2]))
        runs = self.runs
        unknown = {x for _, a, b in split for x in (a, b)}.difference(runs)
        if len(runs) + len(unknown) > self.most_runs:
            runs.clear()
            runs[""] = b""
            unknown = {x for _, a, b in split for x in (a, b) if x}
        listed = list(unknown)
        runs.update(zip(listed, self._encode_runs(listed)))
        for i, a, b in split:
            got[i] = runs[a] + runs[b]
        for i, x in zip(other, self._encode([texts[i] for i in other])):
            got[i] = x
        return got

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, each text's ended by the separator, and where each ends."""
        words = words_of(texts)
        if self.used > self.POOL:
            self._empty()
        place = (words.hashes >> np.uint64(64 - self.BITS)).astype(np.int64)
        start, length = self.start[place], self.length[place]
        new = np.flatnonzero(self.tag[place] != words.hashes)
        if len(new):
            fresh, first, which = np.unique(words.hashes[new], return_index=True, return_inverse=True)
            got = self._learn([words.word(i).decode("utf-8", "replace") for i in new[first]])
            flat = np.frombuffer(b"".join(got), "<u4")
            sizes = np.fromiter(map(len, got), np.int64, len(got)) // 4
            begins = self.used + np.cumsum(sizes) - sizes
            if self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate((self.pool, np.zeros(max(len(self.pool), len(flat)), "<u4")))
            self.pool[self.used : self.used + len(flat)] = flat
            self.used += len(flat)
            start[new], length[new] = begins[which], sizes[which]
            own = place[new[first]]
            self.tag[own], self.start[own], self.length[own] = fresh, begins, sizes
            # of two new words for one place the later stays; its start and length must be its own
            lost = self.tag[own] != fresh
            if lost.any():
                kept = np.flatnonzero(~lost)
                self.start[own[kept]], self.length[own[kept]] = begins[kept], sizes[kept]
        ends = np.cumsum(words.counts + 1) - 1
        starts, lengths = np.zeros(len(start) + len(texts), np.int64), np.ones(len(start) + len(texts), np.int64)
        inside = np.ones(len(starts), bool)
        inside[ends] = False
        starts[inside], lengths[inside] = start, length
        upto = np.cumsum(lengths)
        return self.pool[np.repeat(starts - upto + lengths, lengths) + np.arange(upto[-1] if len(upto) else 0)], upto[ends]


#: Of this worker process, by the tokenizer's path: what one task has learned serves the next.
_KNOWN: dict[tuple[str, int], WordIds] = {}


def tokenised(batches: Iterator[pa.RecordBatch], path: str, separator: int) -> Iterator[tuple[pa.Array, list[memoryview]]]:
    """Ids of the rows and their tokens with the separator, as little-endian 32-bit integers, chunk by chunk."""
    key = path, separator
    for batch in batches:
        known = _KNOWN.get(key) or _KNOWN.setdefault(key, WordIds(path, separator))
        at = 0
        for ids, texts in text_chunks(batch, 0, 1):
            flat, ends = known.ids(texts)
            view = memoryview(flat).cast("B")
            yield batch.column(0).slice(at, len(ids)), [view[4 * a : 4 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
            at += len(ids)


def pieces(docs: DataFrame, path: str, capacity: int, separator: int, groups: list[str | None] | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32, _group, _key, _task, _rank): every document's pieces, ranked in their task
    among those of their group and length, which _key tells. groups: the values of a third column of docs, else all
    documents are of group 0."""
    number = {x: k for k, x in enumerate(groups or ())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), {}
        named: list[int] = []  # of the batch whose chunks come now, and at which row the next chunk begins
        at = 0

        def noted() -> Iterator[pa.RecordBatch]:
            nonlocal named, at
            for batch in batches:
                named, at = [number[x] for x in batch.column(2).to_pylist()] if groups else [0] * batch.num_rows, 0
                yield batch

        for ids, tokens in tokenised(noted(), path, separator):
            owner, piece, length, crc = [], [], [], []
            for i, t in enumerate(tokens):
                for p, s in enumerate(range(0, len(t), 4 * capacity)):
                    part = t[s : s + 4 * capacity]
                    owner.append(i)
                    piece.append(p)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            length = np.array(length, np.int64)
            piece = np.array(piece, np.int64)
            group = np.array(named[at : at + len(ids)], np.int64)[owner]
            at += len(ids)
            key = group * (capacity + 1) + length
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(owner, pa.int64())), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(length), pa.array(crc, pa.int64()), pa.array(group), pa.array(key), pa.array(np.full(len(length), task, np.int64)), pa.array(local_ranks(key, seen))],
                ["id", "piece", "start", "length", "ids_crc32", "_group", "_key", "_task", "_rank"],
            )

    return docs.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long, _group long, _key long, _task long, _rank long")


# --- the configuration program -------------------------------------------------------------------------------------

Filling = tuple[tuple[int, int], ...]  # (length, how many of it), longest first


def _parts(numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Parts 1, 2, 4, ... and a rest of each number, so that all up to it are sums of some; and which numbers have them."""
    rest, size = numbers.copy(), 1
    while (full := rest >= size).any():
        yield size, full
        rest = np.where(full, rest - size, rest)
        done = (numbers < 4 * size - 1) & (rest > 0)
        for n in np.unique(rest[done]).tolist():
            yield n, done & (rest == n)
        rest = np.where(done, 0, rest)
        size *= 2


class Knapsacks:
    """Bounded knapsacks of one capacity: for each row of `left` and each capacity up to the given one, the dearest
    filling with no more of a length than the row has. prices: of each length, by row."""

    def __init__(self, lengths: np.ndarray, prices: np.ndarray, left: np.ndarray, capacity: int):
        self.lengths = lengths
        best = np.zeros((len(left), capacity + 1))
        self.steps: list[tuple[int, int, np.ndarray]] = []  # a length, how many of it at once, and where that was better
        most = np.minimum(left, capacity // lengths)
        for k, x in enumerate(lengths.tolist()):
            for n, have in _parts(most[:, k]):
                value = best[:, : capacity + 1 - n * x] + (prices[:, k] * n)[:, None]
                better = (value > best[:, n * x :] + 1e-9) & have[:, None]
                np.copyto(best[:, n * x :], value, where=better)
                self.steps.append((k, n, np.packbits(better, axis=1)))

    def fillings(self, row: int, rooms: np.ndarray) -> np.ndarray:
        """[room, length]: the dearest filling of each of some capacities in a row's knapsack."""
        taken = np.zeros((len(rooms), len(self.lengths)), np.int16)
        at = rooms.copy()
        for k, n, better in reversed(self.steps):
            place = at - n * int(self.lengths[k])
            own = np.maximum(place, 0)
            hit = (place >= 0) & (better[row, own >> 3] >> (7 - (own & 7)).astype(np.uint8) & 1).astype(bool)
            if hit.any():
                taken[hit, k] += n
                at[hit] = place[hit]
        return taken


class Plan(NamedTuple):
    """Fillings and how many sequences have each; the share of the tokens that the program placed, and the least number
    of sequences that any plan needs."""

    fillings: dict[Filling, int]
    placed: float
    bound: int


def plan(demand: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> Plan:
    """The configuration program, covering the demand exactly.

    A round deals what is left evenly to KNAPSACKS knapsacks and solves them for the current prices. From each, every
    length, longest first, gets the dearest filling of the room beside it, and that filling as many sequences as the
    knapsack's share still allows: a whole number. Only sequences without a free place count, or, where a round finds
    none, those as full as the fullest it finds. Prices begin as the lengths, the program's own prices where a plan
    without waste exists, a little more for long ones, which fit less often; they fall with the share of a length that
    is covered. The rounds end when all but REST of the tokens are placed. What is left, and the fillings made last if
    they waste what best fit would not, is placed by best fit.
    """
    total = sum(x * n for x, n in demand.items())
    bound = -(-total // capacity)
    made: list[tuple[Filling, int]] = [(((capacity, 1),), demand[capacity])] if demand.get(capacity) else []
    lengths = np.array(sorted((x for x in demand if x < capacity and demand[x]), reverse=True), np.int64)
    need = np.array([demand[int(x)] for x in lengths], np.int64)
    kept_back = np.where(lengths <= SHORT * capacity, need // 2, 0)
    left = need - kept_back
    level = capacity
    rng = np.random.default_rng(1)
    for _ in range(rounds if len(lengths) else 0):
        open_ = int((left * lengths).sum())
        if open_ <= REST * total:
            break
        some = np.flatnonzero(left)
        groups = max(1, min(KNAPSACKS, open_ // (32 * capacity)))
        share, more = np.divmod(left[some], groups)
        dealt = share + (rng.random((groups, len(some))).argsort(axis=0) < more)
        prices = lengths[some] * (1 + LONG * lengths[some] / capacity) * np.exp(-FALL * (1 - left[some] / need[some])) * rng.uniform(1, 1 + NOISE, dealt.shape)
        solved = Knapsacks(lengths[some], prices, dealt, capacity)
        before, fullest = int(left.sum()), 0
        for row, had in enumerate(dealt):
            anchors = np.flatnonzero(had)
            rooms = capacity - lengths[some[anchors]]
            for k, own in zip(anchors.tolist(), solved.fillings(row, rooms)):
                own[k] += 1
                used = np.flatnonzero(own)
                n = int((had[used] // own[used]).min())
                size = int(lengths[some[used]] @ own[used])
                if n and size < level:
                    fullest = max(fullest, size)
                elif n:
                    made.append((tuple(zip(lengths[some[used]].tolist(), own[used].tolist())), n))
                    had[used] -= n * own[used]
                    left[some[used]] -= n * own[used]
        if int(left.sum()) == before:
            if not fullest:
                break
            level = fullest
    return _rounded(made, demand, capacity, total, bound)


def _rounded(made: list[tuple[Filling, int]], demand: dict[int, int], capacity: int, total: int, bound: int) -> Plan:
    """The longest beginning of the fillings that, with best fit for the rest, needs the fewest sequences."""
    best: Plan | None = None
    for kept in dict.fromkeys(len(made) * k // 16 for k in range(16, -1, -1)):
        left, fillings = dict(demand), defaultdict(int)
        for filling, n in made[:kept]:
            fillings[filling] += n
            for x, m in filling:
                left[x] -= m * n
        rest = sum(x * n for x, n in left.items())
        for filling, n in best_fit(left, capacity).items():
            fillings[filling] += n
        if best is None or sum(fillings.values()) < sum(best.fillings.values()):
            best = Plan(dict(fillings), 1 - rest / total if total else 0.0, bound)
        if sum(best.fillings.values()) == bound:
            break
    return best


def solve(demand: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> dict[Filling, int]:
    """Fillings and how many sequences have each, covering the demand exactly."""
    return plan(demand, capacity, rounds).fillings


def best_fit(left: dict[int, int], capacity: int) -> dict[Filling, int]:
    """Best fit, longest first, of many equal pieces and many equal sequences at a time."""
    room: dict[int, list[list]] = defaultdict(list)  # by what is free: [filling, sequences]
    for length in sorted(left, reverse=True):
        n = left[length]
        while n > 0:
            free = next((f for f in range(length, capacity) if room.get(f)), None)
            if free is None:
                m = min(capacity // length, n)
                sequences = n // m
                room[capacity - m * length].append([((length, m),), sequences])
                n -= m * sequences
                continue
            filling, sequences = room[free].pop()
            m = min(free // length, n)
            take = min(sequences, n // m)
            if take < sequences:
                room[free].append([filling, sequences - take])
            room[free - m * length].append([(*filling, (length, m)), take])
            n -= m * take
    plan: dict[Filling, int] = defaultdict(int)
    for groups in room.values():
        for filling, sequences in groups:
            plan[filling] += sequences
    return plan


@dataclass(frozen=True)
class Slots:
    """Of one length: from which slot a filling's slots begin, how many a sequence has, the first sequence, the places."""

    begins: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    place: np.ndarray


def slots(plan: dict[Filling, int], base: int = 0) -> dict[int, Slots]:
    """base: the first sequence."""
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    begins: dict[int, int] = defaultdict(int)
    for filling, n in sorted(plan.items()):
        place = 0
        for length, m in filling:
            rows[length].append((begins[length], m, base, place))
            begins[length] += m * n
            place += m * length
        base += n
    return {k: Slots(*(np.array(c, np.int64) for c in zip(*v))) for k, v in rows.items()}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, separator: int = 0, by: str | None = None) -> DataFrame:
    """docs: (id, text). Returns (id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece; with
    `by`, a column of texts in docs, also that column, and each sequence is of one value of it."""
    sc = docs.sparkSession.sparkContext
    rows = pick(docs, "id", "text", *([by] if by else [])).withColumn("id", F.col("id").cast("long"))
    if by:
        rows = rows.select("id", "text", F.col(by).cast("string").alias("by"))
    groups = sorted((r[0] for r in rows.select("by").distinct().collect()), key=lambda x: (x is None, x)) if by else None
    ranked = cut(pieces(rows, tokenizer_path, capacity, separator, groups))
    demands: dict[int, dict[int, int]] = defaultdict(dict)
    for r in ranked.groupBy("_group", "length").agg(F.count(F.lit(1)).alias("n")).collect():  # capacity rows of a group at most
        demands[r["_group"]][r["length"]] = r["n"]
    listed = sorted(demands.items())
    plans = sc.parallelize(listed, len(listed)).map(lambda x: solve(x[1], capacity)).collect() if len(listed) > 1 else [solve(x, capacity) for _, x in listed]
    by_key, base = {}, 0
    for (group, _), made in zip(listed, plans):
        by_key |= {group * (capacity + 1) + x: s for x, s in slots(made, base).items()}
        base += sum(made.values())
    shared = sc.broadcast(by_key)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_key = shared.value
        for batch in batches:
            length, group, key, number = (batch.column(k).to_numpy() for k in (3, 5, 6, 7))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for x in np.unique(key):
                rows = np.flatnonzero(key == x)
                s = by_key[int(x)]
                f = np.searchsorted(s.begins, number[rows], "right") - 1
                within = number[rows] - s.begins[f]
                sequence[rows] = s.sequence[f] + within // s.each[f]
                offset[rows] = s.place[f] + within % s.each[f] * length[rows]
            names = [pa.array(groups, pa.string()).take(pa.array(group))] if groups else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset), *names], [*batch.schema.names[:5], "sequence_id", "offset", *["by"] * len(names)])

    numbered = numbered_offsets(ranked, "_key", "number").select("id", "piece", "start", "length", "ids_crc32", "_group", "_key", "number")
    packed = numbered.mapInArrow(assign, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + (", by string" if groups else ""))
    return packed if not by else packed.withColumnRenamed("by", by) if groups else packed.withColumn(by, F.lit(None).cast("string"))


def sequences(docs: DataFrame, packed: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, separator: int = 0) -> DataFrame:
    """The packed sequences themselves: (sequence_id, ids) with every id in its place. Ids of `docs` must be unique."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tokens in tokenised(batches, tokenizer_path, separator):
            rows = [(i, p, np.frombuffer(t, "<u4", count=min(capacity, len(t) // 4 - p * capacity), offset=4 * p * capacity).astype(np.int64)) for i, t in zip(ids.to_pylist(), tokens) for p in range(-(-len(t) // (4 * capacity)))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["id", "piece", "ids"])

    tokens = pick(docs, "id", "text").select(F.col("id").cast("long"), "text").mapInArrow(run, "id long, piece int, ids array<long>")
    parts = packed.join(tokens, ["id", "piece"]).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))  # capacity ids at most
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"))
