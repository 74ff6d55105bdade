"""Benchmark decontamination by template windows.

Words become template tokens: numbers, units and capitalised words (names, or the start of a sentence) become typed
placeholders, all others are lower-cased and stripped of marks. Numbers in a row are one placeholder, as are names in a
row ("Anna Maria", "one thousand"), unless a mark stands between them; a word that is a unit only sometimes (`a`, `s`,
`second`) is one behind a number. Characters of scripts without spaces are words of their own. Windows of five tokens are
joined by hash between documents and benchmark items. A document holds an item if at least 0.8 of the item's windows, or
windows over at least 13 tokens in a row, are found in it, and the placeholders agree: one value of the item must stand
for one value of the document throughout, so a question with other numbers or names is caught while text of the same
shape is not.

Template windows of fewer than three ordinary words do not count. What they cannot tell (arithmetic, titles, lists of
names, documents in capitals) is found exactly: the same shares of an item's windows of case-folded literal words, with
no demand on the words. An item shorter than a window is found as a whole, and one of one or two words only as the whole
document, since within a text it cannot be told from ordinary words. `ways` counts the items by the way they take. Names
in small letters are ordinary words: a question that is re-parameterised by these is not found.

The benchmark stays distributed. The documents' tasks get a bitmap of its windows' hashes, of at most 2^MOST_BITS bits;
windows that fall on a set bit are joined to the benchmark's windows (broadcast if there are at most BROADCAST_ROWS of
these, else by a shuffle), and each pair of a document and an item is judged on its own.

Null texts, and items without a word, hold and match nothing. Documents are told apart by id and text, so repeated rows
of one id and text give one row per item; null ids stay null; items with equal ids are separate items; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.common import NULL_ID, cut, few, grouped_runs, pick, remix, shuffle_partitions, text_chunks, words_of

WINDOW = 5
SHARE = 0.8
RUN = 13
LITERALS = 3
#: Items of fewer words match whole documents only.
WITHIN = 3
AGREE = 0.8
#: Bits of the bitmap: at least 256 for a window, within these powers of two.
LEAST_BITS, MOST_BITS = 24, 27

NUMBER, UNIT, NAME = 1, 2, 3
#: Kinds that the neighbours decide: a unit behind a number, a number before a number word, and number words.
MAYBE_UNIT, MAYBE_NUMBER, NUMBER_WORD = 4, 5, 6
KIND, STOP, LOW = 7, 8, 31
# Units of measure and currency, and those that are other words too.
UNITS = frozenset("mm cm km inch inches ft feet yards mile miles mg kg tons tonne tonnes lb lbs oz pounds ounce ounces ml cl liter liters litre litres gallon gallons sec minutes hr hours days weeks months years mph kph km/h m/s hz khz mhz ghz kb mb gb tb kw mw kwh kj cal kcal ohm pa kpa °c °f % percent dollar dollars euro euros cent cents usd eur gbp € $ £".split())
MAYBE_UNITS = frozenset("m in in. foot yard g ton pound l s second seconds min minute h hour day week month year w j v a bar k c f".split())
_NUMBER = re.compile(r"[+\-−]?[$€£]?\d[\d.,:/\-]*(?:%|st|nd|rd|th|[a-z°€$£]{1,3})?$", re.I)
# Number words, and words that belong to one that follows.
NUMBER_WORDS = frozenset("two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
BEFORE_NUMBER_WORDS = frozenset(("one", "an"))
_EDGE = ".,;:!?\"'()[]{}<>«»„“”‘’¿¡*_|&#。、，！？；：「」『』（）"
_STOPS = tuple(".,;:!?")
#: Scripts that set no spaces between words: Thai, Lao, Burmese, Khmer, kana, Han.
_DENSE = re.compile(r"[฀-໿က-႟ក-៿々-ヿ㐀-䶿一-鿿豈-﫿]")
#: First bytes of those characters, and of few others.
_DENSE_BYTES = re.compile(rb"[\xe0\xe1\xe3-\xe9\xef]")


def spaced(text: bytes) -> bytes:
    """The text with spaces around the characters of scripts without spaces."""
    if _DENSE_BYTES.search(text):
        text = _DENSE.sub(r" \g<0> ", text.decode("utf-8", "replace")).encode()
    return text


def words_in(text: bytes) -> list[bytes]:
    """The words of a text that are not marks only."""
    return [w for w in spaced(text).split() if token(w)]


def plain(word: bytes) -> str:
    return word.decode("utf-8", "replace").strip(_EDGE).lower()


#: Kinds of words by themselves, as bytes.
_KINDS = {w.encode(): kind for words, kind in ((MAYBE_UNITS, MAYBE_UNIT), (UNITS, UNIT), (NUMBER_WORDS, NUMBER_WORD), (BEFORE_NUMBER_WORDS, MAYBE_NUMBER)) for w in words}


def token(word: bytes) -> int:
    """A hash of the case-folded word with its kind and whether a mark ends it in the low bits; 0 for marks only."""
    bare = word.rstrip(b".,;:!?")
    if bare.isalpha():  # the common case: ASCII letters and marks behind them
        low = bare.lower()
        kind = _KINDS.get(low) or (0 if bare[0] > 90 else NAME)
        return xxhash.xxh3_64_intdigest(low) & ~LOW | 16 | (STOP if len(bare) < len(word) else 0) | kind
    text = word.decode("utf-8", "replace")
    bare = text.strip(_EDGE)
    if not bare:
        return 0
    low = bare.lower()
    if low in NUMBER_WORDS:
        kind = NUMBER_WORD
    elif _NUMBER.match(bare):
        kind = NUMBER
    elif low in UNITS:
        kind = UNIT
    elif low in MAYBE_UNITS:
        kind = MAYBE_UNIT
    elif low in BEFORE_NUMBER_WORDS:
        kind = MAYBE_NUMBER
    else:
        kind = NAME if bare[0].isupper() else 0
    stop = STOP if text.rstrip("\"'»”’)]}").endswith(_STOPS) else 0
    return xxhash.xxh3_64_intdigest(low.encode()) & ~LOW | 16 | stop | kind


class Tokens:
    """Tokens of texts' words; those of the words met last are remembered by hash, in tables of a fixed size."""

    def __init__(self, bits: int = 20):
        self.bits = bits
        self.tag, self.value = np.zeros((2, 1 << bits), np.uint64)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All words' tokens in a row, but for marks, and the text of each."""
        words = words_of([spaced(t) for t in texts])
        place = (words.hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.value[place]
        new = np.flatnonzero(self.tag[place] != words.hashes)
        if len(new):
            fresh, first, which = np.unique(words.hashes[new], return_index=True, return_inverse=True)
            got = np.fromiter((token(words.word(i)) for i in new[first].tolist()), np.uint64, len(fresh))
            out[new] = got[which]
            self.tag[place[new[first]]], self.value[place[new[first]]] = fresh, got
        owner = np.repeat(np.arange(len(texts)), words.counts)
        real = out != 0
        return out[real], owner[real]


class Template(NamedTuple):
    """Template tokens of some texts in a row."""

    hashes: np.ndarray
    kinds: np.ndarray
    owner: np.ndarray
    #: The first word of each token, and the word after it.
    first: np.ndarray
    last: np.ndarray


def template(tokens: np.ndarray, owner: np.ndarray) -> Template:
    """Of the words' tokens: kinds decided by neighbours, numbers and names in a row made one."""
    n = len(tokens)
    kind = (tokens & np.uint64(KIND)).astype(np.int8)
    if not n:
        return Template(tokens, kind, owner, np.zeros(0, np.int64), np.zeros(0, np.int64))
    stop = (tokens & np.uint64(STOP)) > 0
    linked = np.concatenate(([False], (owner[1:] == owner[:-1]) & ~stop[:-1]))  # to the word before
    before_word = np.concatenate((linked[1:] & (kind[1:] == NUMBER_WORD), [False]))
    # `a` is a number only before a number word, a unit only behind a number
    one = xxhash.xxh3_64_intdigest(b"a") & ~LOW
    article = (tokens & ~np.uint64(LOW)) == np.uint64(one)
    kind = np.where((kind == NUMBER_WORD) | before_word & ((kind == MAYBE_NUMBER) | article), NUMBER, kind)
    kind = np.where(kind == MAYBE_NUMBER, 0, kind)
    behind = np.concatenate(([False], linked[1:] & (kind[:-1] == NUMBER)))
    kind = np.where(kind == MAYBE_UNIT, np.where(behind, UNIT, 0), kind)
    joins = linked & np.concatenate(([False], (kind[1:] == kind[:-1]) & ((kind[1:] == NUMBER) | (kind[1:] == NAME))))
    first = np.flatnonzero(~joins)
    kinds = kind[first]
    hashes = np.where(kinds > 0, kinds.astype(np.uint64), tokens[first] & ~np.uint64(LOW))
    return Template(hashes, kinds, owner[first], first, np.append(first[1:], n))


def _hashes(tokens: np.ndarray, size: int, code: int) -> np.ndarray:
    n = max(len(tokens) - size + 1, 0)
    h = np.zeros(n, np.uint64)
    mixed = remix(tokens)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + mixed[k : k + n]
    return remix(h ^ np.uint64(0xA0761D6478BD642F * (code + 1) & (1 << 64) - 1)) | np.uint64(1)


def template_windows(t: Template) -> np.ndarray:
    """A hash of each window of template tokens; 0 where it has too few ordinary words or is over two texts."""
    n = max(len(t.hashes) - WINDOW + 1, 0)
    ordinary = t.kinds == 0
    literals = np.zeros(n, np.int8)
    for k in range(WINDOW):
        literals += ordinary[k : k + n]
    counts = (literals >= LITERALS) & (t.owner[:n] == t.owner[WINDOW - 1 :])
    return np.where(counts, _hashes(t.hashes, WINDOW, 0), np.uint64(0))


def literal_windows(tokens: np.ndarray, owner: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """A hash of each window of `size` case-folded words; 0 where it is over two texts."""
    n = max(len(tokens) - size + 1, 0)
    return np.where(owner[:n] == owner[size - 1 :], _hashes(tokens & ~np.uint64(LOW), size, size), np.uint64(0))


def slots(words: list[bytes], t: Template, at: int, base: int = 0) -> str:
    """The values of the placeholders of a window, in their order. base: the text's first word in `t`."""
    parts = [" ".join(plain(w) for w in words[t.first[k] - base : t.last[k] - base]) for k in range(at, at + WINDOW) if t.kinds[k]]
    return "\x1f".join(parts)


# --- the benchmark's windows -----------------------------------------------------------------------------------------

_ITEM = "key long, item long, code int, size int, total int, hash long, p int, rank int, kinds string, own string"


def item_windows(benchmark: DataFrame) -> DataFrame:
    """A row for each window that counts of each item; code: 0 for template windows, else the size of literal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                count += 1
                words = words_in((text or "").encode())
                if not words:
                    continue
                tokens = np.array([token(w) for w in words], np.uint64)
                owner = np.zeros(len(words), np.int64)
                t = template(tokens, owner)
                found = template_windows(t)
                places = np.flatnonzero(found).tolist()
                for rank, p in enumerate(places):
                    kinds = "".join(str(k) for k in t.kinds[p : p + WINDOW])
                    rows.append((count, item, 0, WINDOW, len(places), int(found[p].view(np.int64)), p, rank, kinds, slots(words, t, p)))
                size = min(len(words), WINDOW)
                found = literal_windows(tokens, owner, size)
                rows += [(count, item, size, size, len(found), int(h), p, p, "", "") for p, h in enumerate(found.view(np.int64))]
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string())
            columns = zip(*rows) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [x.split()[0] for x in _ITEM.split(", ")])

    items = pick(benchmark, "item", "text").filter("text is not null").select(F.col("item").cast("long"), "text")
    return cut(items.mapInArrow(run, _ITEM))


def bitmap(windows: DataFrame) -> tuple[np.ndarray, int]:
    """Which leading bits the windows' hashes have, packed, and how many bits those are. The bits are set in the tasks
    and combined there; the driver gets the bitmap only, of a bounded size."""
    need = 256 * max(windows.count(), 1)
    bits = min(max(need.bit_length(), LEAST_BITS), MOST_BITS)
    place = f"shiftrightunsigned(hash, {64 - bits})"
    words = windows.selectExpr(f"shiftright({place}, 5) AS word", f"shiftleft(1L, cast({place} & 31L AS int)) AS bit")
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(max(1 << bits >> 5, 1), np.uint32)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().astype(np.uint32)
    return out, bits


def maybe(marks: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    """The places of the hashes that may be in the benchmark."""
    place = hashes >> np.uint64(64 - bits)
    return np.flatnonzero((marks[place >> np.uint64(5)] >> (place & np.uint64(31)).astype(np.uint32) & np.uint32(1)).astype(bool) & (hashes != 0))


# --- the documents' windows ------------------------------------------------------------------------------------------

_HIT = "id long, _a long, _b long, hash long, q int, begin long, end long, other string"


def document_windows(docs: DataFrame, marks: np.ndarray, bits: int, sizes: list[int]) -> DataFrame:
    """docs: (id, text, _a, _b). Windows that may be in the benchmark; sizes: of the literal ones that it has."""
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, found_bits = Tokens(), shared.value
        for batch in batches:
            at = 0
            for ids, texts in text_chunks(batch, 0, 1):
                tokens, owner = known(texts)
                first = np.searchsorted(owner, np.arange(len(texts) + 1))
                if not len(tokens):
                    at += len(ids)
                    continue
                words: dict[int, list[bytes]] = {}

                def own_words(i: int, words=words, texts=texts) -> list[bytes]:
                    if i not in words:
                        words[i] = words_in(texts[i])
                    return words[i]

                rows = []
                t = template(tokens, owner)
                found = template_windows(t)
                base = np.searchsorted(t.owner, np.arange(len(texts)))
                for k in maybe(found_bits, bits, found).tolist():
                    i = int(t.owner[k])
                    rows.append((i, int(found[k].view(np.int64)), k - int(base[i]), int(t.first[k] - first[i]), int(t.last[k + WINDOW - 1] - first[i]), slots(own_words(i), t, k, int(first[i]))))
                for size in sizes:
                    found = literal_windows(tokens, owner, size)
                    hit = maybe(found_bits, bits, found)
                    if size < WITHIN:
                        hit = hit[np.diff(first)[owner[hit]] == size]
                    rows += [(int(owner[k]), int(found[k].view(np.int64)), int(k - first[owner[k]]), int(k - first[owner[k]]), int(k - first[owner[k]]) + size, "") for k in hit.tolist()]
                if rows:
                    who, h, q, a, b, other = zip(*rows)
                    who = pa.array(np.array(who) + at)
                    yield pa.RecordBatch.from_arrays([*[batch.column(c).take(who) for c in (0, 2, 3)], pa.array(h, pa.int64()), pa.array(q, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(other, pa.string())], ["id", "_a", "_b", "hash", "q", "begin", "end", "other"])
                at += len(ids)

    return docs.mapInArrow(run, _HIT)


class Met(NamedTuple):
    """A window of an item that is a window of a document; kinds: of its tokens, 0 for ordinary words."""

    p: int
    rank: int
    q: int
    begin: int
    end: int
    kinds: str
    own: str
    other: str


def judged(met: list[Met], total: int, size: int, is_template: bool) -> tuple | None:
    """(matched, windows, longest, changed, from_word, to_word) if the document holds the item. met: distinct."""
    lines = Counter(x.q - x.p for x in met)
    best: dict[int, Met] = {}
    for x in met:
        if x.p not in best or (lines[x.q - x.p], -x.q) > (lines[best[x.p].q - x.p], -best[x.p].q):
            best[x.p] = x
    changed = False
    if is_template:
        values: dict[tuple[str, str], Counter] = defaultdict(Counter)
        seen = set()
        for x in best.values():
            places = [k for k, kind in enumerate(x.kinds) if kind != "0"]
            for k, own, other in zip(places, x.own.split("\x1f"), x.other.split("\x1f")):
                if (x.p + k, x.q + k) not in seen:
                    seen.add((x.p + k, x.q + k))
                    values[x.kinds[k], own][other] += 1
        total_slots = sum(sum(c.values()) for c in values.values())
        leads = {key: max(c.items(), key=lambda v: (v[1], v[0])) for key, c in values.items()}
        owner: dict[tuple[str, str], int] = {}
        for (kind, _), (value, n) in leads.items():  # one document value for one item value
            owner[kind, value] = max(owner.get((kind, value), 0), n)
        if total_slots and sum(owner.values()) < AGREE * total_slots:
            return None
        changed = any(value != own for (_, own), (value, _) in leads.items())
    span = 0
    begun = before = None
    for p in sorted(best):  # in a row: no window of the item that counts is missing in between
        x = best[p]
        if before is None or x.rank != before.rank + 1 or x.q - p != before.q - before.p:
            begun = p
        before = x
        span = max(span, p - begun + size)
    if len(best) < SHARE * total and span < RUN:
        return None
    return len(best), total, span, changed, min(x.begin for x in best.values()), max(x.end for x in best.values())


_FOUND = "id long, _a long, _b long, item long, matched int, windows int, longest int, changed boolean, from_word long, to_word long"


def _judge(joined: DataFrame) -> DataFrame:
    """A row for each pair of a document and an item that it holds; template windows decide first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in grouped_runs(batches):
            rows = pa.Table.from_batches(held).to_pylist()
            by_pair = defaultdict(lambda: defaultdict(dict))
            for r in rows:
                by_pair[r["id"], r["_a"], r["_b"], r["key"]][r["code"]][r["p"], r["q"]] = r
            out = []
            for (i, a, b, _), codes in by_pair.items():
                for code in sorted(codes):
                    some = next(iter(codes[code].values()))
                    met = [Met(*[r[f] for f in Met._fields]) for _, r in sorted(codes[code].items())]
                    if got := judged(met, some["total"], some["size"], code == 0):
                        out.append((i, a, b, some["item"], *got))
                        break
            if out:
                types = (*[pa.int64()] * 4, *[pa.int32()] * 3, pa.bool_(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [x.split()[0] for x in _FOUND.split(", ")])

    pairs = joined.select(F.xxhash64("id", "_a", "_b", "key").alias("pair"), *joined.columns)
    dealt = pairs.repartition(shuffle_partitions(joined.sparkSession), "pair").sortWithinPartitions("pair")
    return dealt.mapInArrow(run, _FOUND)


def text_hashes() -> dict:
    """Columns that tell texts apart."""
    return {"_a": F.xxhash64("text"), "_b": F.xxhash64(F.lit(1), F.col("text"))}


def _contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    windows = item_windows(benchmark)
    sizes = sorted(r["code"] for r in windows.filter("code > 0").select("code").distinct().collect())  # WINDOW at most
    hits = document_windows(docs, *bitmap(windows), sizes)
    return _judge(hits.join(few(windows), "hash"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs: (id, text); benchmark: (item, text). Returns a row for each document and item that it holds: (id, item,
    matched, windows, longest, changed, from_word, to_word); `changed` tells a re-parameterised copy."""
    docs = pick(docs, "id", "text").select(F.col("id").cast("long"), "text").withColumns(text_hashes())
    return _contaminated(docs, benchmark).drop("_a", "_b")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs: rows with doc_id and text among their columns. Those that hold no item, unchanged. The others are known by
    id and two hashes of the text, and broadcast if they are few."""
    plain_docs = docs.select(F.col("doc_id").cast("long").alias("id"), "text").withColumns(text_hashes())
    known = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(int(NULL_ID))).alias("_id")
    gone = cut(_contaminated(plain_docs, benchmark).select(known("id"), "_a", "_b").distinct())
    keyed = docs.withColumns({"_id": known("doc_id"), **text_hashes()})
    return keyed.join(few(gone), ["_id", "_a", "_b"], "left_anti").select(*docs.columns)


def ways(benchmark: DataFrame) -> dict[str, int]:
    """Numbers of the benchmark's items (item, text) by how they are found: by `template` windows (and literal ones),
    by `literal` windows only, as a `short` item within a text, as a `whole` document, or `never` (no word)."""
    items = pick(benchmark, "item", "text")
    per_item = item_windows(benchmark).groupBy("key").agg(F.min("code").alias("least"), F.max("code").alias("most"))
    way = F.when(F.col("least") == 0, "template").when(F.col("most") == WINDOW, "literal").when(F.col("most") >= WITHIN, "short").otherwise("whole")
    found = {r["way"]: r["n"] for r in per_item.groupBy(way.alias("way")).agg(F.count(F.lit(1)).alias("n")).collect()}
    never = items.count() - sum(found.values())
    return found | ({"never": never} if never else {})
