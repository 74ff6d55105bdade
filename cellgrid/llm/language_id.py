"""Language identification by error-correcting output codes.

Each language gets a codeword; one binary classifier per bit tells the languages whose bit is set from the others, by
the byte n-grams (1 to 4, with word edges) of the lower-cased text. A text is decoded to the language whose codeword
has the least logistic loss against the bits' margins; where the runner-up is nearly as near, the text is flagged as
ambiguous. A text of EVIDENCE n-grams or more whose least loss is above that of all labelled rows of the fit, or above
that of no evidence at all, is in none of the languages: `keep_identified` rejects it. The one bit of
two languages always fits one of them, so there the bound tells little.

Null text, or a text without a letter: language `und`, score 0. An empty table gives an empty result; without any
labelled row every text is `und`. Rows with equal ids are scored one by one; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellgrid.llm.common import pick, text_chunks

UNDETERMINED = "und"
#: Hashed n-grams.
DIMENSIONS = 1 << 15
#: Rows of each language that the classifiers are fitted on, about; the bound of the fit.
SAMPLE_PER_LANGUAGE = 1500
#: A lead of the best language over the next, in mean loss per bit, under which a text is ambiguous.
AMBIGUOUS = 0.05
#: Margins are a mean per n-gram; this many n-grams of evidence are believed at most.
EVIDENCE = 60.0
_LETTER = re.compile(r"[^\W\d_]")


def codebook(classes: int, seed: int = 7) -> np.ndarray:
    """Codewords of -1 and 1, a row for each class: all distinct splits up to five classes, else the random code of
    24 bits or more (5 a doubling) with the largest least distance among 200."""
    if classes < 2:
        return np.ones((classes, 1), dtype=np.float32)
    if classes <= 5:
        splits = [[1] + [1 if k >> j & 1 else -1 for j in range(classes - 1)] for k in range((1 << (classes - 1)) - 1)]
        return np.array(splits, dtype=np.float32).T
    rng = np.random.default_rng(seed)
    bits = max(24, 5 * int(np.ceil(np.log2(classes))))
    best, least = None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], dtype=np.float32), size=(classes, bits))
        if (np.abs(code.sum(axis=0)) == classes).any():
            continue
        apart = (bits - code @ code.T) / 2
        apart[np.diag_indices(classes)] = bits
        if apart.min() > least:
            best, least = code, apart.min()
    return best


def word_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of words set between edges, and where each word's begin (and the end)."""
    joined = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))  # of each word's left edge
    owner = np.repeat(np.arange(len(words)), sizes + 1)
    last = starts[1:][owner]  # the place of the word's right edge
    at = np.arange(len(owner))
    grams, owners, code = [], [], np.zeros(len(owner), np.uint32)
    for n in range(1, 5):
        end = at + n - 1
        inside = end <= last
        code = np.where(inside, code * np.uint32(257) + joined[np.minimum(end, len(joined) - 1)] + np.uint32(1), code)
        mixed = (code ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0xC2B2AE35)
        grams.append(((mixed ^ (mixed >> np.uint32(13))) % np.uint32(DIMENSIONS))[inside])
        owners.append(owner[inside])
    gram, own = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return gram[order], np.searchsorted(own[order], np.arange(len(words) + 1))


def lowered(texts: list[bytes]) -> list[list[bytes]]:
    return [x.decode("utf-8", "replace").lower().encode().split() for x in texts]


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray
    #: For each n-gram its addition to every bit's margin.
    weights: np.ndarray
    #: The least loss above which a text of enough evidence is in none of the languages.
    bound: float = np.inf


def fit(rows: DataFrame, most: int = SAMPLE_PER_LANGUAGE, bounded: bool = False) -> Model:
    """rows: (id, text, lang), all of them fit to learn from. Of each language about `most` rows, chosen by a hash of
    the id, are used whole; what reaches the driver is a count for each language and n-gram. `bounded` scores the same
    rows once more to set the model's bound: their greatest least loss, but no more than that of margins of 0."""
    rows = pick(rows, "id", "text", "lang").filter("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    sizes = {k: v for k, v in sizes.items() if k != UNDETERMINED}
    if not sizes:
        return Model([], np.ones((0, 1), np.float32), np.zeros((DIMENSIONS, 1), np.float32))
    rate = F.lit(0.0)
    for lang, n in sizes.items():
        rate = F.when(F.col("lang") == lang, F.lit(min(1.0, most / n))).otherwise(rate)
    chosen = rows.filter(F.pmod(F.xxhash64("id", F.lit("language sample")), F.lit(1 << 20)) < rate * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(2).to_pylist()
            at = 0
            for ids, texts in text_chunks(batch, 0, 1):
                for lang, words in zip(langs[at : at + len(ids)], lowered(texts)):
                    if words:
                        total.setdefault(lang, np.zeros(DIMENSIONS))
                        total[lang] += np.bincount(word_grams(words)[0], minlength=DIMENSIONS)
                at += len(ids)
        for lang, counts in total.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some, pa.int32()), pa.array(counts[some])], ["lang", "gram", "n"])

    counted = chosen.mapInArrow(count, "lang string, gram int, n double").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted["lang"].unique())
    profile = np.full((len(languages), DIMENSIONS), 0.5)
    profile[counted["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(dtype=np.int64), counted["gram"].to_numpy()] += counted["n"].to_numpy()
    profile /= profile.sum(axis=1, keepdims=True)
    code = codebook(len(languages))
    weights = np.zeros((DIMENSIONS, code.shape[1]), np.float32)
    for bit in range(code.shape[1]):
        one, other = profile[code[:, bit] > 0], profile[code[:, bit] < 0]
        if len(one) and len(other):
            weights[:, bit] = np.log(one.mean(axis=0)) - np.log(other.mean(axis=0))
    model = Model(languages, code, weights)
    if not bounded or len(languages) < 2:  # one language has no other to be told from
        return model
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def worst(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordMargins(shared.value.weights)
        for batch in batches:
            if batch.num_rows:
                losses = scored(shared.value, known, batch, 0, 1)[3]
                yield pa.RecordBatch.from_arrays([pa.array([losses.max()])], ["loss"])

    most_lost = chosen.mapInArrow(worst, "loss double").agg(F.max("loss")).first()[0] or 0.0
    return replace(model, bound=min(most_lost, float(np.log(2))))


class WordMargins(dict):
    """Row numbers of words in a table of margins; bounded: it starts anew when full."""

    def __init__(self, weights: np.ndarray, most: int = 250_000):
        self.weights, self.most = weights, most
        self.rows = np.zeros((most, weights.shape[1] + 1), np.float32)

    def learn(self, words: set[bytes]) -> None:
        fresh = [w for w in words if w not in self]
        if len(self) + len(fresh) > self.most:
            self.clear()
            fresh = list(words)
            if len(fresh) > self.most:
                self.most = 2 * len(fresh)
                self.rows = np.zeros((self.most, self.rows.shape[1]), np.float32)
        if fresh:
            grams, starts = word_grams(fresh)
            at = len(self)
            for bit in range(self.weights.shape[1]):
                self.rows[at : at + len(fresh), bit] = np.add.reduceat(self.weights[grams, bit], starts[:-1])
            self.rows[at : at + len(fresh), -1] = np.diff(starts)
            self.update(zip(fresh, range(at, at + len(fresh))))


def decode(model: Model, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class, score, ambiguity and least loss from the margins' sums (last column: the number of n-grams)."""
    n = np.maximum(sums[:, -1:], 1)
    margins = sums[:, :-1] / n * np.minimum(n, EVIDENCE) / EVIDENCE * 8
    loss = np.logaddexp(0, -margins[:, None, :] * model.code[None, :, :]).mean(axis=2)
    best = loss.argmin(axis=1)
    least = loss.min(axis=1)
    weight = np.exp(-(loss - least[:, None]) * model.code.shape[1] * 2)
    ranked = np.sort(loss, axis=1)
    close = ranked[:, 1] - ranked[:, 0] < AMBIGUOUS if loss.shape[1] > 1 else np.zeros(len(loss), bool)
    return best, 1 / weight.sum(axis=1), close, least


def scored(model: Model, known: WordMargins, batch: pa.RecordBatch, id_at: int, text_at: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, ambiguity, least loss (0 where the evidence is too little) and whether there is a letter, of a
    batch's rows, from whole texts."""
    langs, scores, unsure, lost, letters = [], [], [], [], []
    for ids, texts in text_chunks(batch, id_at, text_at):
        docs = lowered(texts)
        known.learn({w for d in docs for w in d})
        sums = np.zeros((len(ids), model.weights.shape[1] + 1), np.float32)
        for i, words in enumerate(docs):
            if words:
                sums[i] = known.rows[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].sum(axis=0)
        letters.append(np.array([_LETTER.search(x.decode("utf-8", "replace")) is not None for x in texts], bool))
        lettered = letters[-1] & (len(model.languages) > 0)
        if len(model.languages):
            best, sure, close, least = decode(model, sums)
        else:
            best, sure, close, least = np.zeros(len(ids), int), np.zeros(len(ids)), np.zeros(len(ids), bool), np.zeros(len(ids))
        langs += [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best, lettered)]
        scores.append(np.where(lettered, sure, 0.0).astype(np.float64))
        unsure.append(np.where(lettered, close, True))
        lost.append(np.where(sums[:, -1] >= EVIDENCE, least, 0.0).astype(np.float64))
    return langs, np.concatenate(scores), np.concatenate(unsure), np.concatenate(lost), np.concatenate(letters)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs: (id, text). Returns (id, lang_pred, score, ambiguous) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = WordMargins(model.weights)
        for batch in batches:
            if batch.num_rows:
                langs, scores, unsure, _, _ = scored(model, known, batch, 0, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores), pa.array(unsure)], ["id", "lang_pred", "score", "ambiguous"])

    return pick(docs, "id", "text").select(F.col("id").cast("long"), "text").mapInArrow(run, "id long, lang_pred string, score double, ambiguous boolean")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """docs: rows with doc_id, text and, where there are labels, lang among their columns. Those that have a language,
    with `lang` set to it (as the last column where there was none): the one that their text is decoded to, whatever the
    label says; only where the decoder flags the text as ambiguous the label, or `und` without one. Rejected are
    texts without a letter, and of the rows without a label those whose least loss is above the model's bound. Short or
    mixed texts, though flagged by `identify`, have a language and stay, as do labelled rows: their label says so.
    Without any labelled row to learn from, every text with a letter stays; labels stay, and the others are `und`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("doc_id"), docs.columns.index("text")
    lang_at = docs.columns.index("lang") if "lang" in docs.columns else len(docs.columns)
    fields = list(docs.schema.fields)
    fields[lang_at : lang_at + 1] = [T.StructField("lang", T.StringType())]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = WordMargins(model.weights)
        for batch in batches:
            if batch.num_rows:
                found, _, unsure, lost, lettered = scored(model, known, batch, *at)
                labels = batch.column(lang_at).to_pylist() if lang_at < batch.num_columns else [None] * batch.num_rows
                labels = [UNDETERMINED if x is None else str(x) for x in labels]
                labelled = np.array([x != UNDETERMINED for x in labels], bool)
                langs = [label if vague or lang == UNDETERMINED else lang for label, lang, vague in zip(labels, found, unsure)]
                columns = [pa.array(langs, pa.string()) if i == lang_at else batch.column(i) for i in range(len(schema))]
                yield pa.RecordBatch.from_arrays(columns, schema.names).filter(pa.array(lettered & (labelled | (lost <= model.bound))))

    return docs.mapInArrow(run, schema)


def language_id(docs: DataFrame, learn_from: DataFrame, most: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """Fits on `learn_from` (id, text, lang), then identifies every row of `docs` (id, text)."""
    return identify(docs, fit(learn_from, most))
