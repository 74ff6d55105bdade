import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from test_near_duplicates import brute as near
from test_substring import brute as cut
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from cellgrid.llm import language_id, queries

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")]
    rows = [(i, t) for i, t in rows if (i, i) in {(a, c) for a, _, c in near(rows, 5, 80)}]
    kept = {i: (n, text) for i, _, n, text in cut(rows, 13)}
    rows = [(i, kept[i][1] if kept[i][0] else t) for i, t in rows]
    items = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    rows = [(i, t) for i, t in rows if not any(x in " ".join(t.split()) for x in items)]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want |= {(i, p // 2048, len(ids[p : p + 2048]), zlib.crc32(ids[p : p + 2048].tobytes())) for p in range(0, len(ids), 2048)}
    got = corpus_pipeline.run(spark, SMALL)
    assert {(r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in got.collect()} == want


def test_stages_keep_the_columns(spark):
    odd = spark.createDataFrame([(1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (3, "some words", "en", None, 10, None), (3, "some words", "en", None, 10, None), (None, "others here", None, "s", None, "y")], "doc_id int, text string, lang string, source string, n_chars int, block string")
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
    assert sorted((r["doc_id"] or -1) for r in docs.collect()) == [-1, 3]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == 2
    empty = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SMALL)
        assert empty.count() == 0


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run_on_the_smallest_tables(spark, name):
    got = queries.QUERIES[name](spark, SMALL)
    table = "pages" if "op8" in name else "embeddings" if "op10" in name else "conversations" if "op5" in name else "documents"
    n, rows = spark.read.parquet(f"{SMALL}/{table}.parquet").count(), got.count()
    if name.startswith(("op4", "op5", "op7")):
        assert rows > 0
    else:
        assert rows == n


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_agree_with_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    df = queries.QUERIES[name](spark, SMALL)
    want = con.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_the_decoder_rejects_what_is_no_language(spark):
    import random

    rng = random.Random(3)
    words = {"en": "the of and to in that is was for on with his they at be this from have".split(), "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine".split(), "fr": "le la les et des un une du dans que qui pour pas sur au avec ce il sont par".split(), "es": "el los las que y en un por con no una su para es al lo como pero sus este".split()}
    rows = [(10 * i + k, " ".join(rng.choices(words[lang], k=60)), lang, "s", 1) for i in range(40) for k, lang in enumerate(words)]
    noise = [" ".join("".join(rng.choices("qxzjkvwyp", k=7)) for _ in range(60)) for _ in range(5)]
    rows += [(1000 + k, x, None, "s", 1) for k, x in enumerate(noise)]
    mixed = " ".join(rng.choices(words["en"] + words["de"], k=60))
    good = [" ".join(rng.choices(words["en"], k=60)), "Hm, so?", mixed]
    rows += [(2000, good[0], None, "s", 1), (2001, good[1], None, "s", 1), (2002, mixed, "de", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, SMALL).collect()}
    assert left == {r[0] for r in rows if not 1000 <= r[0] < 2000}


@pytest.mark.parametrize("label", [None, "und"])
def test_without_labels_texts_with_a_letter_stay(spark, label):
    rows = [(1, "Some clean words of text.", label, "s", 25), (2, "12 34 !!", label, "s", 8), (3, None, label, "s", 0), (4, "x", label, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, SMALL).collect()} == {1, 4}


def test_what_language_id_finds_decides_what_shares_a_sequence(spark):
    import random

    rng = random.Random(4)
    words = "the of and to in that is was for on with his they at be this from have".split()
    mirrored = str.maketrans("abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba")  # as many n-grams as the first
    own, rows = {}, []
    for k in range(0, 200, 2):  # some with each other's label, some with none
        text = " ".join(rng.choices(words, k=60))
        own |= {k: "aa", k + 1: "bb"}
        labels = ("bb", "aa") if k % 20 == 0 else (None, None) if k % 20 == 10 else ("aa", "bb")
        rows += [(k, text, labels[0], "s", 1), (k + 1, text.translate(mirrored), labels[1], "s", 1)]
    rows += [(1000, "\u03a9", "aa", "s", 1), (1001, "\u03a9", "bb", "s", 1), (1002, "\u03a9", None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.identify_language(spark, docs, SMALL)
    langs = {r["doc_id"]: r["lang"] for r in found.collect()}
    assert langs == own | {1000: "aa", 1001: "bb", 1002: "und"}
    packed = corpus_pipeline.pack_sequences(spark, found, SMALL).collect()
    assert {(r["doc_id"], r["lang"]) for r in packed} == set(langs.items())
    held = {}
    for r in packed:
        held.setdefault(r["sequence_id"], set()).add(langs[r["doc_id"]])
    assert all(len(x) == 1 for x in held.values())
    # with the labels alone, texts in one language would share sequences with texts in the other
    by_label = {}
    for r in corpus_pipeline.pack_sequences(spark, docs, SMALL).collect():
        by_label.setdefault(r["sequence_id"], set()).add(langs[r["doc_id"]])
    assert any(len(x) > 1 for x in by_label.values())


def test_without_a_model_labels_stay(spark):
    docs = spark.createDataFrame([(1, "Some words.", "en"), (2, "Some words.", None)], "doc_id long, text string, lang string")
    none = language_id.fit(docs.limit(0).withColumnRenamed("doc_id", "id"))
    assert {r["doc_id"]: r["lang"] for r in language_id.keep_identified(docs, none).collect()} == {1: "en", 2: "und"}
    assert language_id.keep_identified(docs.drop("lang"), none).columns == ["doc_id", "text", "lang"]
