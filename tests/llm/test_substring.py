import random
import re

import pytest

from cellgrid.llm import substring_dedup as S
from cellgrid.llm.common import NULL_ID

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    """rows: (id, text). What each row loses, by comparing all windows."""
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, NULL_ID), NULL_ID if i is None else i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (NULL_ID if i is None else i):
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["id"], r["n_words"], r["n_removed"], r["text"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("seed", "alphabet", "window"), [(1, 2, 4), (2, 3, 6), (3, 30, 13), (4, 1, 5), (5, 6, 13)])
def test_against_brute_force(spark, seed, alphabet, window):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(alphabet)]
    pool = [[rng.choice(words) for _ in range(rng.randint(window, 3 * window))] for _ in range(6)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += rng.choice(pool) if rng.random() < 0.6 else [rng.choice(words) for _ in range(rng.randint(0, 20))]
            if rng.random() < 0.3:
                text += [rng.choice(words)] * rng.randint(1, 20)
        rows.append((rng.choice([i, i, i, i // 2, None]), rng.choice([" ", "\n", "\t "]).join(text)))
    df = spark.createDataFrame(rows, "id long, text string")
    assert got(S.remove_repeats(df, window)) == brute(rows, window)


def test_odd_rows(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, None), (2, ""), (3, " \n "), (4, passage), (4, passage), (5, f"x {passage} y"), (None, passage), (-7, "é" * 50), (9, "a\u00a0b " + passage)]
    df = spark.createDataFrame([(i, t, 0, "x", "y") for i, t in rows], "id long, text string, n_words int, block string, key string")
    assert got(S.remove_repeats(df)) == brute(rows, 13)
    assert got(S.remove_repeats(df.filter("id < -100"))) == []


def test_long_text(spark):
    long = " ".join(f"t{i % 997}x{i}" for i in range(60_000))
    rows = [(1, long), (2, "lead " + long + " tail"), (3, "w" * 300_000)]
    found = got(S.remove_repeats(spark.createDataFrame(rows, "id long, text string")))
    assert found == brute(rows, 13)


def test_rows_stay_in_place(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, passage, "en", None, 5), (2, f"a  b\n{passage}", None, "s", 6), (3, "a  b", "fr", "s", None), (4, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = {r["doc_id"]: tuple(r) for r in S.cut_repeats(df).collect()}
    assert found == {1: rows[0], 2: (2, "a b", None, "s", 3), 3: rows[2], 4: rows[3]}


def test_equal_stretches_have_equal_symbols():
    import numpy as np

    rng = np.random.default_rng(0)
    inner = rng.integers(1, 5, 60).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    found = []
    for seed in (1, 2):
        pad = np.random.default_rng(seed).integers(5, 9, 7 + seed).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        words = np.concatenate(([np.uint64(0)], pad, inner, pad, [np.uint64(0)]))
        at = 1 + len(pad)
        *_, (name, lo, hi, _, _) = S.rounds(words, np.array([0, len(words) - 1]), 2)
        inside = (lo >= at) & (hi <= at + len(inner))
        found.append([(int(n), int(a) - at) for n, a in zip(name[inside], lo[inside])])
    assert found[0] == found[1] and len(found[0]) > 10


def parse(texts):
    import numpy as np

    flat, breaks = S.joined_words([t.encode() for t in texts])
    made = S.parsed(flat, breaks, 26)
    owner = np.searchsorted(breaks, made.first, "right") - 1
    return flat, breaks, made, owner


def test_high_symbols_span_long_repeats():
    """The rounds end with one symbol a text; equal texts are one symbol, and a long passage within others has common
    symbols that cover most of it."""
    rng = random.Random(7)
    words = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    passage = words(600)
    texts = [f"{words(50)} {passage} {words(70)}", f"{words(90)} {passage}", passage, passage, words(500)]
    flat, breaks, made, owner = parse(texts)
    for i, t in enumerate(texts):
        assert (made.last - made.first)[owner == i].max() == len(t.split())
    a, b = S.span_hashes(flat, made.first, made.last)
    symbols = [set(zip(a[owner == i].tolist(), b[owner == i].tolist())) for i in range(len(texts))]
    assert symbols[2] == symbols[3] and not symbols[4] & (symbols[0] | symbols[1] | symbols[2])
    shared = [k for k, x in enumerate(zip(a.tolist(), b.tolist())) if owner[k] == 0 and x in symbols[1]]
    covered = {w for k in shared for w in range(int(made.first[k]), int(made.last[k]))}
    assert len(covered) > 400


def test_symbols_settle_copies(spark):
    """Windows of copies do not travel: only those of the first of them do."""
    rng = random.Random(9)
    text = " ".join(f"v{rng.randrange(10**6)}" for _ in range(900))
    rows = [(i, text) for i in range(40)] + [(99, text + " and more")]
    df = spark.createDataFrame(rows, "id long, text string")
    assert got(S.remove_repeats(df)) == brute(rows, 13)
    from pyspark.sql import functions as F

    blocked = df.withColumn("block", F.col("id"))
    shared = S._shared_symbols(S._send_symbols(blocked, 13, 8), 4).cache()
    sent = S._send_windows(blocked, shared, 13, 8).groupBy("block").agg(F.sum(F.octet_length("a0") / 8).alias("n"))
    n = {r["block"]: int(r["n"]) for r in sent.collect()}
    assert n.pop(0) == 888 and set(n) <= {99} and n.get(99, 0) < 300
    shared.unpersist()


def test_known_tells_twins_apart():
    import numpy as np

    known = S.Known(np.array([5, 5, 9], np.uint64), np.array([1, 2, 7], "<u4"), np.array([3, 8, 4]))
    names, halves = np.array([5, 5, 5, 9, 9, 1], np.uint64), np.array([1, 2, 3, 7, 8, 1], "<u4")
    assert known.earlier(names, halves, np.full(6, 6)).tolist() == [True, False, False, True, False, False]
    assert known.earlier(names, halves, np.full(6, 9)).tolist() == [True, True, False, True, False, False]
