import random
import re

import numpy as np
import pytest

from cellgrid.llm import embedding_dedup as E
from cellgrid.llm import minhash_dedup as M
from cellgrid.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def least_reachable(n, links):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def sets(texts, words):
    out = []
    for t in texts:
        w = WORD.findall((t or "").encode().lower())
        out.append(frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)]) if w else frozenset())
    return out


def brute(rows, words, percent):
    s = sets([t for _, t in rows], words)
    links = [(a, b) for a in range(len(s)) for b in range(a) if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])]
    label = least_reachable(len(s), links)
    big = float("inf")
    ids = [big if i is None else i for i, _ in rows]
    best = {k: min(ids[i] for i in range(len(s)) if label[i] == k) for k in set(label)}
    return sorted(((rows[i][0], len(s[i]), None if best[label[i]] == big else best[label[i]]) for i in range(len(s))), key=repr)


def got(df):
    return sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("seed", "words", "percent"), [(1, 3, 85), (2, 5, 80), (3, 1, 90)])
def test_documents_against_brute_force(spark, seed, words, percent):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 30, 120]))]
        for _ in range(rng.choice([1, 2, 15])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), rng.choice([" ", "\n"]).join(copy).upper() if rng.random() < 0.2 else " ".join(copy)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, text string")
    assert got(M.near_duplicates(df, words, percent)) == brute(rows, words, percent)


def test_odd_documents(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "one two"), (5, "ONE  two"), (6, "One Two three"), (6, "other words here now"), (6, "other words here now"), (None, "one two"), (8, "é È"), (9, "É È")]
    df = spark.createDataFrame([(i, t, b"", "p") for i, t in rows], "id long, text string, node binary, parts string")
    assert got(M.near_duplicates(df, 3, 85)) == brute(rows, 3, 85)
    assert M.near_duplicates(df.limit(0)).count() == 0


def test_one_of_each_stays(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(3, text, 1), (1, text, 2), (1, text, 2), (2, text + " x", 3), (7, "quite other words that stay here", 4), (8, None, 5), (9, "", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    assert sorted(r["doc_id"] for r in M.keep_one(df).collect()) == [1, 7, 8, 9]
    # of linked rows with one id one stays, of rows with an empty set those of another id or text
    other = " ".join(f"v{i}" for i in range(40))
    rows = [(5, other, 1), (5, other + " y", 2), (5, text, 3), (None, text + " x", 4), (9, "", 5), (9, "", 6), (9, None, 7), (None, None, 8), (None, None, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    kept = M.keep_one(df).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=repr) in [sorted([(5, x), (5, text), (9, ""), (9, None), (None, None)], key=repr) for x in (other, other + " y")]


def test_sketches_never_rule_out_a_link(spark, monkeypatch):
    """Sets that share tables but are not linked to their leader: found by blocks, whatever the blocks' size; also where
    nothing is broadcast."""
    rng = random.Random(12)
    base = [f"u{i}" for i in range(150)]
    rows = []
    for _ in range(70):  # a chain: each is near the one before, far from the first
        rows.append((len(rows), " ".join(base)))
        for _ in range(3):
            base[rng.randrange(len(base))] = f"u{rng.randrange(10**6)}"
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, text string")
    want = brute(rows, 1, 90)
    assert got(M.near_duplicates(df, 1, 90)) == want
    monkeypatch.setattr(M, "BLOCK", 3)
    monkeypatch.setattr("cellgrid.llm.common.BROADCAST_ROWS", 0)
    assert got(M.near_duplicates(df, 1, 90)) == want
    assert M.least_agreement(72, 85) < 0.85 * 72 and M.least_agreement(10, 100) == 10


def test_signatures_meet_as_sets_do():
    rng = np.random.default_rng(5)
    whole = rng.integers(1, 1 << 62, 1000).astype(np.uint64)
    a, b = np.sort(whole[:900]), np.sort(whole[100:])
    got = M.signatures(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]), 200)
    assert abs((got[0] == got[1]).mean() - 0.8**3) < 0.12


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 480)] + [(500, k) for k in range(501, 560)]
    label = least_reachable(600, links)
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert found == {k: label[k] for e in links if e[0] != e[1] for k in e}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def vectors_brute(rows):
    def unit(v):
        if v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, float) / max(abs(x) for x in v)
        return v / np.linalg.norm(v)

    u = [unit(v) if label is not None else None for _, v, label in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if u[a] is not None and u[b] is not None and rows[a][2] == rows[b][2] and len(u[a]) == len(u[b]) and u[a] @ u[b] >= 0.98]
    n = [sum(i in e for e in links) for i in range(len(rows))]
    label = least_reachable(len(rows), links)
    best = {k: min(rows[i][0] for i in range(len(rows)) if label[i] == k) for k in set(label)}
    return sorted((rows[i][0], n[i], best[label[i]]) for i in range(len(rows)))


def vectors_got(df):
    return sorted((r["id"], r["n_links"], r["component_id"]) for r in df.collect())


@pytest.mark.parametrize("block", [7, 1500])
def test_vectors_against_brute_force(spark, block):
    rng = np.random.default_rng(block)
    rows = []
    for _ in range(10):
        base = rng.normal(size=64)
        for _ in range(rng.choice([1, 3, 25])):
            rows.append((len(rows), [float(x) for x in (base + rng.normal(size=64) * rng.choice([0, 0.08, 0.14])).astype(np.float32)], int(rng.integers(2))))
    df = spark.createDataFrame(rows, "id long, embedding array<double>, label int")
    assert vectors_got(E.near_duplicates(df, block=block)) == vectors_brute(rows)


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, v, 1), (3, [2.0, 4.0, 6.0], 1), (4, v, 2), (5, v, None), (6, None, 1), (7, [0.0, -0.0, 0.0], 1), (8, [1.0, None, 3.0], 1), (9, [1.0, float("nan"), 3.0], 1), (10, [1.0, float("inf"), 3.0], 1), (11, [], 1), (12, [1.0, 2.0], 1), (13, [1e200, 2e200, 3e200], 1), (13, [1e-200, 2e-200, 3e-200], 1)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "id long, embedding array<double>, label int, node string, times int")
    assert vectors_got(E.near_duplicates(df)) == vectors_brute(rows)
    assert E.near_duplicates(df.limit(0)).count() == 0


def test_pairs_at_the_threshold_are_found():
    rng = np.random.default_rng(8)
    a = rng.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(4000, 64))
    b -= (b * a).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    x, y = E.bucket_keys(a), E.bucket_keys(0.98 * a + np.sqrt(1 - 0.98**2) * b)
    assert (x[:, :, :, None] == y[:, :, None, :]).any(axis=(1, 2, 3)).all()


def test_the_threshold_sets_the_parts():
    from cellgrid.llm import minhash_dedup as near

    assert (near.parts_for(85), near.parts_for(80), near.parts_for(100)) == (12, 16, 12)
    assert all(2 * (1 - (p / 100) ** near.PER_PART) ** near.parts_for(p) <= near.MISSED for p in range(50, 100))
