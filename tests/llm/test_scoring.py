import numpy as np

from cellgrid.llm import language_id as L
from cellgrid.llm import quality as Q


def test_codebooks_keep_apart():
    for k in (2, 3, 4, 5, 12, 40):
        code = L.codebook(k)
        assert len(code) == k and len({tuple(r) for r in code.tolist()}) == k
        apart = min((code[a] != code[b]).sum() for a in range(k) for b in range(a))
        assert apart >= (1 if k == 2 else 2)


WORDS = {"aa": "the of and that with ing tion", "bb": "der die und nicht sch keit ung", "cc": "le la que eau eux ment"}


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        lang = sorted(WORDS)[i % 3]
        parts = WORDS[lang].split()
        rows.append((i, " ".join("".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(rng.integers(3, 40))), lang))
    return rows


def test_languages(spark):
    train = spark.createDataFrame(corpus(300, 1), "id long, text string, lang string")
    test = corpus(150, 2)
    got = {r["id"]: r for r in L.language_id(spark.createDataFrame(test, "id long, text string, lang string"), train).collect()}
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang in test]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_odd_texts(spark):
    train = spark.createDataFrame(corpus(90, 1) + [(None, None, "aa"), (7, "x", None)], "id long, text string, lang string")
    rows = [(1, None), (2, ""), (3, "12 34 !?"), (4, "que la le"), (4, "que la le"), (None, "\u00e9"), (6, "und " * 50_000)]
    df = spark.createDataFrame([(*r, "z", "z") for r in rows], "id long, text string, lang_pred string, score string")
    got = L.language_id(df, train).collect()
    assert len(got) == len(rows)
    by = {r["id"]: r["lang_pred"] for r in got}
    assert by[1] == by[2] == by[3] == "und" and by[4] == "cc" and by[6] == "bb"
    assert L.language_id(df.limit(0), train).count() == 0
    none = L.language_id(df, train.limit(0)).collect()
    assert {r["lang_pred"] for r in none} == {"und"} and {r["score"] for r in none} == {0.0}
    one = L.language_id(df, train.filter("lang = 'aa'")).collect()
    assert {r["lang_pred"] for r in one} == {"und", "aa"}


def test_rejects_only_what_has_no_letters(spark):
    train = spark.createDataFrame(corpus(90, 1), "id long, text string, lang string")
    rows = [(1, None), (2, "123 !"), (3, "und"), (4, "der la the 5")]
    kept = L.keep_identified(spark.createDataFrame(rows, "doc_id long, text string"), L.fit(train))
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4]


def good(rng):
    return " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) + (". " if rng.random() < 0.1 else "") for _ in range(rng.integers(5, 200)))


def bad(rng):
    kind = rng.integers(3)
    words = good(rng).split()
    return " ".join(w + "%%%" for w in words) if kind == 0 else " ".join(w for w in words[:8] for _ in range(15)) if kind == 1 else " ".join(w.upper() + "!!" for w in words)


def test_quality(spark):
    rng = np.random.default_rng(3)
    rows = [(i, good(rng) if i % 3 else bad(rng), int(i % 3 > 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 400] + [(0, 0), (None, 1), (5, None)], "id long, label int")
    model = Q.fit(labels, docs)
    got = {r["id"]: r["score"] for r in Q.score(docs, model).collect()}
    assert np.mean([(got[i] >= 0.5) == y for i, _, y in rows if i >= 400]) > 0.97
    odd = spark.createDataFrame([(1, None, 1), (2, "", 2), (2, "", 2), (None, "x", 3), (4, "y " * 100_000, 4)], "id long, text string, score int")
    assert all(0 <= r["score"] <= 1 for r in Q.score(odd, model).collect())
    assert [r["score"] for r in Q.score(odd, Q.fit(labels.limit(0), docs)).collect()] == [0.5] * 5
    assert Q.fit(labels.filter("label = 1"), docs) is None
    assert Q.score(docs.limit(0), model).count() == 0


def test_shrinkage_keeps_factors_finite():
    x = np.column_stack((np.ones(40), np.arange(40.0)))
    model = Q.fit_matrix(x, (np.arange(40) > 19).astype(int))
    assert np.isfinite(model.whiten).all() and model.score(x)[0] < 0.5 < model.score(x)[-1]


def plain_grams(text):
    """Hashed byte n-grams of a text's words between edges, one by one."""
    out = []
    for word in text.lower().encode().split():
        edged = b" " + word + b" "
        for n in range(1, 5):
            for k in range(len(edged) - n + 1):
                code = 0
                for byte in edged[k : k + n]:
                    code = (code * 257 + byte + 1) & 0xFFFFFFFF
                x = ((code ^ (n * 0x9E3779B1 & 0xFFFFFFFF)) * 0x85EBCA6B) & 0xFFFFFFFF
                x = ((x ^ (x >> 15)) * 0xC2B2AE35) & 0xFFFFFFFF
                out.append((x ^ (x >> 13)) % L.DIMENSIONS)
    return out


def test_languages_against_brute_force(spark):
    """The whole method by plain loops: profiles, one log-odds classifier a bit, the least logistic loss."""
    train, test = corpus(90, 5), corpus(60, 6)
    languages = sorted(WORDS)
    profile = {lang: np.full(L.DIMENSIONS, 0.5) for lang in languages}
    for _, text, lang in train:
        for g in plain_grams(text):
            profile[lang][g] += 1
    profile = {k: v / v.sum() for k, v in profile.items()}
    code = L.codebook(len(languages))
    weights = []
    for bit in range(code.shape[1]):
        one, other = ([profile[x] for k, x in enumerate(languages) if (code[k, bit] > 0) == side] for side in (True, False))
        weights.append(np.log(np.mean(one, axis=0)) - np.log(np.mean(other, axis=0)))
    got = {r["id"]: r["lang_pred"] for r in L.language_id(spark.createDataFrame([r[:2] for r in test], "id long, text string"), spark.createDataFrame(train, "id long, text string, lang string")).collect()}
    for i, text, _ in test:
        grams = plain_grams(text)
        margins = [sum(w[g] for g in grams) / len(grams) * min(len(grams), L.EVIDENCE) / L.EVIDENCE * 8 for w in weights]
        losses = [np.mean([np.log1p(np.exp(-m * c)) for m, c in zip(margins, code[k])]) for k in range(len(languages))]
        assert got[i] == languages[int(np.argmin(losses))]


def test_discriminant_against_plain_densities():
    """Log-density differences from explicit inverses and determinants."""
    rng = np.random.default_rng(2)
    y = (rng.random(400) < 0.4).astype(int)
    x = rng.normal(size=(400, 3)) @ rng.normal(size=(3, 3)) + y[:, None] * [1.0, 0.5, -1.0]
    model = Q.fit_matrix(x, y)
    z = np.clip((x - x.mean(axis=0)) / x.std(axis=0), -8, 8)
    covs = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    pooled = covs[0] * (y == 0).mean() + covs[1] * (y == 1).mean()
    dens = []
    for c in (0, 1):
        s = 0.85 * covs[c] + 0.1 * pooled + 0.05 * np.diag(np.diag(pooled)) + 1e-4 * np.eye(3)
        d = z - z[y == c].mean(axis=0)
        dens.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) + np.linalg.slogdet(s)[1]))
    assert np.allclose(model.difference(x), dens[1] - dens[0])
    p = model.score(x)
    assert 0 <= p.min() and p.max() <= 1 and abs((p - y).mean()) < 0.01  # the logistic fit is calibrated


def test_folds_and_thresholds_of_the_queries(spark):
    import os
    import zlib

    import pytest

    from cellgrid.llm import queries

    small = "/root/testdata/sf0.001"
    if not os.path.isdir(small):
        pytest.skip("no test tables here")
    fold = lambda i, n: zlib.crc32(str(i).encode()) % n
    for r in queries.op6_quality(spark, small).collect():
        assert r["held_out"] == (fold(r["doc_id"], 4) == 2) and r["predicted"] == int(r["score"] >= 0.7)
    langs = {r["lang"] for r in spark.read.parquet(f"{small}/documents.parquet").select("lang").collect()}
    for r in queries.op9_language_id(spark, small).collect():
        assert r["held_out"] == (fold(r["doc_id"], 3) == 1) and r["lang_pred"] in langs | {"und"}


def test_shards_of_the_query(spark):
    import os

    import pytest

    from cellgrid.llm import queries

    small = "/root/testdata/sf0.001"
    if not os.path.isdir(small):
        pytest.skip("no test tables here")
    got = queries.op3_sharding(spark, small).toPandas()
    texts = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").toPandas()
    joined = got.merge(texts, on="doc_id")
    assert (joined["size"] == joined["text"].fillna("").map(lambda t: len(t.encode()) + 1)).all()
    assert (joined.groupby(joined["text"].fillna(""))["shard"].nunique() == 1).all()
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    by = got.groupby("shard")["size"].sum()
    assert len(by) == 8 and by.max() - by.min() <= got.groupby("text_crc32")["size"].sum().max()
