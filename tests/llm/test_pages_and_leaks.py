import pytest

from cellgrid.llm import decontaminate as D
from cellgrid.llm import html_extract as H


@pytest.fixture(scope="module")
def model():
    return H.fit(H.labelled_pages())


def test_held_out_blocks(model):
    right = total = 0
    for page in H.labelled_pages(150, seed=77):
        nodes = H.parse(page)
        for node, odds in zip(nodes, model.marginals(nodes)):
            if node.tag == "#text":
                total += 1
                right += (node.label == 1) == (odds >= 0)
    assert right / total > 0.96


def test_page(model):
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><a href="/">Site</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- ad --><div class="ad">Buy this now.</div>
    <article><h1>Title &amp; more</h1><p><b>Lead.<br><p>Some  text\nwith &eacute; &#8364; and a <a href="/x">link</a>.</p><ul><li>One</li><li>Two words</li></ul><p>Word<p>&lt;tag&gt; a < b</article>
    <aside class="sidebar"><h3>More</h3><ul><li><a href="/b">B</a></li></ul></aside><form><label>Name</label><input></form>
    <section class="comments"><p>I liked it.</p></section><div class="cookie-notice">We use cookies.</div><footer>&copy; x.example.com &middot; All.</footer></body></html>"""
    assert model.extract(page).split("\n") == ["Title & more", "Lead.", "Some text with é € and a link.", "One", "Two words", "Word", "<tag> a < b"]


def test_odd_pages(model, spark):
    assert model.extract(None) == model.extract("") == model.extract("<script>x") == model.extract("<!-- x") == ""
    for page in ("<p", "<p class='x", "<<<>>>", "</p></div>", "<a><a><a>", "&am", "<p>" * 3000, "<div " * 3000, "<![CDATA[x]]>", "<!-->x<p>y"):
        assert isinstance(model.extract(page), str)
    rows = [(1, "u", None, "t"), (1, "u", "", "t"), (None, None, "<article><p>Some words of text here.</p></article>", None)]
    got = H.extract(spark.createDataFrame(rows, "id long, url string, html string, text string"), model).collect()
    assert sorted((r["text"], r["n_chars"]) for r in got) == [("", 0), ("", 0), ("Some words of text here.", 24)]
    assert H.extract(spark.createDataFrame([], "id long, url string, html string"), model).count() == 0


def test_messages_are_exact(model):
    """The marginals against a sum over all states of a small tree."""
    import itertools
    import math

    nodes = H.parse('<article><p>One two.</p><div class="ad"><p>Buy.</p></div></article>')
    free = [i for i, x in enumerate(nodes) if x.tag not in H.ROOTS]
    weight = dict.fromkeys(free, 0.0)
    whole = 0.0
    for states in itertools.product((0, 1), repeat=len(free)):
        s = dict(zip(free, states))
        w = 1.0
        for i in free:
            own = sum(model.weights.get(f, 0.0) for f in H.node_features(nodes[i], nodes))
            w *= math.exp(own) if s[i] else 1.0
            if nodes[i].parent in s:
                w *= model.edge[s[nodes[i].parent]][s[i]]
        whole += w
        for i in free:
            weight[i] += w * s[i]
    odds = model.marginals(nodes)
    assert all(abs(1 / (1 + math.exp(-odds[i])) - weight[i] / whole) < 1e-9 for i in free)


def test_entities():
    assert H.parse("<p>a&nbsp;&nbsp;b &amp;amp; &#x41;</p>")[-1].text == "a b &amp; A"


ITEM = "Anna has 12 apples and gives 5 of them to Bob. How many apples does Anna keep after Bob leaves?"


def held(spark, docs, items=((1, ITEM),), **kw):
    d = spark.createDataFrame([(*r, 0, 0) for r in docs], "id long, text string, item int, matched int")
    return D.contaminated(d, spark.createDataFrame(list(items), "item long, text string"), **kw).collect()


def test_leaks(spark):
    other = "intro. Maria has 30 apples and gives 7 of them to Tom. How many apples does Maria keep after Tom leaves? end"
    mixed = "Maria has 30 apples and gives 7 of them to Tom. How many apples does Peter keep after Jack leaves?"
    docs = [(1, f"some words {ITEM} more words"), (2, other), (3, mixed), (4, "quite other text " * 30), (5, None), (6, ""), (None, ITEM), (1, ITEM), (8, "x " * 50_000 + ITEM)]
    got = {(r["id"], r["item"]): r for r in held(spark, docs)}
    assert set(got) == {(1, 1), (2, 1), (None, 1), (8, 1)}
    assert got[2, 1]["changed"] and not got[1, 1]["changed"] and got[1, 1]["matched"] == got[1, 1]["windows"]
    assert (got[8, 1]["from_word"], got[8, 1]["to_word"]) == (50_000, 50_020)


def test_parts_of_the_benchmark(spark):
    items = [(i, f"item number{i} has its own words{i} and some more text{i} to be found again") for i in range(30)] + [(None, ITEM), (40, None), (41, "too short")]
    docs = [(i, f"a b c {t} d e f") for i, t in items if t]
    once = sorted((r["id"] or -1, r["item"] or -1) for r in held(spark, docs, items))
    assert len(once) == 31 and all(a == b for a, b in once)
    assert held(spark, docs, [(1, None)]) == [] and held(spark, [], items) == []


def test_clean_documents_stay(spark):
    docs = spark.createDataFrame([(1, f"x {ITEM}"), (2, "fine"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM)], "item long, text string")
    assert sorted(r["doc_id"] for r in D.keep_clean(docs, items).collect()) == [2, 3]


def test_part_of_an_item(spark):
    item = "Der Hund lief schnell zum Haus und die Katze sah ihm lange nach bis er hinter dem Baum am Fluss ganz verschwunden war und nie mehr zu sehen blieb"
    words = item.split()
    docs = [(1, "etwas " * 30 + " ".join(words[3:20]) + " noch etwas"), (2, "etwas " * 30 + " ".join(words[3:12]) + " noch etwas")]
    assert [r["id"] for r in held(spark, docs, [(5, item)])] == [1]


def test_items_of_few_ordinary_words(spark):
    """Verbatim copies of items that template windows cannot tell, and items in documents in capitals."""
    items = ["Solve: 3x + 5 = 20, 2y - 7 = 9. Find X + Y.", "WHO WROTE THE FIRST EDITION OF THE ORIGIN OF SPECIES IN 1859?", "Who Wrote The Origin Of Species And In Which Year?", "Anna Bob Carl Dora Emil Fritz Gerd Hans Ida Jan Karl Lena Max", "12 km 30 min 7", "What is love?", "Yes!", ITEM, "..."]
    items = list(enumerate(items))
    docs = [(i, f"some words before {t} and some behind") for i, t in items]
    docs += [(100 + i, t.upper()) for i, t in items] + [(200, "Solve: 4x + 6 = 21, 3y - 8 = 10. Find A + B."), (201, "Anna Bob Carl"), (202, "13 km 30 min 7"), (203, "WHO WROTE THE FIRST EDITION OF THE BOOK OF KELLS IN 800?")]
    got = held(spark, docs, items)
    assert {(r["id"], r["item"]) for r in got} == {(i, i) for i in range(8) if i != 6} | {(100 + i, i) for i in range(8)}
    assert all(r["matched"] == r["windows"] for r in got) and len(got) == 15
    assert D.ways(spark.createDataFrame(items, "item long, text string")) == {"template": 1, "literal": 5, "short": 1, "whole": 1, "never": 1}


def brute_templates(docs, items):
    """The template rule by plain loops, over items whose windows all have enough ordinary words. A token is a kind and
    the words it stands for."""
    import re

    def tokens(text):
        out = []
        for w in text.split():
            bare = w.strip(D._EDGE)
            low = bare.lower()
            if not bare:
                continue
            kind = "N" if re.fullmatch(r"\d+", bare) or low in D.NUMBER_WORDS else "P" if bare[0].isupper() else ""
            if low in ("one", "a") and out is not None:
                kind = "?"
            if low in D.UNITS or low in D.MAYBE_UNITS and low != "a":
                kind = "U" if low in D.UNITS else "u"
            out.append([kind, [low], w[-1] in ".,;:!?", low in D.NUMBER_WORDS])
        for i, t in enumerate(out):
            if t[0] == "?":
                t[0] = "N" if i + 1 < len(out) and out[i + 1][3] and not t[2] else ""
        for i, t in enumerate(out):
            if t[0] == "u":
                t[0] = "U" if i and out[i - 1][0] == "N" and not out[i - 1][2] else ""
        joined = []
        for t in out:
            if joined and t[0] in ("N", "P") and joined[-1][0] == t[0] and not joined[-1][2]:
                joined[-1] = [t[0], joined[-1][1] + t[1], t[2], t[3]]
            else:
                joined.append(t)
        return [(k, tuple(w)) for k, w, *_ in joined]

    def windows(t):
        shape = [k or w for k, w in t]
        return {p: tuple(shape[p : p + 5]) for p in range(len(t) - 4) if sum(isinstance(x, tuple) for x in shape[p : p + 5]) >= 3}

    found = set()
    for i, text in docs:
        d = tokens(text)
        dw = windows(d)
        for item, own in items:
            t = tokens(own)
            tw = windows(t)
            met = [(p, q) for p, x in tw.items() for q, y in dw.items() if x == y]
            lines = {}
            for p, q in met:
                lines[q - p] = lines.get(q - p, 0) + 1
            best = {}
            for p, q in sorted(met):
                if p not in best or lines[q - p] > lines[best[p] - p]:
                    best[p] = q
            slots = {}
            for p, q in {(p + k, q + k) for p, q in best.items() for k in range(5)}:
                if t[p][0]:
                    slots.setdefault(t[p], []).append(d[q][1])
            total = sum(map(len, slots.values()))
            lead = {k: max(set(v), key=lambda x, v=v: (v.count(x), " ".join(x))) for k, v in slots.items()}
            taken = {}
            for k, v in lead.items():
                taken[k[0], v] = max(taken.get((k[0], v), 0), slots[k].count(v))
            if len(best) >= 0.8 * len(tw) and tw and sum(taken.values()) >= 0.8 * total:
                found.add((i, item))
    return found


def test_templates_against_brute_force(spark):
    import random

    rng = random.Random(8)
    names = ["Anna", "Bob", "Maria", "Tom", "Anna Maria", "Jean Paul", "Li"]
    numbers = ["3", "12", "450", "twelve", "one thousand", "a hundred", "two hundred"]
    shapes = [
        "{0} has {2} apples and gives {3} of them to {1}. How many apples does {0} keep after {1} leaves?",
        "a train runs {2} km in {3} hours while {0} waits at the gate for the next one",
        "if a box holds {2} pens and {0} buys {3} boxes how many pens does {0} own now",
        "we saw that {0} and {1} ran for {2} s on a track of {3} m near the old mill",
    ]
    fill = lambda s: s.format(*rng.sample(names, 2), *rng.sample(numbers, 2))
    items = [(k, fill(s)) for k, s in enumerate(shapes)]
    mixed = [s.replace("{0}", "{4}", 1).format(*rng.sample(names, 2), *rng.sample(numbers, 2), "Zoe") for s in shapes]
    docs = [(k, f"before it {t} and then") for k, t in enumerate([fill(rng.choice(shapes)) for _ in range(30)] + mixed + [s.lower() for _, s in items])]
    template_only = {(r["id"], r["item"]) for r in held(spark, docs, items)}
    assert template_only == brute_templates(docs, items) | {(34 + k, k) for k in range(4)}
    assert {i for i, _ in template_only if i < 30} == set(range(30))


def test_benchmark_in_a_script_without_spaces(spark):
    item = "小明有十二个苹果,他给了小红五个,请问小明还剩下几个苹果?"
    docs = [(1, f"一些别的文字。{item}后面的文字"), (2, "小明昨天去了学校,他见到了很多朋友。"), (3, "plain words " * 20)]
    assert [(r["id"], r["item"]) for r in held(spark, docs, [(7, item)])] == [(1, 7)]


def test_tokens():
    import numpy as np

    def kinds(text):
        t = np.array([D.token(w) for w in text.encode().split()], np.uint64)
        got = D.template(t, np.zeros(len(t), np.int64))
        return "".join(".NUP"[k] for k in got.kinds)

    assert kinds("a man ran 5 m in a second") == "...NU..."  # `a`, `in` and `second` are words here
    assert kinds("12 s after a hundred days, Anna Maria and Bob, Tom won") == "NU.NUP.PP."
    assert kinds("one thousand two hundred. three") == "NN" and kinds("one of them") == "..."


def test_small_bitmaps_only_send_more(spark, monkeypatch):
    monkeypatch.setattr(D, "LEAST_BITS", 6)
    monkeypatch.setattr(D, "MOST_BITS", 6)
    monkeypatch.setattr("cellgrid.llm.common.BROADCAST_ROWS", 0)
    items = [(i, f"item number{i} has its own words{i} and some more text{i} to be found again") for i in range(30)]
    docs = [(i, f"a b c {t} d e f") for i, t in items] + [(99, "no item is in here, whatever the bits say of it")]
    assert sorted((r["id"], r["item"]) for r in held(spark, docs, items)) == [(i, i) for i in range(30)]


def test_deep_and_broken_pages_take_time_in_proportion(model):
    import time

    n = 120_000
    pages = ["<div>" * n + "x" + "</section>" * n, "<blockquote>" * n, "<svg><p>" * n + "</svg>", "<script>" * n, '<a ">" ' * n, "<li>" * n + "</ul>" * n, "<p><b>" * n, "<svg>" * n + "</svg>" * n, "<math><annotation>" * n, "<!--" * n, "<a '" * n]
    for page in pages:
        began = time.perf_counter()
        model.extract(page)
        assert time.perf_counter() - began < 20, page[:20]


def test_no_words_are_lost(model):
    tail = "<p>The second part has some more words, and these go on for a while.</p>"
    assert model.extract(f"<article><p>The first part has words.</p><noscript><p>A part that is here without scripts, too.</p></noscript>{tail}</article>").count("\n") == 2
    for name in ("inhalt", "contenu", "x7f3", "kiri"):
        page = f'<body><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><div class="{name}"><h1>A title of words</h1><p>The first part has some words, and more of them follow here.</p>{tail * 3}</div><footer>&copy; x.example.com</footer></body>'
        assert model.extract(page).split("\n")[-3:] == [tail[3:-4]] * 3, name


def test_drawings_and_formulas(model):
    tail = "<p>The second part has some more words.</p>"
    for drawing in ('<svg width="1"/>', "<svg />", '<svg viewBox="0 0 1 1"><svg><path d="M0"/></svg><text>No</text></svg>', '<svg><svg/><text>No</text></svg>', "<math/>", "<svg>", '<svg><path d="M0">', "<script>var a = '<svg/>';</script>"):
        page = f"<article><p>The first part has words.</p>{drawing}{tail}</article>"
        assert model.extract(page) == "The first part has words.\nThe second part has some more words."
    formula = "<math><semantics><mrow><mi>x</mi><mo>+</mo><mn>1</mn></mrow><annotation encoding='tex'>x+1</annotation></semantics></math>"
    assert model.extract(f"<article><p>So we have {formula} in all.</p>{tail}</article>") == "So we have x+1 in all.\nThe second part has some more words."
    open_note = "<math><mi>x</mi><annotation>y</math>"
    assert model.extract(f"<article><p>So we have {open_note} in all.</p>{tail}</article>") == "So we have x in all.\nThe second part has some more words."


def test_all_words_of_an_element_count(model):
    many = " ".join(f"u{chr(97 + i)}" for i in range(20))
    nodes = H.parse(f'<div class="{many} sidebar" id="cookie"><p>Words.</p></div>')
    assert {"sidebar", "cookie"} <= set(nodes[1].words) and len(nodes[1].words) == 22
