"""Held-out accuracy, hand-made cases, and tables of nulls, nothing, repeated rows and clashing names."""

import zlib

import duckdb
import pyarrow as pa
import pytest

import corpus_pipeline
from tessera.llm import html_extraction as H
from tessera.llm import language_id as L
from tessera.llm import license_scan as Z
from tessera.llm import quality_rules as Q
from tessera.llm import toxicity as T
from tessera.llm.license_texts import TEXTS

SF = "/root/testdata/sf0.01"


def test_toxicity_held_out(spark):
    out = T.op7_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in out)
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.9
    assert all(0 <= r.score <= 1 for r in out)


def test_toxicity_segments():
    import numpy as np

    at, s = np.array([3, 5, 40, 41]), np.array([4.0, 3.0, 5.0, -20.0])
    found = T.segments(at, s)
    assert [(a, b) for a, b, _ in found] == [(3, 40)] or [(a, b) for a, b, _ in found] == [(3, 5), (40, 40)]
    # Against all intervals: the best segment has the greatest sum of any run of words.
    full = np.full(60, -T.DRIFT)
    full[at] = s - T.DRIFT
    best = max(full[i:j].sum() for i in range(60) for j in range(i + 1, 61))
    assert max(x[2] for x in found) == pytest.approx(best)


def test_toxicity_segments_are_all_maximal_ones():
    """Against the definition: runs of words no part of which sums to less than nothing at either end, that can't be widened."""
    import random

    def plain(x):
        # The best run, then the best runs on both sides of it.
        def split(lo, hi):
            best, at = 0.0, None
            for i in range(lo, hi):
                total = 0.0
                for j in range(i, hi):
                    total += x[j]
                    if total > best + 1e-12:
                        best, at = total, (i, j)
            if at is None:
                return []
            return split(lo, at[0]) + [(*at, best)] + split(at[1] + 1, hi)

        return split(0, len(x))

    import numpy as np

    r = random.Random(4)
    for _ in range(300):
        n = r.randint(1, 25)
        scored = {i: r.choice((-3.13, -0.71, 0.437, 1.31, 2.917, 5.3)) for i in range(n) if r.random() < 0.5}
        x = [scored.get(i, 0.0) - T.DRIFT for i in range(n)]
        got = T.segments(np.array(sorted(scored), dtype=np.int64), np.array([scored[i] for i in sorted(scored)]))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in plain(x)] and [s for _, _, s in got] == pytest.approx([s for _, _, s in plain(x)])


def test_toxicity_every_use_counts(spark):
    """Toxic words used singly, then a dense passage of them, twice; and more segments than a few."""
    import numpy as np
    import pyarrow as pa
    from tessera.llm import bytewise as B

    words = "vexo karn dulm".split()
    one = next(iter(B.chunks(pa.array([" ".join(words)]))))
    hashes = T.features(one)[0][-1]
    m = T.Model(np.sort(hashes), np.full(3, 4.0), 1.0, 1e-3, 1.0, -5.0)
    quiet = ["plain"] * 200
    text = [w for x in words for w in [*quiet, x]] + (quiet * 5 + words * 4) * 2
    docs = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(quiet))], "doc_id long, text string")
    got = {r.doc_id: [(p.first, p.last) for p in r.passages] for r in T.scored(docs, m).collect()}
    assert got[1][-2:] == [(1603, 1614), (2615, 2626)] and got[2] == []
    few, many = ([(i, i, 9.0) for i in range(n)] for n in (8, 20))
    assert T.significance(few, 1_800_000, 1.0, 1e-3) < T.significance(many, 1_800_000, 1.0, 1e-3) < T.CAP


def test_toxicity_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string, score string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    m = T.fit(none, labels)
    assert T.scored(none, m).collect() == []
    docs = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (2, "", None), (None, "x y", "b")], "doc_id long, text string, score string")
    rows = T.scored(docs, m).collect()
    assert len(rows) == 4 and all(r.n_passages == 0 for r in rows)
    assert T.clean(docs, m).columns == docs.columns


def test_language_held_out(spark):
    out = L.op8_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.95


def test_language_edges(spark):
    docs = spark.createDataFrame([(i, t, g, "x") for i, (t, g) in enumerate([(None, "en"), ("", "de"), ("12 !!", "en"), ("日本", "en"), ("word word", None)])], "doc_id long, text string, lang string, lang_pred string")
    m = L.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    got = {r.doc_id: r.lang_pred for r in L.predicted(docs, m).collect()}
    assert [got[i] for i in range(3)] == ["und"] * 3 and got[3] != "und" and got[4] != "und"
    assert {r.doc_id for r in L.identified(docs, m).collect()} == {3, 4}
    empty = spark.createDataFrame([], docs.schema)
    assert L.predicted(empty, L.fit(empty)).collect() == []
    assert {r.lang_pred for r in L.predicted(docs, L.fit(empty)).collect()} == {"und"}


@pytest.fixture(scope="module")
def page_model():
    return H.fit(H.labelled_pages())


def test_pages_held_out(page_model):
    """Leaves told right; on pages without telling names a short header or footer can't always be."""
    right, total = [0, 0], [0, 0]
    for html in H.labelled_pages(160, 7):
        t = H.parse(html, marked=True)
        named = not H.nameless(t)
        for tag, y, m in zip(t.tag, t.label, page_model.marginals(t), strict=True):
            if tag == H.LEAF and y is not None:
                total[named] += 1
                right[named] += (m > 0) == bool(y)
    assert right[True] / total[True] > 0.98 and right[False] / total[False] > 0.94


def test_page_text(page_model):
    html = """<html><head><title>No</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body><nav><a href=x>Home</a></nav>
    <header class="site-header">Site name</header><div class="cookie-notice">We use cookies. Accept them all, please.</div>
    <article><h1>A &amp; B</h1><p>First   line<br>of <b>bold</b> text, and some more of it.<p>Second &eacute;&nbsp;paragraph, which is not closed. It goes on.
    <div class="ad">Buy this now. It is cheap and good.</div><ul><li>One thing to keep in mind, always.</li></ul></article>
    <section id="comments"><p>Nice text, I liked it a lot. Thank you!</p></section><aside><p>Related things that you may like to read.</p></aside><footer>&copy; 2020 Me. All rights reserved.</footer></body>"""
    assert H.blocks(html, page_model) == ["A & B", "First line of bold text, and some more of it.", "Second é paragraph, which is not closed. It goes on.", "One thing to keep in mind, always."]


@pytest.mark.parametrize("odd", ['<div data-main-nav="x"></div>', "<div data-main=x></div>", '<svg class="i"/>', "<svg class=i/>", '<svg><title/><path d="x"/>', "<svg-icon></svg-icon>", "<video-js></video-js>", "<button-group></button-group>", "<button>", "<object data=a>", "<select>", "<canvas>", "<video src=a>", "<template>", "<template><p>Not a text of the page, as it is.</p></template>", "<button>Share</button>"])
def test_page_goes_on_after_odd_elements(page_model, odd):
    one, two = "First text of the page, that is long enough.", "Second text of the page, also long enough."
    assert H.blocks(f"<body>{odd}<article><h1>A title</h1><p>{one}</p><p>{two}</p></article>", page_model) == ["A title", one, two]
    assert H.blocks(f"<body><article><h1>A title</h1><p>{one}</p>{odd}<p>{two}</p></article>", page_model) == ["A title", one, two]


def test_page_without_telling_names(page_model):
    one, two = "First text of the page, that is long enough to be one. It goes on.", "Second text of the page, also long enough. It ends here."
    for a, b in (("div", "div"), ("div class=x1", "div"), ("section id=q7", "section"), ("td", "td")):
        page = f"<body><{a}><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul></{b}><{a}><h1>A title of it</h1><div>{one}</div><div>{two}</div></{b}><{a}>&copy; 2020 A company</{b}>"
        assert H.blocks(page, page_model) == ["A title of it", one, two], page


def test_page_with_open_quotes_and_deep_trees(page_model):
    import time

    one, two = "First text of the page, that is long enough.", "Second text of the page, also long enough."
    assert H.blocks(f"<article><h1>A title</h1><p class='x>{one}</p><p class='y'>{two}</p><p title=\"a > b\"class=c>{one}</p></article>", page_model) == ["A title", one, two, one]
    began = time.time()
    for page in ("<div>" * 20000 + "</section>" * 20000, "<x-a>" * 20000 + "<p>a" * 20000, "<svg>" + "<g>" * 20000 + "<path/>" * 20000, "<p class='x' " * 20000, "<button " * 20000):
        H.parse(page)
    assert time.time() - began < 20


def test_page_text_of_math_object_and_noscript(page_model):
    one, two = "First text of the page, that is long enough.", "Second text of the page, also long enough."
    html = f"<body><article><h1>A title</h1><p>{one}</p><noscript><p>{two}</p></noscript><object data=a><p>{two}</p></object><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold for all of it.</p></article>"
    assert H.blocks(html, page_model) == ["A title", one, two, two, "Let x=2 hold for all of it."]


def test_page_edges(spark, page_model):
    pages = spark.createDataFrame([(1, "u", None, "t"), (2, "u", "", "t"), (2, "u", "", "t"), (3, None, "<<<p <b", "t"), (4, "u", "<p>" * 3000, "t")], "page_id long, url string, html string, text string")
    rows = H.extracted(pages, page_model).collect()
    assert len(rows) == 5 and all(r.text == "" or r.page_id == 3 for r in rows) and all(r.n_chars == len(r.text) for r in rows)
    assert H.extracted(pages.limit(0), page_model).collect() == []


def test_message_passing_is_exact(page_model):
    """Marginals of a small tree against all labellings."""
    import itertools
    import math

    t = H.parse("<div class=content><p>Some words here.</p><ul><li><a>x</a></li></ul></div>")
    n = len(t.tag)
    unary = [sum(page_model.weights.get(x, 0.0) for x in f) * (page_model.leaf if tag == H.LEAF else 1) for f, tag in zip(H.node_features(t), t.tag, strict=True)]
    total = [[0.0, 0.0] for _ in range(n)]
    for y in itertools.product((0, 1), repeat=n):
        e = sum(u for u, v in zip(unary, y, strict=True) if v) + sum(page_model.pair.get(H._pair_kind(t, i, H.nameless(t)), page_model.default)[2 * y[t.parent[i]] + y[i]] for i in range(1, n))
        for i in range(n):
            total[i][y[i]] += math.exp(e)
    assert page_model.marginals(t) == pytest.approx([math.log(b / a) for a, b in total])


def test_licences(spark):
    mit = TEXTS["MIT"]
    rows = [(1, mit), (2, mit.upper().replace(",", " ;")), (3, "Copyright 2001 Somebody\n" + mit.replace("<year> <copyright holders>", "2020 A. Person")), (4, mit + "more"), (5, None), (6, ""), (7, TEXTS["Zlib"].replace("acknowledgment", "acknowledgement")), (7, mit[:50])]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, digest string, license_id string")
    got = sorted((r.doc_id, r.license_id) for r in Z.scan(docs).collect() if r.is_license)
    assert got == [(1, "MIT"), (2, "MIT"), (3, "MIT"), (7, "Zlib")]
    assert Z.scan(docs.limit(0)).collect() == [] and len(Z.scan(docs).collect()) == len(rows)


def test_licences_wrapped(spark):
    """Wrapped anew at any width, so that lines begin with any word of the text."""
    import re
    import textwrap

    def wrapped(text, width):
        return "\n\n".join(textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) if not re.match("copyright", p, re.I) else p for p in text.split("\n") if p.strip())

    rows = [(k, wrapped(t, w)) for k, t in TEXTS.items() for w in range(20, 90, 3)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = Z.scan(docs).collect()
    assert [r.doc_id for r in got if r.license_id != r.doc_id] == []
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}))
    assert sorted(con.execute(Z.ORACLE_SQL["op5_license_scan"]).fetchall()) == sorted((r.doc_id, r.canon_chars, r.digest, r.license_id, r.is_license) for r in got)


def test_long_licences_by_digest(spark):
    """Published texts, as they are and wrapped anew; where this machine has them."""
    import os
    import textwrap

    names = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0", "MPL-2.0": "MPL-2.0"}
    rows = [(v, open(f"/usr/share/common-licenses/{k}", encoding="utf-8").read()) for k, v in names.items() if os.path.exists(f"/usr/share/common-licenses/{k}")]
    rows += [(k, textwrap.fill(t, 100, break_long_words=False, break_on_hyphens=False)) for k, t in rows if k == "MPL-2.0"] + [("", "Apache License")]
    got = Z.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert [r.doc_id for r in got if (r.license_id or "") != r.doc_id] == []


def test_quality_measures(spark):
    rows = [(1, None), (2, ""), (3, "a b c a b c"), (4, "x\nx\ny\n\n"), (5, "é# $% " * 30), (6, "one two three four " * 20), (6, "w")]
    docs = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, n_words int")
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in Q.measures(docs).collect()]
    assert sorted(got) == [(1, 0, 0, 0, 0, 0), (2, 0, 0, 0, 0, 0), (3, 6, 6, 0, 0, 6), (4, 3, 3, 0, 1, 0), (5, 60, 120, 90, 0, 60), (6, 1, 1, 0, 0, 0), (6, 80, 300, 0, 0, 80)]
    assert Q.apply(docs.limit(0)).collect() == []


def test_pipeline(spark):
    """Each stage takes effect on its own input and keeps what is clean."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = corpus_pipeline.run(spark, sf).collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "jaccard_join", "substring_dedup", "best_fit_packing"]
    left = {r.doc_id for r in rows}
    assert left <= {r.doc_id for r in docs.collect()} and len(left) > docs.count() // 2
    clean = T.clean(docs, T.fit(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    known = L.identified(clean, L.fit(clean))
    sets: dict = {}
    from test_dedup import join, plain_substrings, shingles

    texts = {r.doc_id: r.text for r in known.collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    first = {i: texts[i] for i, c in join(links, sets).items() if i == c}
    gone = {i for i, (n, k, _) in plain_substrings(list(first.items())).items() if n and n == k}
    assert left == first.keys() - gone


def test_pipeline_edges(spark, tmp_path):
    """Nulls, an empty text, repeats, shared ids, clashing names; then nothing at all."""
    text = " ".join(f"word{i} and" for i in range(60))
    rows = [(1, text, "en"), (2, text, "en"), (3, None, None), (4, "", "en"), (5, "12 34", None), (6, "quite another text of a few words", None), (6, "and one more under the same id as that", None), (6, "quite another text of a few words", None)]
    docs = spark.createDataFrame([(i, t, g, "s", 0, None, 1) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long, _r string, n_removed int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    known = L.fit(docs)
    stages = dict(corpus_pipeline.STAGES)
    told = {r.doc_id for r in L.identified(docs, known).collect()}
    assert told <= {1, 2, 6} and stages["toxicity"](spark, docs, str(tmp_path)).count() == len(rows)
    alone = stages["jaccard_join"](spark, docs, str(tmp_path))
    assert alone.columns == docs.columns and sorted(r.doc_id for r in alone.collect()) == [1, 3, 4, 5, 6, 6]
    cut = stages["substring_dedup"](spark, docs, str(tmp_path))
    assert cut.columns == docs.columns and 2 not in {r.doc_id for r in cut.collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= {1, 6}
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


@pytest.mark.parametrize("classes", ["no toxic in fold 4", "no clean in fold 4", "only fold 4", "only toxic", "only clean", "none"])
def test_toxicity_with_labels_of_one_class(spark, classes):
    import random

    rng = random.Random(5)
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    text = lambda toxic: " ".join(rng.choice(["vile", "filth", "scum"] if toxic and k % 3 == 0 else ["tree", "river", "stone", "cloud", "house", "road"]) for k in range(60))
    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(2400)]
    keep = {
        "no toxic in fold 4": lambda i, t: fold(i) != 4 or not t, "no clean in fold 4": lambda i, t: fold(i) != 4 or t, "only fold 4": lambda i, t: fold(i) == 4,
        "only toxic": lambda i, t: t, "only clean": lambda i, t: not t, "none": lambda i, t: False,
    }[classes]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows if keep(i, t)], "doc_id long, toxic int")
    kept = {r.doc_id for r in T.clean(docs, T.fit(docs, labels)).collect()}
    clean, toxic = {i for i, _, t in rows if not t}, {i for i, _, t in rows if t}
    assert clean <= kept
    if classes.startswith("only fold") or classes.endswith("fold 4"):
        assert len(toxic & kept) < 0.05 * len(toxic)
    else:
        assert kept == clean | toxic


ONE, TWO, THREE = "First text of the page, that is long enough to be one. It goes on.", "Second text of the page, also long enough. It ends here.", "A third text, with what is left to say about it."
H1, HEAD = "<h1>A title of it</h1>", "A title of it"


@pytest.mark.parametrize(
    ("inner", "want"),
    [
        ("<main>{h1}{p}</main>", [HEAD, ONE, TWO, THREE]), ("<main>{p}</main>", [ONE, TWO, THREE]), ("<div class=wrapper><main>{h1}{p}</main></div>", [HEAD, ONE, TWO, THREE]),
        ("<article>{h1}{p}<p><a href=x>A text that is a link as a whole, and long.</a></p></article>", [HEAD, ONE, TWO, THREE, "A text that is a link as a whole, and long."]),
        ("<article>{h1}<p><a href=x>See the notes</a></p>{p}</article>", [HEAD, "See the notes", ONE, TWO, THREE]),
        ("<article><header>{h1}</header>{p}</article>", [HEAD, ONE, TWO, THREE]), ("<article><header>{h1}</header><p>" + ONE + "</p></article>", [HEAD, ONE]),
        ('<div class="content"><header>{h1}</header><p>' + ONE + "</p></div>", [HEAD, ONE]), ('<div class="content"><header>{h1}</header>{p}{p}</div>', [HEAD, ONE, TWO, THREE] * 1 + [ONE, TWO, THREE]),
        ("<article>{h1}{p}<h2><a href=y>A linked heading</a></h2><p>" + ONE + "</p></article>", [HEAD, ONE, TWO, THREE, "A linked heading", ONE]),
        ("<article>{h1}{p}<ul><li><a href=s>First source</a></li><li><a href=t>Second source</a></li></ul></article>", [HEAD, ONE, TWO, THREE, "First source", "Second source"]),
        ('<article>{h1}{p}</article><section class="comments"><p>I liked this text. It is good.</p></section>', [HEAD, ONE, TWO, THREE]),
    ],
)
def test_page_written_by_hand(page_model, inner, want):
    """Whole articles come back, between an ordinary nav and footer that don't."""
    nav = "<nav><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li><li><a href=c>About us</a></li></ul></nav>"
    html = f"<body>{nav}{inner.format(h1=H1, p=''.join(f'<p>{x}</p>' for x in (ONE, TWO, THREE)))}<footer><p>&copy; 2020 A company. All rights reserved.</p></footer></body>"
    assert H.blocks(html, page_model) == want
