"""Deduplication against plain versions, with nulls, ties, repeated rows, long texts, empty tables and clashing names."""

import hashlib
import random
import re

import numpy as np

from tessera.llm import components as C
from tessera.llm import embedding_dedup as E
from tessera.llm import jaccard_join as J
from tessera.llm import substring_dedup as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def corpus(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdeéXß", k=r.randint(1, 4)))
    passage = [" ".join(word() for _ in range(k)) for k in (49, 50, 51, 80, 130)]
    texts = [None, "", " \n", "one", "two words", "Two words"]
    for _ in range(n):
        parts = [" ".join(word() for _ in range(r.randint(0, 120))) for _ in range(2)]
        if r.random() < 0.6:
            parts.insert(1, r.choice(passage))
        if r.random() < 0.15:
            parts = [r.choice(passage)] * r.randint(1, 3)
        t = r.choice((" ", "\n", "  ")).join(parts)
        if r.random() < 0.3 and texts[-1]:
            w = texts[-1].split()
            for _ in range(r.randint(0, 2)):
                w[r.randrange(len(w))] = word()
            t = " ".join(w)
        texts.append(t)
    texts.append(" ".join(word() for _ in range(30_000)))
    texts.append(texts[-1] + " end")
    texts += texts[8:12]
    return list(enumerate(texts))


def plain_substrings(rows, window=50):
    first, words = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = words[i] = WORD.findall(t or "")
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def join(pairs, nodes):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def shingles(t):
    w = WORD.findall((t or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def query(spark, fn, tmp_path, name, df):
    df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return fn(spark, str(tmp_path)).collect()


def test_substrings(spark, tmp_path):
    rows = corpus(1)
    got = query(spark, S.op1_substring_dedup, tmp_path, "documents", spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == plain_substrings(rows)


def test_substring_index_grows_by_batches_and_compacts(spark, tmp_path):
    rows = corpus(2, 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = {tuple(r) for r in S.repeats(docs, batches=1).collect()}
    many = {tuple(r) for r in S.repeats(docs, path=f"file://{tmp_path}/index", batches=5, fanout=2).collect()}
    cover = lambda rs: {(d, k) for d, s, n, _ in rs for k in range(s, s + n)}
    assert cover(one) == cover(many)
    index = S.Index.open(spark, f"file://{tmp_path}/index", 2)
    assert 1 <= len(index.runs) < 5 and max(level for level, _ in index.runs) >= 1
    assert index.read().where("fp IS NULL").count() == 0


def test_substring_texts_and_extra_columns(spark):
    p = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, p, "x"), (2, f"before\n{p}\nafter", "y"), (3, p, "z"), (4, None, "n"), (None, p, "k")], "doc_id long, text string, n_removed_ string")
    out = {r.doc_id: r for r in S.deduplicated(docs).collect()}
    assert out[2].text == "before\nafter" and out[2].n_removed == 60 and 3 not in out
    assert out[1].text == p and out[4].text is None and out[None].text == p


def test_substring_index_in_a_later_session(spark, tmp_path):
    """A batch is added to an index that was opened anew; what is removed from it is as if all had come at once."""
    import pytest

    rows = corpus(6, 40)
    path, at = f"file://{tmp_path}/index", 30
    first, later = (spark.createDataFrame(x, "doc_id long, text string") for x in (rows[:at], rows[at:]))
    S.deduplicated(first, path=path).collect()
    with pytest.raises(ValueError):
        S.repeats(later, path=path)
    got = {r.doc_id: (r.text, r.n_removed) for r in S.deduplicated(later, path=path, earlier=first).collect()}
    both = {r.doc_id: (r.text, r.n_removed) for r in S.deduplicated(first.unionAll(later)).collect() if r.doc_id >= at}
    want = plain_substrings(rows)
    assert got == both and all(got[i][1] == want[i][1] for i in got) and any(n for _, n in got.values())


def test_substrings_of_shared_ids_and_clashing_names(spark):
    p, q = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(70))
    rows = [(1, p, 1, "a"), (5, f"x {p}", 2, "b"), (5, q, 3, "c"), (5, "short", 4, "d"), (5, f"x {p}", 2, "b"), (7, q, 5, "e"), (8, f"{p} {q} end", 6, "f")]
    docs = spark.createDataFrame([(*r, None) for r in rows], "doc_id int, text string, n_removed int, _gone string, start string")
    out = S.deduplicated(docs)
    assert out.columns == ["doc_id", "text", "_gone", "start", "n_removed"]
    assert sorted((r.doc_id, r._gone, r.text, r.n_removed) for r in out.collect()) == [(1, "a", p, 0), (5, "b", "x", 60), (5, "b", "x", 60), (5, "c", q, 0), (5, "d", "short", 0), (8, "f", "end", 130)]


def test_substrings_of_nothing(spark, tmp_path):
    assert query(spark, S.op1_substring_dedup, tmp_path, "documents", spark.createDataFrame([], "doc_id long, text string")) == []


def test_jaccard(spark, tmp_path):
    rows = corpus(3) + [(1000 + i, " ".join(f"k{j}" if (i * 7 + j) % 40 else f"z{i}" for j in range(90))) for i in range(30)]
    got = query(spark, J.op3_jaccard_join, tmp_path, "documents", spark.createDataFrame(rows, "doc_id long, text string"))
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = join(links, sets)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s), want[i]) for i, s in sets.items()}


def test_jaccard_hub_rounds_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(J, "PAIRS_PER_ROW", 0.0)
    rows = corpus(4, 50)
    got = {r.doc_id: r.component for r in J.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert got == join(links, sets)


def test_jaccard_edges(spark):
    assert J.classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (2, "A B c d e f"), (None, "a b c d e f"), (7, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component string")
    assert sorted((r.doc_id or -1, r.component or -1) for r in J.classes(docs).collect()) == [(-1, -1), (-1, 2), (2, 2), (5, 2), (5, 2), (7, 7)]
    kept = J.representatives(docs).collect()
    assert sorted((r.doc_id or -1) for r in kept) == [-1, -1, 2, 7]
    # Two texts under one id, the second like an earlier document; names that the operator uses itself.
    texts = [(2, "a b c d e f"), (3, "k l m n o p"), (3, "a b c d e f"), (3, "k l m n o p")]
    more = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in texts], "doc_id int, text string, hash int, d int, component int")
    assert sorted((r.doc_id, r.text) for r in J.representatives(more).collect()) == [(2, "a b c d e f"), (3, "k l m n o p")]
    assert J.representatives(more).columns == more.columns and J.representatives(more.limit(0)).collect() == []


def test_suffix_filter_is_an_upper_bound():
    r = np.random.default_rng(0)
    for _ in range(300):
        x, y = (np.unique(r.integers(0, 60, r.integers(0, 40))).astype(np.uint64) for _ in range(2))
        assert J.most_shared(x, y) >= len(np.intersect1d(x, y))
    assert J.most_shared(np.arange(64), np.arange(64)) == 64 and J.most_shared(np.arange(64), np.arange(64) + 1000) < 10


def test_embeddings(spark, tmp_path):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    x = np.vstack([base, base[:10] + 0.05 * rng.normal(size=(10, 16)), base[:3], np.repeat(base[:1], 30, axis=0) + 0.02 * rng.normal(size=(30, 16))]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0]), (904, [None] * 16)]
    got = {r.vec_id: r for r in query(spark, E.op2_embedding_dedup, tmp_path, "embeddings", spark.createDataFrame(rows, "vec_id long, embedding array<float>"))}
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    s = u @ u.T >= 0.95
    np.fill_diagonal(s, False)
    want = join([(int(a), int(b)) for a, b in zip(*np.nonzero(s))], range(len(x)))
    found = sum(got[i].n_links for i in range(len(x)))
    assert found >= 0.9 * s.sum() and all(got[i].n_links <= s[i].sum() for i in range(len(x)))
    assert {i: got[i].component_id for i in want} == want
    assert all(got[i].n_links == 0 and got[i].kept for i in range(900, 905))


def test_embeddings_of_nothing(spark):
    assert E.classes(spark.createDataFrame([], "vec_id long, embedding array<double>")).collect() == []


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (102, 102)] + [(200, 300 + i) for i in range(50)]
    got = {r.node: r.component for r in C.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: c for n, c in join(links, {x for p in links for x in p}).items() if n != 102}
