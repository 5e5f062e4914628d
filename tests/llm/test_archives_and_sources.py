"""WARC archives, importance resampling and the divergence of sources, against plain versions on small tables."""

import base64
import gzip
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import importance_resampling as R
from tessera.llm import source_divergence as D
from tessera.llm import warc as W

# WARC

HTML = [
    "", None, "<p>a</p>", "<p>a</p>", "x" * 100_000, "é" * 30_000, "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\nWARC/1.0\r\n", "WARC/1." * 5000,
    "\r\n\r\n", "5\r\nabc\r\n0\r\n\r\n", "x" * 100_000, "NUL\0x", "", "WARC/1.1\r\nContent-Length: 99999\r\n\r\n" * 900,
]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def plain(pages, least=0):
    first = {}
    for i, h in pages:
        if len((h or "").encode()) >= least and i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    return [(i, len((h or "").encode()), digest(h), *(("response", None) if first.get(h or "", i) == i else ("revisit", first[h or ""]))) for i, h in pages]


def read_back(spark, path):
    return [(r.page_id and int(r.page_id), r.payload_bytes, r.payload_digest, r.kind, r.of_page and int(r.of_page)) for r in W.resolved(W.captures(spark, path)).collect()]


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize(("segment", "compression", "least"), [(W.SEGMENT, "gzip", 0), (97, "gzip", 0), (5000, "none", 0), (1 << 30, "none", 5)])
def test_warc_round_trip(spark, tmp_path, segment, compression, least):
    pages = list(enumerate(HTML, 7))
    df = spark.createDataFrame([(i, f"http://h/{i} \r\n", h, "clash", i) for i, h in pages], "page_id long, url string, html string, payload string, segment long").repartition(3)
    path = W.archive(df, f"file://{tmp_path}/a", segment, least, compression)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")  # files that Spark may split, are
    try:
        assert ordered(read_back(spark, path)) == ordered(plain(pages, least))
        payloads = {int(r.page_id): r.payload.decode() for r in W.captures(spark, path).where("kind = 'response'").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert payloads == {i: HTML[i - 7] or "" for i, _, _, kind, _ in plain(pages, least) if kind == "response"}
    assert W.captures(spark, path).where("uri <> concat('http://h/', page_id, '%20%0D%0A')").count() == 0


def test_warc_edges(spark, tmp_path):
    schema = "page_id long, url string, html string"
    assert read_back(spark, W.archive(spark.createDataFrame([], schema), f"file://{tmp_path}/none")) == []
    long = "y" * 40_000
    rows = [(1, None, long), (1, None, long), (None, "u", long), (2, "u", long), (None, "u", "alone"), (3, "", "alone too")]
    got = read_back(spark, W.archive(spark.createDataFrame(rows, schema), f"file://{tmp_path}/odd", 1000))
    assert ordered(got) == ordered([(1, 40_000, digest(long), "response", None)] * 2 + [(x, 40_000, digest(long), "revisit", 1) for x in (None, 2)] + [(None, 5, digest("alone"), "response", None), (3, 9, digest("alone too"), "response", None)])


def foreign(parts, drop=(), total=None, order=None):
    """An archive by hand: each record its own gzip member, segments in the given order."""
    block = W.HTTP + W.chunked(b"".join(parts), 10)
    cuts = [block[i : i + 50] for i in range(0, len(block), 50)]
    out = []
    for k, c in enumerate(cuts, 1):
        kind = ["WARC-Type: response", "WARC-Record-ID: <a>", f"WARC-Payload-Digest: sha1:{digest(b''.join(parts).decode())}", "Page-Id: 1"] if k == 1 else ["WARC-Type: continuation", f"WARC-Record-ID: <a{k}>", "WARC-Segment-Origin-ID: <a>"]
        last = [f"WARC-Segment-Total-Length: {len(block) if total is None else total}"] if k == len(cuts) else []
        head = "\r\n".join(["WARC/1.0", *kind, f"WARC-Segment-Number: {k}", *last, f"Content-Length: {len(c)}"]).encode()
        out.append(gzip.compress(head + b"\r\n\r\n" + c + b"\r\n\r\n"))
    return [out[k] for k in (order(len(out)) if order else range(len(out))) if k not in drop]


@pytest.mark.parametrize(("case", "whole"), [({}, True), ({"order": lambda n: reversed(range(n))}, True), ({"drop": (1,)}, False), ({"drop": (0,)}, None), ({"total": 7}, False)])
def test_warc_segments_from_elsewhere(spark, tmp_path, case, whole):
    records = foreign([b"some words of a page ", b"WARC/1.1 and more " * 9], **case)
    (tmp_path / "x").mkdir()
    for k in range(3):  # dealt over files, so that no file has a whole capture
        (tmp_path / f"x/{k}.warc.gz").write_bytes(b"".join(records[k::3]))
    got = [r.payload for r in W.captures(spark, f"file://{tmp_path}/x").collect()]
    assert got == ([] if whole is None else [b"some words of a page " + b"WARC/1.1 and more " * 9] if whole else [None])


def test_warc_truncated_file_and_lost_response(spark, tmp_path):
    W.archive(spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc")], "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/t", compression="none")
    file = next((tmp_path / "t").glob("part*"))
    records = [b"WARC/1.1" + r for r in file.read_bytes().split(b"WARC/1.1")[1:]]
    (tmp_path / "u").mkdir()
    (tmp_path / "u/a.warc").write_bytes(next(r for r in records if b"Type: revisit" in r))
    (tmp_path / "u/b.warc").write_bytes(next(r for r in records if b"Type: response" in r)[:-20])
    assert ordered(read_back(spark, f"file://{tmp_path}/u")) == ordered([(1, None, digest("abc"), "response", None), (2, None, digest("abc"), "revisit", 1)])
    (tmp_path / "u/b.warc").unlink()
    assert read_back(spark, f"file://{tmp_path}/u") == [(2, None, digest("abc"), "revisit", None)]


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 40))
def test_chunked_framing(body, size):
    framed = W.chunked(body, size)
    assert W.dechunked(framed) == body
    assert all(W.dechunked(framed[:k]) is None for k in range(len(framed) - 4))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=60) | st.sampled_from([b"WARC/1.", b"WARC/1.1\r\n\r\n", b"\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"]), max_size=6))
def test_records_from_pieces(blocks):
    raw = b"".join(W.record({"WARC-Type": "response"}, b) + W.END for b in blocks)
    assert [b for _, b in W.parsed(("f", p) for p in raw.split(W.MARK))] == blocks


# Importance resampling


def words(text):
    return re.findall(R.WORD, (text or "").translate(str.maketrans(R.UPPER, R.LOWER)))


def runs(text, run):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, run + 1) for i in range(len(w) - n + 1)]


def resampled(docs, target, run=1, buckets=50, seed=2024, percent=10, least=20):
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = (Counter(bucket(x) for text in texts for x in runs(text, run)) for texts in ([d for _, d in docs], target))
    S, T = s.total(), t.total()
    gain = {k: math.floor(1000 * math.log((t[k] + 1) * (S + buckets) / ((s[k] + 1) * (T + buckets)))) for k in range(buckets)}
    out = []
    for i, text in docs:
        f = runs(text, run)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= least])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    rank = {id(r): k for k, r in enumerate(able[: percent * len(able) // 100], 1)}
    return [(*r[:4], rank.get(id(r))) for r in out]


@pytest.mark.parametrize(("run", "percent"), [(1, 10), (1, 100), (3, 35)])
def test_resampling(spark, run, percent):
    some = ["Alpha beta gamma " * 7, "über Straße l'été 42 " * 6, "a-b_c d.e " * 12, "one two three", "WORD word Word " * 900]
    docs = [(i, some[i % 5] + ("" if i % 3 else f" doc {i} {i % 7}" * 6)) for i in range(60)] + [(100 + i, some[0]) for i in range(40)] + [(200, None), (201, ""), (202, "...!"), (None, some[1]), (7, some[2]), (7, some[2])]
    target = [some[1], "gamma delta", None]
    df = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in docs], "doc_id long, text string, copies string, weight int, text_id int")
    got = R.resampled(df, spark.createDataFrame([(t,) for t in target], "text string"), run=run, buckets=50, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    # Equal rows share a score and are told apart by their ranks alone.
    assert ordered(map(tuple, got.collect())) == ordered(resampled(docs, target, run, 50, percent=percent))


def test_resampling_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert R.resampled(none, none).collect() == []
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [tuple(r) for r in R.resampled(one, none, buckets=50).collect()] == resampled([(1, "a b")], [], buckets=50)


# Divergence of sources


def diverging(docs, least=3, top=200):
    uses, held = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        t = re.findall(D.TERM, (text or "").translate(str.maketrans(D.UPPER, D.LOWER)))
        uses[lang or "", source or ""].update(t)
        held[lang or ""].update(set(t))
    out = []
    for lang in {g[0] for g in uses}:
        kept = {t for t, n in held[lang].items() if n >= least}
        groups = {s: {t: n for t, n in c.items() if t in kept} for (x, s), c in uses.items() if x == lang}
        share = lambda c: {t: 1 + D.SCALE * (c.get(t, 0) + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p = {s: share(c) for s, c in groups.items()}
        q = share(sum((Counter(c) for c in groups.values()), Counter()))
        gap = lambda a, b: (a - b) ** 2 // b
        for s, c in groups.items():
            pairs = [(o, sum(gap(p[s][t], p[o][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, gap(p[s][t], q[t])) for t, n in c.items() if n and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(found[:most], 1)]
    return out


@pytest.mark.parametrize(("block", "chunk", "span", "top"), [(D.BLOCK, D.CHUNK, D.SPAN, D.TOP), (2, 3, 2, 4), (1, 1, 1, 1)])
def test_divergence(spark, monkeypatch, block, chunk, span, top):
    for name, n in (("BLOCK", block), ("CHUNK", chunk), ("SPAN", span)):
        monkeypatch.setattr(D, name, n)
    texts = ["Red green BLUE red", "naïve Été l'eau", "one1two three", "", None, "...", "only here", "green green green blue", "red " * 5000]
    docs = [(texts[(i * i + j) % 9], lang, f"s{j % 7}") for lang in ("en", "de", None) for i in range(12) for j in range(i % 5 + 2)]
    docs += [("red", "en", None)] * 5 + [("lonely words lonely", "xx", "a")] * 3 + [("", "yy", "a"), (None, "yy", "b"), ("rare", "zz", "s")]
    df = spark.createDataFrame([(*d, 1, "clash") for d in docs], "text string, lang string, source string, n int, term string")
    got = D.divergence(df, top=top)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert ordered(map(tuple, got.collect())) == ordered(diverging(docs, top=top))


def test_divergence_empty(spark):
    assert D.divergence(spark.createDataFrame([], "text string, lang string, source string")).collect() == []


def test_shares_are_exact_beyond_64_bits():
    import numpy as np

    for n, total in ((10**13, 2 * 10**14), (0, 7), (10**10, 10**10 + 1), (123_456_789_012, 987_654_321_098)):
        assert D.shares(np.array([[n]]), np.array([total]))[0, 0] == 1 + D.SCALE * (n + 1) // total
