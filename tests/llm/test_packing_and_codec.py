import zlib

import numpy as np
import pytest

from tessera.llm import best_fit_packing as P
from tessera.llm import sentencepiece_codec as S

TEXTS = ["", None, "a", "  two  spaces ", "x\n\ny", "foo.\nBar baz", "don't stop! a-b_c", "é" * 30, "tab\tbed", "word " * 3000, "<|endoftext|>", "same", "same", "\n", " ", "a \n b", "中文 字", "NUL\0x", "\t", "a\n\tb", "\tq\n\n\tr s", "x\n\t\ny", "\u3000z y", "***\n*** ok"]


def ids_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.tokenizer_path())
    t.encode_special_tokens = True
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_packing_round_trip(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, length string")
    rows = P.pack(docs, keep_ids=True).collect()
    got, bins = {}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == len(got.setdefault(r.doc_id, []))
        assert r.length == len(r.ids) <= 1024 and (r.piece == 0 or r.length == 1024)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        got[r.doc_id] += r.ids
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == {i: x + [2] for i, x in enumerate(ids_of(TEXTS))}
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    total = sum(map(len, got.values()))
    assert len(bins) <= -(-total // 1024) + 1
    whole = {r.sequence_id: r for r in P.sequences(P.pack(docs, keep_ids=True)).collect()}
    assert sum(r.length for r in whole.values()) == total


def test_packing_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert P.pack(docs).collect() == []


def test_plan_uses_every_piece_once_and_two_fit_is_tighter():
    rng = np.random.default_rng(0)
    for _ in range(40):
        counts = np.zeros(101, dtype=int)
        for n in rng.integers(1, 101, rng.integers(1, 300)):
            counts[n] += 1
        used = np.zeros_like(counts)
        bins = 0
        for pattern, times in P.plan(counts, 100):
            assert 0 < sum(pattern) <= 100
            bins += times
            for x in pattern:
                used[x] += times
        assert (used == counts).all()
        total = int((counts * np.arange(101)).sum())
        assert bins <= 1.25 * -(-total // 100) + 1
    # 60 + 30 leaves 10; the 30 gives way to 20 + 20, which fill the gap of 40.
    counts = np.zeros(101, dtype=int)
    counts[[60, 30, 20]] = [1, 1, 2]
    assert P.plan(counts, 100)[0][0] == [60, 20, 20]


def test_codec_parity(spark):
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate([*TEXTS, "a▁b", "\U0001f600 ok"])], "doc_id long, text string, parity boolean")
    out = {r.doc_id: r for r in S.encoded(docs).collect()}
    assert len(out) == len(TEXTS) + 2
    assert all(r.parity for r in out.values())
    assert [i for i, r in out.items() if not r.round_trip] == [len(TEXTS)]  # the marker itself becomes a space
    back = {r.doc_id: r.text for r in S.decoded(S.encoded(docs)).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS))


def test_codec_library_decode_agrees():
    c = S.Codec(S.model_path())
    texts = [t or "" for t in TEXTS]
    ids = c.encode(texts)
    assert c.library_decode(ids) == c.decode(ids) == texts
    assert c.decode([np.array([3 + 0xC3], dtype="<u4")]) == c.library_decode([np.array([3 + 0xC3], dtype="<u4")])


def test_unigram_model_is_rebuilt(tmp_path):
    """A small hand-made unigram model: scores decide the segmentation as the sentencepiece library does."""
    import sentencepiece

    def varint(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    def message(n, b):
        return varint(n << 3 | 2) + varint(len(b)) + b

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁ab", -1.0, 1), ("▁a", -1.5, 1), ("b", -2.0, 1), ("bc", -2.2, 1), ("c", -2.5, 1), ("▁", -3.0, 1), ("a", -3.5, 1)]
    raw = b"".join(message(1, message(1, p.encode()) + varint(2 << 3 | 5) + np.array([s], "<f4").tobytes() + varint(3 << 3) + varint(t)) for p, s, t in pieces)
    raw += message(2, varint(3 << 3) + varint(1)) + message(3, message(1, b"identity") + varint(3 << 3) + varint(1) + varint(4 << 3) + varint(0))
    path = tmp_path / "u.model"
    path.write_bytes(raw)
    own = sentencepiece.SentencePieceProcessor(model_file=str(path))
    c = S.Codec(str(path))
    for t in ["abc", "ab bc", "c a", "aab", ""]:
        assert c.encode([t])[0].tolist() == own.encode(t), t


def test_bad_model_type(tmp_path):
    m = S.Model(pieces=[("<unk>", 0.0, 2)], model_type=3)
    with pytest.raises(ValueError):
        m.tokenizer()


def test_marks_after_a_word_that_is_not_cut():
    """White space inside a word before marks: the text goes to the library whole."""
    texts = ["x\ty, z", "a\tb!", "\u3000q. ok", "x\ty z x\ty, z", "fine, (too)"]
    c = P._cache(P.tokenizer_path())
    assert [x.tolist() for x in c.ids(texts)] == [x.tolist() for x in c.ids(texts)] == ids_of(texts)


def test_word_cache_numbers_the_chunks_of_a_column():
    """Each distinct chunk of a column is encoded once, whatever the texts; texts that mustn't be cut come whole; what was evicted comes back."""
    import pyarrow as pa
    import pyarrow.compute as pc

    from tessera.llm.word_cache import WordCache

    asked, whole = [], []

    def split(column):
        unsafe = pc.match_substring(column, "|")
        return pc.split_pattern(pc.if_else(unsafe, "", column), " "), unsafe.to_numpy(zero_copy_only=False)

    def chunks(words):
        asked.extend(words)
        return [None if w == "bad" else np.frombuffer(w.encode(), dtype=np.uint8).astype("<u4").tobytes() for w in words]

    def encode(texts):
        whole.extend(texts)
        return [[7, len(t)] for t in texts]

    c = WordCache(split, chunks, encode, max_entries=4)
    plain = lambda t: list(t.replace(" ", "").encode())
    column = pa.array(["left out", "a b a", "", "b bad", "a|b", "bad", "c a"]).slice(1)
    for _ in range(2):
        assert [x.tolist() for x in c.ids(column)] == [plain("aba"), [], [7, 5], [7, 3], [7, 3], plain("ca")]
    assert sorted(asked) == ["", "a", "b", "bad", "c"] and whole == ["b bad", "a|b", "bad"] * 2
    assert [x.tolist() for x in c.ids(["d e a"])] == [plain("dea")] and [x.tolist() for x in c.ids(["b d"])] == [plain("bd")]
    assert sorted(asked) == ["", "a", "b", "bad", "c", "d", "e"] and c.ids([]) == []


def test_codec_is_rebuilt_once_and_decodes_any_ids():
    """A second codec has the first one's tokenizer; texts of ids between invalid and empty ones keep their place."""
    a, b = S.Codec(S.model_path()), S.Codec(S.model_path())
    assert a.tokenizer is b.tokenizer
    ids = [*a.encode(["one two", "", "é ok"]), np.array([3 + 0xC3], dtype="<u4"), np.zeros(0, dtype="<u4"), *a.encode(["last"])]
    assert a.decode(ids) == a.library_decode(ids) and a.decode([]) == []
