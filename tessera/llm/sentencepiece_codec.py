"""SentencePiece models on the ``tokenizers`` library.

The model protobuf is parsed here and its parts rebuilt: normaliser (compiled
character map, extra white space, dummy prefix), the metaspace marker, unigram
scores or, for BPE models, merges ranked by the score of the piece they make,
and byte fallback. Everything is encoded in batches on the library's threads:
where the model cuts at the marker, the words that single spaces separate and
that a cache doesn't know yet, in one batch for a slice of texts; other texts
whole. Encodings can be held against the ``sentencepiece`` library's own, text
by text.

Defined results: null and empty texts have no ids and decode to the empty text;
repeated rows each get their row; rows are independent, so there is no shuffle.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .shared import freeing, modest_batches, read_table
from .word_cache import WordCache, cut_after, slices

MODEL = "piece_bpe_32k.model"
#: New words that go to the library as one text.
JOINED = 256
MARK = "▁"
#: Piece types and model types of the protobuf.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        x = b[i]
        i += 1
        out |= (x & 127) << shift
        if x < 128:
            return out, i
        shift += 7


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: varints as int, the rest as bytes."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        else:
            n = {1: 8, 5: 4}[kind]
            value, i = b[i : i + n], i + n
        yield tag >> 3, value


@dataclass
class Model:
    """What a model file says; field numbers are those of the public protobuf definition."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    suffix_marker: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True

    @classmethod
    def read(cls, path: str) -> Model:
        m = cls()
        with open(path, "rb") as f:
            raw = f.read()
        for n, v in _fields(raw):
            if n == 1:
                p = dict(_fields(v))
                m.pieces.append((p.get(1, b"").decode(), float(np.frombuffer(p.get(2, b"\0\0\0\0"), "<f4")[0]), p.get(3, NORMAL)))
            elif n == 2:
                t = dict(_fields(v))
                m.model_type, m.byte_fallback, m.suffix_marker = t.get(3, UNIGRAM), bool(t.get(35, 0)), bool(t.get(24, 0))
            elif n == 3:
                s = dict(_fields(v))
                m.charsmap, m.dummy_prefix, m.remove_extra, m.escape = s.get(2, b""), bool(s.get(3, 1)), bool(s.get(4, 1)), bool(s.get(5, 1))
        return m

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces that make a piece, best made piece first."""
        known = {p: i for i, (p, _, t) in enumerate(self.pieces) if t in (NORMAL, USER_DEFINED, UNUSED)}
        out = []
        for p, score, t in self.pieces:
            if t == NORMAL and len(p) > 1:
                out += [(-score, known[p[:k]], known[p[k:]], p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in known and p[k:] in known]
        return [x[3:] for x in sorted(out)]

    @property
    def cuts_at_marker(self) -> bool:
        """No piece has the marker after another character: text can be cut before each run of spaces."""
        return not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, t in self.pieces if t in (NORMAL, USER_DEFINED))

    def tokenizer(self):
        from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        if self.suffix_marker or not self.escape:
            raise ValueError("models with a suffix marker or unescaped white space aren't supported")
        if self.model_type == UNIGRAM:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], unk_id=self.unknown, byte_fallback=self.byte_fallback)
        elif self.model_type == BPE:
            # Without the library's own cache of words: most words that it gets are new, and its threads wait for that.
            model = models.BPE({p: i for i, (p, _, _) in enumerate(self.pieces)}, self.merges(), unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback, cache_capacity=0)
        else:
            raise ValueError(f"model type {self.model_type}: only unigram and BPE models are supported")
        t = Tokenizer(model)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.remove_extra:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip(left=True, right=True)]
        steps += [normalizers.Prepend(MARK)] * self.dummy_prefix + [normalizers.Replace(" ", MARK)]
        t.normalizer = normalizers.Sequence(steps)
        if self.cuts_at_marker:
            t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
        t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()] + [decoders.Strip(" ", 1, 0)] * self.dummy_prefix)
        t.add_special_tokens([AddedToken(p, special=True, normalized=False) for p, _, k in self.pieces if k == CONTROL])
        t.add_tokens([AddedToken(p, normalized=False) for p, _, k in self.pieces if k == USER_DEFINED])
        t.encode_special_tokens = True
        return t


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def _rebuilt(path: str):
    """The model and its tokenizer, once for all tasks of a worker in a row."""
    model = Model.read(path)
    return model, model.tokenizer()


class Codec:
    """Encodes and decodes lists of texts with the rebuilt model."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        self.model, self.tokenizer = _rebuilt(path)
        #: The bytes of each piece, with a space for the marker.
        self.bytes = pa.array([bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, _, k in self.model.pieces], pa.large_binary())
        self.byte_ids = np.array([k == BYTE for _, _, k in self.model.pieces])
        self.plain = self.model.cuts_at_marker and not self.model.charsmap and not self.model.remove_extra and self.model.dummy_prefix and not any(k == USER_DEFINED for _, _, k in self.model.pieces)

        def split(texts: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
            """The words of each text, and which texts have the marker or spaces that repeat, begin or end them."""
            whole = pc.match_substring(texts, "  ")
            for x in (pc.starts_with(texts, " "), pc.ends_with(texts, " "), pc.match_substring(texts, MARK)):
                whole = pc.or_(whole, x)
            return pc.split_pattern(pc.if_else(whole, "", texts), " "), whole.to_numpy(zero_copy_only=False)

        starts = np.array([p.startswith(MARK) for p, _, _ in self.model.pieces])

        def chunks(words: list[str]) -> list[bytes]:
            """Words in texts of ``JOINED`` for the library's threads: the ids of each begin with a piece that begins with the marker, and no other piece has one."""
            if "" in words:  # an empty text's
                out = iter(chunks([w for w in words if w]))
                return [next(out) if w else b"" for w in words]
            out = []
            for x in self._whole([" ".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)]):
                ids = np.array(x, dtype="<u4")
                out += cut_after(ids, starts[ids])
            return out

        self.cache = WordCache(split, chunks, self._whole)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array | list[str]) -> list[np.ndarray]:
        if self.plain:
            return self.cache.ids(texts)
        return [np.array(x, dtype="<u4") for x in self._whole(texts.to_pylist() if isinstance(texts, pa.Array) else texts)]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Texts of ids; the library decodes those whose bytes aren't valid UTF-8, or that have control pieces."""
        if not self.plain or not ids:
            return self.library_decode(ids)
        # Arrow puts the pieces' bytes one after another; a text's are between the offsets of its first and last piece.
        _, at, raw = self.bytes.take(pa.array(np.concatenate(ids))).buffers()
        ends = np.frombuffer(at, dtype=np.int64)[np.cumsum([0, *map(len, ids)])].tolist()
        data = memoryview(raw if raw is not None else b"")
        out, rest = [], []
        for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            try:
                text = str(data[a:b], "utf-8")
            except UnicodeDecodeError:
                text = None
                rest.append(i)
            out.append(text[1:] if text and text[0] == " " else text)
        for i, text in zip(rest, self.library_decode([ids[i] for i in rest]), strict=True):
            out[i] = text
        return out

    def library_decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.tokenizer.decode_batch([x.tolist() for x in ids], skip_special_tokens=False) if ids else []


def encoded(docs: DataFrame, path: str | None = None, parity: bool = True, decode: bool = True, keep_ids: bool = True, text: str = "text") -> DataFrame:
    """``docs`` without its text but with n_tokens, n_byte_tokens, ids_crc32, and where asked for ids, parity (the sentencepiece library gives the same ids) and round_trip (ids decode to the text)."""
    path = path or model_path()
    added = ["n_tokens", "n_byte_tokens", "ids_crc32", "parity", "round_trip", "ids"]
    kept = [f for f in docs.schema.fields if f.name != text and f.name not in added]
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
        + ["n_tokens long, n_byte_tokens long, ids_crc32 long"]
        + ["parity boolean"] * parity
        + ["round_trip boolean"] * decode
        + ["ids array<int>"] * keep_ids
    )

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, own = Codec(path), None
        if parity:
            import sentencepiece

            own = sentencepiece.SentencePieceProcessor(model_file=path)
        for b in batches:
            for lo, column in slices(b.column(0)):
                ids, texts = codec.encode(column), column.to_pylist()
                out = [b.column(i + 1).slice(lo, len(texts)) for i in range(len(kept))]
                out += [pa.array([len(x) for x in ids], pa.int64()), pa.array([int(codec.byte_ids[x].sum()) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())]
                names = [f.name for f in kept] + added[:3]
                if parity:
                    out.append(pa.array([x.tolist() == y for x, y in zip(ids, own.encode(texts, num_threads=1), strict=True)]))
                    names.append("parity")
                if decode:
                    out.append(pa.array([x == y for x, y in zip(texts, codec.decode(ids), strict=True)]))
                    names.append("round_trip")
                if keep_ids:
                    out.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    return modest_batches(docs).select(text, *[f.name for f in kept]).mapInArrow(run, schema)


def decoded(rows: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """``rows`` with the text of their ids in place of them; null ids give the empty text."""
    path = path or model_path()
    kept = [f for f in rows.schema.fields if f.name not in (ids, "text")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["text string"])

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for b in batches:
            texts = codec.decode([np.array(x or [], dtype="<u4") for x in b.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(b.column(i + 1) for i in range(len(kept))), pa.array(texts, pa.string())], [*(f.name for f in kept), "text"])

    return rows.select(ids, *[f.name for f in kept]).mapInArrow(run, schema)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(read_table(spark, sf_dir, "documents").select("doc_id", "text"), keep_ids=False)


QUERIES = {"op4_sentencepiece": op4_sentencepiece}
ORACLE_SQL: dict[str, str] = {}
