"""Best-two-fit packing of documents into fixed-length token sequences.

Bins are planned on the histogram of piece lengths, which has at most one entry
per length whatever the input's size: fill a bin greedily with the longest
pieces that fit, then replace its smallest piece by two unpacked ones that fill
the widened gap more tightly, and use the pattern for as many bins as the counts
allow. Pieces then find their place by their rank among the pieces of their
length. Ranks are counted within (length, salt), so a length that most documents
share is spread over ``SALTS`` groups.

Defined results: a null or empty text is the end id alone; repeated rows are
separate documents; an empty table gives an empty result. Longer documents are
cut into whole sequences from their end, so that only the first piece is short.
"""

from __future__ import annotations

import re
import string
import zlib
from array import array
from collections.abc import Iterator
from contextlib import closing

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import freeing, modest_batches, read_table, written
from .word_cache import UNSAFE as UNSAFE_CHUNK
from .word_cache import WordCache, cut_after, slices

CAPACITY = 1024
END_ID = 2
SALTS = 64
TOKENIZER = "byte_bpe_50k.json"
#: Byte-level BPE joins a single space to what follows it, and runs of white space to each other: a chunk that is
#: all white space or has some after its first character isn't cut from its text.
UNSAFE = re.compile(r"^\s+$|.\s", re.DOTALL)
#: Marks that end a word; the apostrophe isn't one, because contractions are taken as they are.
MARKS = string.punctuation.replace("'", "")

#: Byte-level BPE's letters for bytes: printable ones stand for themselves, the others follow from U+0100 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARS = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
SPACE = BYTE_CHARS[32]
#: A word of letters below this is one word to the tokenizer's pattern, whatever Unicode version it knows.
LATIN_END = "\u024f"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _cache(path: str) -> WordCache:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    encode = lambda xs: [e.ids for e in t.encode_batch_fast(xs, add_special_tokens=False)]
    newline = np.array(encode(["\n"])[0], dtype="<u4")

    def split(texts: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
        """Chunks: the first word marked by a NUL, words after a space as they are, words after a line feed with it."""
        whole = pc.match_substring(texts, "\0")
        marked = pc.binary_join_element_wise("\0", pc.replace_substring(pc.if_else(whole, "", texts), "\n", " \n"), "")
        return pc.split_pattern(marked, " "), whole.to_numpy(zero_copy_only=False)

    def joined(words: list[str]) -> list[bytes]:
        """Ids of words, encoded as the lines of one text; no word has a line feed."""
        ids = np.array(t.encode("\n".join(words), add_special_tokens=False).ids, dtype="<u4")
        runs = cut_after(np.concatenate([newline, ids]), np.concatenate([[True], ids == newline[0]]))
        return [x[4:] for x in runs]

    marks: dict[str, bytes] = {}

    def letters(w: str) -> bytes:
        """Ids of a word of letters below ``LATIN_END`` after a space."""
        return array("I", [x.id for x in tokenize(SPACE + (w if w.isascii() else w.encode().decode("latin-1").translate(BYTE_CHARS)))]).tobytes()

    def chunks(words: list[str]) -> list[bytes]:
        """Ids of chunks: those of the word without the marks at its end, then those of the marks, which BPE never joins."""
        found: dict[str, bytes | None] = {w: letters(w) for w in words if w.isalpha() and (w.isascii() or max(w) < LATIN_END)}
        rest = [w for w in words if w not in found]
        stems, ends = [], []
        for w in rest:
            stem = w.rstrip(MARKS)
            if not stem[-1:].isalnum():
                stem = w
            stems.append(stem)
            ends.append(w[len(stem) :])
        if fresh := sorted(set(ends) - marks.keys()):
            marks.update(zip(fresh, (np.array(x, dtype="<u4").tobytes() for x in encode(fresh)), strict=True))
        if len(marks) > 50_000:
            marks.clear()
            marks.update(zip(ends, (np.array(x, dtype="<u4").tobytes() for x in encode(ends)), strict=True))
        unique = []
        for w in dict.fromkeys(stems):
            if w in found:
                continue
            if (x := cache.known.get(w)) is not None:
                found[w] = None if x is UNSAFE_CHUNK else x
            elif w.isalpha() and (w.isascii() or max(w) < LATIN_END):
                found[w] = letters(w)
            else:
                unique.append(w)
        bare, spaced = [w for w in unique if w[:1] in ("\0", "\n")], [w for w in unique if w[:1] not in ("\0", "\n")]
        for keys, text in ((bare, [w[1:] for w in bare]), (spaced, [f" {w}" for w in spaced])):
            found.update((k, None) for k, x in zip(keys, text, strict=True) if UNSAFE.search(x))
            # An empty line would join its neighbours' line feeds.
            full = [k for k, x in zip(keys, text, strict=True) if x and k not in found]
            found.update(zip(full, joined([x for k, x in zip(keys, text, strict=True) if x and k not in found]) if full else [], strict=True))
        found.setdefault("\0", b"")
        for w in bare:
            if w[0] == "\n" and found.setdefault(w, None) is not None:
                found[w] = newline.tobytes() + found[w]
        for w, a, b in zip(rest, stems, ends, strict=True):
            if b:
                found[w] = None if found[a] is None else found[a] + marks[b]
        return [found[w] for w in words]

    tokenize = t.model.tokenize
    cache = WordCache(split, chunks, encode)
    return cache


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``length`` ids; all but the first are full."""
    head = length - (max(1, -(-length // capacity)) - 1) * capacity
    return [(0, head)] + [(s, capacity) for s in range(head, length, capacity)]


def tokenised(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents: key, piece, start, length, ids_crc32, and the ids themselves where asked for."""
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    @freeing
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with closing(_cache(path)) as cache:
            for b in batches:
                yield from encoded(cache, b)

    def encoded(cache: WordCache, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, texts in slices(b.column(1)):
            rows, ids = [], []
            for i, x in enumerate(cache.ids(texts), lo):
                x = np.append(x, np.array([end_id], dtype="<u4"))
                for k, (s, n) in enumerate(cut(len(x), capacity)):
                    rows.append((i, k, s, n, zlib.crc32(x[s : s + n].tobytes())))
                    if keep_ids:
                        ids.append(x[s : s + n].astype(np.int32))
            at, k, s, n, c = (np.array(v, dtype=np.int64) for v in zip(*rows, strict=True))
            out = [b.column(0).take(pa.array(at)), pa.array(k.astype(np.int32)), pa.array(s), pa.array(n), pa.array(c)]
            names = [key, "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                out, names = [*out, pa.array(ids, type=pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names)

    return modest_batches(docs).select(key, text).mapInArrow(encode, schema)


def plan(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Patterns of lengths and how many bins have each; ``counts[n]`` pieces have length ``n``."""
    left = [int(c) for c in counts]
    patterns: list[tuple[list[int], int]] = []

    def longest(most: int) -> int:
        while most and not left[most]:
            most -= 1
        return most

    def pair(room: int, over: int) -> tuple[int, int] | None:
        """Two available lengths of the greatest sum within ``room`` that is more than ``over``."""
        best, found = over, None
        a, b = longest(room - 1), 1
        while a >= b and a:
            while b < a and (not left[b] or b + a <= room and b + 1 + a <= room and b + 1 <= a):
                b += 1
            # b is now the largest candidate for this a, or a itself; look down for one that is available
            c = min(b, room - a)
            while c and not (left[c] and (c != a or left[c] > 1)):
                c -= 1
            if c and a + c > best:
                best, found = a + c, (a, c)
                if best == room:
                    break
            a = longest(a - 1) if a > 1 else 0
        return found

    top = longest(capacity)
    while top:
        bin_, room = [], capacity
        size = top
        while size:
            n = min(left[size], room // size)
            bin_ += [size] * n
            left[size] -= n
            room -= n * size
            size = longest(min(room, size - 1)) if room else 0
        while room and len(bin_) > 1 and (two := pair(room + bin_[-1], bin_[-1])):
            small = bin_.pop()
            left[small] += 1
            room += small - sum(two)
            for x in two:
                left[x] -= 1
            bin_ = sorted([*bin_, *two], reverse=True)
        need = {x: bin_.count(x) for x in set(bin_)}
        more = min(left[x] // n for x, n in need.items())
        for x, n in need.items():
            left[x] -= n * more
        patterns.append((bin_, 1 + more))
        top = longest(top)
    return patterns


class Places:
    """Where the piece of a given rank among those of its length goes."""

    SHIFT = 44

    def __init__(self, patterns: list[tuple[list[int], int]]):
        taken: dict[int, int] = {}
        rows, sequence = [], 0
        for bin_, times in patterns:
            offset = 0
            for size in dict.fromkeys(bin_):
                n = bin_.count(size)
                rows.append((size, taken.get(size, 0), sequence, n, offset))
                taken[size] = taken.get(size, 0) + n * times
                offset += n * size
            sequence += times
        rows.sort()
        self.n_sequences = sequence
        self.size, self.first, self.sequence, self.each, self.offset = np.array(rows or [(0, 0, 0, 1, 0)], dtype=np.int64).T
        self.key = (self.size << self.SHIFT) + self.first

    def __call__(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.key, (size << self.SHIFT) + rank, side="right") - 1
        k = rank - self.first[i]
        return self.sequence[i] + k // self.each[i], self.offset[i] + k % self.each[i] * size


def packed(pieces: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", salts: int = SALTS) -> DataFrame:
    """``pieces`` (read twice: a written table) with sequence_id and offset.

    What reaches the driver is one count per (length, salt): at most ``capacity * salts`` rows.
    """
    spark = pieces.sparkSession
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)))
    counts = np.zeros((capacity + 1, salts), dtype=np.int64)
    for r in salted.groupBy("length", "_salt").count().collect():
        counts[r["length"], r["_salt"]] = r["count"]
    before = np.cumsum(counts, axis=1) - counts
    shared = spark.sparkContext.broadcast((before, Places(plan(counts.sum(axis=1), capacity))))
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(key, "piece")) - 1)
    fields = [f for f in ranked.schema.fields if not f.name.startswith("_")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"

    @freeing
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, places = shared.value
        for b in batches:
            size = b.column("length").to_numpy(zero_copy_only=False)
            rank = b.column("_rank").to_numpy(zero_copy_only=False).astype(np.int64) + before[size, b.column("_salt").to_numpy(zero_copy_only=False)]
            sequence, offset = places(size, rank)
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in fields), pa.array(sequence), pa.array(offset)], [*(f.name for f in fields), "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents with the sequence and the offset that each has."""
    return packed(written(tokenised(docs, path or tokenizer_path(), capacity, end_id, keep_ids, key, text), "pieces"), capacity, key)


def sequences(pieces: DataFrame) -> DataFrame:
    """The sequences themselves, from ``pack(..., keep_ids=True)``: sequence_id, length, ids, and the pieces' documents."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", F.struct("doc_id", "piece", "length").alias("part"))))
    return pieces.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.size(F.flatten("p.ids")).alias("length"), F.col("p.part").alias("parts")
    )


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op6_best_fit_packing": op6_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
