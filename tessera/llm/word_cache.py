"""Encode texts with a ``tokenizers`` model, remembering the ids of space-separated chunks.

Where a tokenizer never joins text across the start of a single space (which
its owner must know), a text's ids are those of its chunks in turn. Arrow cuts
the texts and numbers their distinct chunks. Most chunks of prose have been seen
before; only the others go to the library, in batches.
Texts for which the cut is not safe go to it whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

#: Chunks that are kept, twice: about 200 bytes each.
MAX_ENTRIES = 200_000
SLICE_BYTES = 1 << 22
#: In place of the ids of a chunk whose texts mustn't be cut: an empty object of its own, told by identity.
UNSAFE = bytearray()


class WordCache:
    """Ids of texts by those of their chunks.

    ``split`` cuts a column of texts without nulls into lists of chunks, and says
    which texts mustn't be cut (what it gives for those isn't used, and should
    be short); ``encode_chunks`` gives the ids of distinct chunks, as bytes of
    unsigned 32-bit numbers, in the same order, and None for a chunk whose texts
    mustn't be cut; ``encode`` gives the ids of whole texts.
    """

    def __init__(
        self,
        split: Callable[[pa.Array], tuple[pa.ListArray, np.ndarray]],
        encode_chunks: Callable[[list[str]], list[bytes | None]],
        encode: Callable[[list[str]], list[list[int]]],
        max_entries: int = MAX_ENTRIES,
    ):
        self.split, self.encode_chunks, self.encode, self.max_entries = split, encode_chunks, encode, max_entries
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def close(self) -> None:
        """Forget all, and the functions, which refer to the cache in turn: then nothing waits for the garbage collector."""
        self.known, self.before = {}, {}
        del self.split, self.encode_chunks, self.encode

    def _of(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks; ``UNSAFE`` for those whose texts mustn't be cut."""
        out = list(map(self.known.get, chunks))
        if missing := [i for i, x in enumerate(out) if x is None]:
            if len(self.known) + len(missing) > self.max_entries:
                # What was used lately stays; what is used again comes back from the generation before.
                self.before, self.known = self.known, {w: x for w, x in zip(chunks, out, strict=True) if x is not None}
            for i in missing:
                out[i] = self.before.get(chunks[i])
            if fresh := [i for i in missing if out[i] is None]:
                for i, x in zip(fresh, self.encode_chunks([chunks[i] for i in fresh]), strict=True):
                    out[i] = UNSAFE if x is None else x
            self.known.update((chunks[i], out[i]) for i in missing)
        return out

    def ids(self, texts: pa.Array | list[str]) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text: its chunks are numbered, and the ids of each number put together."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(column):
            return []
        lists, whole = self.split(column)
        row = lists.offsets.to_numpy()
        numbered = lists.flatten().dictionary_encode()
        at, found = numbered.indices.to_numpy(), self._of(numbered.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        if bad := [i for i, x in enumerate(found) if x is UNSAFE]:
            odd = np.zeros(len(found), dtype=bool)
            odd[bad] = True
            unsafe = np.concatenate([[0], np.cumsum(odd[at])])[row - row[0]]
            whole = whole | (unsafe[1:] > unsafe[:-1])
        flat = np.frombuffer(b"".join(found), dtype="<u4")
        n = size[at]
        end = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.arange(end[-1]) + np.repeat((np.cumsum(size) - size)[at] - end[:-1], n)]
        cut = end[row - row[0]].tolist()
        out = [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        if whole.any():
            rows = np.flatnonzero(whole)
            for i, x in zip(rows.tolist(), self.encode(column.take(pa.array(rows)).to_pylist()), strict=True):
                out[i] = np.array(x, dtype="<u4")
        return out


def cut_after(ids: np.ndarray, first: np.ndarray) -> list[bytes]:
    """``ids`` in runs that begin where ``first`` is true, each as bytes."""
    raw, at = ids.tobytes(), (np.flatnonzero(first) * 4).tolist()
    return [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)], strict=True)]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of about ``limit`` bytes together; a null is an empty text."""
    column = column.fill_null("")
    size = pa.compute.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, lo = np.cumsum(size), 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, side="right")))
        yield lo, column.slice(lo, hi - lo)
        lo = hi
