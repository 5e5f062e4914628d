"""Binary edge files as a data source that many tasks read: partitions are ranges of edges of a file.

``spark.read.format("edge_arrays")`` reads files of two forms. Raw ones hold
int64 N, int64 M, then M int32 sources and M int32 destinations, little-endian.
NPZ archives hold the arrays ``src`` and ``dst``, and maybe ``t``; their members
are read by offset where they are stored as they are (``numpy.savez``), and a
compressed archive is one partition, as it can't be entered in the middle.
A task reads its range of each array and no more, batch by batch.

``df.write.format("edge_arrays").mode("append").save(path)`` writes src and dst as raw
files of at most ``EDGES`` edges each; they have their names, which readers see, once all tasks are done.

Paths are local, shared, or of a store that Arrow's file systems reach (hdfs,
s3, gs). A file that is shorter than its header says is an error, not a short
table. Rows: file, pos (place in the file), src, dst, t (pos where there is none).
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "file string, pos long, src long, dst long, t long"
#: Edges of a partition, of a batch within it, and of a file that is written.
RANGE, BATCH, EDGES = 1 << 22, 1 << 17, 1 << 24


@dataclass(frozen=True)
class Array:
    """Where an array's values lie in a file, if it can be entered anywhere."""

    at: int
    kind: str


@dataclass
class EdgeRange(InputPartition):
    """Edges lo..hi - 1 of a file; without arrays, the file is a compressed archive."""

    path: str
    lo: int
    hi: int
    arrays: dict[str, Array] | None


def _system(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), unquote(urlsplit(path).path)
    return fs.FileSystem.from_uri(path)


def _files(path: str) -> list[str]:
    system, at = _system(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(at, recursive=True))
    base = path.rstrip("/")
    return sorted(f"{base}/{posixpath.relpath(x.path, at)}" for x in found if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")))


def _raw(f, size: int, path: str) -> tuple[int, dict[str, Array]]:
    head = f.read(16)
    n, m = struct.unpack("<qq", head) if len(head) == 16 else (0, -1)
    if n < 0 or m < 0 or size < 16 + 8 * m:
        raise ValueError(f"{path}: {size} bytes, but {m} edges are said to be in it")
    return m, {"src": Array(16, "<i4"), "dst": Array(16 + 4 * m, "<i4")}


def _npz(f, path: str) -> tuple[int, dict[str, Array] | None]:
    """Number of edges, and where the members' values are; None if they are compressed."""
    arrays, sizes = {}, {}
    with zipfile.ZipFile(f) as z:
        stored = all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
        for name in ("src", "dst", "t"):
            if f"{name}.npy" not in z.namelist():
                continue
            with z.open(f"{name}.npy") as member:
                version = np.lib.format.read_magic(member)
                read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
                shape, _, kind = read(member)
                header = member.tell()
            if len(shape) != 1:
                raise ValueError(f"{path}: {name} has {len(shape)} dimensions")
            sizes[name] = shape[0]
            if stored:
                f.seek(z.getinfo(f"{name}.npy").header_offset + 26)
                a, b = struct.unpack("<HH", f.read(4))
                arrays[name] = Array(z.getinfo(f"{name}.npy").header_offset + 30 + a + b + header, kind.str)
    if not {"src", "dst"} <= sizes.keys() or len(set(sizes.values())) != 1:
        raise ValueError(f"{path}: arrays {sizes}")
    return sizes["src"], arrays if stored else None


class EdgeArrays(DataSource):
    """Options: path (a file or a folder), edges (of a partition at most)."""

    @classmethod
    def name(cls) -> str:
        return "edge_arrays"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return EdgeReader(self.options["path"], int(self.options.get("edges", RANGE)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("edge_arrays appends files, it doesn't overwrite a folder")
        return EdgeWriter(self.options["path"])


class EdgeReader(DataSourceReader):
    def __init__(self, path: str, edges: int):
        self.path, self.edges = path, edges

    def partitions(self) -> list[EdgeRange]:
        out = []
        for path in _files(self.path):
            system, at = _system(path)
            with system.open_input_file(at) as f:
                m, arrays = _npz(f, path) if path.endswith(".npz") else _raw(f, f.size(), path)
            step = self.edges if arrays else max(m, 1)
            out += [EdgeRange(path, lo, min(lo + step, m), arrays) for lo in range(0, m, step)]
        return out or [EdgeRange("", 0, 0, {})]

    def read(self, part: EdgeRange) -> Iterator[pa.RecordBatch]:
        if part.lo == part.hi:
            return
        system, at = _system(part.path)
        with system.open_input_file(at) as f:
            if part.arrays is None:
                with np.load(f) as z:
                    whole = {k: z[k] for k in ("src", "dst", "t") if k in z.files}

            def values(name: str, a: int, b: int) -> np.ndarray | None:
                if part.arrays is None:
                    return whole[name][a:b] if name in whole else None
                if name not in part.arrays:
                    return None
                x = part.arrays[name]
                size = np.dtype(x.kind).itemsize
                raw = f.read_at((b - a) * size, x.at + a * size)
                if len(raw) < (b - a) * size:
                    raise ValueError(f"{part.path}: {name} ends before edge {b}")
                return np.frombuffer(raw, x.kind)

            for a in range(part.lo, part.hi, BATCH):
                b = min(a + BATCH, part.hi)
                pos = np.arange(a, b)
                t = values("t", a, b)
                ends = [values(k, a, b).astype(np.int64) for k in ("src", "dst")]
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * (b - a)), pa.array(pos), *map(pa.array, ends), pa.array(pos if t is None else t.astype(np.int64))], ["file", "pos", "src", "dst", "t"])


@dataclass
class Files(WriterCommitMessage):
    """Files that a task has written under names that readers pass over."""

    names: list[str]


class EdgeWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> Files:
        system, at = _system(self.path)
        system.create_dir(at, recursive=True)
        names, held, size = [], [], 0

        def close() -> None:
            nonlocal held, size
            a, b = (np.concatenate(x) for x in zip(*held, strict=True))
            if min(a.min(), b.min()) < 0 or max(a.max(), b.max()) >= 1 << 31:
                raise ValueError("ids that 32 bits don't hold")
            names.append(f"_{uuid.uuid4().hex}.bin")
            with system.open_output_stream(f"{at}/{names[-1]}") as f:
                f.write(struct.pack("<qq", int(max(a.max(), b.max())) + 1, len(a)))
                f.write(a.astype("<i4").tobytes())
                f.write(b.astype("<i4").tobytes())
            held, size = [], 0

        for batch in batches:
            if batch.num_rows:
                held.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in ("src", "dst")))
                size += batch.num_rows
                if size >= EDGES:
                    close()
        if held:
            close()
        return Files(names)

    def commit(self, messages: list[Files | None]) -> None:
        system, at = _system(self.path)
        for name in (n for m in messages if m for n in m.names):
            system.move(f"{at}/{name}", f"{at}/{name[1:]}")

    def abort(self, messages: list[Files | None]) -> None:
        system, at = _system(self.path)
        for name in (n for m in messages if m for n in m.names):
            system.delete_file(f"{at}/{name}")


def write_edge_arrays(edges: DataFrame, path: str) -> None:
    """Append src and dst as raw files, one or more a task."""
    edges.sparkSession.dataSource.register(EdgeArrays)
    edges.select("src", "dst").write.format("edge_arrays").mode("append").save(path)


def read_edge_arrays(spark: SparkSession, path: str, edges: int = RANGE) -> DataFrame:
    """file, pos, src, dst, t of the raw and NPZ files of a path, at most ``edges`` a partition."""
    spark.dataSource.register(EdgeArrays)
    return spark.read.format("edge_arrays").option("edges", edges).load(path)
