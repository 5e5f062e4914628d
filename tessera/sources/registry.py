"""Known datasets by name, and the forms that their edges come in: both can be added to."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import readers
from .graphs import TemporalGraph, from_edges

TIERS = ("small", "medium", "large", "ultra")


class EdgeStorage(Protocol):
    """What keeps edges: ``readers.EdgeStore`` is one; ``open_storage`` takes any."""

    def ingest(self, edges: DataFrame) -> None: ...
    def load(self) -> DataFrame: ...
    def range(self, t0: int, t1: int) -> DataFrame: ...


@dataclass(frozen=True)
class Dataset:
    name: str
    form: str
    tier: str
    path: str
    edges: int = 0
    about: str = ""
    tags: tuple[str, ...] = ()


#: Reader of each form: path to src, dst, t and more.
FORMS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "edge_list": readers.read_edge_list,
    "ratings": readers.read_ratings,
    "jodie": lambda spark, path: readers.read_jodie(spark, path).withColumnsRenamed({"user": "src", "item": "dst"}),
    "npz": readers.read_npz_edges,
    "binary": lambda spark, path: readers.read_binary_edges(spark, path).withColumn("t", F.col("pos")),
    "parquet": lambda spark, path: spark.read.parquet(path),
    "store": lambda spark, path: readers.EdgeStore(spark, path).load(),
}


def form(name: str):
    """Register a reader of a form."""

    def add(fn):
        FORMS[name] = fn
        return fn

    return add


class Registry:
    def __init__(self, *datasets: Dataset):
        self.known: dict[str, Dataset] = {}
        for d in datasets:
            self.add(d)

    def add(self, d: Dataset) -> None:
        if d.form not in FORMS or d.tier not in TIERS:
            raise ValueError(f"{d.name}: form {d.form!r} of {sorted(FORMS)}, tier {d.tier!r} of {TIERS}")
        self.known[d.name] = d

    def get(self, name: str) -> Dataset:
        try:
            return self.known[name]
        except KeyError:
            raise KeyError(f"unknown dataset {name!r}; known: {sorted(self.known)}") from None

    def by_tier(self, tier: str) -> list[Dataset]:
        return [d for d in self.known.values() if d.tier == tier]

    def table(self, spark: SparkSession) -> DataFrame:
        """All datasets, by tier and name."""
        rows = spark.createDataFrame([tuple(asdict(d).values()) for d in self.known.values()], "name string, form string, tier string, path string, edges long, about string, tags array<string>")
        rank = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("tier"))
        return rows.orderBy(rank, "name")

    def load(self, spark: SparkSession, name: str, prefer: str | None = None) -> TemporalGraph:
        """The graph of a dataset, its file read by its form; from the path ``prefer`` where that is given."""
        d = self.get(name)
        return open_edges(spark, prefer or d.path, d.form, name)


def open_edges(spark: SparkSession, path: str, form: str, name: str = "") -> TemporalGraph:
    """The graph of an edge file; events at one time keep an order by their ends."""
    if form not in FORMS:
        raise ValueError(f"form {form!r}: one of {sorted(FORMS)}")
    return from_edges(FORMS[form](spark, path).select("src", "dst", "t"), ["t", "src", "dst"], name=name or "file")


def open_storage(storage: EdgeStorage, t0: int | None = None, t1: int | None = None, num_nodes: int | None = None, name: str = "store") -> TemporalGraph:
    """The graph of the edges that a storage keeps, of all or with t0 <= t < t1."""
    edges = storage.load() if t0 is None or t1 is None else storage.range(t0, t1)
    return from_edges(edges.select("src", "dst", "t"), ["t", "src", "dst"], num_nodes, name)
