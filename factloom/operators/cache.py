"""Reuse: a bounded store of persisted DataFrames by key, and content-keyed reuse of per-file results."""

from __future__ import annotations

from collections import Counter, OrderedDict
from collections.abc import Callable, Hashable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class FrameCache:
    """Least recently used frames are unpersisted once there are more than ``capacity``. ``stats`` counts hits, misses and evictions."""

    def __init__(self, capacity: int):
        if capacity < 1:
            raise ValueError("a cache holds one frame at least")
        self.capacity = capacity
        self.held: OrderedDict[Hashable, DataFrame] = OrderedDict()
        self.stats: Counter[str] = Counter()

    def get(self, key: Hashable, make: Callable[[], DataFrame]) -> DataFrame:
        if key in self.held:
            self.stats["hit"] += 1
            self.held.move_to_end(key)
            return self.held[key]
        self.stats["miss"] += 1
        self.held[key] = frame = make().persist()
        while len(self.held) > self.capacity:
            _, old = self.held.popitem(last=False)
            old.unpersist()
            self.stats["evict"] += 1
        return frame

    def clear(self) -> None:
        while self.held:
            self.held.popitem()[1].unpersist()


class CachedGraph:
    """Graph analyses memoised by what was asked."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, capacity: int = 16):
        self.nodes, self.edges, self.cache = nodes, edges, FrameCache(capacity)

    def _edges(self, kinds, certainties) -> DataFrame:
        from factloom.operators.graph import select_edges

        return self.cache.get(("edges", kinds, certainties), lambda: select_edges(self.edges, kinds and list(kinds), certainties and list(certainties)))

    def ask(self, name: str, *args, kinds: tuple[str, ...] | None = None, certainties: tuple[str, ...] | None = None) -> DataFrame:
        """``degree``, ``strong_components``, ``betweenness`` (nodes, edges), or ``shortest_path`` (edges, source, target)."""
        from factloom.operators import graph

        edges = self._edges(kinds, certainties)
        with_nodes = name in ("degree", "strong_components", "betweenness")
        return self.cache.get((name, args, kinds, certainties), lambda: getattr(graph, name)(*([self.nodes] if with_nodes else []), edges, *args))


def fingerprint(files: DataFrame) -> DataFrame:
    """path and claim: what a file's derived rows rest on."""
    return files.select("path", F.sha2(F.col("source"), 256).alias("claim"))


def reuse(files: DataFrame, previous: DataFrame, derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Derived rows with their path and claim: those of files whose claim still holds are kept, only the others are derived again."""
    claimed = files.withColumn("claim", F.sha2(F.col("source"), 256))
    held = previous.select("path", "claim").distinct()
    kept = previous.join(claimed.select("path", "claim"), ["path", "claim"], "left_semi")
    missed = claimed.join(held, ["path", "claim"], "left_anti")
    fresh = derive(missed.drop("claim")).join(missed.select("path", "claim"), "path")
    return kept.unionByName(fresh.select(*previous.columns))
