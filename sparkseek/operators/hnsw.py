"""Hierarchical navigable small-world graphs: one per shard of the vectors, searched in parallel and merged.

``Graph`` is the in-memory index of one shard (a bounded number of vectors). ``VectorStore`` keeps shards under a folder, as plain arrays in
Parquet; ``append`` inserts new vectors into the shards that have room and opens new ones for the rest, and counts at once or not at all.
``search`` asks every shard and keeps the k best. The contract is recall, not equality: levels are drawn from a seeded generator.
"""

from __future__ import annotations

import heapq
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkseek.runtime import commit_file, last_committed, materialize, read_committed

SHARD_ROWS = 50_000
GRAPH = "shard int, ids array<long>, d int, m int, ef int, entry int, points array<float>, levels array<struct<nodes: array<int>, ends: array<int>, near: array<int>, dist: array<double>>>"


class Graph:
    """Links per level: ``links[level][node]`` holds (distance, neighbour), nearest first; node numbers follow insertion."""

    def __init__(self, d: int, m: int = 12, ef: int = 64, seed: int = 0):
        self.d, self.m, self.ef = d, m, ef
        self.points = np.zeros((0, d), np.float32)
        self.size, self.entry = 0, -1
        self.links: list[dict[int, list[tuple[float, int]]]] = []
        self.rng = np.random.default_rng(seed)

    def draw_level(self) -> int:
        """Geometric: each level holds about 1/m of the nodes below."""
        return int(-np.log(1.0 - self.rng.random()) / np.log(self.m))

    def distances(self, q: np.ndarray, nodes: list[int]) -> np.ndarray:
        return np.sqrt(((self.points[nodes].astype(np.float64) - q) ** 2).sum(1))

    def descend(self, q: np.ndarray, start: int, level: int) -> int:
        """The node that greedy steps on one level end at."""
        best = float(self.distances(q, [start])[0])
        while True:
            around = [n for _, n in self.links[level].get(start, ())]
            if not around:
                return start
            dist = self.distances(q, around)
            i = int(dist.argmin())
            if dist[i] >= best:
                return start
            start, best = around[i], float(dist[i])

    def beam(self, q: np.ndarray, start: int, level: int, width: int) -> list[tuple[float, int]]:
        """The ``width`` nearest nodes that a best-first search on one level finds, nearest first."""
        first = float(self.distances(q, [start])[0])
        seen, open_, kept = {start}, [(first, start)], [(-first, start)]
        while open_:
            dist, node = heapq.heappop(open_)
            if len(kept) >= width and dist > -kept[0][0]:
                break
            fresh = [n for _, n in self.links[level].get(node, ()) if n not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for d, n in zip(self.distances(q, fresh).tolist(), fresh):
                if len(kept) < width or d < -kept[0][0]:
                    heapq.heappush(open_, (d, n))
                    heapq.heappush(kept, (-d, n))
                    if len(kept) > width:
                        heapq.heappop(kept)
        return sorted((-d, n) for d, n in kept)

    def insert(self, point) -> int:
        """Add a point; gives its number. A point of another dimension is an error."""
        q = np.asarray(point, np.float64)
        if q.shape != (self.d,):
            raise ValueError(f"expected {self.d} dimensions, got {q.shape}")
        if self.size == len(self.points):
            self.points = np.concatenate((self.points, np.zeros((max(64, self.size), self.d), np.float32)))
        node, top = self.size, self.draw_level()
        self.points[node] = q
        self.size += 1
        entry, height = self.entry, len(self.links) - 1
        while len(self.links) <= top:
            self.links.append({})
        for level in range(height, -1, -1):
            if level > top:
                entry = self.descend(q, entry, level)
                continue
            near = self.beam(q, entry, level, self.ef)
            entry = near[0][1]
            cap = 2 * self.m if level == 0 else self.m
            self.links[level][node] = near[: self.m]
            for dist, other in near[: self.m]:
                theirs = self.links[level].setdefault(other, [])
                theirs.append((dist, node))
                if len(theirs) > cap:
                    theirs.sort()
                    del theirs[cap:]
        for level in range(max(height + 1, 0), top + 1):
            self.links[level][node] = []
        if top > height:
            self.entry = node
        return node

    def knn(self, query, k: int, ef: int | None = None) -> list[tuple[float, int]]:
        """(distance, node) of at most k nearest nodes, nearest first."""
        if not self.size:
            return []
        q, node = np.asarray(query, np.float64), self.entry
        for level in range(len(self.links) - 1, 0, -1):
            node = self.descend(q, node, level)
        return self.beam(q, node, 0, max(ef or self.ef, k))[:k]

    def neighbourhood(self, node: int) -> list[list[tuple[float, int]]]:
        """A node's links level by level."""
        return [level[node] for level in self.links if node in level]


    def to_arrays(self) -> dict:
        """The graph as plain arrays: per level its nodes, and where the links of each end in the lists of neighbours and distances."""
        levels = []
        for level in self.links:
            nodes = np.fromiter(level, np.int32, len(level))
            flat = [x for links in level.values() for x in links]
            levels.append({"nodes": nodes, "ends": np.cumsum([len(x) for x in level.values()]).astype(np.int32), "near": np.array([n for _, n in flat], np.int32), "dist": np.array([x for x, _ in flat], np.float64)})
        return {"d": self.d, "m": self.m, "ef": self.ef, "entry": self.entry, "points": self.points[: self.size].ravel(), "levels": levels}

    @classmethod
    def from_arrays(cls, row: dict, seed: int = 0) -> Graph:
        """The graph again; levels of points that are inserted later are drawn from a generator of this seed and the graph's size."""
        g = cls(row["d"], row["m"], row["ef"])
        g.points = np.array(row["points"], np.float32).reshape(-1, row["d"])
        g.size, g.entry, g.rng = len(g.points), row["entry"], np.random.default_rng((seed, len(g.points)))
        for level in row["levels"]:
            links = list(zip(np.asarray(level["dist"]).tolist(), np.asarray(level["near"]).tolist()))
            ends = np.asarray(level["ends"]).tolist()
            g.links.append({n: links[a:b] for n, a, b in zip(np.asarray(level["nodes"]).tolist(), [0, *ends], ends)})
        return g


def _rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v"))


def _inserted(shard: int, row: dict | None, new: pd.DataFrame, d: int, m: int, ef: int, seed: int) -> pd.DataFrame:
    """A shard's row after its new vectors were inserted in the order of their ids."""
    g = Graph(d, m, ef, seed) if row is None else Graph.from_arrays(row, seed)
    new = new.sort_values("id", kind="stable")
    for v in new["v"]:
        g.insert(v)
    ids = np.concatenate(([] if row is None else np.asarray(row["ids"]), new["id"].to_numpy())).astype(np.int64)
    return pd.DataFrame([{"shard": shard, "ids": ids, **g.to_arrays()}])[["shard", "ids", "d", "m", "ef", "entry", "points", "levels"]]


def build(vectors: DataFrame, path: str, d: int, id_col: str = "vec_id", vector_col: str = "embedding", m: int = 12, ef: int = 64, seed: int = 0) -> None:
    """Write one graph per shard of about SHARD_ROWS vectors. Null vectors are left out; other columns aren't read."""
    rows = materialize(_rows(vectors, id_col, vector_col), "vectors")
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    make = lambda pdf: _inserted(int(pdf["shard"].iloc[0]), None, pdf, d, m, ef, seed)
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    rows.withColumn("shard", shard).groupBy("shard").applyInPandas(make, GRAPH).write.mode("overwrite").parquet(path)


class VectorStore:
    """Graphs of shards under ``path``; state N names the folder and the size of every shard."""

    def __init__(self, spark: SparkSession, path: str, d: int, m: int = 12, ef: int = 64, seed: int = 0, shard_rows: int | None = None):
        self.spark, self.path, self.d, self.m, self.ef, self.seed = spark, path.rstrip("/"), d, m, ef, seed
        self.shard_rows = SHARD_ROWS if shard_rows is None else shard_rows

    def version(self) -> int:
        return last_committed(self.spark, f"{self.path}/commits")

    def shards(self) -> dict[int, tuple[str, int]]:
        """shard -> (folder, vectors)."""
        v = self.version()
        return {int(s): (f, n) for s, (f, n) in json.loads(read_committed(self.spark, f"{self.path}/commits", v)).items()} if v else {}

    def _read(self, shards: dict[int, tuple[str, int]]) -> DataFrame:
        paths = [f"{self.path}/{folder}/part={s}" for s, (folder, _) in sorted(shards.items())]
        return self.spark.read.schema(GRAPH).parquet(*paths) if paths else self.spark.createDataFrame([], GRAPH)

    def index(self) -> DataFrame:
        """One row per shard, for ``search``."""
        return self._read(self.shards())

    def append(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> int:
        """Add vectors to the index; only shards that take in some are rewritten. Gives the new version; ids aren't checked for repeats."""
        start, known = self.version(), self.shards()
        rows = materialize(_rows(vectors, id_col, vector_col), "vectors")
        n = rows.count()
        if not n:
            return start
        room = [(s, self.shard_rows - size) for s, (_, size) in sorted(known.items()) if size < self.shard_rows]
        left, first = n - sum(r for _, r in room), max(known, default=-1) + 1
        room += [(first + i, self.shard_rows) for i in range(-(-max(left, 0) // self.shard_rows))]
        share, whole = np.cumsum([r for _, r in room]), sum(r for _, r in room)
        bounds = F.array(*(F.lit(int(x)) for x in share))  # a few new shards and those with room: at most n / shard_rows + the last ones
        place = F.pmod(F.xxhash64("id", F.lit(start)), F.lit(int(whole)))
        target = F.element_at(F.array(*(F.lit(s) for s, _ in room)), F.size(F.filter(bounds, lambda b: b <= place)) + 1)
        new = materialize(rows.withColumn("shard", target.cast("int")), "placed")
        sizes = {r["shard"]: r["n"] for r in new.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        open_ = {s: known[s] for s in sizes if s in known}
        d, m, ef, seed = self.d, self.m, self.ef, self.seed

        def insert(key: tuple, old: pd.DataFrame, fresh: pd.DataFrame) -> pd.DataFrame:
            return _inserted(int(key[0]), old.iloc[0].to_dict() if len(old) else None, fresh, d, m, ef, seed)

        folder = f"shards/{uuid.uuid4().hex}"
        done = self._read(open_).groupBy("shard").cogroup(new.groupBy("shard")).applyInPandas(insert, GRAPH)
        done.withColumn("part", F.col("shard")).write.partitionBy("part").parquet(f"{self.path}/{folder}")
        state = {**known, **{s: (folder, k + known.get(s, ("", 0))[1]) for s, k in sizes.items()}}
        if not commit_file(self.spark, f"{self.path}/commits", str(start + 1), json.dumps(state)):
            raise RuntimeError(f"version {start + 1} was written by someone else")
        return start + 1

    def search(self, queries: DataFrame, k: int, ef: int | None = None) -> DataFrame:
        return search(self.index(), queries, k, ef)


def search(index: DataFrame, queries: DataFrame, k: int, ef: int | None = None, block: int = 10_000) -> DataFrame:
    """(query_id, id, dist, rank) for a stated set of queries (query_id, query) over stored shards, ``block`` queries at a time."""
    asked = materialize(queries.where(F.col("query_id").isNotNull() & F.col("query").isNotNull()).select("query_id", "query"), "queries")
    parts, hits = max(1, -(-asked.count() // block)), None
    for i in range(parts):
        some = [(r["query_id"], list(r["query"])) for r in asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i).toLocalIterator()]  # about ``block`` rows
        found = index.mapInPandas(_asker(index.sparkSession.sparkContext.broadcast(some), k, ef), "query_id long, id long, dist double")
        hits = found if hits is None else hits.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def _asker(shared, k: int, ef: int | None):
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                g, ids = Graph.from_arrays(row), row["ids"]
                found = [(q, int(ids[n]), dist) for q, v in shared.value for dist, n in g.knn(v, k, ef)]
                yield pd.DataFrame(found, columns=["query_id", "id", "dist"])

    return ask
