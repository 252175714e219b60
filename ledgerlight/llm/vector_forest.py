"""Approximate nearest neighbours by largest inner product: a forest of random-projection trees, then exact ranking.

A tree's node cuts its vectors in two halves by a hyperplane across the line between two of them that are picked at random.
So that the largest inner products are the nearest, vectors carry one more component that brings all to the same length; queries
have zero there.

1. Equal vectors become one, with the ``k`` + 1 smallest of their ids: more can't be in a result. Each map task limits its part before
   the shuffle, so a frequent vector fills no group.
2. The trees share their first cuts (the trunk), fitted on a hashed sample of ``SAMPLE_BYTES`` at most. They deal every vector to a cell of about ``CELL``;
   each cell grows ``TREES`` trees over all its vectors and is a row of the written index.
3. A query enters one priority queue shared by all trees of all cells, ordered by the largest distance to a hyperplane that was crossed on the way.
   It takes leaves until the queue's head is beyond a limit. Since what comes off the queue is then all that is within the limit, a task takes
   that of its own cell, all queries at once, and queries go only to cells that the trunk's part of the queue reaches.
4. The candidates of those leaves are ranked by their exact inner products in double precision.

The limit is found by measurement: ``MEASURED`` queries are answered exactly by one pass over the whole index, and the limit is the least under which
the forest finds ``recall`` of their neighbours. Queries for which that leaves too few candidates take all leaves.

Defined results: vectors that are null or zero or hold null or non-finite components take no part, nor do null ids. Vectors of unequal length compare as if
the shorter went on with zeros. Rows that repeat both id and vector count once; an id with several vectors is as many candidates, and asks with one of
them (the smallest by bytes). A query isn't matched to its own id. Ties go to the smaller vec_id. Empty tables give an empty result. Other columns play no part.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, written

TREES = 8
CELL = 4096
LEAF = 48
SAMPLE_BYTES = 8 << 20
MEASURED = 128
#: Queries that a task takes of a cell, and that are ranked at once.
QUERY_BLOCK = 16384
AT_ONCE = 512


@dataclass
class Tree:
    """Nodes with a unit normal and an offset; children at or above 0 are nodes, others leaves (-1 - leaf)."""

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    members: list[np.ndarray]

    def home(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        at = np.zeros(len(x), dtype=np.int64) if len(self.offsets) else np.full(len(x), -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            side = ((x[inner] * self.normals[node]).sum(axis=1) > self.offsets[node]).astype(np.int64)
            at[inner] = self.children[node, side]
        return -1 - at

    def costs(self, q: np.ndarray, start: np.ndarray) -> np.ndarray:
        """For each query and leaf the largest distance to a hyperplane crossed on the way, or ``start`` if that is larger."""
        out = np.empty((len(q), max(1, len(self.members))))
        if not len(self.offsets):
            out[:] = start[:, None]
            return out
        margin = q @ self.normals.T - self.offsets
        here = {0: start}
        for node, (left, right) in enumerate(self.children.tolist()):  # a node comes before its children
            own = here.pop(node)
            for child, crossed in ((left, margin[:, node]), (right, -margin[:, node])):
                cost = np.maximum(own, crossed)
                if child < 0:
                    out[:, -1 - child] = cost
                else:
                    here[child] = cost
        return out

    def within(self, q: np.ndarray, limit: float) -> list[tuple[int, float]]:
        """(leaf, cost) of one query off the priority queue, cheapest first, until the head is beyond ``limit``."""
        queue, found = [(0.0, 0 if len(self.offsets) else -1)], []
        while queue and queue[0][0] <= limit:
            cost, at = heapq.heappop(queue)
            if at < 0:
                found.append((-1 - at, cost))
                continue
            margin = float(q @ self.normals[at] - self.offsets[at])
            near = int(margin > 0)
            heapq.heappush(queue, (cost, int(self.children[at, near])))
            heapq.heappush(queue, (max(cost, abs(margin)), int(self.children[at, 1 - near])))
        return found


def grown(x: np.ndarray, most: int, seed: int) -> Tree:
    """A tree with leaves of at most ``most`` vectors, or of equal ones."""
    rng = np.random.default_rng(seed)
    normals, offsets, children, members = [], [], [], []
    todo = [(np.arange(len(x)), -1, 0)]
    while todo:
        own, above, side = todo.pop()
        name = None
        for _ in range(4 if len(own) > most else 0):
            a, b = x[rng.choice(own, 2, replace=False)]
            if not (length := np.linalg.norm(b - a)):
                continue
            normal = (b - a) / length
            share = x[own] @ normal
            in_order, half = np.sort(share), len(own) // 2
            offset = float(in_order[half - 1] + in_order[half]) / 2
            right = share > offset
            if right.any():
                name = len(offsets)
                normals.append(normal)
                offsets.append(offset)
                children.append([0, 0])
                todo += [(own[right], name, 1), (own[~right], name, 0)]
                break
        if name is None:
            name = -1 - len(members)
            members.append(own)
        if above >= 0:
            children[above][side] = name
    width = x.shape[1]
    return Tree(
        np.array(normals, dtype=np.float64).reshape(-1, width), np.array(offsets), np.array(children, dtype=np.int64).reshape(-1, 2), members
    )


def _matrix(raw: list[bytes], kind: str, width: int) -> np.ndarray:
    """Vectors from their bytes, a row each, with zeros up to ``width``."""
    out = np.zeros((len(raw), width))
    size = np.dtype(kind).itemsize
    if all(len(x) == size * width for x in raw):
        return np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), width).astype(np.float64)
    for row, x in zip(out, raw, strict=True):
        own = np.frombuffer(x, dtype=kind)
        row[: len(own)] = own
    return out


def _levelled(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with one more component, all of the length ``longest``."""
    return np.c_[x, np.sqrt(np.maximum(0.0, longest**2 - (x**2).sum(axis=1)))]


def _asking(x: np.ndarray) -> np.ndarray:
    """Queries of length 1, with zero for the further component."""
    return np.c_[x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))]


def packed(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, str]:
    """(vec_id, v binary) of the rows that take part, repeated rows of a batch once, and the kind of number in ``v``."""
    kind = "<f4" if vectors.schema[vector_col].dataType.elementType.simpleString() == "float" else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[int, bytes], None] = {}
            lists = batch.column(1)
            flat = lists.flatten()
            ok = np.asarray(flat.is_valid())
            values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
            ok &= np.isfinite(values)
            ends = np.cumsum(np.nan_to_num(np.asarray(lists.value_lengths().fill_null(0)))).tolist()
            start = 0
            for n, end in zip(batch.column(0).to_pylist(), ends, strict=True):
                own = values[start:end]
                if n is not None and ok[start:end].all() and (used := np.flatnonzero(own)).size:
                    found[n, (own[: used[-1] + 1] + 0.0).astype(kind).tobytes()] = None
                start = end
            yield pa.RecordBatch.from_pydict(
                {"vec_id": pa.array([n for n, _ in found], pa.int64()), "v": pa.array([x for _, x in found], pa.binary())}
            )

    v = F.col(vector_col)
    plain = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>" if kind == "<f8" else "array<float>").alias("v"))
    return plain.mapInArrow(run, "vec_id long, v binary"), kind


def _best(ids: list[np.ndarray], score: np.ndarray, n: int) -> list[tuple[int, int, float]]:
    """(id, place, score) of the n best candidates, ties to the smaller id."""
    rows = [(-s, i, at) for at, s in enumerate(score.tolist()) for i in ids[at].tolist()]
    return [(i, at, -s) for s, i, at in heapq.nsmallest(n, rows)]


def _exactly(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products with one query, components added in their order."""
    return (x * q).cumsum(axis=1)[:, -1] if len(x) else np.empty(0)


@dataclass
class Cell:
    """A cell of the index: its vectors, their ids and its trees."""

    x: np.ndarray
    ids: list[np.ndarray]
    trees: list[Tree]
    leaf: np.ndarray  # of each tree and vector

    def costs(self, q: np.ndarray, start: np.ndarray) -> np.ndarray:
        """For each query and vector the least cost at which a tree of the cell yields it."""
        out = np.full((len(q), len(self.x)), np.inf)
        for tree, leaf in zip(self.trees, self.leaf, strict=True):
            np.minimum(out, tree.costs(q, start)[:, leaf], out=out)
        return out

    def search(self, x: np.ndarray, q: np.ndarray, start: np.ndarray, limit: float, n: int) -> Iterator[list[tuple[int, int, float]]]:
        """For each query the n best of the candidates within the limit."""
        blocks = self.trees[0].members
        for at in range(0, len(q), AT_ONCE):
            some = slice(at, at + AT_ONCE)
            inside = np.zeros((len(q[some]), len(self.x)), dtype=bool)
            for tree, leaf in zip(self.trees, self.leaf, strict=True):
                inside |= (tree.costs(q[some], start[some]) <= limit)[:, leaf]
            score = np.full(inside.shape, -np.inf)
            for block in blocks:  # only what some tree yields is multiplied
                asked = np.flatnonzero(inside[:, block].any(axis=1))
                if len(asked):
                    own = np.where(inside[np.ix_(asked, block)], x[some][asked] @ self.x[block].T, -np.inf)
                    score[np.ix_(asked, block)] = own
            keep = min(n + 4, score.shape[1])
            top = np.argpartition(-score, keep - 1, axis=1)[:, :keep] if keep < score.shape[1] else np.tile(np.arange(keep), (len(score), 1))
            for vector, own, places in zip(x[some], score, top, strict=True):
                places = places[np.isfinite(own[places])]
                yield _best([self.ids[p] for p in places.tolist()], _exactly(vector, self.x[places]), n)


def _grow_cell(key, batches: pa.Table, kind: str, width: int, longest: float) -> pa.Table:
    raw = batches.column("v").to_pylist()
    order = sorted(range(len(raw)), key=raw.__getitem__)
    ids = [batches.column("ids")[n].as_py() for n in order]
    x = _matrix([raw[n] for n in order], kind, width)
    number = key[0].as_py()
    level = _levelled(x, longest)
    trees = [grown(level, LEAF, number * TREES + t) for t in range(TREES)]
    leaf = np.empty((TREES, len(x)), dtype=np.int32)
    for t, tree in enumerate(trees):
        for n, own in enumerate(tree.members):
            leaf[t, own] = n
        tree.normals = tree.normals.astype(np.float32)
        if t:
            tree.members = [np.empty(0, np.int32)] * len(tree.members)  # known from ``leaf``
    cell = Cell(x.astype(kind), [np.array(i, dtype=np.int64) for i in ids], trees, leaf)
    return pa.table({"cell": pa.array([number], pa.int64()), "trees": pa.array([pickle.dumps(cell)], pa.binary())})


def _cell(raw: bytes) -> Cell:
    cell = pickle.loads(raw)  # what _grow_cell wrote into the index
    cell.x = cell.x.astype(np.float64)
    for tree in cell.trees:
        tree.normals = tree.normals.astype(np.float64)
    return cell


FOUND = "q long, vec_id long, score double"


class Forest:
    """The index of a table of vectors. ``index``: (cell, trees); ``limit``: up to which distance hyperplanes are crossed."""

    def __init__(self, vectors: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding"):
        spark = self.spark = vectors.sparkSession
        self.k, self.limit = k, float("inf")
        rows, self.kind = packed(vectors, id_col, vector_col)
        self.rows, size, kind = rows, np.dtype(self.kind).itemsize, self.kind

        def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw = batch.column(1).to_pylist()
                widest = max(map(len, raw), default=0) // size
                yield pa.RecordBatch.from_pydict(
                    {
                        "n": [len(raw)],
                        "width": [widest],
                        "longest": [float(np.sqrt((_matrix(raw, kind, widest) ** 2).sum(axis=1)).max(initial=0.0))],
                    }
                )

        told = rows.mapInArrow(lengths, "n long, width long, longest double").agg(F.sum("n"), F.max("width"), F.max("longest")).first()
        self.n, self.width, self.longest = told[0] or 0, max(1, told[1] or 1), told[2] or 1.0
        width, longest = self.width, self.longest
        often = min(1.0, SAMPLE_BYTES / (8 * width) / max(1, self.n))
        picked = rows if often == 1 else rows.filter(F.pmod(F.xxhash64("v"), F.lit(1 << 24)) < int(often * (1 << 24)))
        sample = sorted(bytes(r[0]) for r in picked.select("v").distinct().toLocalIterator())
        trunk = grown(_levelled(_matrix(sample, kind, width), longest), max(8, int(CELL * often)), 1)
        trunk.members = [np.empty(0, np.int64)] * len(trunk.members)
        self.trunk = spark.sparkContext.broadcast(trunk)
        sent = self.trunk

        of_vector = Window.partitionBy("v").orderBy("vec_id")
        distinct = (
            rows.withColumn("place", F.dense_rank().over(of_vector))
            .filter(F.col("place") <= k + 1)
            .groupBy("v")
            .agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
        )

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _levelled(_matrix(batch.column(0).to_pylist(), kind, width), longest)
                yield pa.RecordBatch.from_arrays([pa.array(sent.value.home(x), pa.int64()), *batch.columns], ["cell", "v", "ids"])

        def grow(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            return _grow_cell(key, table, kind, width, longest)

        cells = distinct.mapInArrow(dealt, "cell long, v binary, ids array<long>")
        self.index = written(cells.groupBy("cell").applyInArrow(grow, "cell long, trees binary"), "forest")

    def measure(self, queries: DataFrame, recall: float) -> float:
        """Set ``limit`` to the least that finds ``recall`` of the true neighbours of MEASURED of the queries (q, v); returns the share found."""
        some = queries.orderBy(F.xxhash64("q"), "q").limit(MEASURED).toPandas()
        if not len(some):
            return 1.0
        asked = _matrix(some["v"].tolist(), self.kind, self.width)
        numbers, n = some["q"].tolist(), self.k + 1
        sent, trunk = self.spark.sparkContext.broadcast(asked), self.trunk

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x = sent.value
            q = _asking(x)
            first = trunk.value.costs(q, np.zeros(len(q)))
            for batch in batches:
                for number, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    cell = _cell(raw.as_py())
                    costs = cell.costs(q, first[:, number])
                    out = []
                    for m, (own, cost) in enumerate(zip(x, costs, strict=True)):
                        out += [(m, i, s, float(cost[at])) for i, at, s in _best(cell.ids, _exactly(own, cell.x), n)]
                    yield pa.RecordBatch.from_pydict(
                        dict(zip(("m", "vec_id", "score", "cost"), map(list, zip(*out, strict=True)), strict=True))
                    )

        best = Window.partitionBy("m").orderBy(F.desc("score"), "vec_id")
        met = (
            self.index.mapInArrow(exact, "m long, vec_id long, score double, cost double")
            .withColumn("rank", F.row_number().over(best))
            .filter(F.col("rank") <= n)
            .toPandas()
        )
        met = met[met["vec_id"].to_numpy() != np.array(numbers)[met["m"].to_numpy()]]
        costs = np.sort(met["cost"].to_numpy())
        if not len(costs):
            return 1.0
        self.limit = float(costs[min(len(costs) - 1, int(np.ceil(recall * len(costs))) - 1)])
        return float((costs <= self.limit).mean())

    def _found(self, queries: DataFrame, limit: float, n: int) -> DataFrame:
        """(q, vec_id, score): the n best candidates of each cell for each query (q, v)."""
        trunk, kind, width = self.trunk, self.kind, self.width

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _asking(_matrix(batch.column(1).to_pylist(), kind, width))
                met = [trunk.value.within(q, limit) for q in x]
                count = [len(m) for m in met]
                of = pa.array(np.repeat(np.arange(len(met)), count))
                flat = [pair for m in met for pair in m]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c for c, _ in flat], pa.int64()), pa.array([s for _, s in flat], pa.float64()), batch.column(0).take(of), batch.column(1).take(of)],
                    ["cell", "start", "q", "v"],
                )

        routed = queries.select("q", "v").mapInArrow(route, "cell long, start double, q long, v binary")
        # a row per cell, of which there are SAMPLE_BYTES / (64 * width) at most
        crowds = routed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("parts"))
        crowds = written(crowds, "crowds")
        dealt = routed.join(F.broadcast(crowds), "cell").withColumn("part", F.pmod(F.xxhash64("q"), F.col("parts")).cast("int"))
        copies = self.index.join(F.broadcast(crowds), "cell").select("cell", "trees", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

        def search(asked: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(asked) and len(cells):
                cell = _cell(cells["trees"].iloc[0])
                x = _matrix(asked["v"].tolist(), kind, width)
                for q, own in zip(asked["q"].tolist(), cell.search(x, _asking(x), asked["start"].to_numpy(), limit, n), strict=True):
                    out += [(q, i, s) for i, _, s in own]
            found = pd.DataFrame(out, columns=["q", "vec_id", "score"])
            return found.astype({"q": "int64", "vec_id": "int64", "score": "float64"})

        return dealt.groupBy("cell", "part").cogroup(copies.groupBy("cell", "part")).applyInPandas(search, FOUND)

    def nearest(self, are_queries: Column, recall: float = 0.95) -> DataFrame:
        """(query_id, rank, vec_id, score) for the rows whose ``vec_id`` the condition picks, against all rows.

        Queries of equal vectors are searched once; what they share is dealt out by a join, which the adaptive skew join splits.
        """
        mine = self.rows.filter(are_queries)
        asking = written(
            mine.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"), F.size(F.collect_set(F.xxhash64("v"))).alias("own")),
            "asking",
        )
        vectors = written(asking.groupBy("v").agg(F.min("query_id").alias("q")), "queries")
        more = asking.agg(F.coalesce(F.max("own"), F.lit(1))).first()[0]
        n = self.k + more
        self.measured = self.measure(vectors, recall)
        in_order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        best = lambda found: (
            found.withColumn("rank", F.row_number().over(in_order))
            .filter(F.col("rank") <= n)
            .groupBy("q")
            .agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("best"))
        )
        first = written(best(self._found(vectors, self.limit, n)), "found")
        few = vectors.join(first.filter(F.size("best") >= n).select("q"), "q", "left_anti")
        if self.limit < float("inf") and few.limit(1).count():
            every = best(self._found(few, float("inf"), n))
            found = first.filter(F.size("best") >= n).unionByName(every)
        else:
            found = first
        named = asking.join(vectors, "v").select("query_id", "q")
        others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, self.k)
        return (
            named.join(found, "q")
            .select("query_id", F.posexplode(others).alias("at", "hit"))
            .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")
        )

    def drop(self) -> None:
        """Delete the index."""
        drop_written(self.index)
