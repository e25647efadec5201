"""Nearest neighbours by vantage-point trees, one per shard.

Rows are dealt to shards of bounded size by a hash. A task builds the tree of its shard and sends a block of
queries through it together: each node splits the queries by their side, and a subtree is left out for a query
if the triangle inequality puts all of it beyond the query's present k-th distance. ``factor`` above 1 inflates that bound and leaves out
more; factor 1 is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperwire.llm.common import bounded, checkpointed, on_workers

NEIGHBOURS, FACTOR = 10, 1.0
#: Rows of a shard and queries of a block, about; rows of a leaf.
SHARD, BLOCK, LEAF = 8192, 4096, 64
#: Stands for a NULL id in arrays: last in ties, and NULL again in the result.
NONE = np.iinfo(np.int64).max


class Tree:
    """Inner nodes: vantage point, both subtrees and the least and greatest distance of each from it."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF, seed: int = 5):
        self.points, self.ids, self.leaf = points, ids, leaf
        self.random = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        point = self.points[self.random.choice(rows)]
        distance = np.sqrt(((self.points[rows] - point) ** 2).sum(axis=1))
        inner = distance <= np.median(distance)
        if inner.all():  # at least half of the rows lie equally far
            inner = distance < distance.max()
            if not inner.any():
                return rows
        sides = [(distance[s].min(), distance[s].max(), self._build(rows[s])) for s in (inner, ~inner)]
        return point, sides

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float = FACTOR) -> tuple[np.ndarray, np.ndarray]:
        """Distances and ids of the k nearest rows whose id is not the query's ``own``; infinite where there are fewer."""
        self.best = np.full((len(queries), k), np.inf)
        self.near = np.full((len(queries), k), NONE)
        self.queries, self.own, self.factor = queries, own, factor
        self._visit(self.root, np.arange(len(queries)))
        return self.best, self.near

    def _visit(self, node, asked: np.ndarray) -> None:
        if not len(asked):
            return
        if isinstance(node, np.ndarray):
            for at in range(0, len(node), 1024):  # a leaf of equal points may be large
                self._leaf(node[at : at + 1024], asked)
            return
        point, sides = node
        distance = np.sqrt(((self.queries[asked] - point) ** 2).sum(axis=1))
        bounds = [np.maximum(low - distance, distance - high) for low, high, _ in sides]
        first = bounds[1] < bounds[0]
        for nearer in (True, False):
            for side in (0, 1):
                some = first == (side == 1) if nearer else first == (side == 0)
                # A hair's breadth for rounding; at equal distance the smaller id may still win.
                reach = bounds[side][some] * self.factor - 1e-9 <= self.best[asked[some], -1]
                self._visit(sides[side][2], asked[some][reach])

    def _leaf(self, rows: np.ndarray, asked: np.ndarray) -> None:
        for at in range(0, len(asked), 256):
            some = asked[at : at + 256]
            distance = np.zeros((len(some), len(rows)))
            for a, b in zip(self.queries[some].T, self.points[rows].T):  # summed in order, as SQL would
                gap = a[:, None] - b
                distance += gap * gap
            distance = np.sqrt(distance)
            distance[self.ids[rows][None, :] == self.own[some, None]] = np.inf
            distance = np.concatenate([self.best[some], distance], axis=1)
            ids = np.concatenate([self.near[some], np.broadcast_to(self.ids[rows], (len(some), len(rows)))], axis=1)
            order = np.lexsort((ids, distance), axis=1)[:, : self.best.shape[1]]
            self.best[some] = np.take_along_axis(distance, order, axis=1)
            self.near[some] = np.take_along_axis(ids, order, axis=1)


def usable(vector: Column) -> Column:
    """Not NULL, not empty, all components finite, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def neighbours(
    df: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, factor: float = FACTOR, key: str = "vec_id", vector: str = "embedding",
    shard: int = SHARD, block: int = BLOCK,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k nearest rows of each query by Euclidean distance.

    Rows with a query's id are its own and no candidates; a query with a NULL id has none of its own. Vectors that are NULL, empty, zero or not finite take
    no part; vectors of another length than the query's are not compared. Ties go to the smaller id, NULL ids last. Repeated rows are
    candidates of their own, repeated queries count once. Fewer than k candidates are all returned; an empty table gives
    none. Other columns, texts of any length among them, are not read.
    """
    on_workers(df.sparkSession)
    held = F.transform(F.col(vector), lambda x: x.cast("double"))

    def read(rows: DataFrame) -> DataFrame:
        return rows.where(usable(F.col(vector))).select(F.coalesce(F.col(key), F.lit(int(NONE))).cast("bigint").alias("id"), held.alias("v"), F.size(vector).alias("dim"))

    rows = checkpointed(read(df))
    asked = checkpointed(read(queries).distinct())
    shards = max(1, -(-rows.count() // shard))
    blocks = max(1, -(-asked.count() // block))
    rows = rows.select("*", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int").alias("shard"))
    # Each shard meets each block of queries; with up to ``block`` queries, every row moves once.
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("v", "id"), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def matrix(table: pa.Table) -> np.ndarray:
        flat = table.column("v").combine_chunks().flatten().to_numpy()
        return flat.reshape(table.num_rows, -1)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query", "qv", "score", "id"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.list_(pa.float64())), pa.array([], pa.float64()), pa.array([], pa.int64())], names)
        own = right.column("id").to_numpy()
        # An id of no query keeps rows and queries without an id apart.
        best, near = Tree(matrix(left), left.column("id").to_numpy()).search(matrix(right), np.where(own == NONE, NONE - 1, own), k, factor)
        q, at = np.nonzero(np.isfinite(best))
        vectors = right.column("v").combine_chunks().take(pa.array(q))
        return pa.table([pa.array(own[q]), vectors, pa.array(best[q, at]), pa.array(near[q, at])], names)

    schema = "query bigint, qv array<double>, score double, id bigint"
    found = rows.groupBy("dim", "shard", "block").cogroup(asked.groupBy("dim", "shard", "block")).applyInArrow(search, schema)
    order = Window.partitionBy("query", "qv").orderBy("score", "id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    none = F.lit(int(NONE))
    return found.select(F.nullif("query", none).alias("query_id"), "rank", F.nullif("id", none).alias("vec_id"), "score")


def exact_neighbours(df: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, **options) -> DataFrame:
    """The same with factor 1, to measure recall against."""
    return neighbours(df, queries, k, 1.0, **options)


def recall(found: DataFrame, truth: DataFrame) -> float:
    """Share of the true neighbours that were found."""
    total = truth.count()
    hit = bounded(checkpointed(truth.select("query_id", "vec_id").distinct()))
    return found.select("query_id", "vec_id").distinct().join(hit, ["query_id", "vec_id"]).count() / max(total, 1)
