"""Approximate nearest neighbours (largest inner product) by a hierarchical k-means tree.

The tree is fitted on the driver to at most 2 x SAMPLE vectors and broadcast; every vector is
indexed in the leaf that it descends to. A query visits leaves best-bin-first: a priority
queue holds the nodes seen, and the one whose centre promises most is opened next. How many
leaves to visit is calibrated: for CALIBRATION vectors, neighbours are found exactly over all
rows, and visits widen until TARGET of them are in the leaves visited.

Vectors move once, into groups of neighbouring leaves of at most about GROUP vectors (a larger
leaf has several groups). A query goes, with its list of leaves, to the groups that hold
leaves which it visits, and each gives back its k best there; the k best of these are its
neighbours. So a task holds one group and a block of queries, and up to GROUP x FEWEST
vectors the number of groups, and with it what moves for a query, doesn't grow.

Defined results: vectors that are null, zero, or hold null or non-finite components take no
part, nor do rows with null ids or with another dimension than the most common one (ties: the
smaller); rows with equal ids are rows of their own, and a query never finds its own id;
equal scores go to the smaller id; fewer candidates give fewer rows; other columns are left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import saved

SAMPLE, BRANCH, LEAF, MOST_LEAVES = 8192, 8, 256, 2048
CALIBRATION, TARGET = 64, 0.96
QUERY_BLOCK, GROUP, FEWEST = 128, 1 << 15, 16


class Tree:
    def __init__(self, x: np.ndarray, leaves: int, seed: int = 3):
        self.draw = np.random.default_rng(seed)
        self.centres: list[np.ndarray] = []  # of each inner node's children
        self.children: list[list[int]] = []  # an inner node's number, or -1 - leaf
        self.leaves = 0
        self.root = self._grow(x, leaves)

    def _grow(self, x: np.ndarray, leaves: int) -> int:
        k = min(BRANCH, leaves, len(np.unique(x, axis=0)) if len(x) else 0)
        if k < 2:
            self.leaves += 1
            return -self.leaves
        c = x[self.draw.choice(len(x), k, replace=False)]
        for _ in range(8):
            own = self.nearest(x, c)
            c = np.stack([x[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(k)])
        own = self.nearest(x, c)
        node = len(self.centres)
        self.centres.append(c)
        self.children.append([])
        self.children[node] = [self._grow(x[own == i], max(1, round(leaves * (own == i).mean()))) for i in range(k)]
        return node

    @staticmethod
    def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.argmax(x @ c.T - 0.5 * (c * c).sum(axis=1), axis=1)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(x), np.int64), [(self.root, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                out[at] = -1 - node
            elif len(at):
                own = self.nearest(x[at], self.centres[node])
                todo += [(child, at[own == i]) for i, child in enumerate(self.children[node])]
        return out

    def visits(self, q: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves of a best-bin-first traversal."""
        out, queue = [], [(0.0, self.root)]
        while queue and len(out) < most:
            node = heapq.heappop(queue)[1]
            if node < 0:
                out.append(-1 - node)
            else:
                for promise, child in zip((self.centres[node] @ q).tolist(), self.children[node], strict=True):
                    heapq.heappush(queue, (-promise, child))
        return out


def valid(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part."""
    single = rows.schema[vector].dataType == T.ArrayType(T.FloatType())  # floats travel as floats; all sums are in double precision
    v = F.col(vector) if single else F.col(vector).cast("array<double>")
    rows = rows.select(F.col(key).cast("long").alias("vec_id"), v.alias("vector")).where("vec_id IS NOT NULL AND vector IS NOT NULL")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.where(fine)
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.where(F.size("vector") == (sizes.d if sizes else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def exact(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, added up from the first component to the last: equal vectors score equally everywhere."""
    return np.cumsum(v * q, axis=-1)[..., -1]


def best(score: np.ndarray, v: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Exact scores and ids of one query's k best in a block, its own rows masked first (-inf: masked already); ``floor``: what it takes to matter."""
    score = np.where(ids == own, -np.inf, score)
    if len(score) > k:
        floor = max(floor, np.partition(score, -k)[-k])
    at = np.flatnonzero(score >= floor - 1e-9 * max(1.0, abs(floor)) if np.isfinite(floor) else score > -np.inf)
    s = exact(v[at], q)
    order = np.lexsort((ids[at], -s))[:k]
    return s[order], ids[at][order]


def _calibrated(indexed: DataFrame, tree: Tree, chosen: list, k: int, target: float) -> int:
    """Leaves to visit so that ``target`` of the chosen vectors' true neighbours are among them."""
    q, own = np.array([r.vector for r in chosen]), [r.vec_id for r in chosen]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, leaf, v = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2))
            score = q @ v.T
            rows = []
            for i in range(len(q)):
                at = np.flatnonzero(ids != own[i])
                at = at[np.argsort(-score[i][at], kind="stable")[:k]]
                rows.append((np.full(len(at), i), score[i][at], leaf[at]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows, strict=True)], names=["q", "score", "leaf"])

    near = indexed.select("vec_id", "leaf", "vector").mapInArrow(run, "q long, score double, leaf long")
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "leaf"))).where(F.col("n") <= k).toPandas()
    place = []
    for i, rows in near.groupby("q"):
        rank = {leaf: n for n, leaf in enumerate(tree.visits(q[i], tree.leaves))}
        place += [rank[x] for x in rows["leaf"]]
    return int(np.sort(place)[min(len(place) - 1, int(np.ceil(target * len(place))))]) + 1 if place else 1


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest of ``vectors`` found for each row of ``queries``."""
    spark = vectors.sparkSession
    rows = valid(vectors, key, vector)
    total = rows.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    share = F.lit(min(1.0, SAMPLE / total) * 2.0**63 - 1.0)
    mark = F.xxhash64("vec_id", "vector").bitwiseAND(F.lit((1 << 63) - 1))
    drawn = rows.withColumn("mark", mark).where(F.col("mark").cast("double") <= share).orderBy("mark", "vec_id").limit(2 * SAMPLE).collect()
    drawn.sort(key=lambda r: (r.vec_id, r.vector))
    tree = Tree(np.array([r.vector for r in drawn], np.float64).reshape(len(drawn), -1), min(MOST_LEAVES, max(1, total // LEAF)))
    shared = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.leaf_of(_matrix(batch.column(1))))], names=["vec_id", "vector", "leaf"])

    kind = T.StructType([*rows.schema.fields, T.StructField("leaf", T.LongType())])
    indexed = saved(rows.mapInArrow(place, kind), "knn-index")
    most = _calibrated(indexed, tree, drawn[:: max(1, len(drawn) // CALIBRATION)][:CALIBRATION], k, target)
    # Groups of neighbouring leaves: leaf, its first group, and how many share it.
    size = min(GROUP, max(1, -(-total // FEWEST)))
    first, parts, group, held = np.zeros(tree.leaves, np.int64), np.ones(tree.leaves, np.int64), 0, 0
    for r in sorted(indexed.groupBy("leaf").agg(F.count("*").alias("n")).collect()):  # a row for each leaf
        if held and held + r.n > size:
            group, held = group + 1, 0
        first[r.leaf], parts[r.leaf] = group, max(1, -(-r.n // size))
        group, held = (group, held + r.n) if parts[r.leaf] == 1 else (group + int(parts[r.leaf]), 0)
    layout = spark.createDataFrame(list(zip(range(tree.leaves), first.tolist(), parts.tolist(), strict=True)), "leaf long, first long, parts long")
    kept = indexed.join(F.broadcast(layout), "leaf")  # at most MOST_LEAVES rows
    kept = kept.select((F.col("first") + F.pmod(F.xxhash64("vec_id", "vector"), F.col("parts"))).alias("grp"), F.lit(-1).cast("long").alias("query"), "vec_id", "vector", F.array("leaf").alias("leaves"))
    asked = saved(valid(queries, key, vector).withColumn("query", F.monotonically_increasing_id()), "knn-queries")
    routes = T.StructType([T.StructField("grp", T.LongType()), T.StructField("query", T.LongType()), *rows.schema.fields, T.StructField("leaves", T.ArrayType(T.LongType()))])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(i, QUERY_BLOCK)
                groups, own, leaves = [], [], []
                for n, q in enumerate(_matrix(part.column(1))):
                    goes: dict[int, list[int]] = {}
                    for leaf in shared.value.visits(q, most):
                        for g in range(first[leaf], first[leaf] + parts[leaf]):
                            goes.setdefault(g, []).append(leaf)
                    groups += goes
                    own += [n] * len(goes)
                    leaves += goes.values()
                row = part.take(pa.array(own, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), row.column(2), row.column(0), row.column(1), pa.array(leaves, pa.list_(pa.int64()))], names=routes.names)

    # Of a group, vectors come first (their query is -1), by leaf; then queries.
    met = kept.union(asked.select("vec_id", "vector", "query").mapInArrow(route, routes)).repartition("grp").sortWithinPartitions("grp", "query")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, fresh, ids, leaf, v = None, [], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 0))
        for batch in batches:
            grp, query = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (grp[1:] != grp[:-1]) | ((query[1:] < 0) != (query[:-1] < 0))]))
            for a, b in zip(edges, np.append(edges[1:], len(grp)), strict=True):
                if grp[a] != at:
                    at, fresh, ids, leaf, v = grp[a], [], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 0))
                if query[a] < 0:
                    fresh.append(batch.slice(a, b - a))
                    continue
                if fresh:
                    leaf = np.concatenate([x.column(4).flatten().to_numpy() for x in fresh])
                    order = np.argsort(leaf, kind="stable")
                    leaf, ids = leaf[order], np.concatenate([x.column(2).to_numpy() for x in fresh])[order]
                    v, fresh = np.concatenate([_matrix(x.column(3)) for x in fresh])[order], []
                for i in range(a, b, QUERY_BLOCK):
                    part = batch.slice(i, min(QUERY_BLOCK, b - i))
                    q, own, goes = _matrix(part.column(3)), part.column(2).to_numpy(), part.column(4)
                    near = np.isin(leaf, goes.flatten().to_numpy())  # of leaves that any of these queries visits
                    score, low, who = q @ v[near].T, leaf[near], ids[near]
                    rows, them = v[near], []
                    for n in range(len(q)):
                        mine = np.zeros(tree_leaves, bool)
                        mine[goes[n].values.to_numpy()] = True
                        them.append(best(np.where(mine[low], score[n], -np.inf), rows, who, q[n], own[n], k, -np.inf))
                    count = [len(s) for s, _ in them]
                    numbers = part.column(1).to_numpy()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(numbers, count)), pa.array(np.repeat(own, count)), pa.array(np.concatenate([x for _, x in them])), pa.array(np.concatenate([s for s, _ in them]))], names=["query", "query_id", "vec_id", "score"]
                    )

    tree_leaves = tree.leaves
    found = met.mapInArrow(meet, "query long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
