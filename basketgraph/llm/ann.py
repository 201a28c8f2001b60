"""Approximate nearest neighbours by a forest of random-projection trees, with exact reranking.

Trees are fitted on a bounded sample (`max_sample` vectors, picked by a hash): a node splits its points at the median
of their projections on the difference of two of them. Every vector is then filed in its leaf of each tree. A query
goes through all trees with one priority queue, best margin first, until its leaves hold `share` of the sample (of
all trees together, LEAST at least), so its candidates follow the data and no bucket is capped. Leaves meet their queries by a join on the leaf; each
leaf gives its best k for each query, and these are ranked by the exact inner product of the original vectors.

Equal vectors are filed once with their k + 1 smallest ids, which are all that a result can hold of them, so a vector
that fills a third of the table makes no large leaf.

Edge cases: vectors that are null, zero, or hold null or non-finite numbers take no part, nor do those of another
length than most; ties go to smaller ids; a repeated id counts once for each distinct vector; if there are k
candidates or fewer all are returned; an empty table gives an empty one; other columns are left out.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MAX_SAMPLE, TREES, LEAF, SHARE, LEAST = 20_000, 8, 64, 0.12, 8_192


class Forest:
    """Nodes of all trees in arrays; a child below 0 is the leaf -1 - child."""

    def __init__(self, points: np.ndarray, trees: int, leaf: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.directions, self.cuts, self.children, self.leaf_sizes = [], [], [], []
        self.roots = [self._grow(points, np.arange(len(points)), leaf, rng) for _ in range(trees)]
        self.directions = np.array(self.directions or np.zeros((0, points.shape[1])))
        self.cuts, self.children = np.array(self.cuts), np.array(self.children, np.int64).reshape(-1, 2)
        self.trees = trees

    def _grow(self, points: np.ndarray, own: np.ndarray, leaf: int, rng) -> int:
        if len(own) > leaf:
            for _ in range(4):
                a, b = points[rng.choice(own, 2, replace=False)]
                along = a - b
                size = np.linalg.norm(along)
                if size == 0:
                    continue
                along = along / size
                at = points[own] @ along
                cut = np.median(at)
                low = at < cut
                if 0 < low.sum() < len(own):
                    i = len(self.cuts)
                    self.directions.append(along)
                    self.cuts.append(cut)
                    self.children.append([0, 0])
                    self.children[i] = [self._grow(points, own[low], leaf, rng), self._grow(points, own[~low], leaf, rng)]
                    return i
        self.leaf_sizes.append(len(own))
        return -len(self.leaf_sizes)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.empty((len(x), self.trees), np.int64)
        for t, root in enumerate(self.roots):
            node = np.full(len(x), root)
            live = np.flatnonzero(node >= 0)
            while len(live):
                at = node[live]
                right = np.einsum("ij,ij->i", x[live], self.directions[at]) >= self.cuts[at]
                node[live] = self.children[at, right.astype(int)]
                live = live[node[live] >= 0]
            out[:, t] = -1 - node
        return out

    def search(self, q: np.ndarray, share: float) -> list[int]:
        """Leaves in order of margin until they hold the share of what all leaves hold."""
        margin = (self.directions @ q - self.cuts).tolist()
        want, out = max(share * sum(self.leaf_sizes), LEAST), []
        heap = [(-np.inf, root) for root in self.roots]
        heapq.heapify(heap)
        children, sizes = self.children, self.leaf_sizes
        while heap and want > 0:
            worst, node = heapq.heappop(heap)
            while node >= 0:
                m = margin[node]
                right = m >= 0
                heapq.heappush(heap, (max(worst, abs(m)), int(children[node, int(not right)])))
                node = int(children[node, int(right)])
            out.append(-1 - node)
            want -= sizes[-1 - node]
        return out


def usable(vector: Column, size: int | None = None) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    ok = vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)
    return F.coalesce(ok & (F.size(vector) == size) if size else ok, F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def neighbours(table: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", max_sample: int = MAX_SAMPLE, trees: int = TREES, leaf: int = LEAF, share: float = SHARE) -> DataFrame:
    """query_id, rank, key, score: for each row for which `queries` holds, its k nearest by inner product."""
    spark = table.sparkSession
    rows = table.filter(usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    kind = table.schema[vector].dataType.simpleString()
    empty = f"query_id long, rank int, {key} long, score double"
    if sizes is None:
        return spark.createDataFrame([], empty)
    d, n = sizes
    rows = rows.filter(F.size("v") == d)
    # Equal vectors are one row with their smallest ids.
    first = rows.select("id", "v").distinct().withColumn("nth", F.row_number().over(W.partitionBy("v").orderBy("id"))).filter(F.col("nth") <= k + 1)
    points = first.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("point", F.element_at("ids", 1))
    picked = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < 1_000_000 * min(1.0, max_sample / n)).select("v").distinct().limit(2 * max_sample).toPandas()
    sample = np.array(picked.v.tolist(), float) if len(picked) else np.zeros((1, d))
    shared = spark.sparkContext.broadcast(_state(Forest(sample, trees, max(8, leaf))))

    def file(batches):
        forest = _forest(shared.value)
        for whole in batches:
            for s in range(0, whole.num_rows, 1000):
                b = whole.slice(s, 1000)
                at = forest.leaves(_matrix(b.column("v")))
                of = pa.array(np.repeat(np.arange(b.num_rows), forest.trees))
                yield pa.RecordBatch.from_arrays([pa.array(at.ravel()), b.column("point").take(of), b.column("v").take(of)], ["leaf", "point", "v"])

    def ask(batches):
        forest = _forest(shared.value)
        for whole in batches:
            for s in range(0, whole.num_rows, 16):  # a query goes to hundreds of leaves
                b = whole.slice(s, 16)
                found = [forest.search(q, share) for q in _matrix(b.column("v"))]
                of = pa.array(np.repeat(np.arange(b.num_rows), [len(f) for f in found]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).astype(np.int64)), b.column("id").take(of), b.column("v").take(of)], ["leaf", "query", "v"])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            points, ids = _matrix(left.column("v").combine_chunks()), left.column("point").to_numpy()
            order = np.argsort(ids, kind="stable")
            points, ids = points[order], ids[order]
            for s in range(0, right.num_rows, 256):
                part = right.slice(s, 256)
                q, own = _matrix(part.column("v").combine_chunks()), part.column("query").to_numpy()
                near = q @ points.T
                top = np.argsort(-near, axis=1, kind="stable")[:, : k + 1]
                exact = (points[top] * q[:, None, :]).sum(-1)
                out.append((np.repeat(own, top.shape[1]), ids[top].ravel(), exact.ravel()))
        a, b, c = (np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"query": a, "point": b, "score": c})

    filed = points.select("point", "v").mapInArrow(file, f"leaf long, point long, v {kind}")
    asked = rows.filter("asks").select("id", "v").distinct().mapInArrow(ask, f"leaf long, query long, v {kind}")
    met = filed.groupBy("leaf").cogroup(asked.groupBy("leaf")).applyInArrow(meet, "query long, point long, score double")
    near = met.groupBy("query", "point").agg(F.max("score").alias("score"))
    near = near.withColumn("nth", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "point"))).filter(F.col("nth") <= k + 1)
    # A copy of the query's own vector has it as point; its other ids still count.
    each = near.join(points.select("point", "ids"), "point").select("query", "score", F.explode("ids").alias("id")).filter("query <> id")
    ranked = each.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), "rank", F.col("id").alias(key), "score")


def _state(forest: Forest) -> tuple:
    return forest.directions, forest.cuts, forest.children, forest.leaf_sizes, forest.roots, forest.trees


def _forest(state: tuple) -> Forest:
    out = Forest.__new__(Forest)
    out.directions, out.cuts, out.children, out.leaf_sizes, out.roots, out.trees = state
    return out
