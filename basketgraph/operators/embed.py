"""Node embeddings: skip-gram with negative sampling on walks, trained in blocks of centers and contexts.

Nodes are dealt to B blocks by their hash. A step is a place of a walk with those of its contexts that lie in one
block, so a step belongs to a part, a block of centers and a block of contexts. An epoch has B turns; in turn t block i
of the centers meets block i + t of the contexts, so the B parts of a turn share no vector and are trained side by side.
After B turns each pair of blocks has met, and every step was taken once. Vectors are written after each turn. Few nodes
are one block, however many places the walks have: its steps are dealt to shards, and negatives come from all nodes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from basketgraph.functions.vectors import cosine
from basketgraph.operators import graph, walks
from basketgraph.session import materialize, new_path, remove, uniform

#: Nodes of a block, and places of walks in a part, on average; a part of SLACK times as many is dealt to several tasks.
BLOCK_NODES, PART_STEPS, SLACK = 200_000, 100_000, 4
#: Nodes that a block has at least, on average, unless the number of blocks is given.
LEAST_NODES = 1000
#: Values of the contexts' vectors up to which a step takes all of them, and of the tables for a run of such steps.
DENSE, DENSE_RUN = 4096, 1 << 20
VECTORS = "side int, block int, node string, n long, vector array<double>"


def train_steps(center: np.ndarray, ends: np.ndarray, context: np.ndarray, inner: np.ndarray, outer: np.ndarray, weights: np.ndarray, negatives: int, rate: float, rng: np.random.Generator) -> None:
    """Takes steps in place: step k moves center[k] with the contexts that end before ends[k]; a negative is never the context itself.

    A step is a place of a walk with its contexts: larger ones add up gradients of nodes that a walk visits again and
    again, and diverge on small graphs.
    """
    chance, sizes = np.cumsum(weights / weights.sum()), np.diff(ends, prepend=0)
    others = np.minimum(np.searchsorted(chance, rng.random((len(context), negatives))), len(weights) - 1)
    if outer.size <= DENSE:
        _dense_steps(center, sizes, context, others, inner, outer, rate)
        return
    # A target that a step has several times is one, with how often it is a context and how often it is met.
    target = np.column_stack([context, others]) + (np.repeat(np.arange(len(center)), sizes) * len(weights))[:, None]
    met = np.ones(target.shape)
    met[:, 1:] = others != context[:, None]
    target, of = np.unique(target, return_inverse=True)
    step, target = np.divmod(target, len(weights))
    hits = np.bincount(of.reshape(met.shape)[:, 0], minlength=len(target)) * rate
    met = np.bincount(of.ravel(), met.ravel(), len(target)) * rate / 2
    hits -= met  # of the sigmoid as (1 + tanh(z / 2)) / 2
    ends = np.searchsorted(step, np.arange(1, len(center) + 1)).tolist()
    for c, s, e in zip(center.tolist(), [0, *ends], ends):
        own = target[s:e]
        x, y = inner[c], outer[own]
        g = hits[s:e] - met[s:e] * np.tanh(y @ x / 2)
        outer[own] = y + g[:, None] * x
        inner[c] = x + g @ y


def _dense_steps(center: np.ndarray, sizes: np.ndarray, context: np.ndarray, others: np.ndarray, inner: np.ndarray, outer: np.ndarray, rate: float) -> None:
    """The same steps with a gradient for each context vector, most of them zero: for few nodes, without looking any up."""
    n, size = outer.shape
    ends, run, half = np.cumsum(sizes), max(1, DENSE_RUN // n), math.sqrt(0.5)
    ours, theirs = inner * half, np.ascontiguousarray(outer.T) * half  # so that their product is z / 2, and gradients go from each to the other
    own, columns = list(ours), [x[:, None] for x in ours]
    dot, tanh, multiply, subtract, add = np.dot, np.tanh, np.multiply, np.subtract, np.add
    g, more, product = np.empty(n), np.empty(size), np.empty((size, n))
    line = g[None, :]
    for s in range(0, len(center), run):
        e = min(s + run, len(center))
        rows = slice(ends[s] - sizes[s], ends[e - 1])
        step = np.repeat(np.arange(e - s), sizes[s:e]) * n
        near, far = context[rows], others[rows]
        hits = np.bincount(step + near, minlength=(e - s) * n)
        met = (hits + np.bincount((step[:, None] + far)[far != near[:, None]], minlength=(e - s) * n)) * (rate / 2)
        hits = hits * rate - met
        for c, h, m in zip(center[s:e].tolist(), hits.reshape(-1, n), met.reshape(-1, n)):
            x = own[c]
            dot(x, theirs, g)
            tanh(g, g)
            multiply(g, m, g)
            subtract(h, g, g)
            dot(theirs, g, more)
            dot(columns[c], line, product)
            add(theirs, product, theirs)
            add(x, more, x)
    inner[:], outer[:] = ours / half, theirs.T / half


class Part:
    """A part while its rows come: the vectors of its centers (side 0) and contexts (side 1), then its steps (side 2)."""

    def __init__(self, rng: np.random.Generator, negatives: int, rate: float):
        self.rng, self.negatives, self.rate = rng, negatives, rate
        self.rows: tuple[list, list] = ([], [])
        self.index = self.tables = None

    def take(self, side: int, rows: pa.RecordBatch) -> None:
        if side < 2:
            self.rows[side].append(rows)
            return
        if self.index is None:
            self.index = [pa.concat_arrays([b.column("node") for b in own]) for own in self.rows]
            self.tables = [np.concatenate([b.column("vector").flatten().to_numpy().reshape(b.num_rows, -1) for b in own]) for own in self.rows]
            self.weights = np.concatenate([b.column("n").to_numpy() for b in self.rows[1]]).astype(float) ** 0.75
        at, to = self.index
        near = rows.column("contexts")
        center = pc.index_in(rows.column("node"), at).to_numpy().astype(np.int64)
        context = pc.index_in(near.flatten(), to).to_numpy().astype(np.int64)
        train_steps(center, np.cumsum(near.value_lengths().to_numpy()), context, *self.tables, self.weights, self.negatives, self.rate, self.rng)

    def result(self):
        for side, own in enumerate(self.rows):
            start = 0
            for b in own:
                vector = b.column("vector")
                if self.tables is not None:
                    vector = pa.FixedSizeListArray.from_arrays(self.tables[side][start : start + b.num_rows].ravel(), self.tables[side].shape[1]).cast(pa.list_(pa.float64()))
                start += b.num_rows
                yield pa.RecordBatch.from_arrays([b.column("side"), b.column("block"), b.column("node"), b.column("n"), vector], ["side", "block", "node", "n", "vector"])


def _trainer(epoch: int, turn: int, seed: int, negatives: int, rate: float):
    """For rows in order of part, shard and side: the vectors after the steps. Steps are taken as they come, so a task holds two blocks."""

    def run(batches):
        key = held = None
        for b in batches:
            marks = np.column_stack([b.column(c).to_numpy() for c in ("part", "shard", "side")])
            starts = np.flatnonzero(np.r_[True, (marks[1:] != marks[:-1]).any(1)][: len(marks)]).tolist()
            for s, e in zip(starts, [*starts[1:], len(marks)]):
                part, shard, side = marks[s].tolist()
                if key != (part, shard):
                    if held:
                        yield from held.result()
                    key, held = (part, shard), Part(np.random.default_rng([seed, epoch, turn, part, shard]), negatives, rate)
                held.take(side, b.slice(s, e - s))
        if held:
            yield from held.result()

    return run


def _block(node, blocks: int):
    return F.pmod(F.xxhash64(node), F.lit(blocks)).cast("int")


def steps_of(paths: DataFrame, window: int, blocks: int) -> DataFrame:
    """turn, part (the center's block), start, nth, place, node (the center) and its contexts of one block."""
    near = F.filter(F.sequence(F.greatest(F.lit(0), F.col("place") - window), F.least(F.size("walk") - 1, F.col("place") + window)), lambda i: i != F.col("place"))
    places = paths.select("start", "nth", "walk", F.posexplode("walk").alias("place", "node"))
    places = places.select("start", "nth", "place", "node", F.transform(near, lambda i: F.get("walk", i)).alias("near"))
    dealt = places.select("*", F.explode(F.array_distinct(F.transform("near", lambda x: _block(x, blocks)))).alias("to"))
    own = dealt.select("*", _block("node", blocks).alias("part"), F.filter("near", lambda x: _block(x, blocks) == F.col("to")).alias("contexts"))
    return own.select(F.pmod(F.col("to") - F.col("part"), F.lit(blocks)).alias("turn"), "part", "start", "nth", "place", "node", "contexts")


def train_embeddings(paths: DataFrame, dimensions: int, window: int = 3, negatives: int = 3, epochs: int = 4, rate: float = 0.035, blocks: int | None = None, seed: int = 42) -> DataFrame:
    """node, vector from walks (start, nth, walk).

    Without `blocks` there are as many as keep a block's nodes and a part's steps at a bound, but no more than leave
    LEAST_NODES to each, so a task holds two blocks of vectors whatever the graph. Negatives come from the part's contexts by their counts to the power 0.75.
    Walks come in an order hashed anew each epoch. A part of far more steps than others, as of a node that a third of all
    walks pass, is dealt to shards that start alike and whose vectors are averaged. Empty walks give an empty table;
    a node whose walks have no other place keeps its first vector.
    """
    spark = paths.sparkSession
    dealt = materialize(paths.select("start", "nth", "walk"), "walks")
    counts = materialize(dealt.select(F.explode("walk").alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n")), "counts")
    nodes, places = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    wanted = max(math.ceil(math.sqrt(places / PART_STEPS)), math.ceil(nodes / BLOCK_NODES))
    blocks = max(1, min(blocks, nodes) if blocks else min(wanted, nodes // LEAST_NODES))
    table = new_path(spark, "steps")
    steps = steps_of(dealt, window, blocks)
    # A turn is read by its folder; the parts of a file are 64 at most.
    steps.repartition("turn", F.floor(F.col("part") / 64)).write.partitionBy("turn").parquet(table)
    steps = spark.read.schema(steps.schema).parquet(table)
    sizes = steps.groupBy("turn", "part").agg(F.ceil(F.count(F.lit(1)) / (SLACK * PART_STEPS)).cast("int").alias("shards"))
    # The first shard of a part has the task of the part, the others of a turn have those that follow.
    more = F.sum(F.col("shards") - 1).over(W.partitionBy("turn").orderBy("part"))
    hot = materialize(sizes.filter("shards > 1").withColumn("last", (more + blocks).cast("int")), "hot")
    tasks = hot.agg(F.max("last")).first()[0]
    several = tasks is not None
    start = F.transform(F.sequence(F.lit(1), F.lit(dimensions)), lambda i: (uniform(seed, F.col("node"), i) - 0.5) / dimensions)
    first = counts.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("side"), _block("node", blocks).alias("block"), "node", "n")
    vectors = first.withColumn("vector", F.when(F.col("side") == 0, start).otherwise(F.array_repeat(F.lit(0.0), dimensions)))
    before = None
    for e in range(epochs):
        for t in range(blocks):
            part = F.when(F.col("side") == 0, F.col("block")).otherwise(F.pmod(F.col("block") - t, F.lit(blocks)))
            known = vectors.select(part.alias("part"), "side", "block", "node", "n", "vector")
            order = F.xxhash64(F.lit(seed + e), "start", "nth")
            taken = steps.filter(F.col("turn") == t).select("part", F.lit(2).alias("side"), "node", order.alias("walk"), "place", "contexts", F.xxhash64("start", "nth").alias("dealt"))
            if several:
                own = F.broadcast(hot.filter(F.col("turn") == t).select("part", "shards", "last"))  # rows of one turn's parts, fewer than blocks
                known = known.join(own, "part", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.coalesce("shards", F.lit(1)) - 1)))
                taken = taken.join(own, "part", "left").withColumn("shard", F.pmod("dealt", F.coalesce("shards", F.lit(1))).cast("int"))
                task = F.when(F.col("shard") == 0, F.col("part")).otherwise(F.col("last") - F.col("shard"))
                known, taken = (x.withColumn("task", task).drop("shards", "last") for x in (known, taken))
            else:
                known, taken = (x.withColumns({"shard": F.lit(0), "task": F.col("part")}) for x in (known, taken))
            rows = known.unionByName(taken.drop("dealt"), allowMissingColumns=True)
            rows = rows.repartitionById(tasks or blocks, "task").drop("task").sortWithinPartitions("part", "shard", "side", "walk", "place", "node")
            done = rows.mapInArrow(_trainer(e, t, seed, negatives, rate), VECTORS)
            if several:
                mean = F.array(*[F.avg(F.get("vector", F.lit(i))) for i in range(dimensions)])
                done = done.groupBy("side", "block", "node", "n").agg(mean.alias("vector"))
            path = new_path(spark, "vectors")
            done.write.parquet(path)
            vectors = spark.read.schema(VECTORS).parquet(path)
            if before:
                remove(spark, [before])
            before = path
    remove(spark, [table])
    return vectors.filter("side = 0").select("node", "vector")


def node2vec(nodes: DataFrame, edges: DataFrame, dimensions: int, weighted: bool = True, num_walks: int = 12, length: int = 14, p: float = 1.0, q: float = 0.8, seed: int = 42, **training) -> DataFrame:
    """node, vector of all nodes that have an edge."""
    adj = graph.adjacency(edges, weighted=weighted)
    paths = walks.random_walks(graph.without_isolated(nodes, edges), adj, num_walks, length, p, q, seed)
    return train_embeddings(paths, dimensions, seed=seed, **training)


def embedding_table(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """Attributes of nodes beside their vectors, of those that have one."""
    return nodes.join(vectors, "node")


def similar_to(vectors: DataFrame, target, k: int, key: str = "node", vector: str = "vector") -> DataFrame:
    """The k vectors of most cosine similarity to that of one key. An unknown key raises."""
    found = vectors.filter(F.col(key) == target).select(F.col(vector).cast("array<double>")).first()
    if found is None:
        raise KeyError(target)
    mine = F.array(*[F.lit(float(x)) for x in found[0]])
    rows = vectors.filter(F.col(key) != target).select(F.col(key), F.round(cosine(F.col(vector).cast("array<double>"), mine), 6).alias("similarity"))
    return rows.orderBy(F.desc("similarity"), key).limit(k)


def minmax_scale(rows: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Columns stretched from their extent to the ranges (the second end may be the smaller); a constant one goes to the middle."""
    extent = rows.agg(*[f(c).alias(f"{c}_{n}") for c in ranges for f, n in ((F.min, "low"), (F.max, "high"))])
    out = rows.crossJoin(F.broadcast(extent))  # one row
    for c, (a, b) in ranges.items():
        low, high = F.col(f"{c}_low"), F.col(f"{c}_high")
        flat = F.abs(high - low) <= 1e-9 * F.greatest(F.abs(low), F.abs(high))
        out = out.withColumn(c, F.when(flat, (a + b) / 2).otherwise(a + (F.col(c) - low) / (high - low) * (b - a)))
    return out.select(rows.columns)
