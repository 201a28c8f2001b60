"""Distances, closeness, betweenness and components by rounds of joins.

Every round is written to the shared folder, so plans stay short and a lost executor costs one round. Hop distances come
from a search from 64 sources at once: a node and a word of 64 bits stand for all sources that reach it in a round.
Weighted distances grow in buckets as wide as the longest edge, and a round writes what it has improved. Betweenness
needs a row a source and node, so sources are dealt to batches of a bounded number of rows, whose tables go after each.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketgraph.operators.graph import with_count
from basketgraph.session import materialize, numbered, scratch

TIE = 1e-12
#: Rows of a batch of betweenness: sources times the nodes and edges that each reaches, as estimated from components.
BATCH_ROWS = 200_000_000


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _dealt(sources: DataFrame, i: int, n: int) -> DataFrame:
    return sources if n == 1 else sources.filter(F.pmod(F.xxhash64("source"), F.lit(n)) == i)


def source_words(nodes: DataFrame, by: list[str] = ()) -> DataFrame:
    """by, source, word, bit: each node has a bit of its own in a word of 64."""
    rows = numbered(nodes.select(*by, F.col("node").alias("source")), [F.col(c) for c in (*by, "source")], "nth")
    return rows.select(*by, "source", F.floor(F.col("nth") / 64).alias("word"), (F.col("nth") % 64).cast("int").alias("bit"))


def hop_levels(words: DataFrame, adj: DataFrame, by: list[str] = ()) -> DataFrame:
    """by, node, word, bits, d: the sources (bits of a word) that are d hops from a node.

    A node that is reached in d + 1 hops from a source lies d - 1, d or d + 1 hops away, so of all rows before only those of
    two rounds are read, and a row is written once.
    """
    keys = [*by, "node", "word"]
    step = adj.select(*by, F.col("src").alias("node"), "dst")
    one = F.expr("shiftleft(1L, bit)")
    front = materialize(words.select(*by, F.col("source").alias("node"), "word", one.alias("bits"), F.lit(0).alias("d")), "level")
    levels, none = [front], F.lit(0).cast("long")
    while not front.isEmpty():
        tried = front.join(step, [*by, "node"]).select(*by, F.col("dst").alias("node"), "word", F.col("bits").alias("new"), none.alias("known"))
        before = _union(levels[-2:]).select(*keys, none.alias("new"), F.col("bits").alias("known"))
        met = tried.unionByName(before).groupBy(*keys).agg(F.bit_or("new").alias("new"), F.bit_or("known").alias("known"))
        bits = F.col("new").bitwiseAND(F.bitwise_not("known"))
        front = materialize(met.select(*keys, bits.alias("bits"), F.lit(len(levels)).alias("d")).filter("bits <> 0"), "level")
        levels.append(front)
    return _union(levels)


def hop_distances(nodes: DataFrame, adj: DataFrame, by: list[str] = ()) -> DataFrame:
    """by, source, node, d: hops from each source to each node that it reaches, itself included.

    Bits become rows only here: a row of a word meets the list of its 64 sources.
    """
    words = materialize(source_words(nodes, by), "words")
    of_word = words.groupBy(*by, "word").agg(F.collect_list(F.struct("bit", "source")).alias("sources"))  # 64 at most
    found = hop_levels(words, adj, by).join(of_word, [*by, "word"])
    here = F.filter("sources", lambda x: F.getbit("bits", x["bit"]) == 1)
    return found.select(*by, F.explode(F.transform(here, lambda x: x["source"])).alias("source"), "node", "d")


def hop_sums(nodes: DataFrame, adj: DataFrame, by: list[str] = ()) -> DataFrame:
    """by, node, total (of the distances to all that it reaches), r (how many these are, itself included), from bit counts."""
    words = materialize(source_words(nodes, by), "words")
    n = F.bit_count("bits").cast("long")
    return hop_levels(words, adj, by).groupBy(*by, "node").agg(F.sum(F.col("d") * n).alias("total"), F.sum(n).alias("r"))


def _distances(sources: DataFrame, step: DataFrame, width: float, by: list[str], written: list[int] | None) -> DataFrame:
    """Weighted distances from sources (by, source), by buckets of `width`, the longest edge.

    An edge leads at most one bucket on, and back by one at most, so a round reads three buckets and writes only the rows
    that it has improved; a bucket ends when none of its rows has been. A row's distance is the least that was written.
    """
    keys = [*by, "source", "node"]
    bucket = F.floor(F.col("d") / width)
    start = materialize(sources.select(*keys[:-1], F.col("source").alias("node"), F.lit(0.0).alias("d")), "dist")
    logs: dict[int, list[DataFrame]] = {0: [start]}
    active, k = start, 0
    while True:
        tried = active.join(step, [*by, "node"]).select(*keys[:-1], F.col("dst").alias("node"), (F.col("d") + F.col("length")).alias("new"))
        known = _union([x for i in (k - 1, k, k + 1) for x in logs.get(i, [])]).select(*keys, F.col("d").alias("old"))
        met = tried.unionByName(known, allowMissingColumns=True).groupBy(*keys).agg(F.min("new").alias("d"), F.min("old").alias("old"))
        better = materialize(met.filter("d IS NOT NULL AND (old IS NULL OR d < old)").select(*keys, "d"), "dist")
        sizes = {r.at: r["count"] for r in better.groupBy(bucket.alias("at")).count().collect()}  # two buckets
        if written is not None:
            written.append(sum(sizes.values()))
        for i in sizes:
            logs.setdefault(int(i), []).append(better.filter(bucket == i))
        if k in sizes:
            active = logs[k][-1]
            continue
        k += 1
        if k not in logs:
            return _union([x for i in logs for x in logs[i]]).groupBy(*keys).agg(F.min("d").alias("d"))
        done = _union(logs[k - 1]).select(*keys).distinct()  # rows that went down into the bucket before
        active = _union(logs[k]).groupBy(*keys).agg(F.min("d").alias("d")).join(done, keys, "left_anti")


def _steps(adj: DataFrame, by: list[str]) -> tuple[DataFrame, float]:
    """by, node, dst, length (1 / weight) of all edges, and the longest."""
    step = adj.select(*by, F.col("src").alias("node"), "dst", (1 / F.col("w")).alias("length"))
    return step, step.agg(F.max("length")).first()[0] or 1.0


def weighted_distances(nodes: DataFrame, adj: DataFrame, by: list[str] = (), written: list[int] | None = None) -> DataFrame:
    """by, source, node, d with edges of length 1 / weight. `written` gets the number of rows of each round."""
    step, width = _steps(adj, by)
    return _distances(nodes.select(*by, F.col("node").alias("source")), step, width, list(by), written)


def closeness(distances: DataFrame, nodes: DataFrame, by: list[str] = ()) -> DataFrame:
    """by, node, closeness: (r - 1) / sum d * (r - 1) / (n - 1) with r reachable nodes, of n in all."""
    sums = distances.groupBy(*by, F.col("source").alias("node")).agg(F.sum("d").alias("total"), F.count(F.lit(1)).alias("r"))
    return closeness_of_sums(sums, nodes, by)


def closeness_of_sums(sums: DataFrame, nodes: DataFrame, by: list[str] = ()) -> DataFrame:
    """closeness() from by, node, total, r."""
    rows = with_count(nodes.select(*by, "node").join(sums, [*by, "node"], "left"), nodes, by)
    value = (F.col("r") - 1) / F.col("total") * (F.col("r") - 1) / (F.col("n") - 1)
    return rows.select(*by, "node", F.when(F.col("total") > 0, value).otherwise(0.0).alias("closeness"))


def estimated_closeness(nodes: DataFrame, adj: DataFrame, bits: int = 12) -> DataFrame:
    """node, closeness from sketches of 2 ** bits registers that count what a node reaches in each number of hops.

    A round merges the sketches of neighbours, so its rows are nodes, not pairs. The counts' relative standard error is
    about 1.04 / sqrt(2 ** bits), 1.6 % by default; small counts are nearly exact. Ends when no count grows.
    """
    step = adj.select(F.col("src").alias("node"), "dst")
    now = nodes.groupBy("node").agg(F.hll_sketch_agg(F.col("node").cast("string"), bits).alias("sketch"))
    now = materialize(now.select("node", "sketch", F.lit(1).cast("long").alias("r"), F.lit(0).cast("long").alias("total"), F.lit(True).alias("grown")), "sketches")
    hops = 0
    while not now.filter("grown").isEmpty():
        hops += 1
        own = now.select("node", "sketch", "r", "total")
        moved = now.filter("grown").join(step, "node").select(F.col("dst").alias("node"), "sketch")
        both = own.unionByName(moved, allowMissingColumns=True).groupBy("node").agg(F.hll_union_agg("sketch").alias("sketch"), F.max("r").alias("r"), F.max("total").alias("total"))
        count = F.greatest("r", F.hll_sketch_estimate("sketch"))
        both = both.withColumn("count", count)
        total = F.col("total") + hops * (F.col("count") - F.col("r"))
        now = materialize(both.select("node", "sketch", total.alias("total"), (F.col("count") > F.col("r")).alias("grown"), F.col("count").alias("r")), "sketches")
    return closeness_of_sums(now.select("node", "total", "r"), nodes)


def betweenness(distances: DataFrame, nodes: DataFrame, adj: DataFrame, by: list[str] = (), weighted: bool = False) -> DataFrame:
    """by, node, betweenness (ends left out, undirected, scaled to pairs) from hop or weighted distances."""
    return _scaled(dependencies(distances, adj, by, weighted), nodes, by)


def _scaled(total: DataFrame, nodes: DataFrame, by: list[str]) -> DataFrame:
    pairs = (F.col("n") - 1) * (F.col("n") - 2) / 2
    scaled = F.coalesce("total", F.lit(0.0)) * 0.5 / F.when(pairs > 0, pairs)
    rows = nodes.select(*by, "node").join(total, [*by, "node"], "left")
    return with_count(rows, nodes, by).select(*by, "node", F.coalesce(scaled, F.lit(0.0)).alias("betweenness"))


def dependencies(distances: DataFrame, adj: DataFrame, by: list[str] = (), weighted: bool = False) -> DataFrame:
    """by, node, total: over all sources, and all nodes that each reaches, the share of shortest paths that pass the node.

    Edges on shortest paths make a graph without cycles for each source. Path counts flow down it, dependencies back
    up: with h(u) the sum over paths down from u of 1 / sigma at their ends, the dependency on u is sigma(u) h(u).
    """
    keys = [*by, "source"]
    length = 1 / F.col("w") if weighted else F.lit(1.0)
    here, there = distances.select(*keys, F.col("node").alias("u"), F.col("d").alias("du")), distances.select(*keys, F.col("node").alias("v"), F.col("d").alias("dv"))
    steps = adj.select(*by, F.col("src").alias("u"), F.col("dst").alias("v"), length.alias("length"))
    down = materialize(here.join(steps, [*by, "u"]).join(there, [*keys, "v"]).filter(F.abs(F.col("du") + F.col("length") - F.col("dv")) <= TIE).select(*keys, "u", "v"), "down")
    front = materialize(distances.filter("source = node").select(*keys, F.col("node").alias("u"), F.lit(1.0).alias("x")), "flow")
    counts = [front]
    while not front.isEmpty():
        front = materialize(front.join(down, [*keys, "u"]).groupBy(*keys, F.col("v").alias("u")).agg(F.sum("x").alias("x")), "flow")
        counts.append(front)
    sigma = materialize(_union(counts).groupBy(*keys, "u").agg(F.sum("x").alias("sigma")), "sigma")
    front = sigma.select(*keys, "u", (1 / F.col("sigma")).alias("x"))
    back = []
    while True:
        front = materialize(front.withColumnRenamed("u", "v").join(down, [*keys, "v"]).groupBy(*keys, "u").agg(F.sum("x").alias("x")), "flow")
        back.append(front)
        if front.isEmpty():
            break
    passed = _union(back).groupBy(*keys, "u").agg(F.sum("x").alias("h")).filter("u <> source").join(sigma, [*keys, "u"])
    return passed.groupBy(*by, F.col("u").alias("node")).agg(F.sum(F.col("sigma") * F.col("h")).alias("total"))


def _batches(nodes: DataFrame, edges: DataFrame, by: list[str], batch_rows: int) -> int:
    """As many batches of sources as keep the nodes and edges that a batch's sources reach below a number of rows."""
    parts = connected_components(nodes, edges, by)
    n = parts.groupBy(*by, "component").agg(F.count(F.lit(1)).alias("n"))
    ends = parts.withColumnRenamed("node", "source")
    m = edges.select(*by, "source").join(ends, [*by, "source"]).groupBy(*by, "component").agg((2 * F.count(F.lit(1))).alias("m"))
    reached = F.col("n").cast("double") * (F.col("n") + F.coalesce("m", F.lit(0)))
    rows = n.join(m, [*by, "component"], "left").agg(F.sum(reached)).first()[0] or 0
    return max(1, math.ceil(rows / batch_rows))


def batched_betweenness(nodes: DataFrame, edges: DataFrame, adj: DataFrame, by: list[str] = (), weighted: bool = False, batch_rows: int = BATCH_ROWS, sources: DataFrame | None = None, share: Column | float = 1.0) -> DataFrame:
    """betweenness() of all nodes, from sources in batches whose tables are removed before the next one begins.

    sources (by, source): from these only, which are `share` of all (see sampled_betweenness).
    """
    by = list(by)
    step, width = _steps(adj, by)
    every = nodes.select(*by, F.col("node").alias("source")) if sources is None else sources
    n, spark, sums = _batches(nodes, edges, by, batch_rows), nodes.sparkSession, []
    for i in range(n):
        with scratch(spark) as keep:
            own = _dealt(every, i, n)
            length = step if weighted else step.withColumn("length", F.lit(1.0))
            far = materialize(_distances(own, length, width if weighted else 1.0, by, None), "far")
            sums.append(keep(dependencies(far, adj, by, weighted), "dependencies"))
    total = _union(sums).groupBy(*by, "node").agg(F.sum("total").alias("total"))
    return _scaled(total.withColumn("total", F.col("total") / share), nodes, by)


def sampled_betweenness(nodes: DataFrame, edges: DataFrame, adj: DataFrame, error: float = 0.05, doubt: float = 0.1, weighted: bool = False, seed: int = 1, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """betweenness() estimated from the pairs of a hashed sample of sources; no value is off by more than `error`, but for a chance of `doubt`.

    What a source adds to a node is between 0 and n - 2, so by Hoeffding's bound, for all nodes together, a sample of
    ln(2 n / doubt) / (2 error squared) sources will do: a number that hardly grows with the graph.
    """
    n = nodes.count()
    wanted = math.ceil(math.log(2 * max(n, 1) / doubt) / (2 * error**2))
    sources = nodes.select(F.col("node").alias("source"))
    if wanted < n:
        sources = materialize(sources.orderBy(F.xxhash64(F.lit(seed), "source"), "source").limit(wanted), "sample")
    return batched_betweenness(nodes, edges, adj, (), weighted, batch_rows, sources, min(1.0, wanted / max(n, 1)))


def connected_components(nodes: DataFrame, edges: DataFrame, by: list[str] = ()) -> DataFrame:
    """by, node, component (its smallest node): large and small stars in turn until nothing changes."""
    now = materialize(edges.filter("source <> target").select(*by, F.greatest("source", "target").alias("a"), F.least("source", "target").alias("b")).distinct(), "stars")
    before = None
    while True:
        both = now.unionByName(now.select(*by, F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(*by, "a").agg(F.min("b").alias("m")).select(*by, "a", F.least("a", "m").alias("m"))
        large = both.join(low, [*by, "a"]).filter("b > a").select(*by, F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy(*by, "a").agg(F.min("b").alias("m"))
        small = large.join(low, [*by, "a"]).select(*by, F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        now = materialize(small.filter("a <> b").distinct(), "stars")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*by, "a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    found = now.select(*by, F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.select(*by, "node").join(found, [*by, "node"], "left").withColumn("component", F.coalesce("component", "node"))


def component_sizes(components: DataFrame, by: list[str] = ()) -> DataFrame:
    return components.groupBy(*by, "component").agg(F.count(F.lit(1)).alias("size"))


def largest_component(components: DataFrame) -> DataFrame:
    """node: the members of the largest component (of equal ones, that of the smallest name)."""
    largest = component_sizes(components).orderBy(F.desc("size"), "component").limit(1).select("component")
    return components.join(F.broadcast(largest), "component", "left_semi").select("node")


def path_length_of_sums(components: DataFrame, sums: DataFrame) -> DataFrame:
    """average_path_length() from node, total, r."""
    own = sums.join(largest_component(components), "node", "left_semi").agg(F.sum("total").alias("total"), F.sum(F.col("r") - 1).alias("pairs"))
    return own.select(F.when(F.col("pairs") > 0, F.col("total") / F.col("pairs")).otherwise(0.0).alias("average_path_length"))


def average_path_length(components: DataFrame, distances: DataFrame) -> DataFrame:
    """One row: mean distance of ordered pairs in the largest component (of equal ones, that of the smallest name)."""
    members = largest_component(components).withColumnRenamed("node", "source")
    return distances.join(members, "source", "left_semi").filter("d > 0").agg(F.coalesce(F.avg("d"), F.lit(0.0)).alias("average_path_length"))
