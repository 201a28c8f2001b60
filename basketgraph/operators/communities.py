"""Communities by modularity with a resolution, after Leiden: nodes move in parts, one a task. `by` splits graphs, e.g. settings.

A task has the links of the nodes of its part, added up by community where they lead out of it, and moves these nodes one
after the other against what all others were in the last round; Spark joins, deals, merges and scores. A node's links
are held by one task. A graph of no more than WHOLE_NODES nodes and WHOLE_LINKS links, which is counted first, such as what a
large one has been merged to, is one part with all its levels: its task has numbers only, in arrays and two lists a node.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from basketgraph.operators.graph import ranked
from basketgraph.operators.traverse import connected_components
from basketgraph.session import materialize, numbered, scratch

#: Nodes of a part, nodes and links (each way) of a graph that one task may hold whole, and the least gain that counts.
PART_NODES, WHOLE_NODES, WHOLE_LINKS, GAIN = 20_000, 250_000, 2_000_000, 1e-9
#: Links that are looked at together for better places.
RUN_LINKS = 1 << 18
#: Of each node its neighbours and the weights of the links to them.
Near = list[tuple[list[int], list[float]]]


def modularity(edges: DataFrame, members: DataFrame, resolution: float = 1.0, weighted: bool = True, by: list[str] = (), digits: int | None = 6) -> DataFrame:
    """by, modularity: sum over communities of in / 2m - resolution (total / 2m) squared. members: node, community."""
    w = F.col("weight").cast("double") if weighted else F.lit(1.0)
    e = edges.select(*by, "source", "target", w.alias("w"))
    ends = members.select(*by, "node", "community")
    a = ends.withColumnsRenamed({"node": "source", "community": "ca"})
    b = ends.withColumnsRenamed({"node": "target", "community": "cb"})
    inside = e.join(a, [*by, "source"]).join(b, [*by, "target"]).filter("ca = cb").groupBy(*by, F.col("ca").alias("community")).agg(F.sum(2 * F.col("w")).alias("inside"))
    both = e.select(*by, F.explode(F.array("source", "target")).alias("node"), "w")
    total = both.join(ends, [*by, "node"]).groupBy(*by, "community").agg(F.sum("w").alias("total"))
    rows = total.join(inside, [*by, "community"], "left").fillna(0.0, ["inside"])
    two_m = e.groupBy(*by).agg((2 * F.sum("w")).alias("two_m"))
    rows = rows.join(two_m, list(by)) if by else rows.crossJoin(F.broadcast(two_m))  # one row
    gamma = F.col("resolution") if "resolution" in by else F.lit(resolution)
    value = F.sum(F.col("inside") / F.col("two_m") - gamma * F.pow(F.col("total") / F.col("two_m"), F.lit(2)))
    return rows.groupBy(*by).agg((F.round(value, digits) if digits is not None else value).alias("modularity"))


def settle(order: list[int], community: list, degree: np.ndarray, near: Near, far: list[dict], totals: dict, scale: float) -> None:
    """Moves nodes to the best community of their neighbours, in place, until none has a better one.

    near: neighbours among these nodes with weights; far: weights to communities of nodes that stay; totals: degrees of
    communities summed; scale: resolution / sum of all degrees. A node is looked at again only when a neighbour has moved.
    """
    queue, waiting = deque(order), set(order)
    while queue:
        i = queue.popleft()
        waiting.discard(i)
        now, k, weights = community[i], degree[i], dict(far[i])
        for j, w in zip(*near[i]):
            weights[community[j]] = weights.get(community[j], 0.0) + w
        totals[now] -= k
        best, most = now, max(weights.get(now, 0.0) - scale * k * totals[now], 0.0)
        for c in sorted(weights):
            gain = weights[c] - scale * k * totals[c]
            if c != now and gain > most + GAIN:
                best, most = c, gain
        totals[best] += k
        if best != now:
            community[i] = best
            for j in near[i][0]:
                if community[j] != best and j not in waiting:
                    waiting.add(j)
                    queue.append(j)


def refine(order: list[int], outer: list, degree: np.ndarray, near: Near, scale: float) -> list[int]:
    """Parts of communities: each node that is alone joins the best part that a neighbour of its community is in, if any gains."""
    part, size, totals = list(range(len(order))), [1] * len(order), degree.tolist()
    for i in order:
        if size[part[i]] > 1:
            continue
        weights: dict[int, float] = {}
        for j, w in zip(*near[i]):
            if outer[j] == outer[i] and j != i:
                weights[part[j]] = weights.get(part[j], 0.0) + w
        gains = [(weights[c] - scale * degree[i] * totals[c], -c) for c in weights]
        if gains and max(gains)[0] > GAIN:
            to = -max(gains)[1]
            size[part[i]], part[i] = 0, to
            size[to] += 1
            totals[to] += degree[i]
    return part


class Links:
    """Links of nodes 0 to n - 1 in order of both ends, each way, and the sum of each node's, which has what was merged into it."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, w: np.ndarray, degree: np.ndarray):
        self.src, self.dst, self.w, self.degree = src, dst, w, degree

    def near(self) -> Near:
        ends = np.searchsorted(self.src, np.arange(len(self.degree) + 1)).tolist()
        to, w = np.array(range(len(self.degree)), object)[self.dst].tolist(), self.w.tolist()  # a number is one object
        return [(to[s:e], w[s:e]) for s, e in zip(ends, ends[1:])]

    def restless(self, community: np.ndarray, scale: float) -> np.ndarray:
        """Whether each node has a better community among those of its neighbours."""
        n, own, k = len(self.degree), community, self.degree
        totals = np.bincount(own, k, n)
        stay, best = np.zeros(n), np.full(n, -np.inf)
        starts = np.arange(0, len(self.src), RUN_LINKS)
        edges = [*np.unique(np.searchsorted(self.src, self.src[starts])).tolist(), len(self.src)]  # a node's links are together
        for s, e in zip(edges, edges[1:]):
            pair, of = np.unique(self.src[s:e] * np.int64(n) + own[self.dst[s:e]], return_inverse=True)
            node, there = np.divmod(pair, n)
            gain = np.bincount(of, self.w[s:e], len(pair)) - scale * k[node] * (totals[there] - np.where(there == own[node], k[node], 0.0))
            at = there == own[node]
            stay[node[at]] = np.maximum(gain[at], 0.0)
            np.maximum.at(best, node[~at], gain[~at])
        return best > stay + GAIN

    def merged(self, code: np.ndarray, n: int) -> Links:
        apart = code[self.src] != code[self.dst]
        pair, of = np.unique(code[self.src[apart]] * np.int64(n) + code[self.dst[apart]], return_inverse=True)
        return Links(*(x.astype(np.int32) for x in np.divmod(pair, n)), np.bincount(of, self.w[apart], len(pair)), np.bincount(code, self.degree, n))


def solve(order: list[int], links: Links, community: list[int], scale: float) -> list[int]:
    """Communities (numbers below that of nodes) of a whole graph that starts from some: passes over all levels until one moves nothing."""
    leaves, near = links, links.near()
    while True:
        before, place = community, np.arange(len(order))
        nodes, links, at, own = order, leaves, near, list(community)
        while True:
            moving = links.restless(np.array(own), scale)
            if moving.any():
                totals = dict(enumerate(np.bincount(own, links.degree, len(own)).tolist()))
                settle([i for i in nodes if moving[i]], own, links.degree.tolist(), at, [{}] * len(own), totals, scale)
            if links is leaves and own == before:
                return community
            part = refine(nodes, own, links.degree, at, scale)
            merged = {p: i for i, p in enumerate(dict.fromkeys(part[i] for i in nodes))}
            if len(merged) == len(part):
                break
            code = np.array([merged[p] for p in part])
            place = code[place]
            upper = np.zeros(len(merged), np.int64)
            upper[code] = np.unique(own, return_inverse=True)[1]  # no more than parts, each of which lies in one
            links, nodes = links.merged(code, len(merged)), list(range(len(merged)))
            at, own = links.near(), upper.tolist()
        community = connected(np.array(own)[place].tolist(), near)


def connected(community: list, near: Near) -> list:
    """Communities split into their connected parts, each with the first of its nodes as its name."""
    out = [-1] * len(community)
    for first in range(len(community)):
        if out[first] >= 0:
            continue
        out[first], stack = first, [first]
        while stack:
            i = stack.pop()
            for j in near[i][0]:
                if out[j] < 0 and community[j] == community[i]:
                    out[j] = first
                    stack.append(j)
    return out


def _solved(links: DataFrame, members: DataFrame, by: list[str], gamma: Column, seed: int) -> DataFrame:
    """by, node, community of graphs of a bounded size, one a task."""
    starts = members.select(*by, F.col("node").alias("src"), "community", gamma.alias("gamma"), F.xxhash64("node", F.lit(seed)).alias("nth"))
    rows = links.select(*by, "src", "dst", "w").join(starts, [*by, "src"])

    def run(table: pa.Table) -> pa.Table:
        src = table.column("src").combine_chunks().dictionary_encode()
        names = src.dictionary
        rank = np.empty(len(names), np.int32)
        rank[pc.array_sort_indices(names).to_numpy()] = np.arange(len(names))  # numbers in the order of names
        own, to = rank[src.indices.to_numpy()], rank[pc.index_in(table.column("dst"), names).to_numpy()]
        first = np.empty(len(names), np.int64)
        first[own] = np.arange(len(own))
        gamma, w = table.column("gamma")[0].as_py(), table.column("w").to_numpy()
        start = np.unique(table.column("community").take(pa.array(first)).combine_chunks().dictionary_encode().indices.to_numpy(), return_inverse=True)[1].tolist()
        order = np.argsort(table.column("nth").to_numpy()[first], kind="stable").tolist()
        in_order = np.lexsort((to, own))
        in_order = in_order[own[in_order] != to[in_order]]
        graph = Links(own[in_order], to[in_order], w[in_order], np.bincount(own, w, len(names)))
        del src, rank, own, to, first, w, in_order
        found = solve(order, graph, start, gamma / graph.degree.sum())
        names = names.take(pc.array_sort_indices(names))
        same = {c: pa.repeat(table.column(c)[0], len(names)) for c in by}
        return pa.table(same | {"node": names, "community": pa.array(found, pa.int64()).cast(pa.string())})

    return rows.withColumn("part", F.lit(0)).groupBy(*by, "part").applyInArrow(run, _schema(links, by) + "community string")


def _neighbours(table: pa.Table) -> tuple[list[str], np.ndarray, np.ndarray, list[str], Near, list[dict]]:
    """Names, positions by hash, degrees, communities, near and far of the nodes of a table of links."""
    src, dst, w = table.column("src").to_numpy(), table.column("dst").to_numpy(), table.column("w").to_numpy()
    names, first, own = np.unique(src, return_index=True, return_inverse=True)
    place = {n: i for i, n in enumerate(names.tolist())}
    near: list[list] = [[] for _ in names]
    far: list[dict] = [{} for _ in names]
    for i, d, x, c in zip(own.tolist(), dst.tolist(), w.tolist(), table.column("to").to_pylist()):
        j = place.get(d)
        if j is not None and j != i:
            near[i].append((j, x))
        elif j is None:
            far[i][c] = far[i].get(c, 0.0) + x
    near = [([j for j, _ in sorted(x)], [w for _, w in sorted(x)]) for x in near]
    pick = lambda c: table.column(c).take(pa.array(first))
    return names.tolist(), np.argsort(pick("nth").to_numpy(), kind="stable"), pick("deg").to_numpy(), pick("community").to_pylist(), near, far


def _links(links: DataFrame, members: DataFrame, by: list[str], gamma: Column, seed: int, deal: Column) -> DataFrame:
    """Rows for the tasks: a node's links, with its community and degree, the community at the other end and its total."""
    degree = links.groupBy(*by, F.col("src").alias("node")).agg(F.sum("w").alias("deg"))
    info = members.join(degree, [*by, "node"])
    total = info.groupBy(*by, "community").agg(F.sum("deg").alias("total"))
    two_m = links.groupBy(*by).agg(F.sum("w").alias("two_m"))
    info = info.join(total, [*by, "community"])
    info = info.join(two_m, list(by)) if by else info.crossJoin(F.broadcast(two_m))  # one row
    ends = info.select(*by, F.col("node").alias("dst"), F.col("community").alias("to"), F.col("total").alias("to_total"))
    starts = info.select(*by, F.col("node").alias("src"), "community", "deg", "total", (gamma / F.col("two_m")).alias("scale"), F.xxhash64("node", F.lit(seed)).alias("nth"), deal.alias("part"))
    return links.join(ends, [*by, "dst"]).join(starts, [*by, "src"])


def _settled(links: DataFrame, members: DataFrame, by: list[str], gamma: Column, parts: int, seed: int) -> DataFrame:
    """by, node, community, part: all nodes after the moves of their part, the others staying where they are."""
    rows = _links(links, members, by, gamma, seed, F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(parts)))

    def run(table: pa.Table) -> pa.Table:
        names, order, degree, community, near, far = _neighbours(table)
        totals = dict(zip(table.column("to").to_pylist(), table.column("to_total").to_pylist())) | dict(zip(table.column("community").to_pylist(), table.column("total").to_pylist()))
        settle(order.tolist(), community, degree, near, far, totals, table.column("scale")[0].as_py())
        return _named(table, by, names, {"community": pa.array(community, pa.string()), "part": pa.array([table.column("part")[0].as_py()] * len(names), pa.int64())})

    return rows.groupBy(*by, "part").applyInArrow(run, _schema(links, by) + "community string, part long")


def _refined(links: DataFrame, members: DataFrame, by: list[str], gamma: Column, parts: int, seed: int) -> DataFrame:
    """by, node, part (its smallest node), community. Parts lie in one task: a large community's nodes are dealt to several."""
    whole = F.pmod(F.xxhash64("community"), F.lit(parts))
    rows = _links(links, members, by, gamma, seed, whole)
    if parts > 1:  # communities of more nodes than a task should hold are dealt by node
        large = members.groupBy(*by, "community").agg((F.count(F.lit(1)) > PART_NODES).alias("large"))
        dealt = F.when(F.col("large"), F.pmod(F.xxhash64("src", F.lit(seed)), F.lit(parts))).otherwise(F.col("part"))
        rows = rows.join(large, [*by, "community"]).withColumn("part", dealt).drop("large")

    def run(table: pa.Table) -> pa.Table:
        names, order, degree, outer, near, _ = _neighbours(table)
        part = refine(order.tolist(), outer, degree, near, table.column("scale")[0].as_py())
        least: dict[int, str] = {}
        for i, p in enumerate(part):
            least[p] = min(least.get(p, names[i]), names[i])
        return _named(table, by, names, {"part": pa.array([least[p] for p in part], pa.string()), "community": pa.array(outer, pa.string())})

    return rows.groupBy(*by, "part").applyInArrow(run, _schema(links, by) + "part string, community string")


def _schema(links: DataFrame, by: list[str]) -> str:
    return "".join(f"{c} {links.schema[c].dataType.simpleString()}, " for c in by) + "node string, "


def _named(table: pa.Table, by: list[str], names: list[str], columns: dict[str, pa.Array]) -> pa.Table:
    same = {c: table.column(c).take(pa.array([0] * len(names), pa.int64())) for c in by}
    return pa.table(same | {"node": pa.array(names, pa.string())} | columns)


def _local(links: DataFrame, members: DataFrame, by: list[str], gamma: Column, parts: int, seed: int) -> tuple[DataFrame, bool]:
    """Members after moves until no node has a better community, and whether any has moved.

    One part is settled by its task. Of several, whose nodes move at once, those moves count that raise the score; if
    they don't all together, half of the parts' moves are tried, down to one part's, which always raise it. Parts are
    dealt anew each time. So it ends, and it ends because nothing moves.
    """
    any_moved, turn = False, 0
    while True:
        with scratch(links.sparkSession) as keep:
            found = materialize(_settled(links, members, by, gamma, parts, seed + turn), "settled")
            old = members.select(*by, "node", F.col("community").alias("old"))
            both = found.join(old, [*by, "node"])
            moving = [r.part for r in both.filter("community <> old").select("part").distinct().orderBy("part").collect()]
            if not moving:
                return members, any_moved
            any_moved = True
            if parts == 1:
                return keep(found.drop("part"), "members"), True
            before, step = score(links, members, by, gamma), 1
            while True:
                chosen = moving[::step]
                now = both.select(*by, "node", F.when(F.col("part").isin(chosen), F.col("community")).otherwise(F.col("old")).alias("community"))
                now = materialize(now, "members")
                if len(chosen) == 1 or score(links, now, by, gamma) > before:
                    break
                step *= 2
            members, turn = keep(now, "members"), turn + 1


def score(links: DataFrame, members: DataFrame, by: list[str], gamma: Column) -> float:
    """The quality that moves raise, summed over all graphs."""
    a, b = members.withColumnsRenamed({"node": "src", "community": "ca"}), members.withColumnsRenamed({"node": "dst", "community": "cb"})
    rows = links.join(a, [*by, "src"]).join(b, [*by, "dst"]).groupBy(*by, F.col("ca").alias("community")).agg(F.sum("w").alias("total"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inside"))
    two_m = links.groupBy(*by).agg(F.sum("w").alias("two_m"))
    rows = rows.join(two_m, list(by)) if by else rows.crossJoin(F.broadcast(two_m))  # one row
    return rows.agg(F.sum(F.col("inside") / F.col("two_m") - gamma * F.pow(F.col("total") / F.col("two_m"), F.lit(2)))).first()[0] or 0.0


def communities(edges: DataFrame, resolution: float = 1.0, by: list[str] = (), seed: int = 1, part_nodes: int = PART_NODES) -> DataFrame:
    """by, node, community (numbered from 0 by size, then smallest node). Edges: source, target, weight.

    A level moves nodes, refines each community from single nodes within it, and makes refined parts the nodes of
    the next level, which starts from the communities found, until a level merges nothing. Passes over all levels go on
    until one moves nothing. In the end communities that are not connected are split. Nodes are dealt to tasks of about
    `part_nodes`. A column `resolution` among `by` gives each graph its own.
    """
    by = list(by)
    gamma = F.col("resolution") if "resolution" in by else F.lit(float(resolution))
    first = edges.select(*by, F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), F.col("weight").cast("double").alias("w"))
    links = first.unionByName(first.select(*by, F.col("target").alias("source"), F.col("source").alias("target"), "w"))
    leaves = materialize(links.groupBy(*by, F.col("source").alias("src"), F.col("target").alias("dst")).agg(F.sum("w").alias("w")), "links")
    found = leaves.select(*by, F.col("src").alias("node")).distinct().withColumn("community", F.col("node"))
    if _whole(_largest(found, by)[1], leaves, by, part_nodes):
        return relabel(materialize(_solved(leaves, found, by, gamma, seed), "communities"), by)
    with scratch(edges.sparkSession) as keep:
        turn = 0
        while True:
            found, moved = _pass(leaves, materialize(found, "members"), by, gamma, part_nodes, seed + 1000 * turn)
            turn += 1
            if not moved:
                break
        found = keep(found, "communities")
    return relabel(connected_within(first, found, by), by)


def _pass(links: DataFrame, start: DataFrame, by: list[str], gamma: Column, part_nodes: int, seed: int) -> tuple[DataFrame, bool]:
    """Leaves with their communities after one pass over all levels, and whether any node has moved."""
    place, any_moved, level = None, False, 0
    count = _largest(start, by)
    while True:
        if level and _whole(count[1], links, by, part_nodes):
            return place.join(_solved(links, start, by, gamma, seed), [*by, "node"]).select(*by, F.col("leaf").alias("node"), "community"), True
        parts = max(1, -(-count[1] // part_nodes))
        moved, changed = _local(links, start, by, gamma, parts, seed + 10 * level)
        any_moved |= changed
        if level == 0 and not changed:
            return start, False
        fine = materialize(_refined(links, moved, by, gamma, parts, seed + 10 * level), "parts")
        after = _largest(fine.select(*by, "part").distinct(), by)
        named = fine.select(*by, "node", "part")
        place = named.select(*by, F.col("node").alias("leaf"), F.col("part").alias("node")) if place is None else place.join(named, [*by, "node"]).select(*by, "leaf", F.col("part").alias("node"))
        start = fine.groupBy(*by, F.col("part").alias("node")).agg(F.min("community").alias("community"))
        if after == count:
            return place.join(start, [*by, "node"]).select(*by, F.col("leaf").alias("node"), "community"), any_moved
        a, b = named.withColumnsRenamed({"node": "src", "part": "a"}), named.withColumnsRenamed({"node": "dst", "part": "b"})
        links = materialize(links.join(a, [*by, "src"]).join(b, [*by, "dst"]).groupBy(*by, F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")), "links")
        count, level = after, level + 1


def _whole(nodes: int, links: DataFrame, by: list[str], part_nodes: int) -> bool:
    """Whether a task may hold each graph; with smaller parts than usual, as in tests, one of a part's nodes."""
    return nodes <= (WHOLE_NODES if part_nodes >= PART_NODES else part_nodes) and _most_links(links, by) <= WHOLE_LINKS


def _most_links(links: DataFrame, by: list[str]) -> int:
    """The links of the graph that has most."""
    return links.groupBy(*by).count().agg(F.max("count")).first()[0] or 0


def _largest(nodes: DataFrame, by: list[str]) -> tuple[int, int]:
    """How many nodes all graphs have together, and the largest of them."""
    sizes = nodes.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()
    return sizes[0] or 0, sizes[1] or 0


def connected_within(edges: DataFrame, members: DataFrame, by: list[str] = ()) -> DataFrame:
    """Members with communities split into their connected parts."""
    a = members.withColumnsRenamed({"node": "source", "community": "ca"})
    b = members.withColumnsRenamed({"node": "target", "community": "cb"})
    inside = edges.select(*by, "source", "target").join(a, [*by, "source"]).join(b, [*by, "target"]).filter("ca = cb").select(*by, "source", "target")
    return connected_components(members, inside, by).select(*by, "node", F.col("component").alias("community"))


def relabel(members: DataFrame, by: list[str] = ()) -> DataFrame:
    """Communities numbered from 0, the largest first, then the smallest node. Communities of one graph are ordered together."""
    sizes = members.groupBy(*by, "community").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("least"))
    order = [F.desc("size"), F.asc("least")]
    if by:
        numbers = sizes.select(*by, "community", (F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1).alias("number"))
    else:
        numbers = numbered(sizes, order).select("community", F.col("number").cast("int"))
    return members.join(numbers, [*by, "community"]).select(*by, "node", F.col("number").alias("community"))


def cluster_sizes(members: DataFrame, by: list[str] = ()) -> DataFrame:
    return members.groupBy(*by, "community").agg(F.count(F.lit(1)).alias("size"))


def cluster_table(members: DataFrame, nodes: DataFrame, coordinates: DataFrame) -> DataFrame:
    """node with attributes, coordinates, community and its size (over the nodes kept)."""
    rows = members.join(nodes, "node").join(coordinates, "node")
    return rows.withColumn("size", F.count(F.lit(1)).over(W.partitionBy("community")))


def cluster_top_members(table: DataFrame, k: int = 5) -> DataFrame:
    """community, size, members: the k most frequent nodes, in order."""
    top = ranked(table, [F.desc("frequency"), F.asc("node")], k, ["community"])
    return top.groupBy("community", "size").agg(F.array_sort(F.collect_list(F.struct("rank", "node"))).alias("m")).select("community", "size", F.col("m.node").alias("members"))


def sweep_settings(neighbors: DataFrame, ks: list[int], resolutions: list[float], seed: int = 1) -> DataFrame:
    """k, resolution, clusters, largest, modularity (unweighted, resolution 1) from neighbours ranked up to the largest k."""
    spark = neighbors.sparkSession
    settings = spark.createDataFrame([(k, float(r)) for k in ks for r in resolutions], "k int, resolution double")
    by = ["k", "resolution"]
    chosen = neighbors.join(F.broadcast(settings), F.col("rank") <= F.col("k"))
    edges = chosen.groupBy(*by, F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).agg(F.avg("weight").alias("weight"))
    edges = materialize(edges.withColumns({c: F.col(c).cast("string") for c in ("source", "target")}), "edges")
    members = materialize(communities(edges, by=by, seed=seed), "members")
    sizes = cluster_sizes(members, by).groupBy(*by).agg(F.count(F.lit(1)).alias("clusters"), F.max("size").alias("largest"))
    plain = ["k", "setting"]
    named = lambda d: d.withColumnRenamed("resolution", "setting")  # noqa: E731  so that modularity takes resolution 1
    value = modularity(named(edges), named(members), 1.0, False, plain).withColumnRenamed("setting", "resolution")
    return sizes.join(value, by)
