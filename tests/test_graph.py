import collections
import itertools
import math
import os
import random
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketgraph import session
from basketgraph.operators import communities, cooc, embed, graph, knn, traverse, walks
from basketgraph.plans import queries
from basketgraph.sources import io

SF = "/root/testdata/sf0.001"


def frames(spark, n, edges):
    nodes = spark.createDataFrame([(f"n{i:02d}", 1) for i in range(n)], "node string, frequency int")
    return nodes, spark.createDataFrame([(f"n{min(a, b):02d}", f"n{max(a, b):02d}", w) for a, b, w in edges], "source string, target string, weight long")


def brute(n, edges, weighted):
    """Distances and betweenness by Floyd-Warshall and path counts."""
    length = {}
    for a, b, w in edges:
        length[a, b] = length[b, a] = 1 / w if weighted else 1
    d = {(i, j): 0 if i == j else length.get((i, j), math.inf) for i in range(n) for j in range(n)}
    for k, i, j in itertools.product(range(n), repeat=3):
        d[i, j] = min(d[i, j], d[i, k] + d[k, j])

    def paths(s, t):
        if s == t:
            return 1
        return sum(paths(s, u) for u in range(n) if (u, t) in length and abs(d[s, u] + length[u, t] - d[s, t]) < 1e-12)

    pairs = (n - 1) * (n - 2) / 2
    bc = []
    for v in range(n):
        total = 0
        for s, t in itertools.permutations(range(n), 2):
            if v not in (s, t) and d[s, t] < math.inf and abs(d[s, v] + d[v, t] - d[s, t]) < 1e-12:
                total += paths(s, v) * paths(v, t) / paths(s, t)
        bc.append(total * 0.5 / pairs if pairs else 0)
    return d, bc


GRAPHS = {
    "path": (4, [(0, 1, 1), (1, 2, 1), (2, 3, 1)]), "star": (4, [(0, 1, 2), (0, 2, 2), (0, 3, 2)]), "two parts": (5, [(0, 1, 1), (1, 2, 3), (3, 4, 1)]),
    "weighted ties": (4, [(0, 1, 2), (1, 3, 2), (0, 2, 2), (2, 3, 2), (0, 3, 1)]),
}


@pytest.mark.parametrize("name", GRAPHS)
def test_distances_and_betweenness(spark, name):
    n, edges = GRAPHS[name]
    nodes, e = frames(spark, n, edges)
    adj = graph.adjacency(e)
    for weighted in (False, True):
        d, bc = brute(n, edges, weighted)
        far = traverse.weighted_distances(nodes, adj) if weighted else traverse.hop_distances(nodes, adj)
        assert {(r.source, r.node): round(r.d, 9) for r in far.collect()} == {(f"n{i:02d}", f"n{j:02d}"): round(v, 9) for (i, j), v in d.items() if v < math.inf}
        got = {r.node: round(r.betweenness, 9) for r in traverse.betweenness(far, nodes, adj, weighted=weighted).collect()}
        assert got == {f"n{i:02d}": round(v, 9) for i, v in enumerate(bc)}


@pytest.mark.parametrize("weighted", [False, True])
def test_batches_samples_and_sums(spark, weighted):
    """A graph of two parts and a node alone: many batches, a sample of all, and sums from bit counts give what brute force does."""
    rnd = random.Random(3)
    edges = sorted({tuple(sorted(rnd.sample(range(12), 2))) for _ in range(18)} | {(13, 14), (14, 15)})
    edges = [(a, b, rnd.choice([1, 2, 4])) for a, b in edges]
    nodes, e = frames(spark, 17, edges)
    adj = graph.adjacency(e)
    d, bc = brute(17, edges, weighted)
    for rows in (traverse.batched_betweenness(nodes, e, adj, weighted=weighted, batch_rows=300), traverse.sampled_betweenness(nodes, e, adj, weighted=weighted)):
        assert {r.node: round(r.betweenness, 9) for r in rows.collect()} == {f"n{i:02d}": round(v, 9) for i, v in enumerate(bc)}
    if not weighted:
        reached = {i: [v for (a, _), v in d.items() if a == i and v < math.inf] for i in range(17)}
        assert {r.node: (r.total, r.r) for r in traverse.hop_sums(nodes, adj).collect()} == {f"n{i:02d}": (sum(v), len(v)) for i, v in reached.items()}


def ring(spark, n, chords=()):
    """A ring of n nodes, and what brute force by breadth-first search says of it: hop sums of each node."""
    nodes = spark.range(n).select(F.col("id").alias("node"))
    edges = [(i, (i + 1) % n) for i in range(n)] + list(chords)
    e = spark.createDataFrame([(min(x), max(x), 1) for x in edges], "source long, target long, weight long")
    near = collections.defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    sums = {}
    for s in range(n):
        seen, front = {s: 0}, [s]
        while front:
            front = [v for u in front for v in near[u] if v not in seen and not seen.update({v: seen[u] + 1})]
        sums[s] = sum(seen.values())
    return nodes, e, sums


def test_sketches_estimate_closeness(spark):
    """A stated error: sketches of 4,096 registers are within 5 % on a graph of 700 nodes, the exact form is exact."""
    rnd = random.Random(7)
    nodes, e, sums = ring(spark, 700, [rnd.sample(range(700), 2) for _ in range(500)])
    adj = graph.adjacency(e)
    exact = {i: 699 / v for i, v in sums.items()}
    assert {r.node: round(r.closeness, 9) for r in traverse.closeness_of_sums(traverse.hop_sums(nodes, adj), nodes).collect()} == {i: round(v, 9) for i, v in exact.items()}
    assert all(abs(r.closeness / exact[r.node] - 1) < 0.05 for r in traverse.estimated_closeness(nodes, adj).collect())


def test_sampled_betweenness_keeps_its_error(spark):
    nodes, e, _ = ring(spark, 14, [(0, i) for i in range(2, 13, 2)])
    adj = graph.adjacency(e)
    exact = {r.node: r.betweenness for r in traverse.batched_betweenness(nodes, e, adj).collect()}
    near = {r.node: r.betweenness for r in traverse.sampled_betweenness(nodes, e, adj, error=0.45, doubt=0.2).collect()}
    assert max(exact.values()) > 0.4 and any(near[i] != v for i, v in exact.items()) and max(abs(near[i] - v) for i, v in exact.items()) <= 0.45


def test_weighted_distances_write_what_changes(spark):
    """On a ring each round improves two rows a source, so all rounds together write about as many rows as there are pairs."""
    nodes, e, _ = ring(spark, 12)
    written = []
    far = traverse.weighted_distances(nodes, graph.adjacency(e), written=written).collect()
    assert len(far) == 144 and sum(written) == 144 - 12 and max(written) <= 24


def test_scratch_removes_and_keeps(spark, tmp_path):
    with session.scratch(spark) as keep:
        gone = session.materialize(spark.range(5), "gone")
        gone_at = os.path.dirname(gone.inputFiles()[0].removeprefix("file://"))
        assert os.path.exists(gone_at)
        kept = keep(gone.filter("id > 2"))
    assert [r.id for r in kept.orderBy("id").collect()] == [3, 4]
    assert not os.path.exists(gone_at)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_bulk_queries_are_not_constant(spark):
    """Several components, nodes alone, distances above 2, and scores that differ."""
    d = queries.QUERIES
    assert {r.d for r in d["bulk_hop_distances"](spark, SF).select("d").distinct().collect()} >= {0, 1, 2, 3}
    sizes = [r.size for r in d["bulk_component_sizes"](spark, SF).collect()]
    assert len(sizes) > 20 and min(sizes) == 1 and max(sizes) > 4
    for name, column in (("bulk_closeness", "closeness"), ("bulk_betweenness", "betweenness")):
        assert d[name](spark, SF).select(column).distinct().count() > 3


def test_components_and_small_graphs(spark):
    nodes, e = frames(spark, 6, [(0, 1, 1), (1, 2, 1), (3, 4, 1)])
    assert {r.node: r.component for r in traverse.connected_components(nodes, e).collect()} == {"n00": "n00", "n01": "n00", "n02": "n00", "n03": "n03", "n04": "n03", "n05": "n05"}
    one, none = frames(spark, 1, [])[0], frames(spark, 2, [(0, 1, 1)])[1].limit(0)
    assert graph.degree_centrality(one, graph.adjacency(none)).first().centrality == 0
    assert graph.network_summary(one, none).first().density == 0


def test_communities_of_two_cliques(spark):
    clique = [(a, b, 1) for g in ((0, 1, 2, 3), (4, 5, 6, 7)) for a, b in itertools.combinations(g, 2)]
    _, e = frames(spark, 8, [*clique, (3, 4, 1)])
    members = communities.communities(e).collect()
    got = {frozenset(r.node for r in members if r.community == c) for c in {r.community for r in members}}
    assert got == {frozenset(f"n{i:02d}" for i in g) for g in ((0, 1, 2, 3), (4, 5, 6, 7))}


@pytest.mark.parametrize("by", [[], ["period"]])
def test_large_baskets_are_dealt_out(spark, by):
    """Counts are those of plain loops, whatever the blocks; a basket of 3,000 items spreads over tasks."""
    rnd = random.Random(1)
    rows = [(p, b, sorted(rnd.sample("abcdefghijklmnopqrst", rnd.randrange(0, 20)))) for p in (1, None) for b in range(6)]
    df = spark.createDataFrame(rows, "period int, basket int, items array<string>")
    want = collections.Counter((*([p] if by else []), *x) for p, _, items in rows for x in itertools.combinations(items, 2))
    for block in (1, 3, 7, 100):
        got = cooc.cooccurrence_edges(df, by, block).collect()
        assert {tuple(r)[:-1]: r.weight for r in got} == want and len(got) == len(want)
    large = spark.range(1).select(F.lit(1).alias("period"), F.sequence(F.lit(1), F.lit(3000)).alias("items"))
    edges = cooc.cooccurrence_edges(large, by, 500)
    assert edges.count() == 3000 * 2999 // 2 and edges.filter("weight <> 1 OR source >= target").isEmpty()


@pytest.mark.parametrize("spread, most", [(0.05, 0.5), (5.0, 1.0)])
def test_neighbours_by_pivots_are_exact(spark, spread, most):
    """Clumps, a third of equal vectors, zero vectors and ties: what one matrix product gives, though few blocks of clumps meet."""
    rng = np.random.default_rng(6)
    clumps = rng.normal(size=(12, 8))
    x = np.round(clumps[rng.integers(0, 12, 240)] + spread * rng.normal(size=(240, 8)), 3)
    x[160:235], x[235:] = x[0], 0
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "node long, vector array<double>")
    size = np.linalg.norm(x, axis=1, keepdims=True)
    unit = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
    w = np.round(np.maximum(0.0001, (unit @ unit.T + 1) / 2), 9)
    np.fill_diagonal(w, -1)
    want = {(i, r + 1): (int(j), w[i, j]) for i in range(240) for r, j in enumerate(np.argsort(-w[i], kind="stable")[:5])}
    met = []
    for rows in (16, 1000):
        got = {(r.source, r.rank): (r.target, r.weight) for r in knn.knn_neighbors(df, 5, block_rows=rows, met=met).collect()}
        assert got.keys() == want.keys() and all(abs(got[i][1] - v) < 2e-9 for i, (_, v) in want.items())
        assert sum(got[i][0] != t for i, (t, _) in want.items()) == 0
    assert len(met) == 1 and met[0] <= most


@pytest.mark.parametrize("named", [False, True])
def test_neighbours_pass_by_groups(spark, monkeypatch, named):
    """Groups of several blocks, vectors beyond single precision, nearly equal ones, one vector in a third of all rows: as one product."""
    for name, value in (("GROUP_ROWS", 40), ("GROUPS", 1), ("TILE", (7, 11))):
        monkeypatch.setattr(knn, name, value)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 6))
    x[:50] = x[0]
    x[50:90] = x[50] + 1e-7 * rng.normal(size=(40, 6))
    ids = [f"v{i:03d}" if named else i for i in range(150)]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    w = np.round(np.maximum(0.0001, (unit @ unit.T + 1) / 2), 9)
    np.fill_diagonal(w, -1)
    df = spark.createDataFrame(list(zip(ids, x.tolist())), f"node {'string' if named else 'int'}, vector array<double>")
    got = {(r.source, r.rank): (r.target, r.weight) for r in knn.knn_neighbors(df, 4, block_rows=12).collect()}
    assert len(got) == 600 and all(got[ids[i], r + 1] == (ids[j], w[i, j]) for i in range(150) for r, j in enumerate(np.argsort(-w[i], kind="stable")[:4]))


def test_vectors_are_packed_without_loss():
    x = np.random.default_rng(1).normal(size=(6, 3))
    both = knn.pa.concat_arrays([knn._packed(x.astype(np.float32).astype(float)), knn._packed(x), knn._packed(np.zeros((1, 3)))])
    assert len(both[0].as_py()) == 12 and len(both[6].as_py()) == 24
    assert (knn._vectors(both, 3) == knn._unit(np.vstack([x.astype(np.float32).astype(float), x, np.zeros((1, 3))]))).all()
    assert (knn._vectors(both.slice(5, 3), 3) == knn._vectors(both, 3)[5:8]).all()


def test_walks_follow_transition_weights(spark):
    """Steps after two nodes are as frequent as their weights; a walk ends where there is no way on; strong p and q need many proposals."""
    _, e = frames(spark, 6, [(0, 1, 3), (1, 2, 1), (0, 2, 2), (2, 3, 1), (3, 4, 5)])
    nodes, adj = spark.createDataFrame([(f"n{i:02d}",) for i in range(6)], "node string"), graph.adjacency(e)
    rows = walks.random_walks(nodes, adj, 600, 6, 0.2, 5.0).collect()
    assert len(rows) == 3600 and all(len(r.walk) == (1 if r.start == "n05" else 6) and r.walk[0] == r.start for r in rows)
    weight = {(r.prev, r.cur, r.cand): r.weight for r in walks.transition_weights(adj, 0.2, 5.0).collect()}
    seen = collections.Counter(x for r in rows for x in zip(r.walk, r.walk[1:], r.walk[2:]))
    assert seen.keys() <= weight.keys()
    for two in {x[:2] for x in seen}:
        n, total = sum(c for x, c in seen.items() if x[:2] == two), sum(w for x, w in weight.items() if x[:2] == two)
        assert n < 300 or all(abs(seen[x] / n - w / total) < 0.08 for x, w in weight.items() if x[:2] == two)


def planted(spark, groups=4, size=9, seed=5):
    """Groups of many inner links, a few links between them."""
    rnd, n = random.Random(seed), groups * size
    edges = [(a, b, 1) for a in range(n) for b in range(a + 1, n) if rnd.random() < (0.7 if a // size == b // size else 0.03)]
    return frames(spark, n, edges)[1], edges


def plain_modularity(edges, community, resolution=1.0):
    m = sum(w for *_, w in edges)
    degree = collections.Counter()
    for a, b, w in edges:
        degree[community[f"n{a:02d}"]] += w
        degree[community[f"n{b:02d}"]] += w
    inside = sum(w for a, b, w in edges if community[f"n{a:02d}"] == community[f"n{b:02d}"])
    return inside / m - resolution * sum((k / (2 * m)) ** 2 for k in degree.values())


@pytest.mark.parametrize("part_nodes", [20_000, 10])
def test_communities_end_where_nothing_moves(spark, part_nodes):
    """In one task, and in many parts that are merged and scored by Spark: the planted groups, and no node has a better place."""
    e, edges = planted(spark)
    got = {r.node: r.community for r in communities.communities(e, 1.0, part_nodes=part_nodes).collect()}
    best = plain_modularity(edges, got)
    assert best >= plain_modularity(edges, {f"n{i:02d}": i // 9 for i in range(36)}) - 1e-9
    assert all(plain_modularity(edges, got | {n: c}) <= best + 1e-9 for n in got for c in set(got.values()))
    assert communities.modularity(e, communities.communities(e, 1.0, part_nodes=part_nodes)).first().modularity == round(best, 6)


def test_graphs_that_fit_are_one_task(spark, monkeypatch):
    """25,000 nodes are solved without rounds of Spark jobs: a ring of 5,000 cliques, each a community at a high resolution."""
    monkeypatch.setattr(communities, "_pass", None)
    ends = spark.range(5000).selectExpr("id AS c", "explode(array((0, 1), (0, 2), (0, 3), (0, 4), (1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (4, 5))) AS e")
    e = ends.selectExpr("5 * c + e.col1 AS source", "(5 * c + e.col2) % 25000 AS target", "1.0 AS weight")
    got = collections.defaultdict(set)
    for r in communities.communities(e, 400.0).collect():
        got[r.community].add(int(r.node) // 5)
    assert len(got) == 5000 and all(len(x) == 1 for x in got.values())


def test_sweep_of_graphs_that_fit_is_a_task_each(spark, monkeypatch):
    monkeypatch.setattr(communities, "_pass", None)
    e = spark.range(7000).selectExpr("id AS c", "explode(array((0, 1), (0, 2), (1, 2), (2, 3))) AS e")
    near = e.selectExpr("3 * c + e.col1 AS source", "(3 * c + e.col2) % 21000 AS target", "1.0 AS weight", "IF(e.col2 = 3, 2, 1) AS rank")
    rows = communities.sweep_settings(near, [1, 2], [900.0]).collect()
    assert {(r.k, r.resolution, r.clusters, r.largest) for r in rows} == {(1, 900.0, 7000, 3), (2, 900.0, 7000, 3)}
    assert {r.k: r.modularity for r in rows} == {1: round(1 - 1 / 7000, 6), 2: round(3 / 4 - 1 / 7000, 6)}


def test_links_in_arrays_are_plain_loops():
    """Which nodes have a better place, and what is left of links when nodes are merged."""
    rnd, n, community = random.Random(4), 12, [0, 0, 0, 3, 3, 3, 3, 7, 7, 7, 7, 11]
    edges = {(a, b): rnd.randrange(1, 9) for a in range(n) for b in range(a) if rnd.random() < 0.5}
    w = {**edges, **{(b, a): x for (a, b), x in edges.items()}}
    src, dst = np.array(sorted(w)).T
    degree = np.bincount(src, [w[x] for x in sorted(w)], n)
    links = communities.Links(src, dst, np.array([float(w[x]) for x in sorted(w)]), degree)
    assert [dict(zip(*x)) for x in links.near()] == [{b: w[a, b] for b in range(n) if (a, b) in w} for a in range(n)]
    gain = lambda i, c: sum(w.get((i, j), 0) for j in range(n) if community[j] == c) - 1.1 / degree.sum() * degree[i] * sum(degree[j] for j in range(n) if community[j] == c and j != i)
    want = [any(gain(i, c) > max(gain(i, community[i]), 0) + 1e-9 for c in {community[j] for j in range(n) if (i, j) in w} - {community[i]}) for i in range(n)]
    assert links.restless(np.array(community), 1.1 / degree.sum()).tolist() == want and 0 < sum(want) < n
    few = links.merged(np.array([0, 3, 7, 11]).searchsorted(community), 4)
    sums = collections.Counter()
    for (a, b), x in w.items():
        if community[a] != community[b]:
            sums[[0, 3, 7, 11].index(community[a]), [0, 3, 7, 11].index(community[b])] += x
    assert dict(zip(zip(few.src.tolist(), few.dst.tolist()), few.w.tolist())) == sums and few.degree.sum() == degree.sum()


def test_sweep_is_what_each_setting_gives(spark):
    e, edges = planted(spark, 3, 6)
    near = e.unionByName(e.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight"))
    near = near.withColumn("rank", F.row_number().over(graph.W.partitionBy("source").orderBy("target")))
    rows = {(r.k, r.resolution): r for r in communities.sweep_settings(near, [3, 5], [0.8, 1.5]).collect()}
    assert rows.keys() == {(k, g) for k in (3, 5) for g in (0.8, 1.5)}
    for (k, g), r in rows.items():
        own = knn.knn_edges(near.filter(F.col("rank") <= k))
        got = {x.node: x.community for x in communities.communities(own, g).collect()}
        sizes = collections.Counter(got.values())
        plain = [(int(x.source[1:]), int(x.target[1:]), 1) for x in own.collect()]
        assert (r.clusters, r.largest, r.modularity) == (len(sizes), max(sizes.values()), round(plain_modularity(plain, got), 6))


def plain_skipgram(paths, nodes, inner, outer, n, blocks, block, window, negatives, rate, seed, epochs, order):
    """Training as loops, block by block: one gradient a pair, those of one place of a walk from the vectors before it."""
    for e, t in itertools.product(range(epochs), range(blocks)):
        for part in range(blocks):
            rng = np.random.default_rng([seed, e, t, part, 0])
            to = [x for x in nodes if block[x] == (part + t) % blocks]
            weights = np.array([n[x] for x in to], float) ** 0.75
            chance = np.cumsum(weights / weights.sum())
            for path in (paths[k] for k in order[e]):
                for i, c in enumerate(path):
                    near = [path[j] for j in range(max(0, i - window), min(len(path), i + window + 1)) if j != i and path[j] in to]
                    if block[c] != part or not near:
                        continue
                    old_in, old_out = inner[c].copy(), {x: v.copy() for x, v in outer.items()}
                    for o in near:
                        others = [to[min(int(np.searchsorted(chance, u)), len(to) - 1)] for u in rng.random(negatives)]
                        for x, label in [(o, 1.0)] + [(x, 0.0) for x in others if x != o]:
                            g = (label - 1 / (1 + math.exp(-float(old_in @ old_out[x])))) * rate
                            inner[c] = inner[c] + g * old_out[x]
                            outer[x] = outer[x] + g * old_in


@pytest.mark.parametrize("blocks", [1, 3])
def test_skipgram_is_a_plain_loop(spark, blocks):
    """The distributed training, in one block and in turns of several, gives the vectors of plain loops."""
    rnd = random.Random(2)
    paths = {k: [rnd.choice("abcdef") for _ in range(rnd.randrange(1, 8))] for k in range(30)}
    df = spark.createDataFrame([(k, 0, w) for k, w in paths.items()], "start long, nth int, walk array<string>")
    names = sorted({x for w in paths.values() for x in w})
    rows = spark.createDataFrame([(x,) for x in names], "node string")
    start = rows.select("node", embed._block("node", blocks).alias("b"), F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (embed.uniform(7, F.col("node"), i) - 0.5) / 4).alias("v")).collect()
    inner, outer = {r.node: np.array(r.v) for r in start}, {x: np.zeros(4) for x in names}
    order = [[r.start for r in df.orderBy(F.xxhash64(F.lit(7 + e), "start", "nth")).collect()] for e in range(2)]
    n = collections.Counter(x for w in paths.values() for x in w)
    first = {x: v.copy() for x, v in inner.items()}
    plain_skipgram(paths, names, inner, outer, n, blocks, {r.node: r.b for r in start}, 2, 3, 0.3, 7, 2, order)
    got = {r.node: np.array(r.vector) for r in embed.train_embeddings(df, 4, 2, 3, 2, 0.3, blocks, 7).collect()}
    assert set(got) == set(names) and all(np.allclose(got[x], inner[x]) for x in names)
    assert not any(np.allclose(got[x], first[x]) for x in names)


def test_few_nodes_are_one_block(spark, monkeypatch):
    """Many places of few nodes are one block's steps, dealt to tasks side by side, and not turns of blocks of a node or two."""
    monkeypatch.setattr(embed, "PART_STEPS", 30)
    rnd, turns, seen = random.Random(3), [], spark.sparkContext.accumulator(0)
    paths = [(k, 0, [rnd.choice("abcdef") for _ in range(5)]) for k in range(120)]

    def counted(epoch, turn, *more, was=embed._trainer):
        turns.append((epoch, turn))

        def run(batches):
            batches = list(batches)
            seen.add(sum(b.num_rows for b in batches) > 0)
            return was(epoch, turn, *more)(iter(batches))

        return run

    monkeypatch.setattr(embed, "_trainer", counted)
    got = embed.train_embeddings(spark.createDataFrame(paths, "start long, nth int, walk array<string>"), 4, epochs=2).collect()
    assert {r.node for r in got} == set("abcdef") and turns == [(0, 0), (1, 0)]
    assert seen.value == 2 * 5  # 600 places in shards of 4 x 30, a task each


def test_dense_steps_are_those_looked_up(monkeypatch):
    rng = np.random.default_rng(8)
    center, sizes = rng.integers(0, 5, 400), rng.integers(1, 4, 400)
    context, weights, tables = rng.integers(0, 7, sizes.sum()), rng.random(7), []
    for dense in (0, 4096):
        monkeypatch.setattr(embed, "DENSE", dense)
        monkeypatch.setattr(embed, "DENSE_RUN", 7 * 90)
        inner, outer = np.random.default_rng(9).normal(size=(5, 3)), np.zeros((7, 3))
        embed.train_steps(center, np.cumsum(sizes), context, inner, outer, weights, 3, 0.1, np.random.default_rng(1))
        tables.append((inner, outer))
    assert all(np.allclose(a, b) for a, b in zip(*tables)) and abs(tables[0][1]).min() > 0


def test_steps_meet_each_pair_of_blocks_once(spark):
    """Each place meets each of its contexts once, in the turn of their blocks, and no two parts of a turn share a block."""
    rnd = random.Random(4)
    paths = {k: [rnd.choice("abcdefgh") for _ in range(rnd.randrange(0, 9))] for k in range(20)}
    df = spark.createDataFrame([(k, 0, w) for k, w in paths.items()], "start long, nth int, walk array<string>")
    block = {r.node: r.b for r in spark.createDataFrame([(x,) for x in "abcdefgh"], "node string").select("node", embed._block("node", 3).alias("b")).collect()}
    got = collections.Counter()
    for r in embed.steps_of(df, 2, 3).collect():
        assert r.part == block[r.node] and {block[x] for x in r.contexts} == {(r.part + r.turn) % 3}
        got.update((r.start, r.place, r.node, x) for x in r.contexts)
    assert got == collections.Counter((k, i, c, w[j]) for k, w in paths.items() for i, c in enumerate(w) for j in range(max(0, i - 2), min(len(w), i + 3)) if j != i)


def test_skipgram_of_nothing(spark):
    df = spark.createDataFrame([], "start long, nth int, walk array<string>")
    assert embed.train_embeddings(df, 4).collect() == []
    lone = spark.createDataFrame([(1, 0, ["a"]), (2, 0, [])], "start long, nth int, walk array<string>")
    assert [(r.node, len(r.vector)) for r in embed.train_embeddings(lone, 4).collect()] == [("a", 4)]


@pytest.mark.parametrize(("blocks", "limit"), [(1, 200_000), (3, 200_000), (2, 40)])
def test_node2vec_tells_cliques_apart(spark, monkeypatch, blocks, limit):
    """Members of a clique are nearer to each other than to the other clique's, in blocks too, and where large parts are dealt to shards."""
    monkeypatch.setattr(embed, "PART_STEPS", limit)
    clique = [(a, b, 1) for g in (range(6), range(6, 12)) for a, b in itertools.combinations(g, 2)]
    nodes, e = frames(spark, 12, [*clique, (5, 6, 1)])
    got = {int(r.node[1:]): np.array(r.vector) for r in embed.node2vec(nodes, e, 8, epochs=6, rate=0.1, blocks=blocks).collect()}
    cos = lambda a, b: got[a] @ got[b] / np.linalg.norm(got[a]) / np.linalg.norm(got[b])
    within = np.mean([cos(a, b) for a, b, _ in clique])
    across = np.mean([cos(a, b) for a in range(6) for b in range(6, 12)])
    assert len(got) == 12 and within > across + 0.2


def test_graph_document_is_one_graph(spark, tmp_path):
    """A document with names that need escaping, and a null attribute, parses as one graph and reads back equal."""
    nodes = spark.createDataFrame([("a<b", "x & y", 3), ('say "hi"', None, 1), ("z\n", "c", 2)], "node string, category string, frequency int")
    edges = spark.createDataFrame([("a<b", "z\n", 5), ('say "hi"', "z\n", 9)], "source string, target string, weight long")
    io.write_graph(nodes, edges, f"{tmp_path}/parts", ["category", "frequency"])
    io.merge_parts(spark, f"{tmp_path}/parts", f"{tmp_path}/graph.xml")
    root = ElementTree.parse(f"{tmp_path}/graph.xml").getroot()
    ns = "{http://graphml.graphdrawing.org/xmlns}"
    assert [x.tag for x in root] == [f"{ns}key"] * 3 + [f"{ns}graph"] and {k.get("attr.type") for k in root.iter(f"{ns}key")} == {"string", "int", "long"}
    assert [x.get("id") for x in root.iter(f"{ns}node")] == ["a<b", 'say "hi"', "z\n"] and [(x.get("id"), x.get("source"), x.find(f"{ns}data").text) for x in root.iter(f"{ns}edge")] == [("e0", 'say "hi"', "9"), ("e1", "a<b", "5")]
    at, to = io.read_graph(spark, f"{tmp_path}/graph.xml", ["category", "frequency"])
    assert {tuple(r) for r in at.collect()} == {("a<b", "x & y", "3"), ('say "hi"', None, "1"), ("z\n", "c", "2")}
    assert {tuple(r) for r in to.collect()} == {("e0", 'say "hi"', "z\n", 9.0), ("e1", "a<b", "z\n", 5.0)}
    with pytest.raises(FileExistsError):
        io.merge_parts(spark, f"{tmp_path}/parts", f"{tmp_path}/graph.xml")


@pytest.mark.parametrize("name", ["node_embeddings", "node2vec"])
def test_embeddings_train_four_epochs(spark, monkeypatch, name):
    _, edges = frames(spark, 3, [(0, 1, 1), (1, 2, 1)])
    nodes = frames(spark, 3, [(0, 1, 1)])[0]
    walks = spark.createDataFrame([(1, ["n00", "n01", "n02"])], "basket long, walk array<string>")
    monkeypatch.setattr(queries, "basket_walks", lambda spark, d: walks)
    monkeypatch.setattr(queries, "network", lambda spark, d, **whole: (nodes, edges, None))
    monkeypatch.setattr(embed, "_trainer", lambda epoch, *more, was=embed._trainer: done.append(epoch) or was(epoch, *more))
    done = []
    queries.QUERIES[name](spark, "").collect()
    assert done == [0, 1, 2, 3]


def test_queries_without_sql_run_on_all_edges(spark, tmp_path):
    """a and b meet three times, b and c once, which is below the mean."""
    lines = [(o, p) for o in (1, 2, 3) for p in (1, 2)] + [(4, 2), (4, 3)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.node: r.betweenness for r in queries.weighted_betweenness(spark, str(tmp_path)).collect()}
    assert got == {"a": 0, "b": 1, "c": 0}
    assert {r.start for r in queries.random_walks(spark, str(tmp_path)).collect()} == {"a", "b", "c"}
