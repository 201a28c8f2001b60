"""The published figures, from the published tables. Set PUBLISHED_BASKETS (a CSV with a column of JSON lists of items,
named in PUBLISHED_COLUMN) and PUBLISHED_VECTORS (a CSV of node, ..., dim_1 to dim_16) to run these."""

import os

import pytest
from pyspark.sql import functions as F

from basketgraph.functions import clean
from basketgraph.operators import communities, cooc, graph, knn, traverse
from basketgraph.session import materialize
from basketgraph.sources import io

BASKETS, COLUMN, VECTORS = (os.environ.get(f"PUBLISHED_{x}") for x in ("BASKETS", "COLUMN", "VECTORS"))

#: The first five nodes of each ranking, and the scores of the first.
RANKINGS = {
    "degree": (["GV20", "GV24", "BL23", "BL15", "BL62"], 0.882716),
    "betweenness": (["GV20", "GV24", "BL62", "BL23", "CV12"], 0.125159),
    "closeness": (["GV20", "GV24", "BL23", "BL15", "BL62"], 0.893889),
    "strength": (["GV20", "HT7", "SP6", "BL15", "BL23"], 366),
    "weighted_betweenness": (["GV20", "HT7", "EAR_SHENMEN", "CV12", "SP6"], 0.426051),
    "weighted_closeness": (["GV20", "HT7", "GV24", "SP6", "BL15"], 1.327368),
}


@pytest.mark.skipif(not (BASKETS and COLUMN), reason="no published baskets given")
def test_published_network(spark):
    rows = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(BASKETS).withColumn("basket", F.monotonically_increasing_id())
    items = rows.select("basket", F.explode(clean.parse_list(F.col(COLUMN))).alias("item"))
    baskets = materialize(cooc.basket_items(items, "basket", "item"), "baskets")
    nodes, edges = materialize(cooc.item_frequency(baskets), "nodes"), materialize(cooc.cooccurrence_edges(baskets), "edges")
    summary = graph.network_summary(nodes, edges).first()
    assert (summary.nodes, summary.edges, summary.max_weight, round(summary.density, 6)) == (163, 5285, 27, 0.400288)
    adj = materialize(graph.adjacency(edges), "adjacency")
    components = materialize(traverse.connected_components(nodes, edges), "components")
    assert sorted(r.size for r in traverse.component_sizes(components).collect()) == [1, 162]
    sums, far = materialize(traverse.hop_sums(nodes, adj), "sums"), materialize(traverse.weighted_distances(nodes, adj), "far")
    assert round(traverse.path_length_of_sums(components, sums).first()[0], 6) == 1.695192
    got = graph.rankings({
        "degree": graph.degree_centrality(nodes, adj), "strength": graph.strength(nodes, adj), "closeness": traverse.closeness_of_sums(sums, nodes), "betweenness": traverse.batched_betweenness(nodes, edges, adj),
        "weighted_closeness": traverse.closeness(far, nodes), "weighted_betweenness": traverse.batched_betweenness(nodes, edges, adj, weighted=True),
    }).collect()
    for metric, (names, first) in RANKINGS.items():
        own = sorted((r.rank, r.node, r.value) for r in got if r.metric == metric)
        assert [n for _, n, _ in own] == names and round(own[0][2], 6) == first, metric


@pytest.mark.skipif(not VECTORS, reason="no published vectors given")
def test_published_communities(spark):
    vectors = io.columns_to_vector(spark.read.options(header=True, inferSchema=True).csv(VECTORS)).select("node", "vector")
    edges = materialize(knn.knn_edges(knn.knn_neighbors(vectors, 6)), "edges")
    members = communities.communities(edges, 0.7)
    assert members.agg(F.count_distinct("community")).first()[0] == 4
    assert communities.modularity(edges, members, 1.0, weighted=False).first().modularity == 0.582581
