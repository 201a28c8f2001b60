"""Undirected graphs: nodes (node, ...), edges (source, target, weight), adjacency (src, dst, w)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def adjacency(edges: DataFrame, by: list[str] = (), weighted: bool = True) -> DataFrame:
    """Both directions of each edge. Edges that occur twice are one, of the larger weight; loops go."""
    w = F.col("weight").cast("double") if weighted else F.lit(1.0)
    there = edges.filter("source <> target").select(*by, F.col("source").alias("src"), F.col("target").alias("dst"), w.alias("w"))
    both = there.unionByName(there.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy(*by, "src", "dst").agg(F.max("w").alias("w"))


def connected_nodes(edges: DataFrame, by: list[str] = ()) -> DataFrame:
    return edges.select(*by, F.explode(F.array("source", "target")).alias("node")).distinct()


def isolated_nodes(nodes: DataFrame, edges: DataFrame, by: list[str] = ()) -> DataFrame:
    return nodes.join(connected_nodes(edges, by), [*by, "node"], "left_anti")


def without_isolated(nodes: DataFrame, edges: DataFrame, by: list[str] = ()) -> DataFrame:
    return nodes.join(connected_nodes(edges, by), [*by, "node"], "left_semi")


def ranked(rows: DataFrame, order: list[Column], k: int, by: list[str] = (), rank: str = "rank") -> DataFrame:
    """The first k rows in the order given, of each group, with their rank."""
    if by:
        return rows.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)
    return rows.orderBy(*order).limit(k).withColumn(rank, F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)))


def top_nodes(nodes: DataFrame, k: int) -> DataFrame:
    return ranked(nodes, [F.desc("frequency"), F.asc("node")], k)


def top_edges(edges: DataFrame, k: int, by: list[str] = ()) -> DataFrame:
    return ranked(edges, [F.desc("weight"), F.asc("source"), F.asc("target")], k, by)


def induced_subgraph(edges: DataFrame, nodes: DataFrame, by: list[str] = ()) -> DataFrame:
    """Edges with both ends among the nodes."""
    for end in ("source", "target"):
        edges = edges.join(nodes.select(*by, F.col("node").alias(end)), [*by, end], "left_semi")
    return edges


def node_count(nodes: DataFrame, by: list[str] = ()) -> DataFrame:
    return nodes.groupBy(*by).agg(F.count(F.lit(1)).alias("n")) if by else nodes.agg(F.count(F.lit(1)).alias("n"))


def with_count(rows: DataFrame, nodes: DataFrame, by: list[str] = ()) -> DataFrame:
    """Adds n, the number of nodes (of the group)."""
    n = node_count(nodes, by)
    return rows.join(n, list(by)) if by else rows.crossJoin(F.broadcast(n))  # one row


def degree_centrality(nodes: DataFrame, adj: DataFrame, by: list[str] = ()) -> DataFrame:
    """by, node, degree, centrality (degree / (n - 1), 0 for a single node)."""
    degree = adj.groupBy(*by, F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    rows = with_count(nodes.select(*by, "node").join(degree, [*by, "node"], "left").fillna(0, ["degree"]), nodes, by)
    return rows.select(*by, "node", "degree", F.when(F.col("n") > 1, F.col("degree") / (F.col("n") - 1)).otherwise(0.0).alias("centrality"))


def strength(nodes: DataFrame, adj: DataFrame, by: list[str] = ()) -> DataFrame:
    """by, node, strength: the sum of the weights at a node."""
    total = adj.groupBy(*by, F.col("src").alias("node")).agg(F.sum("w").alias("strength"))
    return nodes.select(*by, "node").join(total, [*by, "node"], "left").fillna(0.0, ["strength"])


def network_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, max_weight, density (0 where no edge is possible)."""
    n, e = nodes.agg(F.count(F.lit(1)).alias("nodes")), edges.agg(F.count(F.lit(1)).alias("edges"), F.coalesce(F.max("weight"), F.lit(0)).alias("max_weight"))
    possible = F.col("nodes") * (F.col("nodes") - 1) / 2
    return n.crossJoin(e).withColumn("density", F.when(possible > 0, F.col("edges") / possible).otherwise(0.0))  # one row each


def category_counts(nodes: DataFrame, by: list[str] = ()) -> DataFrame:
    return nodes.groupBy(*by, "category").agg(F.count(F.lit(1)).alias("nodes"))


def rankings(scores: dict[str, DataFrame], k: int = 5, digits: int = 6) -> DataFrame:
    """metric, rank, node, value: the best k nodes of each score by rounded value, then name."""
    rows = reduce(DataFrame.unionByName, [d.select(F.lit(m).alias("metric"), "node", F.round(d.columns[-1], digits).alias("value")) for m, d in scores.items()])
    return ranked(rows, [F.desc("value"), F.asc("node")], k, ["metric"])


def plot_attributes(nodes: DataFrame, edges: DataFrame, labels: int, radius: tuple[float, float] = (10.0, 22.0), stroke: tuple[float, float] = (1.2, 5.0)) -> tuple[DataFrame, DataFrame]:
    """Nodes with radius and a label flag for the most frequent, edges with stroke."""
    most = F.broadcast(nodes.agg(F.max("frequency").alias("most")))
    heaviest = F.broadcast(edges.agg(F.max("weight").alias("most")))
    flagged = F.broadcast(top_nodes(nodes, labels).select("node", F.lit(True).alias("labelled")))
    at = nodes.crossJoin(most).join(flagged, "node", "left").fillna(False, ["labelled"])  # one row, and `labels` rows
    size = F.when(F.col("most") > 0, radius[0] + radius[1] * F.sqrt(F.col("frequency") / F.col("most"))).otherwise(radius[0])
    width = F.when(F.col("most") > 0, stroke[0] + stroke[1] * F.col("weight") / F.col("most")).otherwise(1.0)
    return at.withColumn("radius", size).drop("most"), edges.crossJoin(heaviest).withColumn("stroke", width).drop("most")
