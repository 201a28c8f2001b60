"""Comparison of periods: one table with a period column goes through every job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from basketgraph.operators import graph, traverse
from basketgraph.session import materialize

BY = ["period"]


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def period_summary(basket_counts: DataFrame, nodes: DataFrame, edges: DataFrame, components: DataFrame, categories: list[str], digits: int = 6) -> DataFrame:
    """A row a period: basket_count, node_count, edge_count, density, avg_degree, avg_weight, component_count, shares of categories."""
    n = nodes.groupBy("period").agg(F.count(F.lit(1)).alias("node_count"), *[F.sum((F.col("category") == c).cast("long")).alias(f"n_{c}") for c in categories])
    e = edges.groupBy("period").agg(F.count(F.lit(1)).alias("edge_count"), F.sum("weight").alias("total_weight"))
    c = components.groupBy("period").agg(F.count_distinct("component").alias("component_count"))
    rows = basket_counts.join(n, "period", "left").join(e, "period", "left").join(c, "period", "left").fillna(0)
    nodes_, edges_ = F.col("node_count"), F.col("edge_count")
    return rows.select(
        "period", "basket_count", "node_count", "edge_count",
        F.round(_ratio(edges_, nodes_ * (nodes_ - 1) / 2), digits).alias("density"),
        F.round(_ratio(2 * edges_, nodes_), digits).alias("avg_degree"),
        F.round(_ratio(F.col("total_weight"), edges_), digits).alias("avg_weight"),
        "component_count",
        *[F.round(_ratio(F.col(f"n_{c}"), nodes_), digits).alias(f"{c}_ratio") for c in categories],
    )


def period_top_nodes(nodes: DataFrame, edges: DataFrame, k: int = 10, digits: int = 6) -> DataFrame:
    """The k nodes of most strength (then degree centrality, name) of each period with their scores."""
    adj = materialize(graph.adjacency(edges, BY), "adjacency")
    hops = materialize(traverse.hop_distances(nodes, adj, BY), "hops")
    scores = [graph.degree_centrality(nodes, adj, BY).drop("degree").withColumnRenamed("centrality", "degree_centrality"), graph.strength(nodes, adj, BY), traverse.betweenness(hops, nodes, adj, BY), traverse.closeness(hops, nodes, BY)]
    rows = nodes
    for s in scores:
        rows = rows.join(s, ["period", "node"])
    rows = rows.select("period", "node", "category", "frequency", *[F.round(c, digits).alias(c) for c in ("degree_centrality", "strength", "betweenness", "closeness")])
    return graph.ranked(rows, [F.desc("strength"), F.desc("degree_centrality"), F.asc("node")], k, BY)


def period_leaders(periods: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A row a period: strongest node, heaviest edge (null where there is none)."""
    s = graph.ranked(graph.strength(nodes, graph.adjacency(edges, BY), BY), [F.desc("strength"), F.asc("node")], 1, BY).select("period", "node", "strength")
    e = graph.top_edges(edges, 1, BY).select("period", "source", "target", "weight")
    return periods.join(s, "period", "left").join(e, "period", "left")


def period_changes(summary: DataFrame, columns: list[str]) -> DataFrame:
    """Each period but the first with the values before and after, and their differences. Periods are few: one row each."""
    order = W.partitionBy(F.lit(0)).orderBy("period")
    rows = summary.select(F.lag("period").over(order).alias("before"), F.col("period").alias("after"), *[x for c in columns for x in (F.lag(c).over(order).alias(f"{c}_before"), F.col(c).alias(f"{c}_after"))])
    return rows.filter("before IS NOT NULL").select("*", *[F.round(F.col(f"{c}_after") - F.col(f"{c}_before"), 6).alias(f"{c}_change") for c in columns])


def relative_strength(top: DataFrame) -> DataFrame:
    """Adds share: strength over the largest of all (1 at least)."""
    most = F.broadcast(top.agg(F.greatest(F.max("strength"), F.lit(1.0)).alias("most")))
    return top.crossJoin(most).withColumn("share", F.round(F.col("strength") / F.col("most"), 6)).drop("most")  # one row
