"""Item frequencies and co-occurrence in baskets. `by` names columns, such as a period, that every result is split by."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def basket_items(rows: DataFrame, basket: str, item: str, by: list[str] = ()) -> DataFrame:
    """by, basket and the sorted array of its distinct items."""
    return rows.filter(F.col(item).isNotNull()).groupBy(*by, basket).agg(F.array_sort(F.collect_set(item)).alias("items"))


def item_frequency(baskets: DataFrame, by: list[str] = ()) -> DataFrame:
    """by, node, frequency: the number of baskets that hold an item."""
    return baskets.select(*by, F.explode("items").alias("node")).groupBy(*by, "node").agg(F.count(F.lit(1)).alias("frequency"))


#: Baskets of more items are cut into blocks of so many.
BLOCK = 1_000


def _pairs(rows: DataFrame, by: list[str], left: str, right) -> DataFrame:
    """by, source, target: each item of `left` with what `right` makes of its place and itself."""
    first = rows.select(*by, *[c for c in rows.columns if c not in by], F.posexplode(left).alias("at", "source"))
    return first.select(*by, "source", F.explode(right(F.col("at"), F.col("source"))).alias("target"))


def cooccurrence_edges(baskets: DataFrame, by: list[str] = (), block: int = BLOCK) -> DataFrame:
    """by, source, target, weight: the number of baskets that hold both, source before target.

    Items are sorted in their basket, so a pair is an item and one behind it; map-side sums apply before the one
    shuffle on pairs. The pairs of a basket of more than `block` items are made in many tasks: its blocks are paired
    and the pairs of blocks are dealt out, so a row makes block x block pairs at most.
    """
    by, size = list(by), F.size("items")
    small = _pairs(baskets.filter((size > 1) & (size <= block)).select(*by, "items"), by, "items", lambda at, _: F.slice("items", at + 2, F.size("items")))
    last = F.ceil(size / block) - 1
    large = baskets.filter(size > block).select(*by, "items", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("i"))
    large = large.select(*by, "items", "i", F.explode(F.sequence(F.col("i"), last)).alias("j"))
    cut = lambda c: F.slice("items", (F.col(c) * block + 1).cast("int"), F.lit(block))
    met = large.select(*by, cut("i").alias("a"), cut("j").alias("b"))
    met = met.repartition(*by, F.xxhash64("a", "b"))
    far = _pairs(met, by, "a", lambda _, source: F.filter("b", lambda x: x > source))
    return small.unionByName(far).groupBy(*by, "source", "target").agg(F.count(F.lit(1)).alias("weight"))
