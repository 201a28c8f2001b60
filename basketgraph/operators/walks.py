"""Biased second-order random walks and what training needs of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketgraph.session import materialize, uniform


def bias(candidate: Column, previous: Column, beside: Column, w: Column, p: float, q: float) -> Column:
    """Weight of a step: w without a previous node or to a neighbour of it, w / p back to it, else w / q."""
    return F.when(previous.isNull() | beside, w).when(candidate == previous, w / p).otherwise(w / q)


def transition_weights(adj: DataFrame, p: float, q: float) -> DataFrame:
    """prev, cur, cand, weight of every second-order step."""
    first = adj.select(F.col("src").alias("prev"), F.col("dst").alias("cur"))
    second = adj.select(F.col("src").alias("cur"), F.col("dst").alias("cand"), "w")
    known = adj.select(F.col("src").alias("prev"), F.col("dst").alias("cand"), F.lit(True).alias("beside"))
    steps = first.join(second, "cur").join(known, ["prev", "cand"], "left")
    beside = F.coalesce("beside", F.lit(False)) & (F.col("cand") != F.col("prev"))
    return steps.select("prev", "cur", "cand", bias(F.col("cand"), F.col("prev"), beside, F.col("w"), p, q).alias("weight"))


def weighted_pick(options: Column, u: Column) -> Column:
    """Of an array of (dst, w) in order, the first dst whose running sum reaches u times the total; the last as guard."""
    total = F.aggregate(options, F.lit(0.0), lambda s, x: s + x["w"])
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("string").alias("pick"))

    def step(s, x):
        now = s["sum"] + x["w"]
        return F.struct(now.alias("sum"), F.coalesce(s["pick"], F.when(now >= u * total, x["dst"].cast("string"))).alias("pick"))

    return F.aggregate(options, start, step, lambda s: F.coalesce(s["pick"], F.element_at(options, -1)["dst"].cast("string")))


def neighbour_lists(adj: DataFrame) -> DataFrame:
    return adj.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", "w"))).alias("options"))


def _over(length: int) -> Column:
    return F.col("done") | (F.size("walk") >= length)


#: Proposals of a walker in a round.
TRIES = 4


def _round(state: DataFrame, lists: DataFrame, known: DataFrame, length: int, p: float, q: float, seed: int) -> DataFrame:
    """Walkers after a round: each goes to its first proposal that is accepted; one without waits for the next round, one that is over stays."""
    most, i = max(1.0, 1 / p, 1 / q), F.size("walk")
    at = state.join(lists.withColumnRenamed("src", "cur"), "cur", "left")
    tries = F.transform(F.sequence(F.col("attempt"), F.col("attempt") + TRIES - 1), lambda a: F.struct(a.alias("a"), weighted_pick(F.col("options"), uniform(seed, "start", "nth", i, a)).alias("next"), uniform(seed + 1, "start", "nth", i, a).alias("u")))
    own = ["start", "nth", "walk", "cur", "prev", "attempt"]
    rows = at.select(*own, F.explode_outer(F.when(~_over(length), tries)).alias("x")).select(*own, "x.*").join(known, ["prev", "next"], "left")
    beside = F.coalesce("beside", F.lit(False)) & (F.col("next") != F.col("prev"))
    accepted = F.col("u") * most <= bias(F.col("next"), F.col("prev"), beside, F.lit(1.0), p, q)
    first = F.min(F.when(accepted & F.col("next").isNotNull(), F.struct("a", "next"))).alias("first")
    best = rows.groupBy(*own).agg(first, F.count("next").alias("n"))
    moved = F.col("first").isNotNull()
    return best.select(
        "start", "nth", F.when(moved, F.concat("walk", F.array("first.next"))).otherwise(F.col("walk")).alias("walk"), F.when(moved, F.col("first.next")).otherwise(F.col("cur")).alias("cur"),
        F.when(moved, F.col("cur")).otherwise(F.col("prev")).alias("prev"), F.when(moved, 0).otherwise(F.col("attempt") + TRIES).alias("attempt"), (F.col("n") == 0).alias("done"),
    )


def random_walks(nodes: DataFrame, adj: DataFrame, num_walks: int, length: int, p: float = 1.0, q: float = 1.0, seed: int = 42) -> DataFrame:
    """start, nth, walk: num_walks walks from each node, of up to `length` nodes, ending early where there is no way on.

    By rejection: a walker draws neighbours of where it stands by weight, and takes the first that is accepted, as often
    as its bias allows; whether that is beside the node before is looked up in the table of edges. So besides the walk it
    carries two nodes and a number, whatever their degrees, and goes on drawing in the next round if it has to.
    """
    lists = materialize(neighbour_lists(adj), "lists")
    known = adj.select(F.col("src").alias("prev"), F.col("dst").alias("next"), F.lit(True).alias("beside"))
    none = F.lit(None).cast("string")
    state = nodes.select(F.col("node").cast("string").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(num_walks - 1))).alias("nth"))
    state = state.select("start", "nth", F.array("start").alias("walk"), F.col("start").alias("cur"), none.alias("prev"), F.lit(0).alias("attempt"), F.lit(length < 2).alias("done"))
    ended = []
    while True:
        state = materialize(state, "walks")
        ended.append(state.filter(_over(length)).select("start", "nth", "walk"))
        state = state.filter(~_over(length))
        if state.isEmpty():
            return reduce(DataFrame.unionByName, ended)
        for _ in range(4):
            state = _round(state, lists, known, length, p, q, seed)


def skipgram_pairs(walks: DataFrame, window: int) -> DataFrame:
    """center, context, n: pairs of walk places at most `window` apart."""
    at = walks.select("walk", F.posexplode("walk").alias("i", "center"))
    before = F.slice("walk", F.greatest(F.col("i") + 1 - window, F.lit(1)), F.least(F.col("i"), F.lit(window)))
    after = F.slice("walk", F.col("i") + 2, F.lit(window))
    return at.select("center", F.explode(F.concat(before, after)).alias("context")).groupBy("center", "context").agg(F.count(F.lit(1)).alias("n"))


def negative_sampling(walks: DataFrame, scale: int = 10_000) -> DataFrame:
    """node, n, repeats: slots of each node in the table of negatives, by its count to the power 0.75."""
    counts = walks.select(F.explode("walk").alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    total = F.broadcast(counts.agg(F.sum(F.pow("n", F.lit(0.75))).alias("total")))
    return counts.crossJoin(total).select("node", "n", F.greatest(F.lit(1), F.bround(scale * F.pow("n", F.lit(0.75)) / F.col("total"))).cast("long").alias("repeats"))  # one row
