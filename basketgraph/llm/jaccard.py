"""Grouped prefix join of word n-gram sets by Jaccard similarity, and the components of its links.

Each text is its set of hashed shingles. Texts with the same set are one vertex. A global order of shingles puts the
most frequent ones last (at most `max_frequent` of them, counted over all texts, so the list has a bound); two sets
of similarity t share one of the first n - ceil(t n) + 1 shingles in any such order. Vertices with the same such
prefix and size form a group; groups that share a prefix shingle, fit in size and share enough prefix shingles are
pairs, whose members are verified on their whole sets.

Only components are asked for, so pairs within one component need no check. First come stars, rounds of pairs of each
group with one representative of each shingle's groups (and of each member with its group's first), whose number is
linear in a shingle's groups; their verified links are merged, and later rounds only pair across components, with
other representatives. What is left are shingles whose groups lie in several components. There a group of the smaller
component first meets the other component as a whole, by the shingles and sizes that any group of it has: with too few
of them in common no group of it can be linked, so only the rest is spread out to pairs of groups, filtered and
verified. No link is lost, and large groups of near copies give all their pairs neither with each other nor with texts
that share a little with all of them.

The order of frequent shingles is by their counts, so what many texts quote comes last and starts few pairs.

Enough: with L the smaller of both prefixes' last shingles, the set whose prefix ends at L has, beyond the c shared
prefix shingles, only what follows its prefix in common with the other. So the overlap is at most c + the larger of
(n - prefix length) of both, and must reach what the similarity asks for. Prefixes are stored by the upper halves of
their hashes; `twins`, the shingles of a prefix whose half another of it has, are added to c. Verification compares
whole hashes.

Edge cases: null and empty texts have no shingles and link with nothing; texts with fewer words than k are one
shingle; rows (id with text) are vertices, so a repeated or null id links nothing; a null id names no component; ties don't
arise, as the smallest id names a component; ids must be whole numbers; texts of any length are read whole, the hashes of
their shingles held at once (8 bytes each); other columns are left out; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from basketgraph.llm.common import arrow_rows, gram_hashes, lookup, materialize, mix, text_hashes

K, SHARE, MAX_FREQUENT, FREQUENT, STARS = 5, 80, 500_000, 8, 3
#: Bits of the map of shared shingles (8 MB), and pairs up to which their ends are broadcast (16 MB).
MAP_BITS, BROADCAST_PAIRS = 26, 500_000
#: Rows of an Arrow batch.
ROWS = 2000
#: Sizes whose ratio is at least this are nearly one.
NEAR = 0.98


def shingles(text: str, k: int = K) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words."""
    words = text_hashes(text)
    if not len(words):
        return np.empty(0, np.uint64)
    if len(words) < k:
        return mix(gram_hashes(words, len(words)) + np.uint64(len(words)))
    out = gram_hashes(words, k)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def _token(hashed: np.ndarray) -> np.ndarray:
    return (hashed >> np.uint64(32)).astype(np.uint32)


def _packed(tokens: np.ndarray, bits: int) -> pa.RecordBatch:
    """Sorted tokens by their upper bits: gaps between neighbours, low bytes first, which compress well."""
    tokens = np.sort(tokens)
    at = np.searchsorted(tokens, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32 - bits))
    own = np.flatnonzero(np.diff(at))
    parts = [np.diff(tokens[at[i] : at[i + 1]], prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for i in own]
    return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(parts, pa.binary())], ["bucket", "tokens"])


def _unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel(), dtype=np.uint32)


def _by_bucket(packed: DataFrame, count, schema: str) -> DataFrame:
    """count(bucket, distinct tokens, their numbers) -> a batch, for each bucket of _packed()."""
    n = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        held, bucket = [], None

        def done():
            return count(bucket, *np.unique(np.concatenate(held), return_counts=True))

        for b in batches:
            for i, raw in zip(b.column("bucket").to_pylist(), b.column("tokens").to_pylist()):
                if i != bucket and held:
                    yield done()
                    held = []
                bucket = i
                held.append(_unpacked(raw))
        if held:
            yield done()

    return packed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def _bucket_bits(df: DataFrame) -> int:
    return min(MAP_BITS - 3, max(8, (4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()))


def frequent_tokens(rows: DataFrame, k: int, max_frequent: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles (their upper 32 bits), FREQUENT times or more, max_frequent at most, and each one's place among them."""
    bits, least = _bucket_bits(rows), FREQUENT

    def pack(batches):
        for whole in batches:
            for s in range(0, whole.num_rows, 4000):
                yield _packed(np.concatenate([_token(shingles(t, k)) for t in whole.column("t").slice(s, 4000).to_pylist()]), bits)

    def count(bucket, token, times):
        keep = times >= least
        return pa.RecordBatch.from_arrays([pa.array(token[keep].astype(np.int64)), pa.array(times[keep])], ["token", "times"])

    counts = _by_bucket(rows.mapInArrow(pack, "bucket int, tokens binary"), count, "token long, times long")
    top = counts.orderBy(F.desc("times"), "token").limit(max_frequent).select("token").toArrow()
    token = top.column("token").to_numpy().astype(np.uint32)
    order = np.argsort(token)
    return token[order], order.astype(np.int32)


def shared_map(table: DataFrame) -> np.ndarray:
    """A bit for each value of the upper MAP_BITS bits of shingles that stand in two prefixes or more."""
    bits = _bucket_bits(table)
    size = 1 << (MAP_BITS - bits)

    def pack(batches):
        for b in batches:
            if b.num_rows:
                yield _packed(b.column("prefix").flatten().to_numpy().view(np.uint32), bits)

    def mark(bucket, token, times):
        own = np.zeros(size, np.uint8)
        own[(token[times > 1] >> np.uint32(32 - MAP_BITS)) & np.uint32(size - 1)] = 1
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([np.packbits(own).tobytes()], pa.binary())], ["bucket", "map"])

    out = np.zeros((1 << bits, size // 8), np.uint8)
    for r in _by_bucket(table.select("prefix").mapInArrow(pack, "bucket int, tokens binary"), mark, "bucket int, map binary").collect():
        out[r.bucket] = np.frombuffer(r.map, np.uint8)
    return out.ravel()


def _listed(batches, shared: np.ndarray):
    """token, alike, n, twins of the prefix shingles that the map holds."""
    for b in batches:
        flat = b.column("prefix").flatten().to_numpy().view(np.uint32)
        sizes = b.column("prefix").value_lengths().to_numpy()
        at = flat >> np.uint32(32 - MAP_BITS)
        keep = (shared[at >> np.uint32(3)] >> (7 - (at & np.uint32(7))).astype(np.uint8)) & 1
        of = pa.array(np.repeat(np.arange(b.num_rows), sizes)[keep == 1])
        yield pa.RecordBatch.from_arrays([pa.array(flat[keep == 1].view(np.int32)), *(b.column(c).take(of) for c in ("alike", "n", "twins"))], ["token", "alike", "n", "twins"])


def _prefixes(batches, frequent: tuple[np.ndarray, np.ndarray], k: int, share: int):
    import xxhash

    listed, place = frequent
    for b in batches:
        for s in range(0, b.num_rows, 2000):
            c = b.slice(s, 2000)
            size, sig, group, prefix, twins = [], [], [], [], []
            for t in c.column("t").to_pylist():
                own = shingles(t, k)
                token = _token(own)
                n = len(own)
                first = own
                if n and len(listed):
                    at = np.minimum(np.searchsorted(listed, token), len(listed) - 1)
                    first = own[np.argsort(np.where(listed[at] == token, -place[at], np.int32(-len(listed))), kind="stable")]
                first = first[: n - (share * n + 99) // 100 + 1] if n else own
                size.append(n)
                sig.append(xxhash.xxh3_128_digest(own.tobytes()))
                group.append(xxhash.xxh3_64_intdigest(first.tobytes(), seed=n))
                prefix.append(_token(first).view(np.int32))
                tokens = np.sort(prefix[-1])
                twins.append(int((tokens[1:] == tokens[:-1]).sum()))
            yield pa.RecordBatch.from_arrays([c.column("id"), pa.array(size, pa.int32()), pa.array(sig, pa.binary()), pa.array(np.array(group, np.uint64).view(np.int64)), pa.array(prefix, pa.list_(pa.int32())), pa.array(twins, pa.int32())], ["id", "n", "sig", "alike", "prefix", "twins"])


def _sets(batches, k: int):
    """a, b, side and the shingles of each row's text."""
    last, words = None, b""
    for b in batches:
        out = []
        for t in b.column("t").to_pylist():
            if t != last:
                last, words = t, shingles(t, k).tobytes()
            out.append(words)
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), b.column("side"), pa.array(out, pa.binary())], ["a", "b", "side", "words"])


def _similar(batches, share: int):
    for b in batches:
        keep = []
        for ends in b.column("ends").to_pylist():
            sides = [[np.frombuffer(e["words"], np.uint64) for e in ends if e["side"] == s] for s in (0, 1)]
            keep.append(any(_fit(x, y, share) for x in sides[0] for y in sides[1]))
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _fit(x: np.ndarray, y: np.ndarray, share: int) -> bool:
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= share * (len(x) + len(y) - common)


def verified(pairs: DataFrame, rows: DataFrame, k: int, share: int) -> DataFrame:
    """Those of the pairs (a, b), a written table, whose texts in rows (id, t) have the similarity."""
    ends = pairs.select("a", "b", F.col("a").alias("id"), F.lit(0).alias("side")).union(pairs.select("a", "b", F.col("b").alias("id"), F.lit(1).alias("side")))
    few = pairs.count() <= BROADCAST_PAIRS
    sets = rows.join(F.broadcast(ends) if few else ends, "id").select("a", "b", "side", "t").mapInArrow(lambda bs: _sets(bs, k), "a long, b long, side int, words binary")
    return sets.groupBy("a", "b").agg(F.collect_set(F.struct("side", "words")).alias("ends")).mapInArrow(lambda bs: _similar(bs, share), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """id and the smallest id that it is linked with, of the ends of edges (a, b): large and small stars in turn."""
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    before = None
    while True:
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        seen = Observation()
        now = materialize(small.filter("a <> b").distinct().observe(seen, F.count(F.lit(1)).alias("edges"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "edges")
        state = seen.get
        if state == before:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
        before = state


def _fits(share: int) -> Column:
    return 100 * F.least("n", "m") >= share * F.greatest("n", "m")


def _apart() -> Column:
    """Whether two groups are not all of one component."""
    return ~((F.col("low") == F.col("high")) & (F.col("low_2") == F.col("high_2")) & (F.col("low") == F.col("low_2")))


def _enough(share: int) -> Column:
    """Whether c shared prefix shingles let sets of n and m shingles reach the similarity."""
    need = F.ceil(F.lit(share) * (F.col("n") + F.col("m")) / (100 + share) - 1e-9)
    return F.col("c") + F.ceil(F.lit(share) * F.greatest("n", "m") / 100 - 1e-9) - 1 >= need


def _may_reach(share: int) -> Column:
    """Whether c shared prefix shingles let a set of n and one of `least` to `most` shingles reach the similarity.

    What c must be falls with m below n and above it, so the ends of the range decide; one is spared for rounding.
    """
    low, high = F.greatest("least", share * F.col("n") / 100), F.least("most", 100 * F.col("n") / share)
    ends = [F.col("c") + share * F.greatest("n", m) / 100 + 1 >= share * (F.col("n") + m) / (100 + share) for m in (low, high)]
    return ends[0] | ends[1]


def _with_component(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    named = found.select(F.col("id").alias(key), "component")
    return rows.join(named, key, "left").withColumn("component", F.coalesce("component", key))


def _mixed(members: DataFrame, key: str) -> DataFrame:
    """Values of key whose members lie in several components."""
    return members.groupBy(key).agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select(key)


def similar_components(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, share: int = SHARE, max_frequent: int = MAX_FREQUENT) -> DataFrame:
    """key, n_shingles, component_id (the smallest id that is not null among the rows reachable by links)."""
    found = materialize(row_components(docs, key, text, k, share, max_frequent), "found")
    least = found.groupBy("component").agg(F.min("key").cast("long").alias("component_id"))
    return found.join(least, "component").select(F.col("key").alias(key), F.col("n").cast("long").alias("n_shingles"), "component_id")


def row_name(key: str, text: str) -> Column:
    """A hash of the id and the text of a row, so rows that share an id, or have none, are told apart."""
    return F.xxhash64(F.col(key).cast("long"), F.coalesce(F.col(text), F.lit("")))


def row_components(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, share: int = SHARE, max_frequent: int = MAX_FREQUENT) -> DataFrame:
    """id (row_name), key, n, component (the smallest row_name reachable by links) of each row."""
    with arrow_rows(docs.sparkSession, ROWS):
        return _row_components(docs, key, text, k, share, max_frequent)


def _row_components(docs: DataFrame, key: str, text: str, k: int, share: int, max_frequent: int) -> DataFrame:
    context = docs.sparkSession.sparkContext
    rows = docs.select(row_name(key, text).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    frequent = context.broadcast(frequent_tokens(rows, k, max_frequent))
    table = materialize(rows.mapInArrow(lambda bs: _prefixes(bs, frequent.value, k, share), "id long, n int, sig binary, alike long, prefix array<int>, twins int"), "prefixes")
    frequent.destroy()
    full = table.filter("n > 0")
    # Vertices (one for each distinct set) and their groups (same prefix and size), each named by its smallest id.
    firsts = full.groupBy("sig", "alike", "n").agg(F.min("id").alias("id"))
    groups = full.groupBy("alike").agg(F.min("id").alias("gid"))
    vertices = materialize(firsts.join(groups, "alike").select("id", "n", "gid", "alike").distinct(), "vertices")
    copies = firsts.select("sig", F.col("id").alias("a")).join(full.select("sig", F.col("id").alias("b")), "sig").filter("a <> b").select("a", "b").distinct()
    shared = context.broadcast(shared_map(full))
    listed = full.select("alike", "n", "prefix", "twins").mapInArrow(lambda bs: _listed(bs, shared.value), "token int, alike long, n int, twins int").distinct()
    listed = materialize(listed.join(groups, "alike").select("token", "gid", "n", "twins"), "listed")
    shared.destroy()
    several = listed.groupBy("token").agg(F.count(F.lit(1)).alias("groups")).filter("groups > 1").select("token")
    lists = listed.join(several, "token")
    # Shingles of its prefix that a group has for itself: where edits were few, they are few.
    alone = (F.ceil("n") - F.ceil(F.lit(share) * F.col("n") / 100 - 1e-9) - F.count(F.lit(1))).cast("int")
    lists = lists.join(lists.groupBy("gid", "n").agg(alone.alias("alone")).select("gid", "alone"), "gid")
    tried = found = members = kinds = None
    for r in range(STARS):
        lists = materialize(lists, "lists")
        at = lists if r == 0 else lists.join(kinds, "gid")
        own = ["gid", "n"] if r == 0 else ["gid", "n", "low", "high"]
        # The representative is the group with least of its own among all, then among a random half of them for each shingle.
        h = F.xxhash64("gid", "token", F.lit(r))
        order = F.struct("alone", *own) if r == 0 else F.struct((h % 2).alias("half"), "alone", h.alias("h"), *own)
        star = at.groupBy("token").agg(F.min(order).alias("s")).select("token", F.col("s.gid").alias("center"), F.col("s.n").alias("m"), *([] if r == 0 else [F.col("s.low").alias("low_2"), F.col("s.high").alias("high_2")]))
        star = materialize(star, "stars")
        pairs = at.join(star, "token").filter((F.col("gid") != F.col("center")) & _fits(share) & (F.lit(True) if r == 0 else _apart()))
        pairs = pairs.select(F.least("gid", "center").alias("a"), F.greatest("gid", "center").alias("b")).distinct()
        pairs = _counted(lists, pairs, share)
        if r == 0:
            pairs = pairs.union(vertices.filter("id <> gid").select(F.col("gid").alias("a"), F.col("id").alias("b"))).distinct()
        else:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        if r > 0 and pairs.isEmpty():
            break
        tried = pairs if tried is None else tried.union(pairs)
        linked = verified(pairs, rows, k, share)
        found = materialize(components(linked if found is None else linked.union(found.select(F.col("component").alias("a"), F.col("id").alias("b")))), "components")
        members = _with_component(vertices, found, "id")
        kinds = members.groupBy("gid").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        lists = lists.join(_mixed(lists.join(members.select("gid", "component"), "gid"), "token"), "token")
    # What is left: shingles and groups whose vertices lie in several components.
    lists = materialize(lists, "lists")
    pairs = _mixed(members, "gid").select("gid", F.col("gid").alias("other"))
    if not lists.isEmpty():
        pairs = pairs.union(materialize(_counted(lists, _across(lists.join(kinds, "gid"), share), share), "across").select(F.col("a").alias("gid"), F.col("b").alias("other")))
    x = members.select("gid", F.col("id").alias("x"), F.col("component").alias("cx"))
    y = members.select(F.col("gid").alias("other"), F.col("id").alias("y"), F.col("component").alias("cy"))
    pairs = pairs.join(x, "gid").join(y, "other").filter("cx <> cy").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    rest = verified(materialize(pairs.join(tried, ["a", "b"], "left_anti"), "pairs"), rows, k, share)
    found = components(rest.union(found.select(F.col("component").alias("a"), F.col("id").alias("b"))).union(copies))
    sizes = table.select("id", "n").distinct()
    named = docs.select(row_name(key, text).alias("id"), F.col(key).alias("key"))
    return _with_component(named.join(sizes, "id"), found, "id").select("id", "key", "n", "component")


def _across(at: DataFrame, share: int) -> DataFrame:
    """Pairs (a, b) of groups not all of one component that may be linked.

    A group whose members lie in several components is a unit of its own, the other groups of a component are one. Of
    two units the one of fewer groups has its groups held against the other's groups of nearly one size, all at once.
    """
    unit = F.when(F.col("low") == F.col("high"), F.struct(F.lit(0).alias("own"), F.col("low").alias("id"))).otherwise(F.struct(F.lit(1).alias("own"), F.col("gid").alias("id")))
    at = at.select("token", "gid", "n", "twins", unit.alias("unit"), F.floor(F.log("n") / F.lit(-np.log(NEAR))).cast("int").alias("sized"))
    at = materialize(at, "units")
    groups = at.groupBy("gid", "n", "unit", "sized").agg(F.count(F.lit(1)).alias("held"))
    weights = groups.groupBy("unit").agg(F.sum("held").alias("held"), F.count(F.lit(1)).alias("weight"))
    at = materialize(lookup(at, materialize(weights, "weights"), ["unit"], "held"), "units")
    wholes = at.groupBy("token", F.col("unit").alias("with"), F.col("sized").alias("as")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.first("weight").alias("weight_2"))
    smaller = F.struct("weight", "unit") < F.struct(F.col("weight_2").alias("weight"), F.col("with").alias("unit"))
    fits = (100 * F.col("most") >= share * F.col("n")) & (100 * F.col("n") >= share * F.col("least"))
    met = at.join(wholes, "token").filter(smaller & fits).groupBy("gid", "n", "with", "as").agg((F.count(F.lit(1)) + F.max("twins")).alias("c"), F.min("least").alias("least"), F.max("most").alias("most"))
    found = materialize(met.filter(_may_reach(share)).select("gid", "n", "with", "as"), "met")
    others = groups.select(F.col("gid").alias("other"), F.col("n").alias("m"), F.col("unit").alias("with"), F.col("sized").alias("as"))
    return found.join(others, ["with", "as"]).filter(_fits(share)).select(F.col("gid").alias("a"), F.col("other").alias("b"))


def _counted(lists: DataFrame, pairs: DataFrame, share: int) -> DataFrame:
    """Those of pairs (a, b) of groups that share enough prefix shingles. Plans are cut here and there, as the driver holds a plan again for each of its stages."""
    pairs = materialize(pairs, "met")
    own = materialize(lists.groupBy("gid", "n", "twins").agg(F.collect_set("token").alias("tokens")), "tokens")
    left = own.select(F.col("gid").alias("a"), "n", "twins", F.col("tokens").alias("x"))
    right = own.select(F.col("gid").alias("b"), F.col("n").alias("m"), F.col("tokens").alias("y"))
    return pairs.join(left, "a").join(right, "b").withColumn("c", F.size(F.array_intersect("x", "y")) + F.col("twins")).filter(_enough(share)).select("a", "b")
