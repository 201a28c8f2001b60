"""Prefix trie of conversations by vertical bitmaps, in shards that are merged by the hash of a prefix.

Turns are numbered in their conversation and hashed (role and text, with the position, to 128 bits); a prefix is the
XOR of its turns' hashes, so it can be put together from parts. Conversations in order of id are dealt to shards of
`shard` each, and their turns to blocks of `block` positions, so a shard's block has at most shard x block turns,
however long a conversation is. In a block an index leads from (position, turn) to the bitset of conversations that
have it; depth first, a node's bitset is intersected with the posting of the first conversation left in it, which gives
a child, until none is left. Popcounts, the first bit and the conversations that end there are a shard's part of a node.

Parts of equal prefix are added up. A node belongs to its smallest conversation, and a conversation that owns a node
owns all further ones on its way, so each node is on one such chain. What a node has below is the sum over its
conversations of what their chains hold: a second pass adds these up over the bitsets, and from the own chain goes what
lies above the node. So the number of rounds doesn't grow with the depth. Ids of conversations that end at a node are
hashed in order from the shards' lists, which are in order of id, by one task a node that holds one list at a time.

Edge cases: rows without conv_id are no conversation; null turns come first, ties go by role, then text; null role or
text is empty; the remainder is that of SQL, with the sign of the id; repeated rows are turns of their own; other
columns are left out; texts of any length are read whole; an empty table gives an empty one (no root).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from basketgraph.llm.common import lookup, materialize

SHARD, BLOCK, GROUP, HEAD = 512, 64, 20, 4
KEY = ["depth", "k1", "k2"]
PART = "shard long, block long, depth long, k1 long, k2 long, p1 long, p2 long, n long, conv_id long, words long, bits binary, ends string"


def n_words(text: str) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a column."""
    body = F.btrim(F.col(text), F.lit(" \t\n\x0b\f\r"))
    return F.when(body == "", 0).otherwise(F.size(F.split(body, r"[\x20\x09-\x0D]+"))).cast("long")


def ordered_turns(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, part, seq, role, text hashed, words) sorted by ranges of all turns, and (conv_id, part, first, before, rows).

    A conversation lies in one part (a range) or in several in a row; `before` are its turns in earlier parts.
    """
    given = rows.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = given.repartitionByRange(*order).sortWithinPartitions(*order)
    hashes = [F.xxhash64(F.lit(i), "role", "text").alias(f"t{i}") for i in (1, 2)]
    turns = materialize(placed.select("conv_id", F.monotonically_increasing_id().alias("seq"), *hashes, n_words("text").alias("words")).withColumn("part", F.shiftright("seq", 33)), "turns")
    parts = turns.groupBy("conv_id", "part").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("rows").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return turns, materialize(parts.withColumn("before", before), "parts")


def rebuilt(rows: DataFrame, group: int = GROUP, head: int = HEAD) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, t1, t2, words) of rebuilt conversations, and (conv_id, length) of all.

    A conversation c takes its first h turns from c - c % group, h = crc32(c) % head, and its own after its first h.
    """
    turns, parts = ordered_turns(rows)
    own = parts.groupBy("conv_id").agg(F.sum("rows").alias("own"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(head))
    convs = own.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    lengths = own.select(F.col("conv_id").alias("base"), F.col("own").alias("of_base"))
    convs = convs.join(lengths, "base", "left").withColumn("taken", F.least("h", F.coalesce("of_base", F.lit(0))))
    convs = materialize(convs.withColumn("length", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "conversations")
    at = parts.join(convs.select("conv_id", "h", "taken"), "conv_id")
    numbered = turns.join(at, ["conv_id", "part"]).withColumn("pos", F.col("before") + F.col("seq") - F.col("first"))
    kept = numbered.filter("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "t1", "t2", "words")
    heads = numbered.filter(F.col("pos") < head - 1).select(F.col("conv_id").alias("base"), "pos", "t1", "t2", "words")
    taken = heads.join(convs.select("conv_id", "base", "taken"), "base").filter("pos < taken").select("conv_id", "pos", "t1", "t2", "words")
    return kept.unionByName(taken), convs.select("conv_id", "length")


def sharded(convs: DataFrame, shard: int) -> DataFrame:
    """Adds shard and bit: places of the conversations in order of id."""
    ranges = materialize(convs.repartitionByRange("conv_id").sortWithinPartitions("conv_id").withColumn("seq", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("seq", 33)
    counts = ranges.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.min("seq").alias("first"))
    before = F.coalesce(F.sum("rows").over(W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a range
    starts = counts.select("part", "first", before.alias("before"))
    number = F.col("before") + F.col("seq") - F.col("first")
    placed = ranges.withColumn("part", part).join(F.broadcast(starts), "part")
    return placed.select(*convs.columns, F.floor(number / shard).alias("shard"), (number % shard).alias("bit"))


def _entries(turns: DataFrame, block: int) -> DataFrame:
    """conv_id, block, e1, e2: the prefix before each block of a conversation but its first."""
    sums = turns.groupBy("conv_id", F.floor(F.col("pos") / block).alias("block")).agg(*[F.bit_xor(f"t{i}").alias(f"x{i}") for i in (1, 2)])
    earlier = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    return sums.select("conv_id", "block", *[F.bit_xor(f"x{i}").over(earlier).alias(f"e{i}") for i in (1, 2)]).filter("block > 0")


def _bits(members: int) -> list[int]:
    """Places of the bits of a bitset, ascending."""
    raw = np.frombuffer(members.to_bytes(-(-members.bit_length() // 8), "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little")).tolist()


def search(table: pa.Table, block: int) -> list[tuple]:
    """A shard's block: rows of PART, depth first.

    table: bit, conv_id, length, e1, e2 (the prefix before the block) and pos, t1, t2, words, without a turn null.
    """
    start = table.column("block")[0].as_py() * block
    of_conv: dict[int, tuple] = {}
    turns: dict[tuple[int, int], tuple] = {}
    postings: dict[tuple, int] = {}
    for bit, conv, length, e1, e2, pos, t1, t2, words in zip(*[table.column(c).to_pylist() for c in ("bit", "conv_id", "length", "e1", "e2", "pos", "t1", "t2", "words")]):
        of_conv[bit] = (conv, length, (e1 or 0, e2 or 0))
        if pos is not None:
            turns[bit, pos] = turn = (pos, t1, t2, words)
            postings[turn] = postings.get(turn, 0) | 1 << bit

    def part(depth: int, key: tuple, parent: tuple, members: int, words: int) -> tuple:
        bits = _bits(members)
        ends = ",".join(str(of_conv[b][0]) for b in bits if of_conv[b][1] == depth)
        return depth, *key, *parent, len(bits), of_conv[bits[0]][0], words, np.array(bits, "<u2").tobytes(), ends

    entries: dict[tuple, int] = {}
    for bit, (_, _, key) in of_conv.items():
        entries[key] = entries.get(key, 0) | 1 << bit
    out = [part(0, key, key, members, 0) for key, members in entries.items()] if start == 0 else []
    stack = [(start, key, members) for key, members in entries.items()]
    while stack:
        depth, key, members = stack.pop()
        if depth == start + block:
            continue
        while members:
            first = (members & -members).bit_length() - 1
            turn = turns.get((first, depth))
            if turn is None:  # it ends here
                members ^= 1 << first
                continue
            child = members & postings[turn]
            members ^= child
            below = (key[0] ^ turn[1], key[1] ^ turn[2])
            out.append(part(depth + 1, below, key, child, turn[3]))
            stack.append((depth + 1, below, child))
    return out


def node_parts(turns: DataFrame, convs: DataFrame, shard: int = SHARD, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """PART rows of all shards, and convs with shard and bit."""
    turns = materialize(turns.withColumns({f"t{i}": F.xxhash64(F.lit(i), "pos", "t1", "t2") for i in (1, 2)}), "rebuilt")
    placed = materialize(sharded(convs, shard), "shards")
    own = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((F.col("length") - 1) / block), F.lit(0)))).alias("block"))
    own = own.join(_entries(turns, block), ["conv_id", "block"], "left")
    rows = own.join(turns.withColumn("block", F.floor(F.col("pos") / block)), ["conv_id", "block"], "left")

    def run(table: pa.Table) -> pa.Table:
        found = search(table, block)
        shard, b = (table.column(c)[0].as_py() for c in ("shard", "block"))
        columns = list(zip(*found)) if found else [[]] * 10
        kinds = [pa.int64()] * 8 + [pa.binary(), pa.string()]
        data = [pa.array([shard] * len(found), pa.int64()), pa.array([b] * len(found), pa.int64())] + [pa.array(c, k) for c, k in zip(columns, kinds)]
        return pa.Table.from_arrays(data, [x.split()[0] for x in PART.split(", ")])

    rows = rows.select("shard", "block", "bit", "conv_id", "length", "e1", "e2", "pos", "t1", "t2", "words")
    return rows.groupBy("shard", "block").applyInArrow(run, PART), placed


def end_hashes(parts: DataFrame) -> DataFrame:
    """KEY and the SHA-256 of the ids of the conversations that end at each node where some do."""
    lists = parts.filter("ends <> ''").select(*KEY, "shard", "ends")

    def run(batches):
        now, digest = None, None
        for batch in batches:
            done = []
            for *key, ends in zip(*[batch.column(c).to_pylist() for c in (*KEY, "ends")]):
                if key == now:
                    digest.update(b"," + ends.encode())
                    continue
                if now:
                    done.append((*now, digest.hexdigest()))
                now, digest = key, hashlib.sha256(ends.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], [*KEY, "ends_sha256"])
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, digest.hexdigest())], [*KEY, "ends_sha256"])

    placed = lists.repartition(*KEY).sortWithinPartitions(*KEY, "shard")
    return placed.mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string")


def _above(nodes: DataFrame, block: int) -> DataFrame:
    """Adds to nodes the sum of `value` over what stands above them on their conversation's chain."""
    nodes = nodes.withColumn("_block", F.floor(F.col("depth") / block))
    sums = nodes.groupBy("conv_id", "_block").agg(F.sum("value").alias("sum"))
    earlier = W.partitionBy("conv_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("conv_id", "_block", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("before"))
    here = F.sum("value").over(W.partitionBy("conv_id", "_block").orderBy("depth").rowsBetween(W.unboundedPreceding, -1))
    out = nodes.withColumn("above", F.coalesce(here, F.lit(0))).join(sums, ["conv_id", "_block"])
    return out.withColumn("above", F.col("above") + F.col("before")).drop("_block", "before")


def trie(turns: DataFrame, convs: DataFrame, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """A row a node: depth, conv_id (smallest member), parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, pos from 0, t1, t2 (hashes of the turn), words; convs: conv_id, length, turnless ones too.
    """
    parts, placed = node_parts(turns, convs, shard, block)
    parts = materialize(parts, "parts")
    one = ["p1", "p2", "words"]  # the same in all parts of a node
    nodes = parts.groupBy(*KEY).agg(F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), *[F.min(c).alias(c) for c in one])
    nodes = nodes.withColumn("value", (F.col("n_convs") - 1) * F.col("words"))
    up = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialize(nodes.join(up, KEY, "left").fillna(0, ["n_children"]), "nodes")
    chains = nodes.groupBy("conv_id").agg(F.sum("value").alias("total"), F.max((F.col("n_children") == 0).cast("int")).alias("leaf"))
    weights = placed.join(chains, "conv_id").select("shard", "bit", "total", "leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((F.col("length") - 1) / block), F.lit(0)))).alias("block"))

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        bit, total, leaf = (right.column(c).to_numpy() for c in ("bit", "total", "leaf"))
        totals, leaves = np.zeros(shard, np.int64), np.zeros(shard, np.int64)
        totals[bit], leaves[bit] = total, leaf
        bits = [np.frombuffer(b, "<u2") for b in left.column("bits").to_pylist()]
        sums = [pa.array([int(w[b].sum()) for b in bits], pa.int64()) for w in (leaves, totals)]
        return pa.Table.from_arrays([*(left.column(c) for c in KEY), *sums], [*KEY, "leaves", "below"])

    of = parts.select("shard", "block", *KEY, "bits").groupBy("shard", "block").cogroup(weights.groupBy("shard", "block"))
    below = of.applyInArrow(add, "depth long, k1 long, k2 long, leaves long, below long").groupBy(*KEY).agg(F.sum("leaves").alias("n_leaves"), F.sum("below").alias("below"))
    parents = nodes.filter("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    found = lookup(_above(nodes, block), parents.withColumnRenamed("n_children", "_rows"), ["depth", "p1", "p2"], "_rows")
    out = found.join(below, KEY).join(end_hashes(parts), KEY, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("below") - F.col("above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(rows: DataFrame, group: int = GROUP, head: int = HEAD, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """The trie of rebuilt conversations; rows: conv_id, turn, role, text."""
    turns, convs = rebuilt(rows, group, head)
    return trie(turns, convs, shard, block)
