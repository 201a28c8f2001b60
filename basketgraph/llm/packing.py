"""Packing of tokenised documents into fixed-length sequences: first-fit decreasing in randomised groups.

A document is cut at multiples of the sequence length; its whole pieces fill sequences of their own and its last
piece is packed. Last pieces are dealt by a seeded hash of their id and content into groups of about `group_docs` documents; in each group
they go, largest first, into the first sequence with room, found in a tournament tree of the room left. Only
lengths and checksums (or ids, if asked for) are shuffled.

Edge cases: null text counts as empty, and an empty text is its end token alone; repeated rows are packed as often as
they occur; ties in length go by id, then start; a null id is kept; texts of any length are read whole, their ids held
at once (4 bytes each) and cut into pieces; other columns are left out; an empty table gives an empty one.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketgraph.llm.common import cached

LENGTH, GROUP_DOCS, END_ID = 4096, 8192, 2


class ChunkIds:
    """A run of characters without white space -> its ids as bytes, by the tokenizer's model.

    Right for tokenizers that drop white space and never join across it. A run of visible ASCII characters is split
    into pre-tokens here, so each of these goes through the model once, many in a call; any other run goes through the
    whole tokenizer. Holds up to `limit` runs, and as many pre-tokens.
    """

    #: Fixed value: how the tokenizer's pre-tokenizer splits lower-cased ASCII text.
    PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+"

    def __init__(self, path: str, limit: int = 400_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.limit, self.ids, self.words = limit, {"": b""}, {}
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")
        self.model = Tokenizer(self.tokenizer.model)  # of pre-tokens between spaces
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.split = re.compile(self.PRE_TOKENS).findall

    def learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of new runs; those that are held are in self.ids, the others in the result."""
        plain, other = [], []
        for c in chunks:
            (plain if c.isascii() and c.isprintable() and not self.special.search(c) else other).append(c)
        pre = [self.split(c.lower()) for c in plain]
        words = self._words(list(set().union(*pre).difference(self.words)))
        held = self.words
        new = {c: b"".join([held[w] if w in held else words[w] for w in p]) for c, p in zip(plain, pre)}
        if other:
            found = self.tokenizer.encode_batch_fast(other, add_special_tokens=False)
            new |= {c: np.array(e.ids, "<u4").tobytes() for c, e in zip(other, found)}
        if len(self.ids) < self.limit:
            self.ids.update(new)
            return {}
        return new

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of new pre-tokens; those that are held are in self.words, the others in the result."""
        found = {}
        for s in range(0, len(words), 4096):
            own = words[s : s + 4096]
            e = self.model.encode(" ".join(own), add_special_tokens=False)
            raw = np.array(e.ids, "<u4").tobytes()
            ends = (4 * np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(own)), side="right")).tolist()
            found.update(zip(own, [raw[a:b] for a, b in zip([0, *ends], ends)]))
        if len(self.words) < self.limit:
            self.words.update(found)
            return {}
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        held = self.ids
        new = self.learn(list(set().union(*split).difference(held)))
        if not new:
            return [b"".join(map(held.__getitem__, s)) for s in split]
        return [b"".join([held[c] if c in held else new[c] for c in s]) for s in split]


def chunk_ids(path: str) -> ChunkIds:
    return cached(("chunks", path), lambda: ChunkIds(path), alone=True)


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens of the pieces of each text, and with keep_ids their ids."""
    kind = docs.schema[key].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        table = chunk_ids(path)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                c = b.slice(at, 500)
                of, start, size, crc, total, ids = [], [], [], [], [], []
                for i, raw in enumerate(table.encode(c.column("text").to_pylist())):
                    raw += end
                    for s in range(0, len(raw), 4 * length):
                        part = raw[s : s + 4 * length]
                        of.append(i)
                        start.append(s // 4)
                        size.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        total.append(len(raw) // 4)
                        if keep_ids:
                            ids.append(np.frombuffer(part, "<u4").astype(np.int32))
                columns = [c.column("key").take(pa.array(of, pa.int32())), *(pa.array(x, pa.int64()) for x in (start, size, crc, total))]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.list_(pa.int32()))] if keep_ids else []), [key, "start", "length", "ids_crc32", "doc_tokens", "ids"][: 5 + keep_ids])

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"{key} {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids)


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size, taken in the order given, which must be decreasing.

    Leaf i of the tree has the room left in bin i, an inner node the larger of its children: the first bin with room
    for s is found by going left wherever the left child has room.
    """
    leaves = 1 << max(0, (max(1, len(sizes)) - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    where, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i, s in enumerate(sizes.tolist()):
        at = 1
        while at < leaves:
            at *= 2
            if tree[at] < s:
                at += 1
        where[i], offset[i] = at - leaves, capacity - tree[at]
        tree[at] -= s
        at //= 2
        while at:
            most = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == most:
                break
            tree[at] = most
            at //= 2
    return where, offset


def pack(parts: DataFrame, n_docs: int, key: str = "doc_id", length: int = LENGTH, group_docs: int = GROUP_DOCS, seed: int = 7) -> DataFrame:
    """Adds sequence_id and offset to the rows of pieces()."""
    groups = max(1, -(-n_docs // group_docs))
    part_of = F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col("start"), F.col("ids_crc32"), F.col("doc_tokens")), F.lit(groups))

    def run(table: pa.Table) -> pa.Table:
        size = table.column("length").to_numpy()
        table = table.take(pa.compute.sort_indices(table, [("length", "descending"), (key, "ascending"), ("start", "ascending")]))
        size = table.column("length").to_numpy()
        full = int((size == length).sum())  # these come first
        where, offset = first_fit_decreasing(size[full:], length)
        where = np.concatenate([np.arange(full), where + full]) + (table.column("pack_group")[0].as_py() << 32)
        offset = np.concatenate([np.zeros(full, np.int64), offset])
        return table.drop_columns("pack_group").append_column("sequence_id", pa.array(where)).append_column("offset", pa.array(offset))

    import pyarrow.compute  # noqa: F401

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long"
    return parts.withColumn("pack_group", part_of).groupBy("pack_group").applyInArrow(run, schema)
