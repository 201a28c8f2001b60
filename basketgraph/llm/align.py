"""Alignment of two tokenizers: where tokens of both end at one byte, and which tokens end there together.

A byte-level BPE encodes space + text, a piece BPE the text, to which it adds that space itself. For each the ends of
its tokens, in bytes, index a dictionary; the keys that both dictionaries have, sorted, cut both id lists into groups,
and the tokens that end with a group are linked. Every token has a byte at least, so that is one link a group.

Both tokenizers have an edge before a space that follows something else than a space and stands before something that
is no white space: no pre-token and no piece goes across it. So a text is cut there, each part is encoded and aligned
once a worker, and a text is the chain of its parts. Whole texts are read, whatever their length; a run without such a
place is one part, and parts of more than PART_CHARS characters aren't kept.

A pair's count over the corpus comes from each text's distinct pairs, summed before the shuffle. Two linked tokens end
together, so the bytes of one are the end of the other's: the pairs that can occur are bounded by both vocabularies
(pair_bound), and only their counts are broadcast.

Edge cases: a text that is null or empty, or whose tokens of either side don't spell space + text byte by byte (as with
U+2581 in it), has no tokens: zeros and no groups. Strings of special tokens are text. Repeated rows and ids, and null
ids, give a row each; other columns are left out; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
from itertools import accumulate, chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketgraph.llm import bpe
from basketgraph.llm.common import cached, materialize

PART_CHARS, PARTS = 64, 300_000
#: A space that no cut may stand before: one before white space. (That after a space is the second of such a pair.)
NO_CUT = re.compile(r" \s")


def byte_tokens(path: str) -> dict[int, bytes]:
    """id -> bytes of a byte-level BPE file, without its special tokens."""
    return {i: t for t, i in bpe.encoder(path)._mergeable_ranks.items()}


def piece_tokens(path: str) -> list[bytes]:
    """Bytes of each id of a sentencepiece model: U+2581 is a space, <0xHH> a byte."""
    model = _pieces(path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]


def _pieces(path: str):
    import sentencepiece

    return cached(("pieces", path), lambda: sentencepiece.SentencePieceProcessor(model_file=path))


def pair_bound(byte_path: str, piece_path: str) -> int:
    """The number of id pairs of which one's bytes are the end of the other's: as many can be linked, whatever the corpus."""
    a, b = list(byte_tokens(byte_path).values()), piece_tokens(piece_path)
    times = {}
    for t in b:
        times[t] = times.get(t, 0) + 1
    known = set(a)
    longer_a = sum(times.get(t[i:], 0) for t in a for i in range(len(t)))
    return longer_a + sum(t[i:] in known for t in b for i in range(1, len(t)))


def cut(text: str) -> list[str]:
    """Parts of space + text, each without its first character, a space."""
    parts = text.split(" ")
    if text[-1:] != " " and text[:1] != " " and not NO_CUT.search(text):
        return parts
    out = parts[:1]
    for before, part in zip(parts, parts[1:]):
        if before and part and not part[0].isspace():
            out.append(part)
        else:
            out[-1] += " " + part
    return out


class Aligner:
    """A part of a text -> its groups as text, its links, and its numbers of tokens; None where bytes differ."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = bpe.encoder(byte_path), _pieces(piece_path)
        self.bytes_a, self.bytes_b = byte_tokens(byte_path), piece_tokens(piece_path)
        self.length_a = {i: len(t) for i, t in self.bytes_a.items()}
        self.length_b = list(map(len, self.bytes_b))
        self.special = list(self.a.special_tokens_set)
        self.parts: dict[str, tuple | None] = {}

    def ids_a(self, text: str) -> list[int]:
        if len(text) > bpe.RAW_LEAF and not any(t in text for t in self.special):
            return bpe.encode_tree(self.a, text).tolist()  # runs of any length
        return self.a.encode_ordinary(text)

    def spells(self, raw: bytes, a: list[int], b: list[int]) -> bool:
        return b"".join(map(self.bytes_b.__getitem__, b)) == raw == b"".join(map(self.bytes_a.__getitem__, a))

    def align(self, parts: list[str]) -> dict[str, tuple | None]:
        """Parts are aligned as one text, of which each is known to end where tokens of both do."""
        all_a, all_b = [self.ids_a(" " + p) for p in parts], self.b.encode(parts, num_threads=1) if parts else []
        raws = [f" {p}".encode() for p in parts]
        out: dict[str, tuple | None] = dict.fromkeys(parts)
        good = [i for i, x in enumerate(zip(raws, all_a, all_b)) if self.spells(*x)]
        a, b = list(chain.from_iterable(all_a[i] for i in good)), list(chain.from_iterable(all_b[i] for i in good))
        at_a = dict(zip(accumulate(map(self.length_a.__getitem__, a)), count(1)))
        at_b = dict(zip(accumulate(map(self.length_b.__getitem__, b)), count(1)))
        ends = sorted(at_a.keys() & at_b.keys())
        to_a, to_b = list(map(at_a.__getitem__, ends)), list(map(at_b.__getitem__, ends))
        groups = [
            f"{a[i]}|{b[k]}" if j - i == m - k == 1 else f"{','.join(map(str, a[i:j]))}|{','.join(map(str, b[k:m]))}"
            for i, j, k, m in zip([0, *to_a], to_a, [0, *to_b], to_b)
        ]
        last = [np.array(ids, np.int64)[np.array(to, np.int64) - 1] for ids, to in ((a, to_a), (b, to_b))]
        links = (last[0] << 32 | last[1]).tobytes()
        nth, first = dict(zip(ends, count(1))), 0
        for i, end in zip(good, accumulate(len(raws[i]) for i in good)):
            n = nth[end]
            out[parts[i]] = ";".join(groups[first:n]), links[8 * first : 8 * n], len(all_a[i]) << 32 | len(all_b[i])
            first = n
        return out

    def learn(self, parts: list[str]) -> dict[str, tuple | None]:
        """Alignments of new parts; those that are kept are in self.parts, the others in the result."""
        found = self.align(parts)
        if len(self.parts) >= PARTS:
            return found
        self.parts.update((p, x) for p, x in found.items() if len(p) <= PART_CHARS)
        return {p: x for p, x in found.items() if len(p) > PART_CHARS}

    def documents(self, texts: list[str]) -> list[tuple[int, int, str, bytes]]:
        """n_a, n_b, groups, links (packed ids) of each text."""
        cuts = [cut(t) if t else [] for t in texts]
        new = self.learn(list(set().union(*cuts).difference(self.parts)))
        known, out = self.parts, []
        for parts in cuts:
            of = [known[p] if p in known else new[p] for p in parts] if new else list(map(known.__getitem__, parts))
            if not of or None in of:
                out.append((0, 0, "", b""))
                continue
            groups, links, sizes = zip(*of)
            n = sum(sizes)
            out.append((n >> 32, n & 0xFFFFFFFF, ";".join(groups), b"".join(links)))
        return out


def align(docs: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """key, row (a number of its own), n_a, n_b, n_groups, n_links, groups, pairs, times.

    groups is "a1,a2|b1;a3|b2,b3", or with digest its SHA-256 ('' where there are none); pairs are the distinct links,
    a << 32 | b, and times how often each stands in the text.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        aligner = cached(("align", byte_path, piece_path), lambda: Aligner(byte_path, piece_path), alone=True)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                own = batch.slice(at, 200)
                n_a, n_b, groups, links = zip(*aligner.documents(own.column("text").to_pylist()))
                sets = [np.unique(np.frombuffer(x, np.int64), return_counts=True) for x in links]
                ends = pa.array(np.cumsum([0, *(len(p) for p, _ in sets)]), pa.int32())
                pairs = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([p for p, _ in sets])))
                times = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([n for _, n in sets]), pa.int32()))
                said = [hashlib.sha256(g.encode()).hexdigest() if g and digest else g for g in groups]
                n = [len(x) // 8 for x in links]  # a link a group
                numbers = [pa.array(x, pa.int64()) for x in (n_a, n_b, n, n)]
                yield pa.RecordBatch.from_arrays([own.column("key"), own.column("row"), *numbers, pa.array(said, pa.string()), pairs, times], [key, "row", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(run, f"{key} {kind}, row long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, count (links of that pair over all texts), best (no pair of the same b has more)."""
    links = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("x.*")
    counts = materialize(links.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("count")), "pairs")
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    most = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    return counts.withColumn("b", b).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def scored(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds n_best and count_sum to the rows of align(), which must stand in a table. counts is broadcast (see pair_bound)."""
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), "x.times")
    found = links.join(F.broadcast(counts), "pair")
    sums = found.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("times") * F.col("count")).cast("long").alias("count_sum"))
    return aligned.join(sums, "row", "left").fillna(0, ["n_best", "count_sum"])
