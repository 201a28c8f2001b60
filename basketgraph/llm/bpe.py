"""Byte-level BPE encoding by tree concatenation, and decoding.

A text is halved until its parts have `leaf` characters, the parts are encoded, and joined in a tree. At each join a
window of tokens round the seam is read as text and grows until both sides agree: each has a place in it that no
pre-token crosses, whatever stands around, and its tokens have an edge there. What lies between these places is encoded
again and takes the place of the window's tokens; the join is exact. The parts of texts of more than `spread`
characters are dealt out to all tasks before they are joined; other texts go through their tree where they are read.

Runs of one class that such a window would have to hold whole (`raw_leaf` bytes) are halved by bytes. There two tokens
agree if their bytes encode to just those two; a sequence whose neighbours all agree is the encoding of its bytes.

Edge cases: null text counts as empty and gives no ids; empty texts too; repeated rows and repeated keys give a row
each; other columns are left out, so clashing names do no harm; an empty table gives an empty one.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketgraph.llm.common import cached

LEAF, SPREAD, RAW_LEAF = 1_024, 32_768, 8_192
#: Fixed value: how the byte-level pre-tokenizer splits text.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Places that no match of PATTERN crosses, whatever stands around them.
BOUNDARY = r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})|(?<=[\p{L}\p{N}])(?=[^\s\p{L}\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])"
#: Kinds of part: text, whole pre-tokens, the first part of a halved run, a further one, a further part of a halved text.
TEXT, WHOLE, RUN, GLUE, SEAM = range(5)


def _byte_of_char() -> dict[str, int]:
    """Byte-level files show printable Latin-1 bytes as themselves and the others, in order, from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}


def _load(path: str):
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    chars = _byte_of_char()
    ranks = {bytes(map(chars.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encoder(path: str):
    """The vocabulary at path, kept by the worker. Its ids must be in order of merges, as in byte-level BPE files."""
    return cached(("bpe", path), lambda: _load(path))


def encode_text(enc, text: str) -> np.ndarray:
    return enc.encode_to_numpy(text, allowed_special="all") if text else np.empty(0, np.uint32)


def _bound():
    import regex

    return cached("bpe boundary", lambda: regex.compile(BOUNDARY))


def _has_run(text: str, raw_leaf: int) -> bool:
    import re

    n = raw_leaf // 4
    if len(text) < n:
        return False
    sizes = list(map(len, text.split()))
    return max(sizes, default=0) >= n or (len(text) - sum(sizes) >= n and re.search(rf"\s{{{n}}}", text) is not None)


def cut(enc, text: str, leaf: int = LEAF, raw_leaf: int = RAW_LEAF):
    """(kind, list of bytes) parts of a text, in order."""
    import regex

    specials = enc.special_tokens_set
    parts = regex.split("(" + "|".join(map(regex.escape, sorted(specials))) + ")", text) if any(x in text for x in specials) else [text]
    for part in parts:
        if part in specials or not part:
            yield from [(TEXT, [part.encode()])] * bool(part)
        elif _has_run(part, raw_leaf):
            at = 0
            while at < len(part):
                near = _bound().search(part, at + max(leaf // 2, leaf - 512)) if len(part) - at > leaf else None
                end = near.start() if near else len(part)
                yield from _uncut(part[at:end], raw_leaf)
                at = end
        else:
            for i, half in enumerate(_halves(part, leaf)):
                yield SEAM if i else TEXT, [half.encode()]


def _uncut(text: str, raw_leaf: int):
    """Text between two boundaries; a pre-token of more than raw_leaf bytes is halved."""
    import regex

    if not _has_run(text, raw_leaf):
        yield TEXT, [text.encode()]
        return
    whole: list[bytes] = []
    for m in regex.finditer(PATTERN, text):
        raw = m.group().encode()
        if len(raw) <= raw_leaf:
            whole.append(raw)
            continue
        if whole:
            yield WHOLE, whole
            whole = []
        for i, half in enumerate(_halves(raw, raw_leaf)):
            yield GLUE if i else RUN, [half]
    if whole:
        yield WHOLE, whole


def _halves(whole, size: int) -> list:
    if len(whole) <= size:
        return [whole]
    return _halves(whole[: len(whole) // 2], size) + _halves(whole[len(whole) // 2 :], size)


def encode_part(enc, kind: int, pieces: list[bytes]) -> np.ndarray:
    if kind in (TEXT, SEAM):
        return encode_text(enc, pieces[0].decode())
    return np.array([i for p in pieces for i in enc._encode_single_piece(p)], np.uint32)


def _tokens_of(enc, ids: list[int], size: int) -> int:
    """How many of the ids make up so many bytes; -1 if none of their edges is there."""
    n = 0
    while size > 0 and n < len(ids):
        size -= len(enc.decode_single_token_bytes(ids[n]))
        n += 1
    return n if size == 0 else -1


def join_texts(enc, left: list[int], right: list[int]) -> list[int]:
    """The encoding of the texts of both, from the encodings of either: a window round the seam grows until it agrees."""
    w = 4
    while left and right:
        a, b = left[-w:], right[:w]
        before = enc.decode_bytes(a)
        if len(left) > w:  # the window may begin or end within a character
            before = before[next((i for i, c in enumerate(before) if c & 0xC0 != 0x80), len(before)) :]
        before, after = before.decode(), enc.decode_bytes(b).decode("utf-8", "ignore")
        text, at = before + after, len(before)
        low = max((m.start() for m in _bound().finditer(text, 0, at + 1) if m.start() <= at), default=0 if len(left) <= w else None)
        found = _bound().search(text, at)
        high = found.start() if found else len(text) if len(right) <= w else None
        if low is not None and high is not None:
            m, n = _tokens_of(enc, a[::-1], len(text[low:at].encode())), _tokens_of(enc, b, len(text[at:high].encode()))
            if m >= 0 and n >= 0:
                return left[: len(left) - m] + encode_text(enc, text[low:high]).tolist() + right[n:]
        w *= 2
    return left + right


def join_runs(enc, left: list[int], right: list[int]) -> list[int]:
    """The encoding of the bytes of both, from the encodings of either: a window round the seam grows until it agrees."""

    def agree(a: int, b: int) -> bool:
        return enc._encode_single_piece(enc.decode_bytes([a, b])) == [a, b]

    w = 4
    while left and right:
        a, b = left[-w:], right[:w]
        mid = enc._encode_single_piece(enc.decode_bytes(a + b))
        if (len(left) <= w or agree(left[-w - 1], mid[0])) and (len(right) <= w or agree(mid[-1], right[w])):
            return left[: len(left) - len(a)] + mid + right[len(b) :]
        w *= 2
    return left + right


def join_tree(enc, parts: list[list[int]], join) -> list[int]:
    if len(parts) == 1:
        return parts[0]
    half = len(parts) // 2
    return join(enc, join_tree(enc, parts[:half], join), join_tree(enc, parts[half:], join))


def join_parts(enc, kinds: list[int], ids: list[np.ndarray]) -> np.ndarray:
    """The ids of a text from those of its parts, in order."""
    out: list[np.ndarray] = []
    i = 0
    while i < len(kinds):
        j = i + 1
        while j < len(kinds) and kinds[j] in (GLUE, SEAM):
            j += 1
        join = join_texts if kinds[i] == TEXT else join_runs
        out.append(ids[i] if j == i + 1 else np.array(join_tree(enc, [x.tolist() for x in ids[i:j]], join), np.uint32))
        i = j
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def encode_tree(enc, text: str, leaf: int = LEAF, raw_leaf: int = RAW_LEAF) -> np.ndarray:
    parts = list(cut(enc, text, leaf, raw_leaf))
    return join_parts(enc, [k for k, _ in parts], [encode_part(enc, k, p) for k, p in parts])


def decode_ids(enc, ids) -> str:
    """Special tokens are kept, bytes that are no UTF-8 become U+FFFD."""
    return enc.decode_bytes(ids.tolist()).decode("utf-8", "replace")


def _id_arrays(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)))


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", decode: bool = False, leaf: int = LEAF, spread: int = SPREAD, raw_leaf: int = RAW_LEAF) -> DataFrame:
    """Columns key and ids (array of int), and with decode also decoded (the text that the ids stand for)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    done = f"key {kind}, ids array<int>" + ", decoded string" * decode

    def finished(keys: pa.Array, ids: list[np.ndarray], enc) -> pa.RecordBatch:
        columns = [keys, _id_arrays(ids)] + ([pa.array([decode_ids(enc, x) for x in ids], pa.string())] if decode else [])
        return pa.RecordBatch.from_arrays(columns, ["key", "ids", "decoded"][: len(columns)])

    def short(batches):
        enc = encoder(path)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                c = b.slice(at, 500)
                yield finished(c.column("key"), [encode_tree(enc, t, leaf, raw_leaf) for t in c.column("text").to_pylist()], enc)

    def split(batches):
        enc = encoder(path)
        for b in batches:
            for row, k, t in zip(b.column("row").to_pylist(), b.column("key").to_pylist(), b.column("text").to_pylist()):
                parts = list(cut(enc, t, spread, raw_leaf))
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(parts)), pa.array([k] * len(parts), b.column("key").type), pa.array(range(len(parts)), pa.int32()), pa.array([x for x, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.list_(pa.binary()))], ["row", "key", "part", "kind", "pieces"])

    def encoded(batches):
        enc = encoder(path)
        for b in batches:
            ids = [(encode_tree(enc, p[0].decode(), leaf, raw_leaf) if k in (TEXT, SEAM) else encode_part(enc, k, p)).tobytes() for k, p in zip(b.column("kind").to_pylist(), b.column("pieces").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("key"), b.column("part"), b.column("kind"), pa.array(ids, pa.binary())], ["row", "key", "part", "kind", "ids"])

    def joined(group: pa.Table) -> pa.Table:
        enc = encoder(path)
        group = group.sort_by("part")
        ids = [np.frombuffer(x, np.uint32) for x in group.column("ids").to_pylist()]
        whole = join_parts(enc, group.column("kind").to_pylist(), ids)
        return pa.Table.from_batches([finished(group.column("key").combine_chunks()[:1], [whole], enc)])

    long = rows.filter(F.length("text") > spread).withColumn("row", F.monotonically_increasing_id())
    parts = long.mapInArrow(split, f"row long, key {kind}, part int, kind int, pieces array<binary>")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = parts.repartition(n, "row", "part").mapInArrow(encoded, f"row long, key {kind}, part int, kind int, ids binary")
    out = rows.filter(F.length("text") <= spread).mapInArrow(short, done).unionByName(dealt.groupBy("row").applyInArrow(joined, done))
    return out.withColumnRenamed("key", key)
