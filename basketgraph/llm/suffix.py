"""Removal of repeated passages with suffix arrays.

A byte goes if a string of `length` bytes that covers it also starts anywhere else in the corpus. Starts of such strings
(windows) are dealt to shards by a minimiser: the least hash of the k-byte strings in the window, a function of the
window's bytes alone, so equal windows meet whatever surrounds them. Neighbouring windows of one minimiser form a
stretch of text, so a shard gets few, short stretches. Only minimisers seen twice matter; equal stretches are
counted and sent once. Of a shard's stretches only runs of shorter strings that recur in the shard are kept, if they
have room for a window: whatever else shares a minimiser by chance is not sorted. These runs are concatenated and their suffix array is built by induced sorting
(SA-IS: suffix types, leftmost-smaller substrings sorted recursively through their names, then both inductions, each
a pass over the buckets in numpy), with common prefixes of neighbours in text order (PLCP) by way of the irreducible
ones. Neighbours that share `length` bytes are repeats.

A minimiser in many different stretches, as inside a passage that many documents quote, would make a hot shard. If they
have more than `hot` bytes, the different stretches, each once with its number of places, are dealt again by a longer k (fewer windows a minimiser),
at last by k = length, where a minimiser is the window itself. This is exact at each step and bounds every shard.

Edge cases: null texts count as empty; texts shorter than `length` keep everything; matches never cross documents;
repeated rows are copies of each other and lose all that is long enough; texts of any length are read whole, a row each,
and only what recurs in their stretches is sorted; an empty table gives an empty one; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from basketgraph.llm.common import materialize, mix

LENGTH, GRAMS, HOT_BYTES, SHARD_BYTES, MAX_STRETCH = 400, (64, 352), 1 << 20, 1 << 20, 4096
_B = np.uint64(0xD6E8FEB86659FD93)


# Stretches of windows


def byte_grams(raw: bytes, k: int) -> np.ndarray:
    """Hashes of all k-byte strings."""
    n = len(raw)
    t = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
    # By doubling: those of 2j bytes come from two of j bytes.
    h, done, have, rest = t, 1, None, k
    while True:
        if rest & 1:
            if have is None:
                have, held = h, done
            else:
                m = n - held - done + 1
                have, held = h[:m] * _power(held) + have[done : done + m], held + done
        rest >>= 1
        if not rest:
            break
        m = n - 2 * done + 1
        h, done = h[:m] * _power(done) + h[done : done + m], 2 * done
    return mix(have)


def _power(e: int) -> np.uint64:
    return np.uint64(pow(int(_B), e, 1 << 64))


def sliding_min(g: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours, from least values of blocks forwards and backwards."""
    if w == 1:
        return g
    n = len(g)
    full = -(-n // w) * w
    p = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    p[:n] = g
    p = p.reshape(-1, w)
    forward = np.minimum.accumulate(p, axis=1).ravel()
    backward = np.minimum.accumulate(p[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - w + 1], forward[w - 1 : n])


def stretches(raw: bytes, k: int, length: int, spans=None):
    """(minimiser, first start, last start, whether its string recurs within) of maximal runs of windows with one minimiser."""
    w = length - k + 1
    for a, b in spans if spans is not None else [(0, len(raw) - length)]:
        if b < a:
            continue
        g = byte_grams(raw[a : b + length], k)
        m = sliding_min(g, w)
        cut = np.flatnonzero(m[1:] != m[:-1]) + 1
        for f, z in zip([0, *cut.tolist()], [*(cut - 1).tolist(), len(m) - 1]):
            recurs = np.count_nonzero(g[f : z + w] == m[f]) > 1
            for x in range(f, z + 1, MAX_STRETCH):
                yield m[f], a + x, a + min(x + MAX_STRETCH - 1, z), recurs


# Suffix arrays


def suffix_array(t: np.ndarray, sigma: int) -> np.ndarray:
    """Suffixes of t in order, by induced sorting; t holds 0 to sigma - 1 and ends in its only 0."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int32)
    # Types: a suffix is smaller (S) or larger (L) than the next; in a run of equal symbols that at the run's end holds.
    change = np.flatnonzero(t[1:] != t[:-1])
    small_at = t[change] < t[change + 1]
    runs = np.diff(np.concatenate([[-1], change, [n - 1]]))
    small = np.repeat(np.append(small_at, True), runs)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    counts = np.bincount(t, minlength=sigma)
    ends = np.cumsum(counts)
    heads = ends - counts
    stop = np.append(lms[1:], n - 1)  # a leftmost-smaller substring runs to the next one, inclusive
    if len(lms) == 1:
        return _induce(t, small, lms, heads, ends)
    if _many(counts) and sigma < 1 << 20:
        order, differs = _sort_directly(t, lms, stop)
    else:
        sa = _induce(t, small, lms, heads, ends)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        order = sa[is_lms[sa]]
        size = np.zeros(n, np.int32)
        size[lms] = stop - lms + 1
        differs = _differ(t, order[:-1], order[1:], size)
    # Name the substrings in order; where names recur, the string of names is sorted in the same way.
    names = np.empty(n, np.int32)
    names[order] = np.concatenate([[0], np.cumsum(differs)])
    reduced = names[lms]
    kinds = int(reduced.max()) + 1
    if kinds < len(lms):
        order = lms[suffix_array(reduced, kinds)]
    return _induce(t, small, order, heads, ends)


def _many(counts: np.ndarray) -> bool:
    """Whether buckets are so many and small that a pass over each in numpy is slower than one over all symbols."""
    return np.count_nonzero(counts) > counts.sum() // 50


def _sort_directly(t: np.ndarray, lms: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leftmost-smaller substrings in order, and where one differs from the one before: two symbols at a time.

    They are short where the alphabet is large. Past its end a substring compares as larger: where another goes on,
    that one is of the larger type there, which comes first. A rank is the number of smaller substrings, so only those
    that are still tied and have not ended are compared further.
    """
    size = stop - lms + 1
    rank, live, key, step = np.zeros(len(lms), np.int64), np.arange(len(lms)), t[lms].astype(np.int64), 1
    while len(live):
        by = np.argsort(key)
        live, key = live[by], key[by]
        was = rank[live]
        unlike = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.flatnonzero(unlike)
        count = np.diff(first, append=len(live))
        outer = np.maximum.accumulate(np.where(np.concatenate([[True], was[1:] != was[:-1]]), np.arange(len(live)), 0))
        rank[live] = was - outer + np.repeat(first, count)
        live = live[np.repeat(count > 1, count) & (size[live] > step - 1)]
        key = rank[live] << 42
        for j in (0, 1):
            inside = size[live] > step + j
            key |= np.where(inside, t[np.minimum(lms[live] + step + j, stop[live])].astype(np.int64), np.int64((1 << 21) - 1)) << (21 * (1 - j))
        step += 2
    by = np.argsort(rank, kind="stable")
    return lms[by], rank[by][1:] != rank[by][:-1]


def _differ(t: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether neighbouring substrings differ in length or symbols."""
    out = size[a] != size[b]
    live = np.flatnonzero(~out)
    step = 0
    while len(live):
        more = live[size[a[live]] > step]
        unlike = t[a[more] + step] != t[b[more] + step]
        out[more[unlike]] = True
        live = more[~unlike]
        step += 1
    return out


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, heads: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sorts all suffixes from leftmost-smaller ones in (their substrings') order: larger ones forwards, smaller ones backwards."""
    n, sigma = len(t), len(heads)
    used = np.flatnonzero(ends > heads).tolist()
    if _many(ends - heads):
        return _induce_one_by_one(t, small, lms, heads, ends)
    of = t[lms]
    by = np.argsort(of, kind="stable")
    at = np.searchsorted(of[by], np.arange(sigma + 1))
    seeds = lms[by]
    sa = np.full(n, -1, np.int32)
    top = heads.copy()
    for c in used:  # larger suffixes, from the smallest bucket on
        done = heads[c]
        while done < top[c]:  # those put into this bucket while it is read
            upto = top[c]
            _place(t, small, sa[done:upto] - 1, sa, top, False)
            done = upto
        _place(t, small, seeds[at[c] : at[c + 1]] - 1, sa, top, False)
    low = ends.copy()
    for c in reversed(used):  # smaller suffixes, from the largest bucket back
        done = ends[c]
        while low[c] < done:
            upto = low[c]
            _place(t, small, sa[upto:done][::-1] - 1, sa, low, True)
            done = upto
        _place(t, small, sa[heads[c] : top[c]][::-1] - 1, sa, low, True)
    if sa[0] < 0:
        sa[0] = n - 1  # the end mark
    return sa


def _induce_one_by_one(t: np.ndarray, small: np.ndarray, lms: np.ndarray, heads: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The same for many small buckets."""
    n = len(t)
    sa = np.full(n, n)  # n where nothing is yet: before it is the end mark, which is not put anywhere
    of = t[lms]
    by = np.argsort(of, kind="stable")
    last = np.cumsum(np.bincount(of, minlength=len(ends)))
    sa[np.arange(len(lms)) + (ends - last)[of[by]]] = lms[by]
    sa = sa.tolist()
    bucket, edge = np.where(small, -1, t).tolist(), heads.tolist()
    for x in sa:  # reads what is put ahead of it
        c = bucket[x - 1]
        if c >= 0:
            e = edge[c]
            sa[e] = x - 1
            edge[c] = e + 1
    bucket, edge = np.where(small, t, -1).tolist(), ends.tolist()
    bucket[-1] = -1
    for x in reversed(sa):
        c = bucket[x - 1]
        if c >= 0:
            edge[c] = e = edge[c] - 1
            sa[e] = x - 1
    return np.array(sa, np.int32)


def _place(t: np.ndarray, small: np.ndarray, before: np.ndarray, sa: np.ndarray, edge: np.ndarray, want_small: bool) -> None:
    before = before[before >= 0]
    before = before[small[before] == want_small]
    if not len(before):
        return
    c = t[before]
    if len(c) > 1 and (c[1:] < c[:-1]).any():
        by = np.argsort(c, kind="stable")
        before, c = before[by], c[by]
    first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    size = np.diff(np.append(first, len(c)))
    rank = np.arange(len(c)) - np.repeat(first, size)
    if want_small:
        sa[np.repeat(edge[c[first]], size) - 1 - rank] = before
        edge[c[first]] -= size
    else:
        sa[np.repeat(edge[c[first]], size) + rank] = before
        edge[c[first]] += size


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """PLCP: for each suffix, in text order, how much it shares with the one before it in the suffix array.

    Where the symbols before both are the same the value is one less than that of the suffix before; the others, which
    can't be so reduced, are compared directly.
    """
    n = len(t)
    before = np.empty(n, np.int32)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = n - 1
    i = np.arange(n, dtype=np.int32)
    hard = np.ones(n, bool)
    hard[1:] = (t[:-1] != t[before[1:] - 1]) | (before[1:] == 0)
    hard[sa[0]] = True
    plcp = np.zeros(n, np.int32)
    # Four symbols at a time while they are the same, then one at a time.
    t = np.ascontiguousarray(t, np.int16)
    fours = np.lib.stride_tricks.as_strided(t.view(np.int64) if n % 4 == 0 else np.append(t, np.zeros(4 - n % 4, np.int16)).view(np.int64), (max(n - 3, 0),), (2,))
    live = np.flatnonzero(hard)
    rest = live = live[live != sa[0]]
    x, y = live, before[live]
    while len(live):
        inside = np.maximum(x, y) + 4 <= n
        live, x, y = live[inside], x[inside], y[inside]
        same = fours[x] == fours[y]
        live, x, y = live[same], x[same] + 4, y[same] + 4
        plcp[live] += 4
    while len(rest):
        x, y = rest + plcp[rest], before[rest] + plcp[rest]
        inside = np.maximum(x, y) < n
        rest, x, y = rest[inside], x[inside], y[inside]
        rest = rest[t[x] == t[y]]
        plcp[rest] += 1
    anchor = np.maximum.accumulate(np.where(hard, i, 0))
    return np.maximum(plcp[anchor] - (i - anchor), 0)


def repeated_starts(texts: list[bytes], times: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For each text, which stands for `times` places, spans of starts whose `length` bytes stand somewhere else too."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    t = np.zeros(sizes.sum() + 1, np.int16)
    t[:-1] = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int16) + 2
    ends = np.cumsum(sizes) - 1
    t[ends] = 1  # between texts; the one 0 ends all
    of = np.repeat(np.arange(len(texts)), sizes)
    begins = np.concatenate([[0], ends[:-1] + 1])
    fits = np.append(ends[of] - np.arange(len(of)) >= length, False)
    sa = suffix_array(t, 258)
    plcp = common_prefixes(t, sa)
    near = (plcp[sa] >= length) & fits[sa]
    near[1:] &= fits[sa[:-1]]
    near[0] = False
    group = np.cumsum(~near)
    weight = np.append(np.array(times)[of], 0)[sa] * fits[sa]
    repeated = np.zeros(len(t), bool)
    repeated[sa] = (np.bincount(group, weight)[group] > 1) & fits[sa]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], repeated.view(np.int8), [0]])))
    out: list[list] = [[] for _ in texts]
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):  # no start fits at a text's end, so spans stay within texts
        out[of[a]].append((a - int(begins[of[a]]), b - 1 - int(begins[of[a]])))
    return out


def recurring_parts(texts: list[bytes], times: list[int], groups: list[int], length: int) -> list[tuple[int, int, bytes]]:
    """(text, begin, part): runs of strings, a third of a window long, that recur in their group, where the runs hold a window.

    All strings of a window that recurs do, so no such window is lost; hashes that fall together only keep too much.
    """
    k = max(1, length * 8 // 25)
    joined = b"\0".join(texts)
    h = byte_grams(joined, k)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    h ^= np.repeat(mix(np.array(groups, np.int64).view(np.uint64)), sizes)[: len(h)]
    ordered = np.sort(h)
    table = np.zeros(1 << 22, bool)
    table[ordered[1:][ordered[1:] == ordered[:-1]] >> np.uint64(42)] = True
    hit = table[h >> np.uint64(42)]
    starts = np.cumsum(sizes) - sizes
    for a, n, many in zip(starts.tolist(), sizes.tolist(), times):
        if many > 1:
            hit[a : a + n - k] = True
        hit[a + n - k : a + n] = False  # these reach into the next text
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    a, z = edge[::2], edge[1::2] + k - 1
    a, z = a[z - a >= length], z[z - a >= length]
    of = np.searchsorted(starts, a, side="right") - 1
    return [(i, x - y, joined[x:e]) for i, x, y, e in zip(of.tolist(), a.tolist(), starts[of].tolist(), z.tolist())]


# On Spark

_STRETCH = "minimiser long, stretch long, a long, b long, times long, first int, last int, at array<int>, recurs boolean"
_RUN = "array<struct<first:int,last:int>>"


def _stretch_rows(batches, k: int, length: int):
    """Stretches of texts (bytes raw, named a and b, in `times` places); equal ones of a text are one row, which says where they begin."""
    import xxhash

    for b in batches:
        for s in range(0, b.num_rows, 200):
            c = b.slice(s, 200)
            got = []
            for i, (raw, times) in enumerate(zip(c.column("raw").to_pylist(), c.column("times").to_pylist())):
                own: dict[tuple, list] = {}
                for m, f, z, r in stretches(raw, k, length):
                    row = own.setdefault((m, xxhash.xxh3_64_intdigest(raw[f : z + length])), [f, z, r, []])
                    row[3].append(f)
                got += [(m, h, i, times * len(at), f, z, at, r) for (m, h), (f, z, r, at) in own.items()]
            if not got:
                continue
            m, h, i, n, f, z, at, r = zip(*got)
            of = pa.array(i, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.array(m, np.uint64).view(np.int64)), pa.array(np.array(h, np.uint64).view(np.int64)), c.column("a").take(of), c.column("b").take(of), pa.array(n, pa.int64()), pa.array(f, pa.int32()), pa.array(z, pa.int32()), pa.array(at, pa.list_(pa.int32())), pa.array(r)], ["minimiser", "stretch", "a", "b", "times", "first", "last", "at", "recurs"])


def _sorted_shards(batches, length: int):
    """Suffix arrays of what recurs in SHARD_BYTES or more of stretches, whole minimisers each; rows come sorted by minimiser."""
    held: list[tuple] = []
    size = 0

    def done():
        parts = recurring_parts([x[3] for x in held], [x[2] for x in held], [x[0] for x in held], length)
        spans: dict[int, list] = {}
        if parts:
            for (i, begin, _), own in zip(parts, repeated_starts([x for _, _, x in parts], [held[i][2] for i, _, _ in parts], length)):
                spans.setdefault(i, []).extend((begin + a, begin + z) for a, z in own)
        keep = [(held[i][0], held[i][1], s) for i, s in spans.items() if s]
        m, c, s = zip(*keep) if keep else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(m, pa.int64()), pa.array(c, pa.int64()), pa.array([[{"first": a, "last": z} for a, z in x] for x in s], pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))], ["minimiser", "stretch", "runs"])

    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("minimiser", "stretch", "times", "bytes"))):
            if size >= SHARD_BYTES and held[-1][0] != row[0]:
                yield done()
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield done()


def _fetched(batches, length: int):
    for b in batches:
        for s in range(b.num_rows):
            raw, own = b.column("raw")[s].as_py(), b.column("wanted")[s].as_py()
            yield pa.RecordBatch.from_arrays([*(pa.array([x[c] for x in own], pa.int64()) for c in ("minimiser", "stretch", "times")), pa.array([raw[x["first"] : x["last"] + length] for x in own], pa.binary())], ["minimiser", "stretch", "times", "bytes"])


def _stretch_texts(texts: DataFrame, chosen: DataFrame, length: int) -> DataFrame:
    """minimiser, stretch, times, bytes of the chosen stretches."""
    wanted = chosen.groupBy("a", "b").agg(F.collect_list(F.struct("minimiser", "stretch", "times", "first", "last")).alias("wanted"))
    return texts.join(wanted, ["a", "b"]).mapInArrow(lambda bs: _fetched(bs, length), "minimiser long, stretch long, times long, bytes binary")


def _resolve(texts: DataFrame, grams: tuple, length: int, hot: int) -> DataFrame:
    """a, b, spans of starts of repeated strings in texts (a, b, times, raw)."""
    k = grams[0]
    found = materialize(texts.filter(F.octet_length("raw") >= length).mapInArrow(lambda bs: _stretch_rows(bs, k, length), _STRETCH), "stretches")
    seen = found.groupBy("minimiser").agg(F.sum("times").alias("n"), F.max("recurs").alias("recurs")).filter("n > 1 or recurs").select("minimiser")
    found = materialize(found.join(seen, "minimiser").drop("recurs"), "candidates")
    distinct = found.groupBy("minimiser", "stretch").agg(F.sum("times").alias("times"), F.min(F.struct("a", "b", "first", "last")).alias("x")).select("minimiser", "stretch", "times", "x.*")
    chosen, crowded = distinct, None
    if len(grams) > 1:
        crowded = distinct.groupBy("minimiser").agg(F.sum(F.col("last") - F.col("first") + length).alias("size")).filter(F.col("size") > hot).select("minimiser")
        crowded = materialize(distinct.join(crowded, "minimiser"), "crowded")
        chosen = distinct.join(crowded.select("minimiser").distinct(), "minimiser", "left_anti")
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sharded = _stretch_texts(texts, chosen, length).repartition(n, "minimiser").sortWithinPartitions("minimiser", "stretch")
    marks = sharded.mapInArrow(lambda bs: _sorted_shards(bs, length), f"minimiser long, stretch long, runs {_RUN}")
    if crowded is not None and not crowded.isEmpty():
        again = _stretch_texts(texts, crowded, length).select(F.col("minimiser").alias("a"), F.col("stretch").alias("b"), "times", F.col("bytes").alias("raw"))
        inner = _resolve(materialize(again, "again"), grams[1:], length, hot)
        marks = marks.unionByName(inner.select(F.col("a").alias("minimiser"), F.col("b").alias("stretch"), F.col("spans").alias("runs")))
    hits = found.select("minimiser", "stretch", "a", "b", "at").join(marks, ["minimiser", "stretch"])
    moved = F.flatten(F.transform("at", lambda f: F.transform("runs", lambda r: F.struct((f + r["first"]).alias("first"), (f + r["last"]).alias("last")))))
    grouped = hits.select("a", "b", moved.alias("spans")).groupBy("a", "b").agg(F.collect_list("spans").alias("spans"))
    return grouped.mapInArrow(_merged, f"a long, b long, spans {_RUN}")


def _merged(batches):
    """Spans of starts without overlaps."""
    for b in batches:
        out = []
        for parts in b.column("spans").to_pylist():
            own: list[dict] = []
            for f, z in sorted({(x["first"], x["last"]) for p in parts for x in p}):
                if own and f <= own[-1]["last"] + 1:
                    own[-1]["last"] = max(own[-1]["last"], z)
                else:
                    own.append({"first": f, "last": z})
            out.append(own)
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(out, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))], ["a", "b", "spans"])


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, grams=GRAMS, hot: int = HOT_BYTES) -> DataFrame:
    """a, b (hashes of key and text) and spans of starts of repeated strings."""
    t = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.xxhash64(key).alias("a"), F.xxhash64(t).alias("b"), F.lit(1).cast("long").alias("times"), t.cast("binary").alias("raw"))
    return _resolve(texts, (*grams, length), length, hot)


def covered(spans: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Merged byte ranges covered by strings of `length` bytes at the starts in spans."""
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z + length)
        else:
            out.append([a, z + length])
    return [tuple(x) for x in out]


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, columns: tuple = (), as_text: bool = False, **options) -> DataFrame:
    """key, text_bytes (length in UTF-8), kept (binary), removed (array of start and end).

    With columns there is also `more`, a struct of them, so their names clash with none of these.
    With as_text kept is a string, without the characters that a removal cuts through.
    """
    spans = repeated_spans(docs, key, text, length, **options)
    rows = docs.select(F.col(key).alias("key"), *([F.struct(*columns).alias("more")] if columns else []), F.coalesce(F.col(text), F.lit("")).alias("t"), F.xxhash64(key).alias("a"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("b"))
    keep = ["key", "more"] if columns else ["key"]

    def run(batches):
        for b in batches:
            sizes, kept, removed = [], [], []
            for t, s in zip(b.column("t").to_pylist(), b.column("spans").to_pylist()):
                raw = t.encode()
                gone = covered([(x["first"], x["last"]) for x in s or ()], length)
                at = [0, *(y for x in gone for y in x), len(raw)]
                sizes.append(len(raw))
                parts = [raw[at[i] : at[i + 1]] for i in range(0, len(at), 2)]
                kept.append("".join(x.decode("utf-8", "ignore") for x in parts) if as_text else b"".join(parts))
                removed.append([{"start": a, "end": z} for a, z in gone])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(sizes, pa.int64()), pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], [*keep, "text_bytes", "kept", "removed"])

    joined = rows.join(spans, ["a", "b"], "left").select(*keep, "t", "spans")
    made = StructType.fromDDL(f"text_bytes long, kept {'string' if as_text else 'binary'}, removed array<struct<start:long,end:long>>")
    out = StructType([*joined.select(*keep).schema, *made])
    return joined.mapInArrow(run, out).withColumnRenamed("key", key)
