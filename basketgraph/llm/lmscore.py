"""Masked pseudo-likelihood scores from a window network that sees both sides of each word.

The vocabulary holds each word that makes up `SHARE` of all tokens (`LEAST` times or more, and the `FIRST` most
frequent words in any case), so it follows the counts over the whole corpus; all other words are in buckets. The
network adds projections of the embeddings of `REACH` words on either side, and gives the word's class, then the
word in its class (two short softmaxes). Texts become ids once, in a written table, and the network is trained in numpy
on all of them: each task takes the parameters through its own partition, and after an epoch they are averaged by
tokens, in blocks, through a written table. Every token of every document is then predicted from its neighbours; a document's score is the sum of the log-probabilities, and
their mean. A word outside the vocabulary has its share of its bucket's probability, from the counts of the whole
corpus; one count of each bucket is left to words that the corpus doesn't hold. The counts of the more frequent of
these words are broadcast, those of the others joined to the documents; a word met once needs none.

Edge cases: null and empty texts have no tokens, sum 0 and mean 0; neighbours beyond a text's ends are a mark of
their own; ties in counts go to the smaller word; repeated rows give a row each; on an empty table nothing is
trained and the result is empty; other columns are left out; texts of any length are read whole, a chunk of words at a
time. Each task trains on its own rows before parameters are averaged, so scores depend on how rows are partitioned.
"""

from __future__ import annotations

import math
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketgraph.llm.common import LOWER, materialize, word_hashes, worker_cache

BUCKETS, REACH, WIDTH, HIDDEN = 64, 2, 24, 32
#: Words of a step of training, at every size of the corpus.
BATCH = 2048
SHARE, LEAST, FIRST = 50_000, 5, 960
#: Counts that are broadcast, tokens that a task trains on at once and at least, and values in a block of parameters.
KNOWN, CHUNK, TASK_TOKENS, BLOCK = 200_000, 65_536, 100_000, 4096
#: Words outside the vocabulary whose hashes a worker keeps.
LISTED = 300_000
#: Places of a class in a batch up to which it is reckoned beside others, values of a piece of Adam's arrays, and rows of
#: an embedding in a batch that are added rank by rank.
SIDE, PIECE, RANKS = 16, 1 << 15, 8
OFFSETS = [o for o in range(-REACH, REACH + 1) if o]


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(LOWER).split()


def word_counts(rows: DataFrame) -> DataFrame:
    """word, h (its hash), n over all texts; each task adds its own up first."""

    def count(batches):
        from collections import Counter

        def rows_of(got):
            return pa.RecordBatch.from_arrays([pa.array(list(got), pa.binary()), pa.array(word_hashes(list(got)).view(np.int64)), pa.array(list(got.values()), pa.int64())], ["word", "h", "n"])

        got: Counter = Counter()
        for b in batches:
            for t in b.column("t").to_pylist():
                got.update(words_of(t))
            if len(got) > 300_000:
                yield rows_of(got)
                got = Counter()
        yield rows_of(got)

    return rows.mapInArrow(count, "word binary, h long, n long").groupBy("word", "h").agg(F.sum("n").alias("n"))


class Codes(dict):
    """word -> id in the vocabulary; of a word outside it the hash, which is larger. Holds at most LISTED of the latter."""

    def __init__(self, words: list[bytes]):
        super().__init__((w, i) for i, w in enumerate(words))
        self.size = classes_of(len(words)) ** 2
        self.limit = len(words) + LISTED

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = max(xxhash.xxh3_64_intdigest(word), self.size)
        if len(self) < self.limit:
            self[word] = h
        return h


def classes_of(n_words: int) -> int:
    """Classes, and words in a class, that hold the vocabulary and the buckets."""
    return math.isqrt(n_words + BUCKETS - 1) + 1


def id_type(size: int):
    """In which ids below size are written."""
    return np.uint16 if size <= 1 << 16 else np.int32


def padded_ids(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts with REACH marks (size) round each, the places of words among them, and the words of each text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) // np.dtype(id_type(size)).itemsize
    flat = np.frombuffer(b"".join(texts), id_type(size))
    at = np.arange(len(flat)) + REACH * np.repeat(np.arange(1, len(texts) + 1), sizes)
    out = np.full(len(flat) + REACH * (len(texts) + 1), size, np.int64)
    out[at] = flat
    return out, at, sizes


class Network:
    NAMES = ("embed", "project", "bias", "classes", "class_bias", "words", "word_bias")

    def __init__(self, classes: int, seed: int = 5):
        rng = np.random.default_rng(seed)

        def draw(*shape):
            return (rng.standard_normal(shape) / np.sqrt(shape[-2] if len(shape) > 1 else 1)).astype(np.float32)

        self.embed, self.project, self.bias = draw(classes * classes + 1, WIDTH), draw(len(OFFSETS), WIDTH, HIDDEN), np.zeros(HIDDEN, np.float32)
        self.classes, self.class_bias = draw(HIDDEN, classes) * 0.1, np.zeros(classes, np.float32)
        self.words, self.word_bias = draw(classes, HIDDEN, classes) * 0.1, np.zeros((classes, classes), np.float32)

    def state(self) -> tuple:
        return tuple(getattr(self, n) for n in self.NAMES)

    @classmethod
    def of(cls, state: tuple) -> Network:
        self = cls.__new__(cls)
        for n, x in zip(cls.NAMES, state):
            setattr(self, n, x)
        return self

    def train(self, chunks, batch: int = BATCH, rate: float = 0.003, seed: int = 5) -> int:
        """Adam on the negative log-probability of each word given its neighbours, over chunks (ids, at); gives the tokens."""
        rng = np.random.default_rng(seed)
        embed, *dense = self.state()
        # All but the embeddings lie in one array, as do their gradients, and are updated in pieces that stay in the cache.
        flat = np.concatenate([p.ravel() for p in dense])
        ends = np.cumsum([p.size for p in dense])[:-1]

        def parts(x):
            return [y.reshape(p.shape) for p, y in zip(dense, np.split(x, ends))]

        for name, part in zip(self.NAMES[1:], parts(flat)):
            setattr(self, name, part)
        first, second, step, tokens = np.zeros_like(embed), np.zeros_like(embed), 0, 0
        m, v, g = np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat)
        grads = parts(g)
        for ids, at in chunks:
            tokens += len(at)
            order = rng.permutation(at)
            for s in range(0, len(order), batch):
                step += 1
                rows, (own, *_) = self._gradients(ids, order[s : s + batch], grads)
                up, root = rate / (1 - 0.9**step), 1 / math.sqrt(1 - 0.999**step)
                for b in range(0, len(flat), PIECE):
                    here = slice(b, b + PIECE)
                    flat[here] -= _adam(m[here], v[here], g[here], up, root)
                a, b = first.take(rows, axis=0), second.take(rows, axis=0)
                up_own = _adam(a, b, own, up, root)
                first[rows], second[rows] = a, b
                embed[rows] -= up_own
        return tokens

    def _gradients(self, ids: np.ndarray, at: np.ndarray, out: list[np.ndarray] | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
        """Rows of the embeddings that were met, and gradients of these rows and of all else, the latter in `out` if given."""
        n, classes = len(at), len(self.class_bias)
        out = [np.empty_like(p) for p in self.state()[1:]] if out is None else out
        g_project, g_bias, g_classes, g_class_bias, g_words, g_word_bias = out
        # Places in the order of their words, so those of a class lie together.
        at = at.take(_order(ids.take(at), len(self.embed)))
        kind, place = np.divmod(ids.take(at), classes)
        edges = np.searchsorted(kind, np.arange(classes + 1))
        sizes = np.diff(edges)
        around = ids.take(at[:, None] + np.array(OFFSETS))
        e = self.embed.take(around, axis=0).reshape(n, -1)
        project = self.project.reshape(-1, HIDDEN)
        h = e @ project
        h += self.bias
        np.tanh(h, out=h)
        each, scale = np.arange(n), h.dtype.type(1 / n)
        p = h @ self.classes
        p += self.class_bias
        _softmax(p)
        p[each, kind] -= 1
        p *= scale
        back = p @ self.classes.T
        np.matmul(h.T, p, out=g_classes)
        p.sum(0, out=g_class_bias)
        # Large classes one by one, the others side by side, each filled up to the size of the largest of them.
        large = [(c, slice(edges[c], edges[c + 1])) for c in np.flatnonzero(sizes > SIDE).tolist()]
        small = np.flatnonzero((sizes > 0) & (sizes <= SIDE))
        q = np.empty((n, classes), h.dtype)
        for c, own in large:
            np.matmul(h[own], self.words[c], out=q[own])
        if len(small):
            filled = edges[small, None] + np.arange(sizes[small].max())
            inside = filled < edges[small + 1, None]
            flat, filled = filled[inside], np.minimum(filled, n - 1)
            x, w = h.take(filled, axis=0), self.words.take(small, axis=0)
            x *= inside[:, :, None]
            q[flat] = (x @ w)[inside]
        q += self.word_bias.take(kind, axis=0)
        _softmax(q)
        q[each, place] -= 1
        q *= scale
        more = np.empty_like(h)
        for c, own in large:
            np.matmul(h[own].T, q[own], out=g_words[c])
            np.matmul(q[own], self.words[c].T, out=more[own])
        if len(small):
            y = q.take(filled, axis=0)
            g_words[small] = x.transpose(0, 2, 1) @ y
            more[flat] = (y @ w.transpose(0, 2, 1))[inside]
        absent = np.flatnonzero(sizes == 0)
        g_words[absent], g_word_bias[absent] = 0, 0
        present = np.flatnonzero(sizes)
        g_word_bias[present] = np.add.reduceat(q, edges[present])
        back += more
        np.multiply(h, h, out=more)
        np.subtract(1, more, out=more)
        back *= more
        np.matmul(e.T, back, out=g_project.reshape(-1, HIDDEN))
        back.sum(0, out=g_bias)
        rows, embed = _summed((back @ project.T).reshape(-1, WIDTH), around.ravel(), len(self.embed))
        return rows, [embed, *out]

    def log_probabilities(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the word at each place given its neighbours."""
        tables, classes = [self.embed @ w for w in self.project], len(self.class_bias)
        out = np.empty(len(at), self.bias.dtype)
        for s in range(0, len(at), 16_384):
            # In the order of the words, so those of a class lie together.
            order = _order(ids.take(at[s : s + 16_384]), len(self.embed))
            here = at[s : s + 16_384].take(order)
            h = tables[0].take(ids.take(here + OFFSETS[0]), axis=0)
            for o, table in zip(OFFSETS[1:], tables[1:]):
                h += table.take(ids.take(here + o), axis=0)
            h += self.bias
            np.tanh(h, out=h)
            kind, place = np.divmod(ids.take(here), classes)
            each = np.arange(len(here))
            logits = h @ self.classes
            logits += self.class_bias
            got = logits[each, kind]
            got -= _log_sum(logits)
            edges = np.searchsorted(kind, np.arange(classes + 1)).tolist()
            for c, (a, z) in enumerate(zip(edges, edges[1:])):
                if a < z:
                    np.matmul(h[a:z], self.words[c], out=logits[a:z])
            logits += self.word_bias.take(kind, axis=0)
            got += logits[each, place]
            got -= _log_sum(logits)
            out[s + order] = got
        return out


def _order(ids: np.ndarray, below: int) -> np.ndarray:
    return np.argsort(ids.astype(np.uint16) if below <= 1 << 16 else ids, kind="stable")  # 16 bits go by radix


def _adam(m: np.ndarray, v: np.ndarray, g: np.ndarray, up: float, root: float) -> np.ndarray:
    """What a step takes off; moments m and v are brought up to date, and the gradient g is overwritten."""
    square = g * g
    square *= 0.001
    v *= 0.999
    v += square
    g *= 0.1
    m *= 0.9
    m += g
    np.sqrt(v, out=square)
    square *= root
    square += 1e-8
    np.divide(m, square, out=g)
    g *= up
    return g


def _summed(x: np.ndarray, of: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers in `of`, and the sums of the rows of x that have each: most have few, which are added rank by rank."""
    order = _order(of, below)
    of = of.take(order)
    begins = np.flatnonzero(np.diff(of, prepend=-1))
    sizes = np.diff(begins, append=len(of))
    out = x.take(order.take(begins), axis=0)
    many = np.flatnonzero(sizes > 1)
    for j in range(1, RANKS):
        out[many] += x.take(order.take(begins.take(many) + j), axis=0)
        many = many[sizes.take(many) > j + 1]
    if len(many):
        n = sizes.take(many) - RANKS
        starts = np.cumsum(n) - n
        rest = np.arange(n.sum()) + np.repeat(begins.take(many) + RANKS - starts, n)
        out[many] += np.add.reduceat(x.take(order.take(rest), axis=0), starts)
    return of.take(begins), out


def _shifted(x: np.ndarray) -> np.ndarray | None:
    """The largest of each row, which is taken off in place if exponentials could leave the range of numbers."""
    if x.max() < 60 and x.min() > -60:
        return None
    top = x.max(-1, keepdims=True)
    x -= top
    return top


def _log_sum(x: np.ndarray) -> np.ndarray:
    """Of each row; x is overwritten."""
    top = _shifted(x)
    np.exp(x, out=x)
    out = np.log(x @ np.ones(x.shape[-1], x.dtype))
    return out if top is None else out + top[:, 0]


def _softmax(x: np.ndarray) -> np.ndarray:
    """Over the last axis, in place."""
    _shifted(x)
    np.exp(x, out=x)
    x /= (x @ np.ones(x.shape[-1], x.dtype))[..., None]
    return x


def _rows(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(text), F.lit("")).alias("t"))


class Vocabulary(NamedTuple):
    words: list[bytes]
    totals: np.ndarray  #: tokens of each bucket
    known: tuple[np.ndarray, np.ndarray]  #: hashes of words outside the vocabulary, in order, and their counts
    rare: DataFrame  #: h, n of the others that were met twice or more
    tokens: int


class Model(NamedTuple):
    words: list[bytes]
    state: tuple
    totals: np.ndarray
    known: tuple[np.ndarray, np.ndarray]
    rare: DataFrame


def _chunks(batches, size: int):
    """(ids, places) of about CHUNK tokens each."""
    held, tokens = [], 0
    for b in batches:
        for raw in b.column("ids").to_pylist():
            held.append(raw)
            tokens += len(raw) // np.dtype(id_type(size)).itemsize
            if tokens >= CHUNK:
                yield padded_ids(held, size)[:2]
                held, tokens = [], 0
    if held:
        yield padded_ids(held, size)[:2]


def _epoch(rows: DataFrame, size: int, state: tuple, batch: int, seed: int) -> tuple:
    """The state after each task's pass over its texts (ids below size), averaged by tokens."""
    shared = rows.sparkSession.sparkContext.broadcast(state)

    def train(batches):
        network = Network.of(tuple(p.copy() for p in shared.value))
        tokens = network.train(_chunks(batches, size), batch, seed=seed)
        if tokens:
            flat = np.concatenate([p.ravel() for p in network.state()])
            blocks = [flat[s : s + BLOCK].tobytes() for s in range(0, len(flat), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks), dtype=np.int32)), pa.array(np.full(len(blocks), tokens)), pa.array(blocks, pa.binary())], ["block", "tokens", "raw"])

    def mean(table: pa.Table) -> pa.Table:
        total, tokens = 0.0, 0
        for n, raw in sorted(zip(table.column("tokens").to_pylist(), table.column("raw").to_pylist())):
            total, tokens = total + n * np.frombuffer(raw, np.float32).astype(np.float64), tokens + n
        return pa.table({"block": table.column("block")[:1], "raw": pa.array([(total / tokens).astype(np.float32).tobytes()], pa.binary())})

    trained = materialize(rows.mapInArrow(train, "block int, tokens long, raw binary"), "network")
    found = trained.groupBy("block").applyInArrow(mean, "block int, raw binary").collect()
    shared.unpersist()
    if not found:
        return state
    flat = np.frombuffer(b"".join(bytes(r.raw) for r in sorted(found, key=lambda r: r.block)), np.float32)
    ends = np.cumsum([p.size for p in state])
    return tuple(x.reshape(p.shape) for x, p in zip(np.split(flat, ends[:-1]), state))


def _vocabulary(docs: DataFrame, text: str) -> Vocabulary:
    counts = materialize(word_counts(_rows(docs, text)), "words")
    sizes = sorted(((r.n, r.k) for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    total = sum(n * k for n, k in sizes)
    n_words = max(FIRST, sum(k for n, k in sizes if n >= LEAST and n * SHARE >= total))
    words = [bytes(r.word) for r in counts.orderBy(F.desc("n"), "word").limit(n_words).collect()]
    listed = docs.sparkSession.createDataFrame([(w,) for w in words], "word binary")
    outside = materialize(counts.join(F.broadcast(listed), "word", "left_anti").select("h", "n"), "outside")
    totals = np.zeros(BUCKETS, np.int64)
    for r in outside.groupBy(F.pmod("h", F.lit(BUCKETS)).alias("bucket")).agg(F.sum("n").alias("n")).collect():
        totals[r.bucket] = r.n
    # The least count of those broadcast: words of this count or more are KNOWN at most, without the vocabulary.
    least, held = (sizes[0][0] if sizes else 0) + 1, -len(words)
    for n, k in sizes:
        held += k
        if held > KNOWN or n < 2:
            break
        least = n
    known = outside.filter(F.col("n") >= least).toArrow().combine_chunks()
    h, n = known.column("h").to_numpy(), known.column("n").to_numpy()
    order = np.argsort(h)
    return Vocabulary(words, totals, (h[order], n[order]), outside.filter((F.col("n") >= 2) & (F.col("n") < least)), total)


def _read(docs: DataFrame, words: list[bytes], totals: np.ndarray, known: tuple, key: str, text: str) -> DataFrame:
    """key, row, n_tokens, ids (binary), extra (the shares of words outside the vocabulary, as far as known), rare (hashes of the others).

    Written once, so that texts are split and their words looked up once for all that follows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((words, totals, known))

    def run(batches):
        words, totals, (known, counts) = shared.value
        store = worker_cache()
        if store.get("lm", (None,))[0] is not shared.value:
            store["lm"] = (shared.value, Codes(words))
        codes = store["lm"][1]
        for b in batches:
            for s in range(0, b.num_rows, 200):
                c = b.slice(s, 200)
                split = [words_of(t) for t in c.column("t").to_pylist()]
                sizes = np.fromiter(map(len, split), np.int64, len(split))
                ids = np.fromiter(map(codes.__getitem__, chain.from_iterable(split)), np.uint64, sizes.sum())
                out = np.flatnonzero(ids >= codes.size)
                h = ids[out]
                bucket = (h % np.uint64(BUCKETS)).astype(np.int64)
                ids[out] = codes.size - BUCKETS + bucket
                ids = ids.astype(id_type(codes.size))
                share, h = -np.log1p(totals[bucket]), h.view(np.int64)
                place = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
                hit = known[place] == h if len(known) else np.zeros(len(h), bool)
                share[hit] += np.log(counts[place[hit]])
                starts = np.concatenate([[0], np.cumsum(sizes)])
                extra = np.diff(np.concatenate([[0], np.cumsum(share)])[np.searchsorted(out, starts)])
                raw = pa.Array.from_buffers(pa.binary(), len(split), [None, pa.py_buffer((starts * ids.itemsize).astype(np.int32)), pa.py_buffer(ids)])
                rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(out[~hit], starts), pa.int32()), pa.array(h[~hit]))
                yield pa.RecordBatch.from_arrays([c.column("key"), pa.array(sizes), raw, pa.array(extra), rare], ["key", "n_tokens", "ids", "extra", "rare"])

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    read = rows.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, n_tokens long, ids binary, extra double, rare array<long>")
    return materialize(read.withColumn("row", F.monotonically_increasing_id()), "read")


def _trained(read: DataFrame, vocabulary: Vocabulary, epochs: int) -> Model:
    words, totals, known, rare, total = vocabulary
    state, tasks = Network(classes_of(len(words))).state(), max(1, total // TASK_TOKENS)
    for e in range(epochs if total else 0):
        state = _epoch(read.select("ids").coalesce(int(tasks)), classes_of(len(words)) ** 2, state, BATCH, 5 + e)
    return Model(words, state, totals, known, rare)


def _scored(read: DataFrame, model: Model, key: str) -> DataFrame:
    shared, size = read.sparkSession.sparkContext.broadcast(model.state), classes_of(len(model.words)) ** 2

    def run(batches):
        network = Network.of(shared.value)
        for b in batches:
            for s in range(0, b.num_rows, 200):
                c = b.slice(s, 200)
                ids, at, sizes = padded_ids(c.column("ids").to_pylist(), size)
                each = network.log_probabilities(ids, at).astype(np.float64)
                sums = np.diff(np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(sizes)])])
                yield pa.RecordBatch.from_arrays([c.column("key"), c.column("row"), c.column("n_tokens"), pa.array(sums + c.column("extra").to_numpy())], ["key", "row", "n_tokens", "part"])

    parts = read.select("key", "row", "n_tokens", "ids", "extra").mapInArrow(run, f"key {read.schema['key'].dataType.simpleString()}, row long, n_tokens long, part double")
    more = read.select("row", F.explode("rare").alias("h")).join(model.rare, "h").groupBy("row").agg(F.sum(F.log("n")).alias("more"))
    out = parts.join(more, "row", "left").withColumn("sum", F.col("part") + F.coalesce("more", F.lit(0.0)))
    return out.select(F.col("key").alias(key), "n_tokens", F.col("sum").alias("log_likelihood"), (F.col("sum") / F.greatest("n_tokens", F.lit(1))).alias("mean_log_probability"))


def fit(docs: DataFrame, text: str = "text", epochs: int = 2) -> Model:
    """Vocabulary and counts from all texts, and the state of the network trained on all texts."""
    vocabulary = _vocabulary(docs, text)
    return _trained(_read(docs.select(F.lit(0).alias("k"), F.col(text).alias("t")), *vocabulary[:3], "k", "t"), vocabulary, epochs)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, log_likelihood (summed), mean_log_probability."""
    return _scored(_read(docs, model.words, model.totals, model.known, key, text), model, key)


def fit_and_score(docs: DataFrame, key: str = "doc_id", text: str = "text", epochs: int = 2) -> DataFrame:
    """score(docs, fit(docs)), for which the texts are read once."""
    vocabulary = _vocabulary(docs, text)
    read = _read(docs, *vocabulary[:3], key, text)
    return _scored(read, _trained(read, vocabulary, epochs), key)
