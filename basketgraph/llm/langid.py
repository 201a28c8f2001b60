"""Language identification by character language models with interpolated Kneser-Ney smoothing.

A model for each language over the characters of words, each word after four and before one boundary mark. Counts
come from at most `max_chars` characters a language, whole documents picked by a hash of their text. For each order
the n-grams of all languages stand in one sorted array of hashes beside a row of probabilities (a column a
language), and contexts in another beside their interpolation weights; both are found by binary search. A text goes
to the language of lowest cross-entropy a character. It is rejected where that is far above what held-back training
documents show, with slack for short texts, or where it has no letter.

Edge cases: null texts and texts without a letter are `und`, score 0, rejected; labels that are null teach nothing;
ties go to the first language by name; repeated rows give a row each; with no training rows everything is `und`;
other columns are left out; texts of any length are read whole, 20,000 words at a time, so the longest word bounds memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketgraph.llm.common import mix, worker_cache

ORDER, MAX_CHARS, ALPHABET = 5, 1_500_000, 512
PAD, LETTERS = " ", r"\p{L}[\p{L}\p{M}]*"
UNDETERMINED = "und"


def codes_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ORDER characters, one for each predicted character, and where each word's windows begin."""
    text = "".join([PAD * (ORDER - 1) + w + PAD for w in words])
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    ends = np.repeat(np.arange(len(words)) * (ORDER - 1), sizes) + np.arange(sizes.sum())
    return np.lib.stride_tricks.sliding_window_view(codes, ORDER)[ends], begins


def hashes(windows: np.ndarray) -> np.ndarray:
    h = np.full(len(windows), windows.shape[1], np.uint64)
    for j in range(windows.shape[1]):
        h = h * np.uint64(0x9E3779B97F4A7C15) + windows[:, j].astype(np.uint64) + np.uint64(1)
    return mix(h)


def kneser_ney(windows: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """For each order from 1: hashes of n-grams, their discounted share, hashes of contexts, their weight."""
    out, grams, count = [], windows, counts.astype(np.float64)
    for m in range(ORDER, 0, -1):
        ones, twos = (count == 1).sum(), (count == 2).sum()
        d = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
        contexts, of = np.unique(hashes(grams[:, :-1]) if m > 1 else np.zeros(len(grams), np.uint64), return_inverse=True)
        total, kinds = np.bincount(of, count), np.bincount(of)
        out.append((hashes(grams), np.maximum(count - d, 0) / total[of], contexts, d * kinds / total))
        if m > 1:  # a lower order counts the distinct characters before it
            _, first, count = np.unique(hashes(grams[:, 1:]), return_index=True, return_counts=True)
            grams, count = grams[first, 1:], count.astype(np.float64)
    return out[::-1]


def _merged(keys: list[np.ndarray], values: list[np.ndarray], rest: float) -> tuple[np.ndarray, np.ndarray]:
    all_keys = np.unique(np.concatenate(keys))
    table = np.full((len(all_keys) + 1, len(keys)), rest, np.float32)
    for i, (k, v) in enumerate(zip(keys, values)):
        table[np.searchsorted(all_keys, k), i] = v
    return all_keys, table  # its last row is for what is not found


def _found(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, len(keys))


class Model:
    def __init__(self, languages: list[str], orders: list[list[tuple]]):
        self.languages, self.tables = languages, []
        for m in range(ORDER):
            own = [o[m] for o in orders]
            self.tables.append((*_merged([x[0] for x in own], [x[1] for x in own], 0), *_merged([x[2] for x in own], [x[3] for x in own], 1)))
        self.usual, self.spread = 0.0, 0.0

    @classmethod
    def of(cls, state: tuple) -> Model:
        self = cls.__new__(cls)
        self.languages, self.tables = state
        return self

    def of_words(self, words: list[str]) -> np.ndarray:
        """Minus log-probability of each word in each language, and last the number of characters."""
        windows, begins = codes_of(words)
        p = np.full((len(windows), len(self.languages)), 1 / ALPHABET, np.float32)
        for m, (grams, share, contexts, weight) in enumerate(self.tables, 1):
            own = windows[:, ORDER - m :]
            at = _found(contexts, hashes(own[:, :-1]) if m > 1 else np.zeros(len(own), np.uint64))
            p = share[_found(grams, hashes(own))] + weight[at] * p
        out = np.add.reduceat(-np.log(p), begins, axis=0)
        return np.column_stack([out, np.diff(np.append(begins, len(windows)))]).astype(np.float32)


class ChunkScores:
    """What each run of non-space characters adds to the scores of a text; holds up to `limit` of them."""

    def __init__(self, model: Model, limit: int = 400_000):
        self.model, self.limit, self.at = model, limit, {}
        self.rows = np.zeros((1024, len(model.languages) + 1), np.float32)

    def texts(self, texts: list[str]) -> np.ndarray:
        import regex

        split = [t.lower().split() for t in texts]
        if len(self.at) > self.limit:
            self.at = {}
        new = list({c for s in split for c in s if c not in self.at})
        words, of = [], []
        for i, c in enumerate(new):
            for w in [c] if c.isascii() and c.isalpha() else regex.findall(LETTERS, c):
                words.append(w)
                of.append(i)
        first = len(self.at)
        while first + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[first : first + len(new)] = 0
        for s in range(0, len(words), 20_000):
            np.add.at(self.rows, first + np.array(of[s : s + 20_000]), self.model.of_words(words[s : s + 20_000]))
        self.at.update(zip(new, range(first, first + len(new))))
        get = self.at.__getitem__
        return np.array([self.rows[np.fromiter(map(get, s), np.int64, len(s))].sum(0, dtype=np.float64) for s in split])


def _counted(batches, label: str):
    """Distinct words of each batch with their label and count."""
    from collections import Counter

    import regex

    for b in batches:
        got: Counter = Counter()
        for lab, t in zip(b.column(label).to_pylist(), b.column("t").to_pylist()):
            got.update((lab, w) for w in regex.findall(LETTERS, t.lower()))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in got], pa.string()), pa.array([k[1] for k in got], pa.string()), pa.array(list(got.values()), pa.int64())], ["label", "word", "n"])


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", max_chars: int = MAX_CHARS) -> Model | None:
    """A model from rows with a text and a label; of each label about max_chars characters at most are read."""
    rows = labelled.select(F.col(text).alias("t"), F.col(label).cast("string").alias("label")).dropna()
    sizes = rows.groupBy("label").agg(F.sum(F.length("t")).alias("n")).filter("n > 0").toPandas()
    if sizes.empty:
        return None
    share = F.create_map(*[x for lab, n in zip(sizes.label, sizes.n) for x in (F.lit(lab), F.lit(min(1.0, max_chars / float(n))))])
    rows = rows.withColumn("pick", F.pmod(F.xxhash64("t"), F.lit(1_000_000)))
    rows = rows.filter(F.col("pick") < share[F.col("label")] * 1_000_000)
    held = F.pmod(F.xxhash64(F.lit(1), "t"), F.lit(5)) == 0
    words = rows.filter(~held).select("t", "label").mapInArrow(lambda bs: _counted(bs, "label"), "label string, word string, n long").groupBy("label", "word").agg(F.sum("n").alias("n")).toPandas()
    languages, orders = [], []
    for lab, own in sorted(words.groupby("label"), key=lambda x: x[0]):
        windows, begins = codes_of(own.word.tolist())
        n = np.repeat(own.n.to_numpy(), np.diff(np.append(begins, len(windows))))
        _, first, of = np.unique(hashes(windows), return_index=True, return_inverse=True)
        languages.append(lab)
        orders.append(kneser_ney(windows[first], np.bincount(of, n)))
    if not languages:
        return None
    model = Model(languages, orders)
    shared = labelled.sparkSession.sparkContext.broadcast((model.languages, model.tables))
    seen = rows.filter(held).select("t").mapInArrow(lambda bs: _scored(bs, shared.value, "t", []), "best double, n long, lang_pred string, score double").filter("n >= 40").agg(F.avg("best"), F.expr("percentile(abs(best), 0.99)"), F.stddev_samp((F.col("best")) * F.sqrt("n"))).first()
    # With no text held back that is long enough there is no usual figure: only texts without a letter are rejected.
    usual = seen[1] if seen[1] is not None else seen[0]
    model.usual, model.spread = float("inf") if usual is None else float(usual), min(2.0, float(seen[2] or 0))
    shared.unpersist()
    return model


def _scored(batches, state: tuple, text: str, keep: list[str]):
    store = worker_cache()
    if store.get("langid", (None,))[0] is not state:
        store.clear()  # what stages before have kept
        store["langid"] = (state, ChunkScores(Model.of(state)))
    model, scores = Model.of(state), store["langid"][1]
    for whole in batches:
        for s in range(0, whole.num_rows, 500):
            b = whole.slice(s, 500)
            sums = scores.texts([t or "" for t in b.column(text).to_pylist()])
            n = sums[:, -1]
            each = sums[:, :-1] / np.maximum(n, 1)[:, None]
            best = each.argmin(1)
            lead = np.exp(-(each - each.min(1, keepdims=True)) * np.minimum(n, 50)[:, None])
            names = np.where(n > 0, np.array(model.languages, object)[best], UNDETERMINED)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(each.min(1)), pa.array(n.astype(np.int64)), pa.array(names, pa.string()), pa.array(np.where(n > 0, 1 / lead.sum(1), 0))], [*keep, "best", "n", "lang_pred", "score"])


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score, cross_entropy (nats a character), rejected."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("t"))
    kind = docs.schema[key].dataType.simpleString()
    if model is None:
        return rows.select(F.col("key").alias(key), F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("cross_entropy"), F.lit(True).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.tables))
    out = rows.mapInArrow(lambda bs: _scored(bs, shared.value, "t", ["key"]), f"key {kind}, best double, n long, lang_pred string, score double")
    limit = F.lit(model.usual + 0.5) + F.lit(8 * model.spread) / F.sqrt(F.greatest("n", F.lit(1)))
    return out.select(F.col("key").alias(key), "lang_pred", "score", F.col("best").alias("cross_entropy"), ((F.col("n") == 0) | (F.col("best") > limit)).alias("rejected"))
