"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding: lower case, full-width and look-alike letters to Latin, digits and signs inside words to the letters they
stand for. The lexicon is learned: words and beginnings of words that documents labelled 1 hold far more often than
others, weighted by log-odds. A document's matches, those inside an exception phrase left out, are summed, also a
thousand words, and a logistic fit on labelled documents that the lexicon has not seen turns both sums into a score.
About `max_docs` distinct labelled texts at most are read, picked by a hash; all their terms of enough weight count.

Edge cases: an empty table gives an empty one; texts of any length are read whole, and of terms that begin at one place
the heaviest counts; null text counts as empty and scores as a text without matches; null labels teach nothing; without
labelled rows of both kinds every score is 0; repeated rows give a row each; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketgraph.llm.common import worker_cache

MAX_DOCS, MIN_DOCS, MIN_WEIGHT, SHORTEST, LONGEST = 30_000, 4, 3.0, 4, 12
#: Letters of other scripts that look like Latin ones, and what digits and signs stand for in words.
LOOKALIKE = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ո": "n", "ս": "u", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ο": "o", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "τ": "t", "υ": "u", "ε": "e", "χ": "x", "ı": "i", "ɡ": "g", "ɑ": "a"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
#: Phrases in which a term of the lexicon is harmless.
EXCEPTIONS = ("trash can", "trash bin", "class clown", "clown fish", "clown car", "idiot proof", "pond scum", "scum line")
FULL_WIDTH = {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
TABLE = str.maketrans(FULL_WIDTH | LOOKALIKE | {"​": None, "‌": None, "‍": None, "­": None})
DIGIT_TABLE = str.maketrans(DIGITS)


def fold(text: str) -> str:
    import re

    text = text.lower()
    if not text.isascii() and re.search(_odd(), text):
        text = text.translate(TABLE)
    inside = r"(?<=[a-z])[0134578@$]+(?=[a-z])|(?<![\w])[0134578@$](?=[a-z]{2})|(?<=[a-z]{2})[0134578@$!](?![\w])"
    if re.search(r"[0134578@$!][a-z]|[a-z][0134578@$!]", text):
        text = re.sub(inside, lambda m: m.group().translate(DIGIT_TABLE) if m.group() != "!" else " ", text)
    return text


def _odd() -> str:
    return "[" + "".join(LOOKALIKE) + "​-‍­！-～]"


def _terms(batches):
    """Distinct words of each document, counted by label over a batch."""
    import re
    from collections import Counter

    for b in batches:
        got = (Counter(), Counter())
        for label, t in zip(b.column("label").to_pylist(), b.column("t").to_pylist()):
            got[label].update(set(re.findall(r"[^\W\d_]+", fold(t))))
        words = list(got[0] | got[1])
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([got[i][w] for w in words], pa.int64()) for i in (1, 0))], ["word", "bad", "good"])


class Lexicon:
    """Terms that end in "." are whole words, others are beginnings of words."""

    def __init__(self, terms: dict[str, float], exceptions=EXCEPTIONS):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        found: dict[str, list] = {}
        for t, w in terms.items():
            found.setdefault(t.rstrip("."), []).append((t.endswith("."), w))
        for e in exceptions:
            found.setdefault(e, []).append((None, 0.0))
        for word, kinds in found.items():
            self.automaton.add_word(word, (len(word), kinds))
        if found:
            self.automaton.make_automaton()

    def sums(self, text: str) -> tuple[float, float]:
        """Sum of the weights matched, each word by its best term; and that sum for a thousand words."""
        text = fold(text)
        hits: dict[int, float] = {}
        harmless = []
        for end, (n, kinds) in self.automaton.iter(text) if len(self.automaton) else ():
            at = end - n + 1
            if at and text[at - 1].isalpha():
                continue
            closed = end + 1 == len(text) or not text[end + 1].isalpha()
            for whole, weight in kinds:
                if whole is None:
                    harmless += [(at, end)] * closed
                elif closed or not whole:
                    hits[at] = max(hits.get(at, 0.0), weight)
        total = sum(w for at, w in hits.items() if not any(a <= at <= e for a, e in harmless))
        return total, 1000 * total / (1 + text.count(" ") + text.count("\n"))


def learn_terms(labelled: DataFrame) -> dict[str, float]:
    """Words and their beginnings with their log-odds, from rows of t and label."""
    words = labelled.mapInArrow(_terms, "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    n = labelled.groupBy("label").count().toPandas().set_index("label")["count"]
    if len(n) < 2:
        return {}
    begin = F.transform(F.sequence(F.lit(SHORTEST), F.greatest(F.lit(SHORTEST), F.least(F.length("word"), F.lit(LONGEST)))), lambda k: F.substring(F.col("word"), F.lit(1), k))
    terms = words.select(F.explode(F.concat(F.array(F.concat("word", F.lit("."))), F.when(F.length("word") >= SHORTEST, begin).otherwise(F.array().cast("array<string>")))).alias("term"), "bad", "good")
    terms = terms.groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).filter(F.col("bad") >= MIN_DOCS)
    weight = F.log((F.col("bad") + 0.5) / (float(n[1]) + 1)) - F.log((F.col("good") + 0.5) / (float(n[0]) + 1))
    best = terms.withColumn("weight", weight).filter(F.col("weight") >= MIN_WEIGHT).toPandas()
    kept: dict[str, float] = {}
    for term, w in sorted(zip(best.term, best.weight), key=lambda x: (len(x[0]), x[0])):
        word = term.rstrip(".")
        if max((kept.get(word[:k], -1.0) for k in range(SHORTEST, len(word) + 1)), default=-1.0) < w - 1.5:
            kept[term] = float(w)
    return kept


def _features(batches, state: tuple, keep: list[str]):
    store = worker_cache()
    if store.get("toxicity", (None,))[0] is not state:
        store["toxicity"] = (state, Lexicon(*state))
    lexicon = store["toxicity"][1]
    for b in batches:
        got = np.array([lexicon.sums(t) for t in b.column("t").to_pylist()]).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(got[:, 0]), pa.array(got[:, 1])], [*keep, "total", "rate"])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
    return w


def fit(labelled: DataFrame, text: str = "text", label: str = "label", max_docs: int = MAX_DOCS, exceptions=EXCEPTIONS) -> tuple:
    """(terms with weights, exceptions, coefficients of the score) from rows with a text and a label of 0 or 1."""
    rows = labelled.select(F.coalesce(F.col(text), F.lit("")).alias("t"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1))
    n = rows.count()
    rows = rows.filter(F.pmod(F.xxhash64("t"), F.lit(1_000_000)) < (1_000_000 * min(1.0, max_docs / max(1, n)))).dropDuplicates()
    held = F.pmod(F.xxhash64(F.lit(1), "t"), F.lit(3)) == 0
    terms = learn_terms(rows.filter(~held))
    if not terms:
        return {}, tuple(exceptions), None
    shared = labelled.sparkSession.sparkContext.broadcast((terms, tuple(exceptions)))
    seen = rows.filter(held).mapInArrow(lambda bs: _features(bs, shared.value, ["label"]), "label int, total double, rate double").toPandas()
    shared.unpersist()
    if seen.label.nunique() < 2:
        return terms, tuple(exceptions), None
    x = np.column_stack([np.ones(len(seen)), np.log1p(seen.total), np.log1p(seen.rate)])
    return terms, tuple(exceptions), _logistic(x, seen.label.to_numpy(float)).tolist()


def score(docs: DataFrame, model: tuple, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score, total (weights matched), rate (the same for a thousand words)."""
    terms, exceptions, fitted = model
    shared = docs.sparkSession.sparkContext.broadcast((terms, exceptions))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    out = rows.mapInArrow(lambda bs: _features(bs, shared.value, ["key"]), f"key {docs.schema[key].dataType.simpleString()}, total double, rate double")
    if fitted is None:
        return out.select(F.col("key").alias(key), F.lit(0.0).alias("score"), "total", "rate")
    z = F.lit(fitted[0]) + fitted[1] * F.log1p("total") + fitted[2] * F.log1p("rate")
    return out.select(F.col("key").alias(key), (1 / (1 + F.exp(-z))).alias("score"), "total", "rate")
