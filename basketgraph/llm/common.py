"""What the text operators share: the shared folder, worker caches, word hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators by contract: space and \t \n \v \f \r, which is what bytes.split() uses.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; where it is unset on one machine (tests), a new local folder."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="basketgraph-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """What runs within gets its Arrow batches in `rows` rows at most, so workers and Spark's buffers for them stay small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Keys of at least this share of all rows are hot: there are no more than its inverse.
HOT = 0.001


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int | None = None) -> DataFrame:
    """rows left join table, whose keys are unique and whose `count` says how many rows have them.

    Keys of HOT of all rows or more, 1,000 at most, are broadcast; a row that found its key there, or has none, is given
    another for the join by shuffle, so no task gets more rows of one key than that share.
    """
    if total is None:
        total = table.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) >= max(1.0, HOT * total)
    rest = [c for c in table.columns if c not in (*keys, count)]
    first = F.broadcast(table.filter(hot).select(*keys, F.struct(*rest).alias("_hot")))
    found = rows.join(first, keys, "left")
    lone = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys], F.col("_hot").isNotNull())
    spread = F.when(lone, F.monotonically_increasing_id())
    found = found.withColumn("_spread", F.coalesce(spread, F.lit(-1)))
    second = table.filter(~hot).select(*keys, F.struct(*rest).alias("_cold"), F.lit(-1).cast("long").alias("_spread"))
    found = found.join(second, [*keys, "_spread"], "left").drop("_spread")
    return found.select(*rows.columns, *[F.coalesce(F.col("_hot").getField(c), F.col("_cold").getField(c)).alias(c) for c in rest])


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, whichever task runs in it."""
    import pyspark

    return pyspark.__dict__.setdefault("_basketgraph_cache", {})


def cached(key, make, alone: bool = False):
    """What make() gives, kept by the worker. With alone, for large tables, all else that is kept goes first: it is of stages before."""
    store = worker_cache()
    if key not in store:
        if alone:
            store.clear()
        store[key] = make()
    return store[key]


class WordHashes(dict):
    """bytes -> unsigned 64-bit hash. Holds at most `limit` words; the hash of any other is computed each time."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.limit:
            self[word] = h
        return h


def word_hashes(words: list[bytes]) -> np.ndarray:
    table = cached("words", WordHashes, alone=True)
    return np.fromiter(map(table.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits (finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEPARATES = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", np.uint8))
#: A random number for each byte (of A-Z those of a-z), the base of the polynomial and its inverse modulo 2^64.
_BYTES = mix(np.frombuffer(LOWER, np.uint8).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n - 1) modulo 2^64; what the worker has of a longer text is used again."""
    store = worker_cache()
    have = store.get(("powers", base))
    if have is None or len(have) < n:
        size = max(1 << 14, 1 << (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 18:  # 2 MB
            store["powers", base] = have
    return have[:n]


def text_hashes(text: str) -> np.ndarray:
    """A hash for each word of a text with A-Z in lower case: a polynomial of its bytes, from sums over the whole text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    edge = np.flatnonzero(np.diff(_SEPARATES[raw], prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * _powers(_BASE, len(raw)), out=sums[1:])
    return mix((sums[end] - sums[start]) * _powers(_INVERSE, len(raw))[start] + (end - start).astype(np.uint64))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, from the hashes of the words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
    return mix(out)
