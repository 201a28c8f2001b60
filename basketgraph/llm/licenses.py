"""Licence scan by diagonal voting.

Each text is a row of words; every pair of neighbouring words is hashed and joined to the places of the same pair in
the templates. A match votes for the diagonal (place in the text less place in the template). Neighbouring diagonals
of a template, up to `slack` words apart as words are put in or left out, are merged, and the merged span is verified:
its matches must cover `cover` of the template's pairs, each counted once, within a stretch not much longer than the
template. Phrases count where all their pairs lie on one diagonal, which is where their words stand consecutively.

Templates are constants (a few hundred pairs), so the join broadcasts them whatever the input's size.

Edge cases: null text counts as empty, with no words and no labels; repeated rows give a row each; texts of any
length give one row; other columns are left out; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from basketgraph.llm.common import gram_hashes, word_hashes

#: Phrases that count wherever their words stand consecutively.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Licence notices as they stand in texts, with the label that a notice gives.
TEMPLATES = [
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may obtain a copy of the license at http www apache org licenses license 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
]
COVER, SLACK = 0.7, 3
#: A-Z to a-z, every other ASCII character but letters and digits to a space.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split()


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _grams(batches):
    """A row for each pair of words of each text, and one with a null hash that holds the number of words."""
    for whole in batches:
        for s in range(0, whole.num_rows, 250):
            b = whole.slice(s, 250)
            split = [words_of(t) for t in b.column("t").to_pylist()]
            sizes = np.array([len(x) for x in split])
            hashed = word_hashes([w for x in split for w in x])
            ends = np.cumsum(sizes)
            pairs = gram_hashes(hashed, 2)
            own = np.ones(len(hashed), bool)  # a pair lies within one text
            own[ends[sizes > 0] - 1] = False
            of = np.repeat(np.arange(len(split)), sizes)
            at = np.arange(len(hashed)) - np.repeat(ends - sizes, sizes)
            of, at, pairs = of[own], at[own], pairs[own[: len(pairs)]]
            rows = pa.array(np.concatenate([of, np.arange(len(split))]), pa.int32())
            places = pa.array(np.concatenate([at, sizes]), pa.int32())
            gram = pa.array(np.concatenate([_signed(pairs), np.zeros(len(split), np.int64)]), mask=np.concatenate([np.zeros(len(pairs), bool), np.ones(len(split), bool)]))
            yield pa.RecordBatch.from_arrays([b.column("row").take(rows), b.column("key").take(rows), places, gram], ["row", "key", "at", "gram"])


def template_rows(templates, phrases) -> list[tuple]:
    """(gram, template, place, pairs in it, label, is a phrase)"""
    out = []
    for i, (text, label, phrase) in enumerate([*((t, lab, True) for t, lab in phrases.items()), *((t, lab, False) for t, lab in templates)]):
        grams = _signed(gram_hashes(word_hashes(words_of(text)), 2)).tolist()
        out += [(g, i, j, len(grams), label, phrase) for j, g in enumerate(grams)]
    return out


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES, phrases=PHRASES, cover: float = COVER, slack: int = SLACK) -> DataFrame:
    """key, n_words, spans: array of (label, start, end, coverage, phrase), in order of start."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("row", F.monotonically_increasing_id())
    grams = rows.mapInArrow(_grams, f"row long, key {kind}, at int, gram long")
    known = spark.createDataFrame([*template_rows(templates, phrases), (None, -1, 0, 0, None, False)], "t_gram long, template int, place int, pairs int, label string, phrase boolean")
    votes = grams.join(F.broadcast(known), F.col("gram").eqNullSafe(F.col("t_gram")))
    by_row = votes.repartition("row")
    diagonals = by_row.groupBy("row", "key", "template", "label", "pairs", "phrase", (F.col("at") - F.col("place")).alias("diagonal")).agg(F.count(F.lit(1)).alias("votes"), F.min("at").alias("first"), F.max("at").alias("last"), F.collect_set("place").alias("places"))
    # Diagonals of a notice that lie within slack words of the one before, in order, make one span.
    order = W.partitionBy("row", "template").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(order)
    near = diagonals.withColumn("span", F.sum(F.when(F.col("phrase") | step.isNull() | (step > slack), 1).otherwise(0)).over(order))
    spans = near.groupBy("row", "key", "template", "label", "pairs", "phrase", "span").agg(F.min("first").alias("start"), F.max("last").alias("last"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("covered"), F.min("diagonal").alias("diagonal"))
    share = F.col("covered") / F.col("pairs")
    true = F.when(F.col("phrase"), F.col("covered") == F.col("pairs")).otherwise((share >= cover) & (F.col("last") - F.col("start") <= 1.5 * F.col("pairs") + slack))
    span = F.struct("start", (F.col("last") + 1).alias("end"), "label", "phrase", share.alias("coverage"))
    found = spans.groupBy("row", "key").agg(F.max(F.when(F.col("template") == -1, F.col("diagonal"))).cast("long").alias("n_words"), F.array_sort(F.collect_list(F.when((F.col("template") >= 0) & true, span))).alias("spans"))
    return found.select(F.col("key").alias(key), "n_words", "spans")
