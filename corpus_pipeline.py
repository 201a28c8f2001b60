"""A corpus pipeline: each stage takes the documents that the one before kept.

quality rules -> language ID -> one of each group of near copies -> repeated passages cut out -> packing. All stages
but the last return the columns of documents, and further ones that it has, whatever their names.

Edge cases: a row is judged by its own text, so null or repeated ids share no decision; null and empty texts are
rejected by the quality rules; of repeated rows one stays after the near copies; texts of any length are read whole;
the smallest id of a group stays (ties: by the row's name); an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketgraph.llm import jaccard, langid, packing, quality, suffix
from basketgraph.llm.common import documents, materialize
from basketgraph.llm.queries import _fold, tokenizer_path


ROW = "__row"  # a name of id and text
#: Bytes of a repeated passage that goes (fewer than 50 words have), and of the strings that deal it to shards.
PASSAGE, PASSAGE_GRAMS = 200, (40, 176)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their lines above the limit of their host. n_chars follows the text."""
    return quality.cleaned(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence; lang is left as it is."""
    model = langid.fit(docs.filter(_fold(4) != 2).select("text", "lang"))
    named = docs.withColumn(ROW, jaccard.row_name("doc_id", "text"))
    rejected = langid.predict(named, model, key=ROW).filter("rejected").select(ROW).distinct()
    return named.join(rejected, ROW, "left_anti").select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id (none before a null id) of each group of near copies, once; rows that only share an id are no group."""
    found = materialize(jaccard.row_components(docs), "found")
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "id"))
    chosen = found.groupBy("component").agg(first.alias("first")).select(F.col("first.id").alias(ROW))
    named = docs.withColumn(ROW, jaccard.row_name("doc_id", "text"))
    return named.join(chosen, ROW, "left_semi").dropDuplicates([ROW]).select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of PASSAGE bytes or more that stand elsewhere too; a character cut through goes wholly. n_chars follows the text."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    out = suffix.deduplicate(docs, columns=tuple(rest), as_text=True, length=PASSAGE, grams=PASSAGE_GRAMS)
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return out.select(*[new.get(c, F.col("more").getField(c)).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    return packing.pack(packing.pieces(docs, tokenizer_path("word_bpe_49k.json")), docs.count())


STAGES = [("quality rules", quality_rules), ("language ID", language_id), ("near copies", near_copies), ("repeated passages", repeated_passages), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
