"""Queries of the text operators with their production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketgraph.llm import align, ann, bpe, jaccard, langid, licenses, lmscore, packing, quality, suffix, toxicity, trie, warc
from basketgraph.llm.common import documents, materialize


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), decode=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.fit_and_score(documents(spark, sf_dir))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.neighbours(table, F.col("vec_id") % 20 == 0)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return packing.pack(packing.pieces(docs, tokenizer_path("word_bpe_49k.json")), docs.count())


def _fold(modulus: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.deduplicate(documents(spark, sf_dir))
    return out.select("doc_id", F.col("text_bytes").alias("n_bytes"), (F.col("text_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(_fold(3) != 1).select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs.select("doc_id", "text").join(labels, "doc_id"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", (_fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, labels = F.filter("spans", lambda x: x["phrase"]), lambda spans: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(spans, lambda x: x["label"]))))
    starts = F.transform(base, lambda x: x["start"].cast("long"))
    return licenses.scan(documents(spark, sf_dir)).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda x: x["coverage"])), F.lit(0.0)).alias("score"),
    )  # fmt: skip


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs.filter(_fold(4) != 2).select("text", "lang"))
    out = langid.predict(docs, model)
    return out.select("doc_id", (_fold(4) == 2).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "html", "url")
    return records.select(F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"), "error")


#: Base32 of a digest: each 5 hexadecimal digits are 4 letters.
WARC_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY 1)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to, CAST(NULL AS VARCHAR) AS error FROM p JOIN f USING (h)"""


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: CRC-32 by bits: a byte goes in, then eight shifts (-1), over the characters of an id.
CRC_SQL = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END))"
TRIE_SQL = rf"""WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list(struct_pack(r := r, x := x) ORDER BY pos) AS turns FROM t GROUP BY 1), k AS (SELECT c, turns, c - c % 20 AS base, {CRC_SQL.format("c")} % 4 AS h FROM o),
b AS (SELECT k.c, list_concat(coalesce(o.turns[1:h], []), k.turns[h + 1:]) AS seq FROM k LEFT JOIN o ON o.c = k.base),
p AS (SELECT c, d, seq[1:d] AS pre, len(seq) AS n FROM (SELECT c, seq, unnest(range(0, len(seq) + 1)) AS d FROM b)),
v AS (SELECT d, pre, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c, ',' ORDER BY c) FILTER (WHERE n = d), '') AS ends FROM p GROUP BY 1, 2),
ch AS (SELECT d - 1 AS d, pre[1:d - 1] AS pre, count(*) AS n FROM v WHERE d > 0 GROUP BY 1, 2),
w AS (SELECT v.d, v.pre, conv_id, n_convs, ends, coalesce(ch.n, 0) AS n_children, CASE WHEN v.d > 0 THEN (n_convs - 1) * len(list_filter(regexp_split_to_array(v.pre[v.d].x, '[ 	-]+'), lambda y: y <> '')) ELSE 0 END AS own FROM v LEFT JOIN ch ON ch.d = v.d AND ch.pre = v.pre),
s AS (SELECT a AS d, pre[1:a] AS pre, sum(own) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves FROM (SELECT pre, own, n_children, unnest(range(0, d + 1)) AS a FROM w) GROUP BY 1, 2)
SELECT w.conv_id, w.d AS depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(w.ends) AS ends_sha256
FROM w JOIN s ON s.d = w.d AND s.pre = w.pre LEFT JOIN w u ON u.d = w.d - 1 AND u.pre = w.pre[1:w.d - 1]"""


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = materialize(align.align(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), digest=True), "aligned")
    out = align.scored(found, materialize(align.pair_counts(found), "counts"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


QUERIES = {"op1_bpe": op1_bpe, "op2_suffix_dedup": op2_suffix_dedup, "op3_toxicity": op3_toxicity, "op4_lm_score": op4_lm_score, "op5_nearest": op5_nearest, "op6_packing": op6_packing, "op7_licenses": op7_licenses, "op8_jaccard_join": op8_jaccard_join, "op9_language_id": op9_language_id, "op10_quality_rules": op10_quality_rules, "op11_warc": op11_warc, "op12_conversation_trie": op12_conversation_trie, "op13_alignment": op13_alignment}
SQL = {"op10_quality_rules": quality.oracle_sql(), "op11_warc": WARC_SQL, "op12_conversation_trie": TRIE_SQL}
