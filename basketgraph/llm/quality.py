"""Quality rules from word and line statistics and from how often lines recur in the documents of a host.

Only DataFrame functions. A line is normalised (lower case, digits to 0, outer white space off) and hashed; for each
host the distinct texts that hold it are counted, so exact copies of a document count once. Lines in more texts than
max(`line_docs`, `line_share` of the host's texts) count as removed, but for the document of smallest id that
holds them, which keeps its lines. A document with less than `keep_share` of its characters left is depleted.
quality() gives the figures, cleaned() the rows kept with the text that is left. A row is named by hashes of its id
and text and by its host, so rows that share an id, or have none, are judged each by their own.

Edge cases: null text has no words and fails the base rules; a null host is a host of its own; repeated rows give the
same result each; a null id gives a row with a null id; of documents that hold a line and have one id, that of the smaller
text hash keeps it; texts of any length are read whole, their words' hashes being an array of the row; other columns are
left out; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from basketgraph.llm.common import materialize

LINE_DOCS, LINE_SHARE, KEEP_SHARE = 5, 0.02, 0.2
SPACE, SPACES = r"[\x20\x09-\x0D]+", " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
ID, TEXT, HOST, GONE = "__id", "__text", "__host", "__gone"  # hashes that name a row, its host, and hashes of its lines above the limit


def _trim(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def _shifted(c: str, by: int) -> Column:
    """Hashes of all neighbours `by` apart; each application doubles the run of words that a hash stands for."""
    n = F.greatest(F.size(c) - by, F.lit(0))
    return F.zip_with(F.slice(c, F.lit(1), n), F.slice(c, F.lit(by + 1), n), lambda a, b: F.xxhash64(a, b))


def base_stats(docs: DataFrame, key: str, text: str, host: str) -> tuple[DataFrame, DataFrame]:
    """A row for each document: key, hashes that name it, counts and line hashes, written once for all that reads them; and ID, TEXT, hashes of its 8-word windows.

    The windows, which are larger than the text, have one reader and aren't written.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"))
    rows = rows.select("*", F.xxhash64("key").alias(ID), F.xxhash64("t").alias(TEXT), _trim(F.col("t")).alias("body"))
    rows = rows.withColumn("words", F.when(F.col("body") == "", F.array().cast("array<string>")).otherwise(F.split("body", SPACE)))
    lines = F.filter(F.split("t", "\n"), lambda x: _trim(x) != "")
    normal = F.split(F.translate(F.lower("t"), "123456789", "0" * 9), "\n")
    stats = rows.select(
        "key", "host", ID, TEXT,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.transform(normal, lambda x: F.struct(F.xxhash64(_trim(x)).alias("line"), F.length(_trim(x)).alias("chars"))).alias("normal"),
    )
    windows = rows.select(ID, TEXT, F.transform("words", lambda x: F.xxhash64(x)).alias("h1"))
    for name, of, by in (("h2", "h1", 1), ("h4", "h2", 2), ("h8", "h4", 4)):
        windows = windows.withColumn(name, _shifted(of, by)).drop(of)
    return materialize(stats, "stats"), windows


def repeated_words(windows: DataFrame) -> DataFrame:
    """ID, TEXT, n_repeat_words of the documents that hold a window twice."""
    # A condition inside the generator, not a filter: a filter would be pushed down and the hashes computed again in it.
    twice = F.when(F.size(F.array_distinct("h8")) < F.size("h8"), F.col("h8")).otherwise(F.array().cast("array<long>"))
    windows = windows.select(ID, TEXT, F.posexplode(twice).alias("at", "window"))
    same = W.partitionBy(ID, TEXT, "window")
    repeated = windows.withColumn("times", F.max("at").over(same) - F.min("at").over(same)).filter("times > 0")
    ahead = F.lead("at").over(W.partitionBy(ID, TEXT).orderBy("at"))
    return repeated.select(ID, TEXT, F.least(F.lit(8), F.coalesce(ahead - F.col("at"), F.lit(8))).alias("new")).groupBy(ID, TEXT).agg(F.sum("new").cast("long").alias("n_repeat_words"))


def removed_chars(stats: DataFrame, line_docs: int, line_share: float) -> DataFrame:
    """ID, TEXT, host, removed: characters of a document's lines that are above the limit of its host."""
    by_doc = lines_above(stats, line_docs, line_share).groupBy(ID, TEXT, "host", "line").agg(F.max("chars").alias("chars"), F.count(F.lit(1)).alias("times"))
    removed = by_doc.groupBy(ID, TEXT, "host").agg(F.sum(F.col("chars") * F.col("times")).alias("removed"))
    copies = stats.groupBy(ID, TEXT, "host").agg(F.count(F.lit(1)).alias("copies"))  # the lines of equal rows were added up
    return removed.join(copies, [ID, TEXT, "host"]).select(ID, TEXT, "host", (F.col("removed") / F.col("copies")).cast("long").alias("removed"))


def lines_above(stats: DataFrame, line_docs: int, line_share: float) -> DataFrame:
    """ID, TEXT, host, line, chars of each line of a document that is above the limit of its host."""
    lines = stats.select("key", "host", ID, TEXT, F.explode("normal").alias("x")).select("key", "host", ID, TEXT, "x.line", "x.chars").filter("chars > 0")
    order = F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("key"), F.col(TEXT).alias("of"))
    counts = lines.groupBy("host", "line").agg(F.count_distinct(TEXT).alias("texts"), F.min(order).alias("first")).filter(F.col("texts") > line_docs)
    hosts = stats.groupBy("host").agg(F.count_distinct(TEXT).alias("host_texts"))
    above = counts.join(hosts, "host").filter(F.col("texts") > line_share * F.col("host_texts")).select("host", "line", "first")
    return lines.join(above, ["host", "line"]).filter(order != F.col("first")).select(ID, TEXT, "host", "line", "chars")


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, keep_share: float = KEEP_SHARE) -> DataFrame:
    """key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, removed_chars."""
    return _judged(*base_stats(docs, key, text, host), line_docs, line_share, keep_share).withColumnRenamed("key", key).drop(ID, TEXT, "host")


def cleaned(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, keep_share: float = KEEP_SHARE) -> DataFrame:
    """The rows of docs that are kept, each without its lines above the limit."""
    stats, windows = base_stats(docs, key, text, host)
    kept = _judged(stats, windows, line_docs, line_share, keep_share).filter("kept").select(ID, TEXT, F.col("host").alias(HOST)).distinct()
    gone = lines_above(stats, line_docs, line_share).groupBy(ID, TEXT, F.col("host").alias(HOST)).agg(F.collect_set("line").alias(GONE))
    named = docs.withColumns({ID: F.xxhash64(key), TEXT: F.xxhash64(F.coalesce(F.col(text), F.lit(""))), HOST: F.coalesce(F.col(host).cast("string"), F.lit(""))})
    rows = named.join(kept, [ID, TEXT, HOST], "left_semi").join(gone, [ID, TEXT, HOST], "left")
    normal = lambda x: F.xxhash64(_trim(F.translate(F.lower(x), "123456789", "0" * 9)))
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(GONE, normal(x))), "\n")
    return rows.withColumn(text, F.when(F.col(GONE).isNull(), F.col(text)).otherwise(left)).select(docs.columns)


def _judged(stats: DataFrame, windows: DataFrame, line_docs: int, line_share: float, keep_share: float) -> DataFrame:
    """The columns of quality(), with the names of rows."""
    line_chars = F.aggregate("normal", F.lit(0).cast("long"), lambda a, x: a + x["chars"])
    rows = stats.select("key", ID, TEXT, "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", line_chars.alias("line_chars"))
    rows = rows.join(repeated_words(windows), [ID, TEXT], "left").join(removed_chars(stats, line_docs, line_share), [ID, TEXT, "host"], "left")
    rows = rows.fillna(0, ["n_repeat_words", "removed"])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    depleted = (F.col("line_chars") - F.col("removed")) < keep_share * F.col("line_chars")
    return rows.select("key", ID, TEXT, "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), F.col("removed").cast("long").alias("removed_chars"))


def oracle_sql(line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, keep_share: float = KEEP_SHARE) -> str:
    """The same rows in DuckDB's SQL, over documents with distinct ids."""
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host FROM documents),
s AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
e AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM s),
win AS (SELECT doc_id, p, lead(w, 7) OVER x AS eighth,
  concat_ws(' ', w, lead(w, 1) OVER x, lead(w, 2) OVER x, lead(w, 3) OVER x, lead(w, 4) OVER x, lead(w, 5) OVER x, lead(w, 6) OVER x, lead(w, 7) OVER x) AS g
  FROM e WINDOW x AS (PARTITION BY doc_id ORDER BY p)),
rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win WHERE eighth IS NOT NULL) WHERE c > 1),
cov AS (SELECT doc_id, sum(least(8, coalesce(n - p, 8))) AS r FROM (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS n FROM rep) GROUP BY 1),
l0 AS (SELECT doc_id, host, t, unnest(string_split(translate(lower(t), '123456789', '000000000'), chr(10))) AS l FROM d),
l1 AS (SELECT doc_id, host, t, trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS l FROM l0),
ln AS (SELECT * FROM l1 WHERE l <> ''),
hosts AS (SELECT host, count(DISTINCT t) AS n FROM d GROUP BY 1),
above AS (SELECT ln.host, l, min(doc_id) AS f FROM ln JOIN hosts USING (host) GROUP BY ln.host, l, n HAVING count(DISTINCT t) > {line_docs} AND count(DISTINCT t) > {line_share} * n),
rem AS (SELECT doc_id, sum(length(l)) AS removed FROM ln JOIN above USING (host, l) WHERE doc_id <> f GROUP BY 1),
tot AS (SELECT doc_id, sum(length(l)) AS total FROM ln GROUP BY 1),
r AS (SELECT s.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(cov.r, 0) AS BIGINT) AS n_repeat_words,
  CAST(coalesce(removed, 0) AS BIGINT) AS removed_chars, coalesce(total, 0) AS total
  FROM s LEFT JOIN cov USING (doc_id) LEFT JOIN rem USING (doc_id) LEFT JOIN tot USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (total - removed_chars < {keep_share} * total) AS kept, removed_chars FROM f"""
