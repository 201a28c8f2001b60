"""A query for each operation, on the driver's tables, with the same in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketgraph.functions import clean, vectors
from basketgraph.operators import communities as comm
from basketgraph.operators import cooc, embed, graph, knn, project, temporal, traverse, walks
from basketgraph.session import materialize, new_path, uniform
from basketgraph.sources import io

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Inputs that the queries share, in both dialects

CATEGORIES = {"red": "warm", "hot": "warm", "blue": "cool", "cold": "cool"}
CATEGORY_SQL = "CASE WHEN {0} LIKE 'red%' OR {0} LIKE 'hot%' THEN 'warm' WHEN {0} LIKE 'blue%' OR {0} LIKE 'cold%' THEN 'cool' ELSE 'plain' END"
B = "b AS (SELECT DISTINCT l_orderkey AS basket, p_name AS item FROM lineitem JOIN part ON l_partkey = p_partkey)"
N = f"{B}, n AS (SELECT item AS node, count(*) AS frequency, {CATEGORY_SQL.format('item')} AS category FROM b GROUP BY 1)"
E = f"{N}, e AS (SELECT x.item AS source, y.item AS target, count(*) AS weight FROM b x JOIN b y ON x.basket = y.basket AND x.item < y.item GROUP BY 1, 2)"
K = f"{E}, k AS (SELECT source, target, weight FROM e)"
A = f"{K}, a AS (SELECT source AS src, target AS dst, CAST(weight AS DOUBLE) AS w FROM k UNION ALL SELECT target, source, CAST(weight AS DOUBLE) FROM k)"
H = f"{A}, h0 AS (SELECT node AS source, node, 0 AS d FROM n UNION SELECT h0.source, a.dst, h0.d + 1 FROM h0 JOIN a ON a.src = h0.node WHERE h0.d < 8), h AS (SELECT source, node, min(d) AS d FROM h0 GROUP BY 1, 2)"
PB = "b AS (SELECT DISTINCT year(o_orderdate) AS period, l_orderkey AS basket, p_name AS item FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"
PN = f"{PB}, n AS (SELECT period, item AS node, count(*) AS frequency, {CATEGORY_SQL.format('item')} AS category FROM b GROUP BY 1, 2)"
PE = f"{PN}, e AS (SELECT x.period, x.item AS source, y.item AS target, count(*) AS weight FROM b x JOIN b y ON x.basket = y.basket AND x.item < y.item GROUP BY 1, 2, 3)"
PA = f"{PE}, a AS (SELECT period, source AS src, target AS dst, weight AS w FROM e UNION ALL SELECT period, target, source, weight FROM e), st AS (SELECT period, src AS node, sum(w) AS strength, count(*) AS degree FROM a GROUP BY 1, 2)"


def bellman_ford(rounds: int) -> str:
    out = f"{A}, w0 AS (SELECT node AS source, node, 0.0::DOUBLE AS d FROM n)"
    for i in range(1, rounds + 1):
        out += f", w{i} AS (SELECT source, node, min(d) AS d FROM (SELECT * FROM w{i - 1} UNION ALL SELECT q.source, a.dst, q.d + 1 / a.w FROM w{i - 1} q JOIN a ON a.src = q.node) GROUP BY 1, 2)"
    return out


def path_counts(longest: int) -> str:
    """Walks of as many steps as the distance are the shortest paths."""
    out = f"{H}, s0 AS (SELECT node AS source, node, 1.0::DOUBLE AS c FROM n)"
    for i in range(1, longest + 1):
        out += f", s{i} AS (SELECT s.source, a.dst AS node, sum(s.c) AS c FROM s{i - 1} s JOIN a ON a.src = s.node GROUP BY 1, 2)"
    every = " UNION ALL ".join(f"SELECT {i} AS d, * FROM s{i}" for i in range(longest + 1))
    return f"{out}, sg AS (SELECT h.source, h.node, h.d, s.c FROM h JOIN ({every}) s ON s.source = h.source AND s.node = h.node AND s.d = h.d)"


def baskets(spark: SparkSession, d: str, by_year: bool = False) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    if by_year:
        rows = rows.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("period", F.year("o_orderdate"))
    by = ["period"] if by_year else []
    return cooc.basket_items(rows.select(*by, F.col("l_orderkey").alias("basket"), F.col("p_name").alias("item")), "basket", "item", by)


def nodes_of(items: DataFrame, by: list[str] = ()) -> DataFrame:
    return cooc.item_frequency(items, by).withColumn("category", clean.infer_category(F.col("node"), CATEGORIES, "plain"))


def network(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges, adjacency of all items; written once, as traversals read them again and again."""
    items = materialize(baskets(spark, d), "baskets")
    nodes, edges = materialize(nodes_of(items), "nodes"), materialize(cooc.cooccurrence_edges(items), "edges")
    return nodes, edges, materialize(graph.adjacency(edges), "adjacency")


def period_network(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    items = materialize(baskets(spark, d, True), "baskets")
    return items, materialize(nodes_of(items, ["period"]), "nodes"), materialize(cooc.cooccurrence_edges(items, ["period"]), "edges")


#: Dirty items made from parts, one of 16 forms by key; and what each ruleset makes of a form ({n}: p_size, {b}: p_brand).
DIRTY = """CASE CAST(p_partkey % 16 AS INT) WHEN 0 THEN '(Ear)  Shenmen' WHEN 1 THEN concat('HT', p_size) WHEN 2 THEN concat('PC', p_size, '(bilaterally)')
 WHEN 3 THEN 'occiput and subcortex' WHEN 4 THEN 'hands(unspecified)' WHEN 5 THEN 'Ear points: heart' WHEN 6 THEN 'LR3. Yintang' WHEN 7 THEN concat('moxa:KI', p_size)
 WHEN 8 THEN 'Sishencong' WHEN 9 THEN concat('du', p_size) WHEN 10 THEN concat('RN', p_size, ' ') WHEN 11 THEN 'Sympathetic autonomic(AH6a)' WHEN 12 THEN 'PC7 or KI1'
 WHEN 13 THEN p_brand WHEN 14 THEN 'EX-HN1(see note)' ELSE ' Large   Intestine ' END"""
_REVIEW = [("", "unknown", "review_needed")]
_SAME = {
    0: [("EAR_SHENMEN", "ear", "map")], 1: [("HT{n}", "body", "keep")], 2: [("PC{n}", "body", "map")], 3: [("EAR_OCCIPUT", "ear", "split"), ("EAR_SUBCORTEX", "ear", "split")],
    4: [("", "unknown", "drop")], 9: [("GV{n}", "body", "map")], 10: [("CV{n}", "body", "map")], 13: _REVIEW, 15: [("EAR_LARGE_INTESTINE", "ear", "map")],
}
_LATER = {5: [("EAR_HEART", "ear", "map")], 6: [("LR3", "body", "split"), ("YINTANG", "body", "split")], 7: [("KI{n}", "body", "map")], 8: [("SISHENCONG", "body", "map")], 12: [("", "unknown", "drop")]}
EXPECTED = {
    "2012": _SAME | {i: _REVIEW for i in (5, 6, 7, 8, 11, 12, 14)},
    "2016": _SAME | _LATER | {11: _REVIEW, 14: _REVIEW},
    "2020": _SAME | _LATER | {11: [("EAR_SYMPATHETIC", "ear", "map")], 14: [("EX-HN1", "body", "map")]},
}
RULES = "rules(version, form, part, standard, category, action) AS (VALUES " + ", ".join(f"('{v}', {f}, {i}, '{s}', '{c}', '{a}')" for v, forms in EXPECTED.items() for f, out in sorted(forms.items()) for i, (s, c, a) in enumerate(out)) + ")"
PARTS = f"{RULES}, parts AS (SELECT p_partkey, p_size, p_partkey % 16 AS form, trim({DIRTY}) AS original FROM part)"
STANDARD = "replace(standard, '{n}', CAST(p_size AS VARCHAR))"
LOG = f"{PARTS}, lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS nth FROM lineitem), log AS (SELECT l_orderkey AS basket, row_number() OVER (PARTITION BY l_orderkey ORDER BY nth, part) AS pos, original, {STANDARD} AS standard, category, action FROM lines JOIN parts ON l_partkey = p_partkey JOIN rules USING (form) WHERE version = '2020')"


def dirty_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").withColumn("item", F.expr(DIRTY))


def dirty_baskets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(dirty_parts(spark, d), F.col("l_partkey") == F.col("p_partkey"))
    lists = rows.groupBy(F.col("l_orderkey").alias("basket")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "item"))).alias("x"))
    return lists.select("basket", F.col("x.item").alias("items"))


def basket_log(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = dirty_baskets(spark, d)
    return rows, clean.mapping_log(rows, ["basket"])


LISTS = "SELECT l_orderkey AS basket, list(p_name ORDER BY l_linenumber, l_partkey) AS walk FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"


def basket_walks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    lists = rows.groupBy(F.col("l_orderkey").alias("basket")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "p_name"))).alias("x"))
    return lists.select("basket", F.col("x.p_name").alias("walk"))


# Sources and sinks


@query("SELECT p_partkey, concat(p_name, ', \"', p_brand, '\"', chr(10), p_type) AS items, p_size FROM part")
def read_items(spark, d):
    path = new_path(spark, "items")
    rows = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"\n'), "p_type").alias("items"), "p_size")
    io.write_csv(rows, path)
    return io.read_csv(spark, path, "p_partkey long, items string, p_size int")


@query("SELECT o_orderkey, o_custkey, o_orderstatus AS period FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')")
def union_periods(spark, d):
    orders, paths = table(spark, d, "orders"), {}
    for p in ("F", "O", "P"):
        paths[p] = new_path(spark, "period")
        io.write_csv(orders.filter(F.col("o_orderstatus") == p).select("o_orderkey", "o_custkey"), paths[p])
    return io.union_periods(spark, paths, "o_orderkey long, o_custkey long")


@query("SELECT p_partkey AS row, p_name AS \"Name\", p_brand AS \"Brand\" FROM part WHERE p_partkey > 3")
def locate_header(spark, d):
    header = F.array(F.lit(" Type"), F.lit("Name "), F.lit("Brand"))
    cells = table(spark, d, "part").select(F.col("p_partkey").alias("row"), F.when(F.col("p_partkey") == 3, header).otherwise(F.array("p_type", "p_name", "p_brand")).alias("cells"))
    return io.locate_header(cells, "row", "cells", ["Name", "Brand"])


@query("SELECT c_custkey, round(c_acctbal / 7, 6) AS share FROM customer")
def write_tables(spark, d):
    path = new_path(spark, "csv")
    io.write_csv(table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 7).alias("share")), path, digits=6)
    return io.read_csv(spark, path, "c_custkey long, share double")


@query(f"WITH RECURSIVE {K} SELECT concat('e', row_number() OVER (ORDER BY weight DESC, source, target) - 1) AS id, source, target, weight FROM k")
def graph_export(spark, d):
    nodes, edges, _ = network(spark, d)
    at, to = new_path(spark, "nodes-xml"), new_path(spark, "edges-xml")
    io.write_xml(io.xml_nodes(nodes, "node", ["category", "frequency"]), at, "node")
    io.write_xml(io.number_edges(edges), to, "edge")
    schema = "_id string, _source string, _target string, data struct<_VALUE:long,_key:string>"
    read = spark.read.format("xml").options(rowTag="edge").schema(schema).load(to)
    return read.select(F.col("_id").alias("id"), F.col("_source").alias("source"), F.col("_target").alias("target"), F.col("data._VALUE").alias("weight"))


@query(
    f"""WITH RECURSIVE {K} SELECT 'node' AS kind, node AS id, NULL AS source, NULL AS target, category, CAST(frequency AS DOUBLE) AS value FROM n
UNION ALL SELECT 'edge', concat('e', row_number() OVER (ORDER BY weight DESC, source, target) - 1), source, target, NULL, CAST(weight AS DOUBLE) FROM k"""
)
def graph_document(spark, d):
    nodes, edges, _ = network(spark, d)
    parts, file = new_path(spark, "graph-parts"), new_path(spark, "graph.xml")
    io.write_graph(nodes, edges, parts, ["category", "frequency"])
    io.merge_parts(spark, parts, file)
    at, to = io.read_graph(spark, file, ["category", "frequency"])
    none = F.lit(None).cast("string")
    at = at.select(F.lit("node").alias("kind"), F.col("node").alias("id"), none.alias("source"), none.alias("target"), "category", F.col("frequency").cast("double").alias("value"))
    return at.unionByName(to.select(F.lit("edge").alias("kind"), "id", "source", "target", none.alias("category"), F.col("weight").alias("value")))


@query("SELECT vec_id, label, len(embedding) AS size, round(embedding[1]::DOUBLE, 6) AS first, round(embedding[-1]::DOUBLE, 6) AS last, round(list_sum(list_transform(embedding, lambda x: round(x::DOUBLE, 6))), 6) AS total FROM embeddings")
def embedding_file(spark, d):
    rows = embeddings(spark, d).select(F.col("node").alias("vec_id"), "label", "vector")
    path, size = new_path(spark, "embedding"), dimension(rows)
    io.write_csv(io.vector_to_columns(rows, size), path, digits=6)
    back = io.columns_to_vector(io.read_csv(spark, path, "vec_id long, label int, " + ", ".join(f"dim_{i + 1} double" for i in range(size))))
    total = F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6)
    return back.select("vec_id", "label", F.size("vector").cast("long").alias("size"), F.element_at("vector", 1).alias("first"), F.element_at("vector", -1).alias("last"), total.alias("total"))


@query("SELECT vec_id, len(embedding) AS size, round(embedding[1]::DOUBLE, 6) AS first, round(embedding[-1]::DOUBLE, 6) AS last FROM embeddings")
def vector_columns(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    wide = io.vector_to_columns(rows, rows.select(F.max(F.size("vector"))).first()[0])
    back = io.columns_to_vector(wide)
    return back.select("vec_id", F.size("vector").cast("long").alias("size"), F.round(F.element_at("vector", 1), 6).alias("first"), F.round(F.element_at("vector", -1), 6).alias("last"))


# Extraction and cleaning


@query("SELECT p_partkey AS no, p_name AS name, 'parts' AS sheet FROM part")
def project_rename(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name").withColumnsRenamed({"p_partkey": "no", "p_name": "name"}).withColumn("sheet", F.lit("parts"))


@query("SELECT p_partkey AS no, p_name AS item FROM part WHERE p_partkey % 7 <> 0")
def drop_incomplete(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("no"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_name")).alias("item"))
    return rows.na.drop(how="any", subset=["no", "item"])


@query("SELECT p_partkey, CAST(trunc(p_size + 0.7) AS BIGINT) AS value FROM part WHERE p_partkey % 3 <> 1")
def coerce_numeric(spark, d):
    text = F.when(F.col("p_partkey") % 3 == 1, F.col("p_brand")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".7")))
    return table(spark, d, "part").select("p_partkey", clean.coerce_int(text).alias("value")).na.drop()


@query("SELECT p_partkey, concat(p_name, ' ', p_type) AS text FROM part")
def trim_text(spark, d):
    text = F.concat(F.lit("  "), "p_name", F.lit("\n"), "p_type", F.lit("\t "))
    return table(spark, d, "part").select("p_partkey", clean.trim_text(text, one_line=True).alias("text"))


@query("SELECT p_partkey, unnest([p_brand, p_type, p_name]) AS item, unnest([0, 1, 2]) AS pos FROM part")
def split_items(spark, d):
    text = F.concat("p_brand", F.lit("; "), "p_type", F.lit(",,\n "), "p_name", F.lit(" ;"))
    return table(spark, d, "part").select("p_partkey", F.posexplode(clean.split_items(text)).alias("pos", "item"))


@query(f"SELECT p_partkey, lower(trim(regexp_replace({DIRTY}, '\\s+', ' ', 'g'))) AS key FROM part")
def normalize_key(spark, d):
    return dirty_parts(spark, d).select("p_partkey", clean.normalize_key(F.col("item")).alias("key"))


@query("SELECT p_partkey, CASE p_partkey % 16 WHEN 1 THEN concat('HT', p_size) WHEN 2 THEN concat('PC', p_size) WHEN 9 THEN concat('GV', p_size) WHEN 10 THEN concat('CV', p_size) END AS code FROM part")
def canonical_code(spark, d):
    return dirty_parts(spark, d).select("p_partkey", clean.canonical_code(F.col("item")).alias("code"))


@query(f"SELECT p_partkey, trim(regexp_replace({DIRTY}, '\\([^)]*\\)', '', 'g')) AS text FROM part")
def strip_notes(spark, d):
    return dirty_parts(spark, d).select("p_partkey", clean.strip_notes(F.col("item")).alias("text"))


@query(f"SELECT p_partkey, regexp_replace(lower(trim(regexp_replace({DIRTY}, '\\s+', ' ', 'g'))), '^ear points: *', '') AS key, CASE WHEN p_partkey % 16 = 7 THEN concat('KI', p_size) END AS code FROM part")
def strip_prefix(spark, d):
    key = clean.normalize_key(F.col("item"))
    return dirty_parts(spark, d).select("p_partkey", clean.strip_prefix(key, "ear points:").alias("key"), F.when(key.startswith("moxa:"), clean.canonical_code(clean.after_colon(F.col("item")))).alias("code"))


@query("SELECT p_partkey, CASE p_partkey % 16 WHEN 0 THEN 'EAR_SHENMEN' WHEN 8 THEN 'SISHENCONG' ELSE 'EAR_LARGE_INTESTINE' END AS standard FROM part WHERE p_partkey % 16 IN (0, 8, 15)")
def dictionary_map(spark, d):
    step = clean.Exact("key", {k: ([v], "ear", "map", "ear item") for k, v in (clean.EAR | clean.NAMED).items()})
    rows = clean.match_keys(dirty_parts(spark, d), "item")
    found = clean.lookup_table(rows, step)
    return rows.join(F.broadcast(found), F.col("key") == F.col("entry")).select("p_partkey", F.col("found")[0]["standard"].alias("standard"))


@query("SELECT p_partkey, 'drop' AS action FROM part WHERE p_partkey % 16 IN (4, 12)")
def reject_list(spark, d):
    rows = clean.match_keys(dirty_parts(spark, d), "item")
    return rows.filter(F.col("key").isin(*clean.REJECTED, *clean.REJECTED_2016)).select("p_partkey", F.lit("drop").alias("action"))


@query(f"WITH {PARTS} SELECT p_partkey, part, standard FROM parts JOIN rules USING (form) WHERE version = '2016' AND action = 'split'")
def split_rules(spark, d):
    rows = clean.standardize(dirty_parts(spark, d), "item", "2016").select("p_partkey", F.posexplode("results").alias("part", "r"))
    return rows.filter("r.action = 'split'").select("p_partkey", "part", "r.standard")


@query(f"WITH {PARTS} SELECT p_partkey, version, part, original, {STANDARD} AS standard, category, action FROM parts JOIN rules USING (form)")
def standardize_items(spark, d):
    out = None
    for version in clean.RULESETS:
        rows = clean.standardize(dirty_parts(spark, d), "item", version)
        rows = rows.select("p_partkey", F.lit(version).alias("version"), F.col("value").alias("original"), F.posexplode("results").alias("part", "r")).select("p_partkey", "version", "part", "original", "r.standard", "r.category", "r.action")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"WITH {LOG} SELECT basket, pos, original, standard, category, action FROM log")
def mapping_log(spark, d):
    _, log = basket_log(spark, d)
    nth = F.row_number().over(graph.W.partitionBy("basket").orderBy("pos", "part"))
    return log.select("basket", nth.alias("pos"), "original", "standard", "category", "action")


@query(
    f"""WITH {LOG}, g AS (SELECT basket, item, bad, min(pos) AS pos FROM (SELECT basket, pos, action IN ('drop', 'review_needed') AS bad, CASE WHEN action IN ('drop', 'review_needed') THEN original ELSE standard END AS item FROM log) WHERE item <> '' GROUP BY 1, 2, 3)
SELECT basket, coalesce(string_agg(item, '|' ORDER BY pos) FILTER (WHERE NOT bad), '') AS standard_items, coalesce(string_agg(item, '|' ORDER BY pos) FILTER (WHERE bad), '') AS dropped_items FROM g GROUP BY 1"""
)
def regroup_items(spark, d):
    rows, log = basket_log(spark, d)
    return clean.regroup(rows, log, ["basket"]).select("basket", F.array_join("standard_items", "|").alias("standard_items"), F.array_join("dropped_items", "|").alias("dropped_items"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS item FROM events")
def parse_list(spark, d):
    text = F.concat(F.lit('["'), F.get_json_object("props", "$.k"), F.lit("\"]"))
    return table(spark, d, "events").select("event_id", F.explode(clean.parse_list(text)).alias("item"))


@query("SELECT p_partkey, concat('[\"', p_name, '\",\"', p_type, '\"]') AS json FROM part")
def encode_list(spark, d):
    return table(spark, d, "part").select("p_partkey", clean.encode_list(F.array("p_name", "p_type")).alias("json"))


@query(f"SELECT p_partkey, {CATEGORY_SQL.format('p_name')} AS category FROM part")
def infer_category(spark, d):
    return table(spark, d, "part").select("p_partkey", clean.infer_category(F.col("p_name"), CATEGORIES, "plain").alias("category"))


@query(f"WITH {LOG} SELECT basket, count(*) AS violations FROM log WHERE action = 'review_needed' GROUP BY 1")
def review_gate(spark, d):
    return clean.review_gate(basket_log(spark, d)[1]).groupBy("basket").agg(F.count(F.lit(1)).alias("violations"))


@query(f"WITH {LOG} SELECT basket, NOT bool_or(action IN ('keep', 'map', 'split')) AS excluded FROM log GROUP BY 1")
def split_empty(spark, d):
    kept, excluded = clean.split_empty(clean.regroup(*basket_log(spark, d), ["basket"]))
    return kept.select("basket", F.lit(False).alias("excluded")).unionByName(excluded.select("basket", F.lit(True).alias("excluded")))


@query(f"WITH {LOG} SELECT action, count(*) AS n FROM log GROUP BY 1")
def action_counts(spark, d):
    return clean.action_counts(basket_log(spark, d)[1])


# Co-occurrence


@query(f"WITH {N} SELECT node, frequency, category FROM n")
def item_frequency(spark, d):
    return nodes_of(baskets(spark, d))


@query(f"WITH {E} SELECT source, target, weight FROM e")
def cooccurrence_edges(spark, d):
    return cooc.cooccurrence_edges(baskets(spark, d))


@query(f"WITH {PN} SELECT period, node, frequency, category FROM n")
def period_nodes(spark, d):
    return nodes_of(baskets(spark, d, True), ["period"])


@query(f"WITH {PE} SELECT period, source, target, weight FROM e")
def period_edges(spark, d):
    return cooc.cooccurrence_edges(baskets(spark, d, True), ["period"])


# Graphs


@query(f"WITH RECURSIVE {A} SELECT src, dst, w FROM a")
def adjacency(spark, d):
    return network(spark, d)[2]


@query(f"WITH {K} SELECT node FROM n WHERE node NOT IN (SELECT source FROM k UNION SELECT target FROM k)")
def isolated_nodes(spark, d):
    nodes, edges, _ = network(spark, d)
    return graph.isolated_nodes(nodes, edges).select("node")


@query(f"WITH {N} SELECT node, frequency, row_number() OVER (ORDER BY frequency DESC, node) AS rank FROM n QUALIFY rank <= 10")
def top_nodes(spark, d):
    return graph.top_nodes(nodes_of(baskets(spark, d)), 10).select("node", "frequency", "rank")


@query(f"WITH {K}, t AS (SELECT node FROM n ORDER BY frequency DESC, node LIMIT 30) SELECT source, target, weight FROM k WHERE source IN (SELECT node FROM t) AND target IN (SELECT node FROM t)")
def induced_subgraph(spark, d):
    nodes, edges, _ = network(spark, d)
    return graph.induced_subgraph(edges, graph.top_nodes(nodes, 30))


@query(f"WITH {A}, g AS (SELECT src, count(*) AS c FROM a GROUP BY 1) SELECT node, coalesce(c, 0) AS degree, round(coalesce(c, 0) / ((SELECT count(*) FROM n) - 1), 6) AS centrality FROM n LEFT JOIN g ON src = node")
def degree_centrality(spark, d):
    nodes, _, adj = network(spark, d)
    return graph.degree_centrality(nodes, adj).withColumn("centrality", F.round("centrality", 6))


@query(f"WITH {A}, g AS (SELECT src, sum(w) AS s FROM a GROUP BY 1) SELECT node, coalesce(s, 0) AS strength FROM n LEFT JOIN g ON src = node")
def strength(spark, d):
    nodes, _, adj = network(spark, d)
    return graph.strength(nodes, adj)


@query(f"WITH RECURSIVE {H} SELECT source, node, d FROM h")
def hop_distances(spark, d):
    nodes, _, adj = network(spark, d)
    return traverse.hop_distances(nodes, adj)


CLOSE = "SELECT n.node, round(CASE WHEN s > 0 THEN (r - 1) / s * (r - 1) / ((SELECT count(*) FROM n) - 1) ELSE 0 END, 6) AS closeness FROM n JOIN (SELECT source, sum(d) AS s, count(*) AS r FROM {0} GROUP BY 1) ON source = n.node"


@query(f"WITH RECURSIVE {H} {CLOSE.format('h')}")
def closeness(spark, d):
    nodes, _, adj = network(spark, d)
    return traverse.closeness_of_sums(traverse.hop_sums(nodes, adj), nodes).withColumn("closeness", F.round("closeness", 6))


@query(f"WITH {bellman_ford(8)} {CLOSE.format('w8')}")
def weighted_closeness(spark, d):
    nodes, _, adj = network(spark, d)
    return traverse.closeness(traverse.weighted_distances(nodes, adj), nodes).withColumn("closeness", F.round("closeness", 6))


@query(
    f"""WITH RECURSIVE {path_counts(6)}, t AS (SELECT x.node, sum(x.c * y.c / z.c) AS v FROM sg x JOIN sg y ON x.node = y.source JOIN sg z ON z.source = x.source AND z.node = y.node AND x.d + y.d = z.d
WHERE x.source <> x.node AND y.source <> y.node AND x.source <> y.node GROUP BY 1), c AS (SELECT CAST(count(*) AS DOUBLE) AS m FROM n)
SELECT n.node, round(coalesce(v, 0) * 0.5 / ((m - 1) * (m - 2) / 2), 6) AS betweenness FROM n LEFT JOIN t ON t.node = n.node, c"""
)
def betweenness(spark, d):
    nodes, _, adj = network(spark, d)
    return traverse.betweenness(traverse.hop_distances(nodes, adj), nodes, adj).withColumn("betweenness", F.round("betweenness", 6))


#: Weighted: steps on shortest paths from each source, the numbers of these paths by their steps, and what passes each node.
WEIGHTED = f"""{bellman_ford(8)}, down AS (SELECT x.source, x.node AS u, y.node AS v FROM w8 x JOIN a ON a.src = x.node JOIN w8 y ON y.source = x.source AND y.node = a.dst WHERE abs(x.d + 1 / a.w - y.d) <= 1e-9), p0 AS (SELECT node AS source, node AS v, 1.0::DOUBLE AS c FROM n)""" + "".join(
    f", p{i} AS (SELECT p.source, down.v, sum(p.c) AS c FROM p{i - 1} p JOIN down ON down.source = p.source AND down.u = p.v GROUP BY 1, 2)" for i in range(1, 9)
) + ", sg AS (SELECT source, v AS node, sum(c) AS c FROM (" + " UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(9)) + ") GROUP BY 1, 2), wd AS (SELECT w8.source, w8.node, w8.d, sg.c FROM w8 JOIN sg ON sg.source = w8.source AND sg.node = w8.node), wt AS (SELECT x.node, sum(x.c * y.c / z.c) AS v FROM wd x JOIN wd y ON x.node = y.source JOIN wd z ON z.source = x.source AND z.node = y.node AND abs(x.d + y.d - z.d) <= 1e-9 WHERE x.source <> x.node AND y.source <> y.node AND x.source <> y.node GROUP BY 1), wc AS (SELECT CAST(count(*) AS DOUBLE) AS m FROM n), wb AS (SELECT n.node, round(coalesce(v, 0) * 0.5 / ((m - 1) * (m - 2) / 2), 6) AS betweenness FROM n LEFT JOIN wt ON wt.node = n.node, wc)"


@query(f"WITH {WEIGHTED} SELECT * FROM wb")
def weighted_betweenness(spark, d):
    nodes, _, adj = network(spark, d)
    return traverse.betweenness(traverse.weighted_distances(nodes, adj), nodes, adj, weighted=True).withColumn("betweenness", F.round("betweenness", 6))


COMP = "SELECT source AS node, min(node) AS component FROM h GROUP BY 1"


@query(f"WITH RECURSIVE {H} {COMP}")
def connected_components(spark, d):
    nodes, edges, _ = network(spark, d)
    return traverse.connected_components(nodes, edges)


@query(f"WITH RECURSIVE {H} SELECT component, count(*) AS size FROM ({COMP}) GROUP BY 1")
def component_sizes(spark, d):
    nodes, edges, _ = network(spark, d)
    return traverse.component_sizes(traverse.connected_components(nodes, edges))


@query(f"WITH RECURSIVE {H}, c AS ({COMP}), g AS (SELECT component FROM c GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1) SELECT round(avg(d), 6) AS average_path_length FROM h JOIN c ON c.node = h.source JOIN g USING (component) WHERE d > 0")
def average_path_length(spark, d):
    nodes, edges, adj = network(spark, d)
    out = traverse.path_length_of_sums(traverse.connected_components(nodes, edges), traverse.hop_sums(nodes, adj))
    return out.select(F.round("average_path_length", 6).alias("average_path_length"))


@query(f"WITH {K}, x AS (SELECT (SELECT count(*) FROM n) AS nodes, count(*) AS edges, max(weight) AS max_weight FROM k) SELECT nodes, edges, max_weight, round(edges / (nodes * (nodes - 1) / 2), 6) AS density FROM x")
def network_summary(spark, d):
    nodes, edges, _ = network(spark, d)
    return graph.network_summary(nodes, edges).withColumn("density", F.round("density", 6))


def rankings_sql(scores: dict[str, tuple[str, str]], k: int = 5) -> str:
    every = " UNION ALL ".join(f"SELECT '{m}' AS metric, node, round({c}, 6) AS value FROM ({SQL[q]})" for m, (q, c) in scores.items())
    return f"SELECT metric, node, value, row_number() OVER (PARTITION BY metric ORDER BY value DESC, node) AS rank FROM ({every}) QUALIFY rank <= {k}"


@query(rankings_sql({"degree": ("degree_centrality", "centrality"), "strength": ("strength", "strength"), **{m: (m, m.split("_")[-1]) for m in ("betweenness", "closeness", "weighted_betweenness", "weighted_closeness")}}))
def centrality_rankings(spark, d):
    nodes, _, adj = network(spark, d)
    hops, far = materialize(traverse.hop_distances(nodes, adj), "hops"), traverse.weighted_distances(nodes, adj)
    return graph.rankings({
        "degree": graph.degree_centrality(nodes, adj), "betweenness": traverse.betweenness(hops, nodes, adj), "closeness": traverse.closeness(hops, nodes),
        "strength": graph.strength(nodes, adj), "weighted_betweenness": traverse.betweenness(far, nodes, adj, weighted=True), "weighted_closeness": traverse.closeness(far, nodes),
    })


@query(f"WITH {N} SELECT category, count(*) AS nodes FROM n GROUP BY 1")
def category_counts(spark, d):
    return graph.category_counts(nodes_of(baskets(spark, d)))


# The graph of single parts: 200,000 x sf items, each order a basket.

PART_E = "b AS (SELECT DISTINCT l_orderkey AS basket, l_partkey AS item FROM lineitem), e AS (SELECT x.item AS source, y.item AS target, count(*) AS weight FROM b x JOIN b y ON x.basket = y.basket AND x.item < y.item GROUP BY 1, 2)"


def part_network(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    items = cooc.basket_items(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("basket"), F.col("l_partkey").alias("item")), "basket", "item")
    return cooc.item_frequency(items), cooc.cooccurrence_edges(items)


@query(f"WITH {PART_E}, a AS (SELECT source AS node, weight FROM e UNION ALL SELECT target, weight FROM e), n AS (SELECT DISTINCT item AS node FROM b) SELECT n.node, CAST(coalesce(sum(weight), 0) AS DOUBLE) AS strength FROM n LEFT JOIN a USING (node) GROUP BY 1")
def part_strength(spark, d):
    nodes, edges = part_network(spark, d)
    return graph.strength(nodes, graph.adjacency(edges))


@query(f"WITH {PART_E}, x AS (SELECT (SELECT count(DISTINCT item) FROM b) AS nodes, count(*) AS edges, max(weight) AS max_weight FROM e) SELECT nodes, edges, max_weight, round(edges / (nodes * (nodes - 1) / 2), 6) AS density FROM x")
def part_summary(spark, d):
    nodes, edges = part_network(spark, d)
    return graph.network_summary(nodes, edges).withColumn("density", F.round("density", 6))


@query(f"WITH {E} SELECT source, target, weight, row_number() OVER (ORDER BY weight DESC, source, target) AS rank FROM e QUALIFY rank <= 10")
def top_edges(spark, d):
    return graph.top_edges(cooc.cooccurrence_edges(baskets(spark, d)), 10)


# The graph of parts bought in bulk: order lines of more than BULK units. It is sparse at every scale, with many
# components, parts that stand alone and ways of many hops; a weight is how many units two parts share in orders.

BULK = 46
BULK_E = f"""b AS (SELECT l_orderkey AS basket, l_partkey AS item, sum(l_quantity)::DOUBLE AS units FROM lineitem WHERE l_quantity > {BULK} GROUP BY 1, 2), n AS (SELECT item AS node, count(*) AS frequency FROM b GROUP BY 1),
e AS (SELECT x.item AS source, y.item AS target, sum(least(x.units, y.units)) AS weight FROM b x JOIN b y ON x.basket = y.basket AND x.item < y.item GROUP BY 1, 2), a AS (SELECT source AS src, target AS dst, weight AS w FROM e UNION ALL SELECT target, source, weight FROM e)"""
#: Search by rounds: a row is kept for each pair and changed when a shorter way is found.
BULK_H = f"{BULK_E}, h(source, node, d) USING KEY (source, node) AS (SELECT node, node, 0 FROM n UNION SELECT h.source, a.dst, min(h.d + 1) FROM h JOIN a ON a.src = h.node LEFT JOIN recurring.h r ON r.source = h.source AND r.node = a.dst WHERE r.node IS NULL GROUP BY 1, 2)"
BULK_W = f"{BULK_E}, w(source, node, d) USING KEY (source, node) AS (SELECT node, node, 0.0::DOUBLE FROM n UNION SELECT w.source, a.dst, min(w.d + 1 / a.w) FROM w JOIN a ON a.src = w.node LEFT JOIN recurring.w r ON r.source = w.source AND r.node = a.dst WHERE r.d IS NULL OR w.d + 1 / a.w < r.d - 1e-12 GROUP BY 1, 2)"
#: Steps on shortest paths from each source, and the number of paths to each node, by walks of ever more steps.
BULK_PATHS = """, down AS MATERIALIZED (SELECT x.source, x.node AS u, y.node AS v FROM {d} x JOIN a ON a.src = x.node JOIN {d} y ON y.source = x.source AND y.node = a.dst WHERE abs(x.d + {length} - y.d) <= 1e-9),
p(source, v, i, c) AS (SELECT node, node, 0, 1.0::DOUBLE FROM n UNION ALL SELECT p.source, down.v, p.i + 1, sum(p.c) FROM p JOIN down ON down.source = p.source AND down.u = p.v GROUP BY 1, 2, 3), sg AS MATERIALIZED (SELECT q.source, q.node, q.d, c FROM {d} q JOIN (SELECT source, v, sum(c) AS c FROM p GROUP BY 1, 2) s ON s.source = q.source AND s.v = q.node),
t AS (SELECT x.node, sum(x.c * y.c / z.c) AS v FROM sg x JOIN sg y ON x.node = y.source JOIN sg z ON z.source = x.source AND z.node = y.node AND abs(x.d + y.d - z.d) <= 1e-9 WHERE x.source <> x.node AND y.source <> y.node AND x.source <> y.node GROUP BY 1), m AS (SELECT CAST(count(*) AS DOUBLE) AS m FROM n)
SELECT n.node, round(coalesce(v, 0) * 0.5 / ((m - 1) * (m - 2) / 2), {digits}) AS betweenness FROM n LEFT JOIN t ON t.node = n.node, m"""
#: Shares of all pairs are small here.
FINE = 9


def bulk_network(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges, adjacency."""
    lines = table(spark, d, "lineitem").filter(F.col("l_quantity") > BULK).groupBy(F.col("l_orderkey").alias("basket"), F.col("l_partkey").alias("item")).agg(F.sum("l_quantity").cast("double").alias("units"))
    lines = materialize(lines, "lines")
    nodes = materialize(lines.groupBy(F.col("item").alias("node")).agg(F.count(F.lit(1)).alias("frequency")), "nodes")
    other = lines.select("basket", F.col("item").alias("target"), F.col("units").alias("others"))
    pairs = lines.withColumnRenamed("item", "source").join(other, "basket").filter("source < target")  # an order has few lines
    edges = materialize(pairs.groupBy("source", "target").agg(F.sum(F.least("units", "others")).alias("weight")), "edges")
    return nodes, edges, materialize(graph.adjacency(edges), "adjacency")


@query(f"WITH {BULK_E}, x AS (SELECT (SELECT count(*) FROM n) AS nodes, count(*) AS edges, max(weight) AS max_weight FROM e) SELECT nodes, edges, max_weight, round(edges / (nodes * (nodes - 1) / 2), 9) AS density FROM x")
def bulk_summary(spark, d):
    nodes, edges, _ = bulk_network(spark, d)
    return graph.network_summary(nodes, edges).withColumn("density", F.round("density", FINE))


@query(f"WITH {BULK_E} SELECT node FROM n WHERE node NOT IN (SELECT src FROM a)")
def bulk_isolated(spark, d):
    nodes, edges, _ = bulk_network(spark, d)
    return graph.isolated_nodes(nodes, edges).select("node")


@query(f"WITH {BULK_E}, g AS (SELECT src, count(*) AS c, sum(w) AS s FROM a GROUP BY 1) SELECT node, coalesce(c, 0) AS degree, round(coalesce(c, 0) / ((SELECT count(*) FROM n) - 1), 9) AS centrality, coalesce(s, 0) AS strength FROM n LEFT JOIN g ON src = node")
def bulk_degrees(spark, d):
    nodes, _, adj = bulk_network(spark, d)
    return graph.degree_centrality(nodes, adj).withColumn("centrality", F.round("centrality", FINE)).join(graph.strength(nodes, adj), "node")


@query(f"WITH RECURSIVE {BULK_H} SELECT source, node, d FROM h")
def bulk_hop_distances(spark, d):
    nodes, _, adj = bulk_network(spark, d)
    return traverse.hop_distances(nodes, adj)


@query(f"WITH RECURSIVE {BULK_W} SELECT source, node, round(d, 6) AS d FROM w")
def bulk_weighted_distances(spark, d):
    nodes, _, adj = bulk_network(spark, d)
    return traverse.weighted_distances(nodes, adj).withColumn("d", F.round("d", 6))


BULK_CLOSE = "SELECT n.node, round(CASE WHEN s > 0 THEN (r - 1) / s * (r - 1) / ((SELECT count(*) FROM n) - 1) ELSE 0 END, {digits}) AS closeness FROM n JOIN (SELECT source, sum(d) AS s, count(*) AS r FROM {0} GROUP BY 1) ON source = n.node"


@query(f"WITH RECURSIVE {BULK_H} {BULK_CLOSE.format('h', digits=FINE)}")
def bulk_closeness(spark, d):
    nodes, _, adj = bulk_network(spark, d)
    return traverse.closeness_of_sums(traverse.hop_sums(nodes, adj), nodes).withColumn("closeness", F.round("closeness", FINE))


@query()
def bulk_estimated_closeness(spark, d):
    nodes, _, adj = bulk_network(spark, d)
    return traverse.estimated_closeness(nodes, adj)


@query(f"WITH RECURSIVE {BULK_W} {BULK_CLOSE.format('w', digits=6)}")
def bulk_weighted_closeness(spark, d):
    nodes, _, adj = bulk_network(spark, d)
    return traverse.closeness(traverse.weighted_distances(nodes, adj), nodes).withColumn("closeness", F.round("closeness", 6))


@query(f"WITH RECURSIVE {BULK_H}{BULK_PATHS.format(d='h', length='1', digits=FINE)}")
def bulk_betweenness(spark, d):
    nodes, edges, adj = bulk_network(spark, d)
    return traverse.batched_betweenness(nodes, edges, adj).withColumn("betweenness", F.round("betweenness", FINE))


@query(f"WITH RECURSIVE {BULK_W}{BULK_PATHS.format(d='w', length='1 / a.w', digits=FINE)}")
def bulk_weighted_betweenness(spark, d):
    nodes, edges, adj = bulk_network(spark, d)
    return traverse.batched_betweenness(nodes, edges, adj, weighted=True).withColumn("betweenness", F.round("betweenness", FINE))


@query()
def bulk_sampled_betweenness(spark, d):
    nodes, edges, adj = bulk_network(spark, d)
    return traverse.sampled_betweenness(nodes, edges, adj)


@query(f"WITH RECURSIVE {BULK_H} {COMP}")
def bulk_components(spark, d):
    nodes, edges, _ = bulk_network(spark, d)
    return traverse.connected_components(nodes, edges)


@query(f"WITH RECURSIVE {BULK_H} SELECT component, count(*) AS size FROM ({COMP}) GROUP BY 1")
def bulk_component_sizes(spark, d):
    nodes, edges, _ = bulk_network(spark, d)
    return traverse.component_sizes(traverse.connected_components(nodes, edges))


@query(f"WITH RECURSIVE {BULK_H}, c AS ({COMP}), g AS (SELECT component FROM c GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1) SELECT round(avg(d), 6) AS average_path_length FROM h JOIN c ON c.node = h.source JOIN g USING (component) WHERE d > 0")
def bulk_path_length(spark, d):
    nodes, edges, adj = bulk_network(spark, d)
    out = traverse.path_length_of_sums(traverse.connected_components(nodes, edges), traverse.hop_sums(nodes, adj))
    return out.select(F.round("average_path_length", 6).alias("average_path_length"))


BULK_SCORES = {"degree": ("bulk_degrees", "centrality"), "strength": ("bulk_degrees", "strength"), "betweenness": ("bulk_betweenness", "betweenness"), "closeness": ("bulk_closeness", "closeness"), "weighted_betweenness": ("bulk_weighted_betweenness", "betweenness"), "weighted_closeness": ("bulk_weighted_closeness", "closeness")}


@query(rankings_sql(BULK_SCORES))
def bulk_rankings(spark, d):
    nodes, edges, adj = bulk_network(spark, d)
    far = traverse.weighted_distances(nodes, adj)
    return graph.rankings({
        "degree": graph.degree_centrality(nodes, adj), "strength": graph.strength(nodes, adj), "closeness": traverse.closeness_of_sums(traverse.hop_sums(nodes, adj), nodes),
        "betweenness": traverse.batched_betweenness(nodes, edges, adj), "weighted_closeness": traverse.closeness(far, nodes), "weighted_betweenness": traverse.batched_betweenness(nodes, edges, adj, weighted=True),
    })


# Periods

SUMMARY = f"""{PA}, rc AS (SELECT period, node, node AS comp FROM n UNION SELECT rc.period, a.dst, rc.comp FROM rc JOIN a ON a.period = rc.period AND a.src = rc.node), bc AS (SELECT period, count(DISTINCT basket) AS basket_count FROM b GROUP BY 1), nc AS (SELECT period, count(*) AS node_count, count(*) FILTER (WHERE category = 'warm') AS warm, count(*) FILTER (WHERE category = 'cool') AS cool FROM n GROUP BY 1),
ec AS (SELECT period, count(*) AS edge_count, sum(weight) AS tw FROM e GROUP BY 1), cc AS (SELECT period, count(DISTINCT comp) AS component_count FROM (SELECT period, node, min(comp) AS comp FROM rc GROUP BY 1, 2) GROUP BY 1),
summary AS (SELECT period, basket_count, node_count, edge_count, round(edge_count / (node_count * (node_count - 1) / 2), 6) AS density, round(2 * edge_count / node_count, 6) AS avg_degree, round(CAST(tw AS DOUBLE) / edge_count, 6) AS avg_weight, CAST(component_count AS BIGINT) AS component_count, round(warm / node_count, 6) AS warm_ratio, round(cool / node_count, 6) AS cool_ratio FROM bc JOIN nc USING (period) JOIN ec USING (period) JOIN cc USING (period))"""


def summary_of(spark, d) -> DataFrame:
    items, nodes, edges = period_network(spark, d)
    counts = items.groupBy("period").agg(F.count(F.lit(1)).alias("basket_count"))
    return temporal.period_summary(counts, nodes, edges, traverse.connected_components(nodes, edges, ["period"]), ["warm", "cool"])


@query(f"WITH RECURSIVE {SUMMARY} SELECT * FROM summary")
def period_summary(spark, d):
    return summary_of(spark, d)


#: Hop distances, numbers of shortest paths (walks of as many steps), betweenness and closeness within each period.
PERIOD_PATHS = (
    f"{PA}, h0 AS (SELECT period, node AS source, node, 0 AS d FROM n UNION SELECT h0.period, h0.source, a.dst, h0.d + 1 FROM h0 JOIN a ON a.period = h0.period AND a.src = h0.node WHERE h0.d < 6), h AS (SELECT period, source, node, min(d) AS d FROM h0 GROUP BY 1, 2, 3), s0 AS (SELECT period, node AS source, node, 1.0::DOUBLE AS c FROM n)"
    + "".join(f", s{i} AS (SELECT s.period, s.source, a.dst AS node, sum(s.c) AS c FROM s{i - 1} s JOIN a ON a.period = s.period AND a.src = s.node GROUP BY 1, 2, 3)" for i in range(1, 7))
    + ", sg AS (SELECT h.period, h.source, h.node, h.d, s.c FROM h JOIN (" + " UNION ALL ".join(f"SELECT {i} AS d, * FROM s{i}" for i in range(7)) + ") s ON s.period = h.period AND s.source = h.source AND s.node = h.node AND s.d = h.d)"
)
PERIOD_SCORES = f"""{PERIOD_PATHS}, m AS (SELECT period, count(*) AS c FROM n GROUP BY 1), t AS (SELECT x.period, x.node, sum(x.c * y.c / z.c) AS v FROM sg x JOIN sg y ON x.period = y.period AND x.node = y.source JOIN sg z ON z.period = x.period AND z.source = x.source AND z.node = y.node AND x.d + y.d = z.d
WHERE x.source <> x.node AND y.source <> y.node AND x.source <> y.node GROUP BY 1, 2), cl AS (SELECT period, source AS node, sum(d) AS s, count(*) AS r FROM h GROUP BY 1, 2),
scores AS (SELECT period, node, round(coalesce(v, 0) * 0.5 / ((c - 1) * (c - 2) / 2), 6) AS betweenness, round(CASE WHEN s > 0 THEN (r - 1) / s * (r - 1) / (c - 1) ELSE 0 END, 6) AS closeness FROM n JOIN m USING (period) JOIN cl USING (period, node) LEFT JOIN t USING (period, node))"""
TOP_ST = f"{PERIOD_SCORES}, top AS (SELECT n.period, n.node, category, frequency, CAST(strength AS DOUBLE) AS strength, round(degree / (c - 1), 6) AS degree_centrality, row_number() OVER (PARTITION BY n.period ORDER BY strength DESC, degree DESC, n.node) AS rank FROM n JOIN st ON st.period = n.period AND st.node = n.node JOIN m ON m.period = n.period QUALIFY rank <= 10)"


@query(f"WITH RECURSIVE {TOP_ST} SELECT top.*, betweenness, closeness FROM top JOIN scores USING (period, node)")
def period_top_nodes(spark, d):
    _, nodes, edges = period_network(spark, d)
    return temporal.period_top_nodes(nodes, edges)


@query(f"WITH {PE} SELECT period, source, target, weight, row_number() OVER (PARTITION BY period ORDER BY weight DESC, source, target) AS rank FROM e QUALIFY rank <= 10")
def period_top_edges(spark, d):
    return graph.top_edges(cooc.cooccurrence_edges(baskets(spark, d, True), ["period"]), 10, ["period"])


@query(f"WITH {PA}, s AS (SELECT period, node, CAST(strength AS DOUBLE) AS strength FROM st QUALIFY row_number() OVER (PARTITION BY period ORDER BY strength DESC, node) = 1), x AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY period ORDER BY weight DESC, source, target) = 1) SELECT period, node, strength, source, target, weight FROM s JOIN x USING (period)")
def period_leaders(spark, d):
    items, nodes, edges = period_network(spark, d)
    return temporal.period_leaders(items.select("period").distinct(), nodes, edges)


CHANGES = ["node_count", "edge_count", "avg_weight", "warm_ratio", "cool_ratio"]
CHANGES_SQL = ", ".join(f"lag({c}) OVER o AS {c}_before, {c} AS {c}_after" for c in CHANGES), ", ".join(f"round({c}_after - {c}_before, 6) AS {c}_change" for c in CHANGES)


@query(f"WITH RECURSIVE {SUMMARY}, l AS (SELECT lag(period) OVER o AS before, period AS after, {CHANGES_SQL[0]} FROM summary WINDOW o AS (ORDER BY period)) SELECT *, {CHANGES_SQL[1]} FROM l WHERE before IS NOT NULL")
def period_changes(spark, d):
    return temporal.period_changes(summary_of(spark, d), CHANGES)


@query(f"WITH {PA}, t AS (SELECT period, node, CAST(strength AS DOUBLE) AS strength, row_number() OVER (PARTITION BY period ORDER BY strength DESC, node) AS rank FROM st QUALIFY rank <= 10) SELECT period, node, strength, rank, round(strength / greatest(max(strength) OVER (), 1), 6) AS share FROM t")
def relative_strength(spark, d):
    _, nodes, edges = period_network(spark, d)
    rows = graph.strength(nodes, graph.adjacency(edges, ["period"]), ["period"])
    return temporal.relative_strength(graph.ranked(rows, [F.desc("strength"), F.asc("node")], 10, ["period"]))


# Walks and embeddings


@query(f"WITH {A} SELECT x.src AS prev, x.dst AS cur, y.dst AS cand, round(CASE WHEN y.dst = x.src THEN y.w / 2 WHEN z.src IS NOT NULL THEN y.w ELSE y.w / 0.8 END, 6) AS weight FROM a x JOIN a y ON y.src = x.dst LEFT JOIN a z ON z.src = x.src AND z.dst = y.dst")
def transition_weights(spark, d):
    return walks.transition_weights(network(spark, d)[2], 2.0, 0.8).withColumn("weight", F.round("weight", 6))


@query(
    f"""WITH {A}, r AS (SELECT src, dst, sum(w) OVER (PARTITION BY src ORDER BY dst) AS s, sum(w) OVER (PARTITION BY src) AS t, ('0x' || substr(md5(concat_ws('|', '9', src)), 1, 8))::BIGINT / 4294967296.0 AS u FROM a)
SELECT src AS node, min(dst) AS pick FROM r WHERE s >= u * t GROUP BY 1"""
)
def weighted_pick(spark, d):
    lists = walks.neighbour_lists(network(spark, d)[2])
    return lists.select(F.col("src").alias("node"), walks.weighted_pick(F.col("options"), uniform(9, "src")).alias("pick"))


def walks_sql(num: int, length: int, p: float, q: float, seed: int = 42, tries: int = 16) -> str:
    """Each step: proposals by running sums of weights that reach a hashed share of their total, and the first of them that another hash accepts. That none of 16 is doesn't happen here."""
    out = f"WITH {A}, r AS MATERIALIZED (SELECT src, dst, sum(w) OVER (PARTITION BY src ORDER BY dst) AS run, sum(w) OVER (PARTITION BY src) AS total FROM a), s0 AS MATERIALIZED (SELECT src AS start, nth, src AS cur, NULL::VARCHAR AS prev, src AS walk FROM (SELECT DISTINCT src FROM a), range({num}) r(nth))"
    for i in range(1, length):
        u = [f"('0x' || substr(md5(concat_ws('|', '{seed + k}', start, nth, '{i}', a)), 1, 8))::BIGINT / 4294967296.0" for k in (0, 1)]
        out += f""", t{i} AS (SELECT s.start, s.nth, s.cur, s.prev, s.walk, x.a, min(r.dst) AS next FROM s{i - 1} s CROSS JOIN range({tries}) x(a) JOIN r ON r.src = s.cur WHERE r.run >= {u[0]} * r.total GROUP BY 1, 2, 3, 4, 5, 6),
k{i} AS (SELECT t.*, CASE WHEN t.prev IS NULL OR z.src IS NOT NULL THEN 1 WHEN t.next = t.prev THEN 1 / {p} ELSE 1 / {q} END AS bias FROM t{i} t LEFT JOIN a z ON z.src = t.prev AND z.dst = t.next),
s{i} AS MATERIALIZED (SELECT start, nth, arg_min(next, a) AS cur, k{i}.cur AS prev, concat(walk, '|', arg_min(next, a)) AS walk FROM k{i} WHERE {u[1]} * {max(1, 1 / p, 1 / q)} <= bias GROUP BY start, nth, k{i}.cur, walk)"""
    return f"{out} SELECT start, CAST(nth AS INT) AS nth, walk FROM s{length - 1}"


@query(walks_sql(12, 14, 1.0, 0.8))
def random_walks(spark, d):
    nodes, edges, adj = network(spark, d)
    return walks.random_walks(graph.without_isolated(nodes, edges), adj, 12, 14, 1.0, 0.8).select("start", "nth", F.array_join("walk", "|").alias("walk"))


@query(f"WITH w AS (SELECT basket, unnest(walk) AS node, generate_subscripts(walk, 1) AS i FROM ({LISTS})) SELECT x.node AS center, y.node AS context, count(*) AS n FROM w x JOIN w y ON x.basket = y.basket AND x.i <> y.i AND abs(x.i - y.i) <= 3 GROUP BY 1, 2")
def skipgram_pairs(spark, d):
    return walks.skipgram_pairs(basket_walks(spark, d), 3)


@query("WITH c AS (SELECT p_name AS node, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) SELECT node, n, CAST(greatest(1, round_even(10000 * pow(n, 0.75) / (SELECT sum(pow(n, 0.75)) FROM c), 0)) AS BIGINT) AS repeats FROM c")
def negative_sampling(spark, d):
    return walks.negative_sampling(basket_walks(spark, d))


def _rounded(rows: DataFrame, key: str, size: int) -> DataFrame:
    return rows.select(key, *[F.round(F.get("vector", F.lit(i)), 6).alias(f"dim_{i + 1}") for i in range(size)])


@query()
def node_embeddings(spark, d):
    paths = basket_walks(spark, d).select(F.col("basket").alias("start"), F.lit(0).alias("nth"), "walk")
    return _rounded(embed.train_embeddings(paths, 8, epochs=4), "node", 8)


@query()
def node2vec(spark, d):
    nodes, edges, _ = network(spark, d)
    return _rounded(embed.node2vec(nodes, edges, 16, epochs=4), "node", 16)


def embeddings(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").cast("array<double>").alias("vector"), "label")


def dimension(rows: DataFrame) -> int:
    return rows.select(F.max(F.size("vector"))).first()[0]


@query("SELECT p_partkey AS node, p_name AS name, p_size AS frequency, round(embedding[1]::DOUBLE, 6) AS first FROM part JOIN embeddings ON p_partkey = vec_id")
def embedding_table(spark, d):
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name"), F.col("p_size").alias("frequency"))
    return embed.embedding_table(nodes, embeddings(spark, d)).select("node", "name", "frequency", F.round(F.get("vector", F.lit(0)), 6).alias("first"))


COS = "list_dot_product({0}::DOUBLE[], {1}::DOUBLE[]) / (sqrt(list_dot_product({0}::DOUBLE[], {0}::DOUBLE[])) * sqrt(list_dot_product({1}::DOUBLE[], {1}::DOUBLE[])))"


@query(f"WITH t AS (SELECT embedding AS t FROM embeddings WHERE vec_id = 0) SELECT vec_id AS node, round({COS.format('embedding', 't')}, 6) AS similarity FROM embeddings, t")
def cosine_similarity(spark, d):
    rows = embeddings(spark, d)
    target = F.broadcast(rows.filter("node = 0").select(F.col("vector").alias("target")))
    return rows.crossJoin(target).select("node", F.round(vectors.cosine(F.col("vector"), F.col("target")), 6).alias("similarity"))  # one row


@query(f"WITH t AS (SELECT embedding AS t FROM embeddings WHERE vec_id = 0) SELECT vec_id AS node, round({COS.format('embedding', 't')}, 6) AS similarity FROM embeddings, t WHERE vec_id <> 0 ORDER BY 2 DESC, 1 LIMIT 10")
def similar_to(spark, d):
    return embed.similar_to(embeddings(spark, d), 0, 10)


@query("WITH m AS (SELECT min(p_retailprice) AS a, max(p_retailprice) AS b, min(p_size) AS c, max(p_size) AS e FROM part) SELECT p_partkey, round(10 + (p_retailprice - a) / (b - a) * 90, 6) AS x, round(90 + (p_size - c) / (e - c) * -80, 6) AS y FROM part, m")
def minmax_scale(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"))
    return embed.minmax_scale(rows, {"x": (10.0, 100.0), "y": (90.0, 10.0)}).select("p_partkey", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


# Neighbours, communities, projection

KNN = f"kn AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY weight DESC, target) AS rank FROM (SELECT x.vec_id AS source, y.vec_id AS target, round(greatest(0.0001, ({COS.format('x.embedding', 'y.embedding')} + 1) / 2), 9) AS weight FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id) QUALIFY rank <= 6)"
KNN_EDGES = f"{KNN}, ke AS (SELECT least(source, target) AS source, greatest(source, target) AS target, avg(weight) AS weight FROM kn GROUP BY 1, 2)"


@query(f"WITH {KNN} SELECT source, target, round(weight, 6) AS weight, rank FROM kn")
def knn_neighbors(spark, d):
    return knn.knn_neighbors(embeddings(spark, d), 6).withColumn("weight", F.round("weight", 6))


@query(f"WITH {KNN_EDGES} SELECT source, target, round(weight, 6) AS weight FROM ke")
def knn_edges(spark, d):
    return knn.knn_edges(knn.knn_neighbors(embeddings(spark, d), 6)).withColumn("weight", F.round("weight", 6))


@query()
def communities(spark, d):
    edges = materialize(knn.knn_edges(knn.knn_neighbors(embeddings(spark, d), 6)), "edges")
    return comm.communities(edges, 0.7)


MOD = "SELECT CAST(sum(CASE WHEN x.label = y.label THEN 2 * w ELSE 0 END) AS DOUBLE) AS i FROM {0} JOIN embeddings x ON x.vec_id = source JOIN embeddings y ON y.vec_id = target"


@query(f"WITH {KNN_EDGES}, u AS (SELECT source, target, 1.0 AS w FROM ke), g AS (SELECT label, sum(w) AS t FROM (SELECT source AS v, w FROM u UNION ALL SELECT target, w FROM u) JOIN embeddings ON vec_id = v GROUP BY 1), m AS (SELECT 2 * sum(w) AS m FROM u), i AS ({MOD.format('u')}) SELECT round((SELECT i FROM i) / (SELECT m FROM m) - sum(pow(t / (SELECT m FROM m), 2)), 6) AS modularity FROM g")
def modularity(spark, d):
    rows = embeddings(spark, d)
    edges = knn.knn_edges(knn.knn_neighbors(rows, 6))
    return comm.modularity(edges, rows.select("node", F.col("label").alias("community")), 1.0, weighted=False)


@query("SELECT label AS community, count(*) AS size FROM embeddings GROUP BY 1")
def cluster_sizes(spark, d):
    return comm.cluster_sizes(embeddings(spark, d).withColumnRenamed("label", "community"))


CLUSTERS = "t AS (SELECT vec_id AS node, p_name AS name, p_size AS frequency, label AS community, round(embedding[1]::DOUBLE, 6) AS x, round(embedding[2]::DOUBLE, 6) AS y, count(*) OVER (PARTITION BY label) AS size FROM embeddings JOIN part ON vec_id = p_partkey)"


def clusters(spark, d) -> DataFrame:
    rows = embeddings(spark, d)
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name"), F.col("p_size").alias("frequency"))
    at = rows.select("node", F.round(F.get("vector", F.lit(0)), 6).alias("x"), F.round(F.get("vector", F.lit(1)), 6).alias("y"))
    return comm.cluster_table(rows.select("node", F.col("label").alias("community")), nodes, at)


@query(f"WITH {CLUSTERS} SELECT node, name, frequency, community, x, y, size FROM t")
def cluster_table(spark, d):
    return clusters(spark, d)


@query(f"WITH {CLUSTERS}, r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY frequency DESC, node) AS rank FROM t QUALIFY rank <= 5) SELECT community, size, string_agg(node, '|' ORDER BY rank) AS members FROM r GROUP BY 1, 2")
def cluster_top_members(spark, d):
    return comm.cluster_top_members(clusters(spark, d)).withColumn("members", F.array_join(F.col("members").cast("array<string>"), "|"))


@query()
def sweep_settings(spark, d):
    near = materialize(knn.knn_neighbors(embeddings(spark, d), 12), "near")
    return comm.sweep_settings(near, [5, 8, 10, 12], [0.8, 1.0, 1.2, 1.5])


@query(
    """WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
SELECT a.i AS i, b.i AS j, round(covar_samp(a.x, b.x), 6) + 0.0 AS covariance FROM v a JOIN v b ON a.vec_id = b.vec_id GROUP BY 1, 2"""
)
def covariance(spark, d):
    rows = embeddings(spark, d)
    return project.covariance(rows, dimension(rows)).withColumn("covariance", F.round("covariance", 6) + 0.0)


def _square(m: str) -> str:
    """A symmetric matrix (list of rows) times itself, by its trace."""
    product = f"list_transform({m}, lambda r: list_transform({m}, lambda c: list_dot_product(r, c)))"
    return f"(SELECT list_transform(x, lambda r: list_transform(r, lambda v: v / tr)) AS m FROM (SELECT x, list_sum(list_transform(range(1, len(x) + 1), lambda i: x[i][i])) AS tr FROM (SELECT {product} AS x FROM {{0}})))"


def pca_sql(squarings: int = 16) -> str:
    """Powers of the covariance by squaring leave the outer product of its first component; the second is that of what is left."""
    out = """WITH v AS (SELECT vec_id, label, embedding, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), mean AS (SELECT list(a ORDER BY i) AS mu FROM (SELECT i, avg(x) AS a FROM v GROUP BY 1)),
a0 AS MATERIALIZED (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS r FROM (SELECT a.i AS i, b.i AS j, covar_samp(a.x, b.x) AS c FROM v a JOIN v b ON a.vec_id = b.vec_id GROUP BY 1, 2) GROUP BY 1))"""
    for name, after in (("a", "b"), ("b", "")):
        for i in range(1, squarings + 1):
            out += f", {name}{i} AS MATERIALIZED {_square('m').format(f'{name}{i - 1}')}"
        last = f"(SELECT m, list_transform(range(1, len(m) + 1), lambda i: m[i][i]) AS d FROM {name}{squarings})"
        row = f"(SELECT m[list_position(d, list_max(d))] AS r FROM {last})"
        unit = f"(SELECT list_transform(r, lambda x: x / sqrt(list_dot_product(r, r))) AS u FROM {row})"
        out += f", {name}v AS MATERIALIZED (SELECT list_transform(u, lambda x: x * sign(u[list_position(list_transform(u, lambda y: abs(y)), list_max(list_transform(u, lambda y: abs(y))))])) AS u FROM {unit})"
        if after:
            value = f"list_dot_product(list_transform(m, lambda r: list_dot_product(r, u)), u)"
            out += f", {after}0 AS MATERIALIZED (SELECT list_transform(range(1, len(m) + 1), lambda i: list_transform(range(1, len(m) + 1), lambda j: m[i][j] - l * u[i] * u[j])) AS m FROM (SELECT m, u, {value} AS l FROM {name}0, {name}v))"
    at = "list_dot_product(embedding::DOUBLE[], {0}v.u) - list_dot_product(mu, {0}v.u)"
    return f"{out}, pca AS (SELECT vec_id AS node, round({at.format('a')}, 6) + 0.0 AS pca_x, round({at.format('b')}, 6) + 0.0 AS pca_y, label AS community FROM embeddings, mean, av, bv)"


@query(f"{pca_sql()} SELECT node, pca_x, pca_y FROM pca")
def pca_projection(spark, d):
    rows = embeddings(spark, d)
    return project.pca_projection(rows, dimension(rows)).select("node", (F.round("pca_x", 6) + 0.0).alias("pca_x"), (F.round("pca_y", 6) + 0.0).alias("pca_y"))


@query(f"{pca_sql()} SELECT * FROM pca")
def projection_table(spark, d):
    rows = embeddings(spark, d)
    return pca_projection(spark, d).join(rows.select("node", F.col("label").alias("community")), "node")


@query(f"WITH {K} SELECT node, frequency, round(10 + 22 * sqrt(frequency / (SELECT max(frequency) FROM n)), 6) AS radius, row_number() OVER (ORDER BY frequency DESC, node) <= 12 AS labelled FROM n")
def plot_attributes(spark, d):
    nodes, edges, _ = network(spark, d)
    return graph.plot_attributes(nodes, edges, 12)[0].select("node", "frequency", F.round("radius", 6).alias("radius"), "labelled")


@query(f"WITH {K} SELECT source, target, weight, round(1.2 + 5.0 * weight / (SELECT max(weight) FROM k), 6) AS stroke FROM k")
def plot_edges(spark, d):
    nodes, edges, _ = network(spark, d)
    return graph.plot_attributes(nodes, edges, 12)[1].withColumn("stroke", F.round("stroke", 6))
