"""Tables in files: typed CSV with quoted newlines, sheets with a header somewhere, graph XML, wide vectors."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from basketgraph.session import numbered


def read_csv(spark: SparkSession, path, schema: StructType | str) -> DataFrame:
    """CSV with a header (and a byte order mark, if any), doubled quotes and quoted newlines."""
    return spark.read.schema(schema).options(header=True, multiLine=True, quote='"', escape='"', enforceSchema=False).csv(path)


def write_csv(df: DataFrame, path: str, digits: int | None = None) -> None:
    """With digits floating-point numbers have so many decimals, also where they are zeros."""
    rows = df if digits is None else df.select(*[F.format_string(f"%.{digits}f", F.col(c).cast("double")).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
    rows.write.options(header=True, quote='"', escape='"', escapeQuotes=True).csv(path)


def missing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those paths that don't exist, in any file system that Spark reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    of = [(p, jvm.org.apache.hadoop.fs.Path(p)) for p in paths]
    return [p for p, x in of if not x.getFileSystem(conf).exists(x)]


def union_periods(spark: SparkSession, paths: dict[str, str], schema: StructType | str, period: str = "period") -> DataFrame:
    """The files of all periods with a column that names the period; all missing paths are reported at once."""
    if gone := missing(spark, list(paths.values())):
        raise FileNotFoundError(f"missing: {', '.join(gone)}")
    out = None
    for name, path in paths.items():
        rows = read_csv(spark, path, schema).withColumn(period, F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def locate_header(cells: DataFrame, row: str, values: str, expected: list[str]) -> DataFrame:
    """Rows after the first one whose trimmed cells hold all expected headers, as columns of those names.

    cells has a row number and an array of strings. Without such a row an error is raised when the result is read.
    """
    want = F.array(*[F.lit(e) for e in expected])
    names = F.transform(values, lambda x: F.trim(x))
    header = cells.filter(F.size(F.array_except(want, names)) == 0).agg(F.min_by(F.struct(F.col(row).alias("at"), F.transform(want, lambda e: F.array_position(names, e).cast("int")).alias("where")), row).alias("h"))
    checked = header.select(F.when(F.assert_true(F.col("h").isNotNull(), "no header row").isNull(), F.col("h")).alias("h"))
    rows = cells.join(F.broadcast(checked), F.col(row) > F.col("h.at"))
    return rows.select(row, *[F.get(values, F.col("h.where")[i] - 1).alias(e) for i, e in enumerate(expected)])


def xml_nodes(nodes: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """Rows for the XML writer: an id and a list of data elements."""
    data = F.array(*[F.struct(F.lit(a).alias("_key"), F.col(a).cast("string").alias("_VALUE")) for a in attributes])
    return nodes.select(F.col(key).alias("_id"), data.alias("data"))


def number_edges(edges: DataFrame) -> DataFrame:
    """Edges for the XML writer, numbered e0, e1, ... by weight, source, target."""
    rows = numbered(edges.select("source", "target", "weight"), [F.desc("weight"), F.asc("source"), F.asc("target")])
    data = F.array(F.struct(F.lit("weight").alias("_key"), F.col("weight").cast("string").alias("_VALUE")))
    return rows.select(F.concat(F.lit("e"), "number").alias("_id"), F.col("source").alias("_source"), F.col("target").alias("_target"), data.alias("data"))


def write_xml(rows: DataFrame, path: str, tag: str, root: str = "graph") -> None:
    rows.write.format("xml").options(rowTag=tag, rootTag=root).save(path)


def _escaped(c: Column) -> Column:
    """Text for XML, in elements and attributes."""
    out = c.cast("string")
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


#: Types of keys in graph XML by Spark's.
XML_TYPES = {"bigint": "long", "int": "int", "smallint": "int", "tinyint": "int", "double": "double", "float": "float", "boolean": "boolean"}


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, attributes: list[str], key: str = "node") -> None:
    """One graph document in text files that follow each other in order of name: keys, nodes by key, edges e0, e1, ... by weight.

    Rows are sorted by ranges, so no task or file holds the document; merge_parts() makes one file of them. Attributes
    that are null have no element.
    """
    spark, kinds = nodes.sparkSession, dict(nodes.dtypes)
    keys = [f'<key id="d{i}" for="node" attr.name="{a}" attr.type="{XML_TYPES.get(kinds[a], "string")}"/>' for i, a in enumerate(attributes)]
    keys.append(f'<key id="w" for="edge" attr.name="weight" attr.type="{XML_TYPES.get(dict(edges.dtypes)["weight"], "string")}"/>')
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *keys, '<graph edgedefault="undirected">']
    ends = spark.createDataFrame([(0, i, x) for i, x in enumerate(head)] + [(3, 0, "</graph>"), (3, 1, "</graphml>")], "section int, number long, value string")
    data = [F.when(F.col(a).isNotNull(), F.concat(F.lit(f'<data key="d{i}">'), _escaped(F.col(a)), F.lit("</data>"))) for i, a in enumerate(attributes)]
    node = F.concat_ws("", F.lit('<node id="'), _escaped(F.col(key)), F.lit('">'), *data, F.lit("</node>"))
    at = numbered(nodes, [F.asc(key)]).select(F.lit(1).alias("section"), "number", node.alias("value"))
    ordered = numbered(edges.select("source", "target", "weight"), [F.desc("weight"), F.asc("source"), F.asc("target")])
    edge = F.concat(F.lit('<edge id="e'), "number", F.lit('" source="'), _escaped(F.col("source")), F.lit('" target="'), _escaped(F.col("target")), F.lit('"><data key="w">'), _escaped(F.col("weight")), F.lit("</data></edge>"))
    lines = ends.unionByName(at).unionByName(ordered.select(F.lit(2).alias("section"), "number", edge.alias("value")))
    lines.repartitionByRange("section", "number").sortWithinPartitions("section", "number").select("value").write.text(path)


def merge_parts(spark: SparkSession, path: str, to: str) -> None:
    """One file of all part files of a folder, in order of name: streamed to a file beside it that is renamed when it is whole."""
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    of = lambda p: hadoop.fs.Path(p)
    fs = of(path).getFileSystem(conf)
    parts = sorted(s.getPath().toString() for s in fs.listStatus(of(path)) if s.getPath().getName().startswith("part-"))
    out = fs.create(of(f"{to}.part"), True)
    try:
        for p in parts:
            given = fs.open(of(p))
            try:
                hadoop.io.IOUtils.copyBytes(given, out, 1 << 16, False)
            finally:
                given.close()
    finally:
        out.close()
    if fs.exists(of(to)) or not fs.rename(of(f"{to}.part"), of(to)):
        raise FileExistsError(to)


def read_graph(spark: SparkSession, path: str, attributes: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes (node and attributes, as strings) and edges (id, source, target, weight) of a document, in one file or in parts."""
    value = "array<struct<_VALUE:string,_key:string>>"
    nodes = spark.read.format("xml").options(rowTag="node", ignoreSurroundingSpaces=False).schema(f"_id string, data {value}").load(path)
    pick = lambda i: F.get(F.filter("data", lambda x: x["_key"] == f"d{i}"), F.lit(0))["_VALUE"]
    nodes = nodes.select(F.col("_id").alias("node"), *[pick(i).alias(a) for i, a in enumerate(attributes)])
    edges = spark.read.format("xml").options(rowTag="edge", ignoreSurroundingSpaces=False).schema("_id string, _source string, _target string, data struct<_VALUE:double,_key:string>").load(path)
    return nodes, edges.select(F.col("_id").alias("id"), F.col("_source").alias("source"), F.col("_target").alias("target"), F.col("data._VALUE").alias("weight"))


def _numbered(columns: list[str], prefix: str) -> list[str]:
    return sorted((c for c in columns if re.fullmatch(rf"{re.escape(prefix)}\d+", c)), key=lambda c: int(c[len(prefix) :]))


def columns_to_vector(df: DataFrame, prefix: str = "dim_", vector: str = "vector") -> DataFrame:
    """Wide columns prefix1, prefix2, ... to one array, in order of number."""
    names = _numbered(df.columns, prefix)
    return df.select(*[c for c in df.columns if c not in names], F.array(*[F.col(c).cast("double") for c in names]).alias(vector))


def vector_to_columns(df: DataFrame, size: int, vector: str = "vector", prefix: str = "dim_") -> DataFrame:
    cells: list[Column] = [F.get(vector, F.lit(i)).alias(f"{prefix}{i + 1}") for i in range(size)]
    return df.select(*[c for c in df.columns if c != vector], *cells)
