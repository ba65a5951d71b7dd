"""Graphs and records as files: node-link JSON in and out, JSON lines, artifacts by name."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import node_type_of

VERSION = 1
#: Nodes or edges that one document holds at most; a larger graph is a folder of documents.
MOST = 50_000
_NODE = "array<struct<id string, node_type string, name string, source_file string, transformation_type string>>"
_EDGE = "array<struct<source string, target string, edge_type string, weight double, source_file string, analysis_method string>>"


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a node-link JSON file or a folder of them; edges may be called links. Types that are missing come from the ids."""
    doc = spark.read.option("multiLine", "true").schema(f"part long, nodes {_NODE}, edges {_EDGE}, links {_EDGE}").json(path)
    first = F.shiftleft(F.coalesce("part", F.lit(0)), 32)
    seq = (F.col("first") + F.col("at")).alias("seq")
    nodes = doc.select(first.alias("first"), F.posexplode("nodes").alias("at", "x")).select("x.*", seq)
    kind = F.when(F.trim("node_type") != "", F.lower(F.trim("node_type")))
    nodes = nodes.withColumn("node_type", F.coalesce(kind, node_type_of(F.col("id"))))
    edges = doc.select(first.alias("first"), F.posexplode(F.coalesce("edges", "links")).alias("at", "x")).select(F.col("x.source").alias("src"), F.col("x.target").alias("dst"), "x.edge_type", valid_weight("x.weight").alias("weight"), "x.source_file", "x.analysis_method", seq)
    return nodes, edges


def valid_weight(c: str):
    """At least 0; 1 where there is none."""
    return F.greatest(F.coalesce(F.try_cast(c, "double") if hasattr(F, "try_cast") else F.col(c).cast("double"), F.lit(1.0)), F.lit(0.0))


def graph_document(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row, one column (value): the node-link JSON of a graph, in order of ids. For graphs that one file should hold."""
    n = nodes.agg(F.to_json(F.array_sort(F.collect_list(F.struct("id", *[c for c in nodes.columns if c != "id"])))).alias("n"))
    e = edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), *[c for c in edges.columns if c not in ("src", "dst")])
    e = e.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*e.columns)))).alias("e"))
    both = n.withColumn("k", F.lit(0)).join(e.withColumn("k", F.lit(0)), "k")
    return both.select(F.concat(F.lit('{"directed":true,"multigraph":false,"graph_schema_version":'), F.lit(str(VERSION)), F.lit(',"nodes":'), "n", F.lit(',"edges":'), "e", F.lit("}")).alias("value"))


def _documents(rows: DataFrame, n: int, kind: str) -> DataFrame:
    """(value): node-link documents of `MOST` rows at most, which are nodes or edges, in order of their columns.

    Rows are dealt by ranges, and a task joins the entries of its own: none holds more than a document at once.
    """
    other, most, version = {"nodes": "edges", "edges": "nodes"}[kind], MOST, VERSION
    dealt = rows.repartitionByRange(-(-n // most), *rows.columns).sortWithinPartitions(*rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, k = [], 0, 0

        def document() -> pa.RecordBatch:
            head = f'{{"directed":true,"multigraph":false,"graph_schema_version":{version},"part":{(at << 12) + k},"{other}":[],"{kind}":['
            return pa.RecordBatch.from_arrays([pa.array([head + ",".join(held) + "]}"])], ["value"])

        for b in batches:
            for at, entry in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.append(entry)
                if len(held) == most:
                    yield document()
                    held, k = [], k + 1
        if held:
            yield document()

    return dealt.select(F.spark_partition_id().alias("at"), F.to_json(F.struct(*rows.columns)).alias("entry")).mapInArrow(run, "value string")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A folder with the graph as one document, or as one for each `MOST` nodes or edges; read_graph() reads either."""
    n, e = nodes.count(), edges.count()
    if n + e <= MOST:
        graph_document(nodes, edges).coalesce(1).write.mode("overwrite").text(path)
        return
    links = edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), *[c for c in edges.columns if c not in ("src", "dst")])
    out = [_documents(rows, k, kind) for rows, k, kind in ((nodes.select("id", *[c for c in nodes.columns if c != "id"]), n, "nodes"), (links, e, "edges")) if k]
    for k, documents in enumerate(out):
        documents.write.mode("append" if k else "overwrite").option("maxRecordsPerFile", 1).text(path)


def write_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a missing file has no rows, blank lines are passed over."""
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def artifact(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """An artifact of a folder by its name: JSON lines as rows, else one row with its text."""
    if not name or "/" in name or "\\" in name or name.startswith("."):
        raise ValueError(f"not the name of an artifact: {name!r}")
    path = f"{folder.rstrip('/')}/{name}"
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.json(path) if name.endswith(".jsonl") else spark.read.text(path, wholetext=True)
