"""From source files to the module graph and the lineage graph, whole or incremental.

Extraction is per file and distributed; resolution and metrics are global DataFrame jobs over the extracted facts. An
incremental run extracts changed files only and resolves everything again, so it equals a full run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import other_code, python_code, search, sql_code
from ..session import cut
from ..sources import files as FS
from ..sources import gitlog


@dataclass
class Facts:
    """What extraction gives, one table for each kind; every row names its file in `path`. Kinds that were not asked for are None."""

    modules: DataFrame | None = None
    functions: DataFrame | None = None
    sql: DataFrame | None = None
    flows: DataFrame | None = None
    orders: DataFrame | None = None
    config: DataFrame | None = None
    notebooks: DataFrame | None = None
    issues: DataFrame | None = None

    def without(self, changes: DataFrame) -> Facts:
        """Facts of files that did not change (changes: path)."""
        return Facts(**{k: G.without(v, changes) for k, v in vars(self).items() if v is not None})

    def plus(self, other: Facts) -> Facts:
        return Facts(**{k: v.unionByName(getattr(other, k)) for k, v in vars(self).items() if v is not None})


#: What the lineage graph and the module graph are made of.
LINEAGE, MODULES = ("sql", "flows", "orders", "config", "notebooks"), ("modules", "functions")


def extract(files: DataFrame, *kinds: str) -> Facts:
    """Facts of files(path, ext, language, text), of all kinds or some; each file is parsed once, for what these need."""
    kinds = kinds or tuple(Facts.__dataclass_fields__)
    py, yaml = files.where("ext = 'py'"), files.where("ext IN ('yaml', 'yml')")
    base = files.select("path", "language", T.loc(F.col("text")).alias("loc"), T.comment_ratio(F.col("text")).alias("comment_ratio"), T.docstring(F.col("text")).alias("doc"), T.is_deprecated(F.col("text")).alias("deprecated"))
    asked = [k for k, of in (("module", ("modules", "issues")), ("functions", ("functions",)), ("flows", ("flows",)), ("orders", ("orders",))) if set(of) & set(kinds)]
    found = cut(python_code.facts(py, *asked)) if asked else None
    sql = cut(sql_code.lineages(files.where("ext = 'sql'"))) if {"sql", "issues"} & set(kinds) else None
    out = Facts(
        functions=python_code.functions(found) if "functions" in kinds else None,
        sql=sql.where("issue is null").drop("issue") if "sql" in kinds else None,
        flows=python_code.flows(found) if "flows" in kinds else None,
        orders=python_code.orders(found) if "orders" in kinds else None,
        config=other_code.yaml_edges(yaml) if "config" in kinds else None,
        notebooks=FS.notebook_io(files) if "notebooks" in kinds else None,
    )
    if "module" not in asked:
        return out
    parsed = python_code.modules(found).unionByName(other_code.js_structure(files.where("ext IN ('js', 'ts')")), allowMissingColumns=True).unionByName(other_code.yaml_structure(yaml).drop("key_paths"), allowMissingColumns=True)
    none = F.array().cast("array<string>")
    modules = base.join(parsed, "path", "left").withColumns({c: F.coalesce(c, none) for c in ("imports", "public_functions", "classes", "issues")} | {"complexity": F.coalesce("complexity", F.lit(1.0))})
    modules = modules.select("path", "language", "loc", "comment_ratio", "doc", "deprecated", "imports", "public_functions", "classes", "issues", "complexity")
    wrong = modules.select("path", F.lit("structure").alias("phase"), F.explode("issues").alias("issue"))
    if "modules" in kinds:
        out.modules = modules
    if "issues" in kinds:
        out.issues = wrong.union(sql.where("issue is not null").select("path", F.lit("lineage"), "issue"))
    return out


def call_edges(functions: DataFrame) -> DataFrame:
    """(src, dst, edge_type) of calls between functions(path, id, calls) of one file, by the callee's name."""
    called = functions.select("path", F.col("id").alias("src"), F.explode("calls").alias("callee"))
    edges = called.select("src", F.concat_ws("::", "path", "callee").alias("dst"), F.lit("CALLS").alias("edge_type")).distinct()
    return G.within(edges, functions)


def call_centrality(edges: DataFrame) -> DataFrame:
    """(id, calls): each CALLS edge counts once for the module of either end."""
    ends = edges.where("edge_type = 'CALLS'").select(F.explode(F.array("src", "dst")).alias("x"))
    return ends.groupBy(F.split_part("x", F.lit("::"), F.lit(1)).alias("id")).agg(F.count("*").alias("calls"))


def import_graph(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Imports whose ends are both modules(path)."""
    return G.within(edges.where("edge_type = 'IMPORTS'"), modules.select(F.col("path").alias("id")))


def import_edges(modules: DataFrame) -> DataFrame:
    """(src, dst, edge_type, weight) of imports between modules(path, imports)."""
    imports = modules.select(F.col("path").alias("importer"), F.explode("imports").alias("name"))
    found = FS.import_targets(imports, modules.select("path")).where("importer <> target")
    return found.select(F.col("importer").alias("src"), F.col("target").alias("dst"), F.lit("IMPORTS").alias("edge_type")).distinct().withColumn("weight", F.lit(1.0))


def module_edges(facts: Facts) -> DataFrame:
    """(src, dst, edge_type, weight): imports between modules, functions in their modules, and calls in a module."""
    f = facts.functions.select("path", "local", F.concat_ws("::", "path", "qualified").alias("id"))
    contains = f.select(F.col("path").alias("src"), F.col("id").alias("dst"), F.lit("CONFIGURES").alias("edge_type"))
    # a call stays in its file, so its ends are told where the file's row lies, as call_edges() would by joins
    calls = f.select("path", "id", F.explode("local").alias("callee")).select(F.col("id").alias("src"), F.concat_ws("::", "path", "callee").alias("dst"), F.lit("CALLS").alias("edge_type")).distinct()
    return cut(import_edges(facts.modules).union(contains.union(calls).withColumn("weight", F.lit(1.0))))


def module_graph(facts: Facts, commits: DataFrame | None = None, ranked: bool = True) -> tuple[DataFrame, DataFrame]:
    """(modules with metrics, module_edges()): rank, cycles, dead code and velocity of modules.

    Rank and cycles take many passes over the whole graph; not ranked: rank and cycle_id are null and size too, all
    else is the same.
    """
    m, edges = facts.modules, module_edges(facts)
    imported = import_graph(edges, m)
    out = m.withColumn("id", F.col("path"))
    if ranked:
        ids = m.select(F.col("path").alias("id"))
        rank = G.pagerank(ids, imported)
        cycles = G.strong_components(ids, imported).select("cycle_id", "size", F.explode("members").alias("id"))
        out = out.join(rank, "id", "left").join(cycles, "id", "left")
    else:
        out = out.withColumns({"rank": F.lit(None).cast("double"), "cycle_id": F.lit(None).cast("string"), "size": F.lit(None).cast("long")})
    into = imported.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("imported_by"))
    out = out.join(into, "id", "left").join(call_centrality(edges), "id", "left")
    velocity = gitlog.ranked(gitlog.velocity(commits)) if commits is not None else m.sparkSession.createDataFrame([], "path string, commit_count long, last_commit string, velocity_rank long, is_core boolean")
    out = gitlog.with_velocity(out, velocity).withColumns({c: F.coalesce(c, F.lit(0)) for c in ("imported_by", "calls")} | {"is_core": F.coalesce("is_core", F.lit(False))})
    dead = (F.size("public_functions") > 0) & (F.col("imported_by") == 0)
    return semantics(out.withColumns({"is_dead_code": dead, "dead_symbols": F.when(dead, F.col("public_functions")).otherwise(F.array().cast("array<string>"))})), edges


#: Fixed value: what a purpose says of a module whose docstring does not fit it.
SUSPECTED = " [Documentation Drift Suspected]"


def semantics(modules: DataFrame) -> DataFrame:
    """Modules with `purpose`, and `drift` of their docstring from it; the purpose says where there is any."""
    purpose = T.purpose(F.concat_ws(" ", F.col("path"), F.col("doc"), F.array_join("imports", " ")), F.col("language"), F.size("public_functions"))
    told = modules.withColumn("purpose", purpose).withColumn("drift", T.drift(F.col("doc"), F.col("purpose")))
    return told.withColumn("purpose", F.when(F.col("drift.drift"), F.concat("purpose", F.lit(SUSPECTED))).otherwise(F.col("purpose")))


def lineage_edges(facts: Facts) -> DataFrame:
    """(src, dst, edge_type, ...) between datasets, transformations, configs and pipelines, with the place in the code that says so."""
    where = lambda a, b: F.struct(F.col(a).cast("int").alias("start"), F.col(b).cast("int").alias("end"))
    s = facts.sql.select("path", "sources", "targets", "operation", "class", where("start", "end").alias("line_range")).withColumn("t", F.concat(F.lit("transform::"), F.col("path"), F.lit("::"), F.sha2(F.concat_ws("|", "path", F.array_join("sources", ","), F.array_join("targets", ","), F.col("line_range").cast("string")), 256).substr(1, 12)))
    data = lambda c: F.concat(F.lit("dataset::"), c)
    common = ["path", "line_range", "class"]
    all_data = lambda c: F.explode(F.transform(c, data))
    e = s.select(all_data("sources").alias("src"), F.col("t").alias("dst"), F.lit("CONSUMES").alias("edge_type"), *common, F.lit("sql").alias("analysis_method"))
    e = e.union(s.select(F.col("t").alias("src"), all_data("targets").alias("dst"), F.lit("PRODUCES").alias("edge_type"), *common, F.lit("sql").alias("analysis_method")))
    p = facts.flows.withColumn("t", F.concat(F.lit("transform::"), F.col("path")))
    at = F.concat(F.col("path"), F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
    name = F.when(F.col("unresolved"), F.concat_ws("::", F.col("dataset"), at)).otherwise(F.col("dataset"))
    reads = F.col("flow") == "CONSUMES"
    e = e.union(p.select(F.when(reads, data(name)).otherwise(F.col("t")).alias("src"), F.when(reads, F.col("t")).otherwise(data(name)).alias("dst"), F.col("flow").alias("edge_type"), "path", where("start", "end").alias("line_range"), "class", F.col("method").alias("analysis_method")))
    steps = facts.orders.select(F.concat(F.lit("pipeline::"), F.col("source")).alias("src"), F.concat(F.lit("pipeline::"), F.col("target")).alias("dst"), F.lit("CONFIGURES").alias("edge_type"), "path", where("start", "end").alias("line_range"), F.lit("").alias("class"), F.lit("python_ast").alias("analysis_method"))
    config = facts.config.select(F.concat(F.lit("config::"), F.col("source")).alias("src"), F.concat(F.lit("config::"), F.col("target")).alias("dst"), F.lit("CONFIGURES").alias("edge_type"), "path", where("start", "end").alias("line_range"), F.lit("").alias("class"), F.col("method").alias("analysis_method"))
    nb = facts.notebooks.select("path", "class", "flow", F.col("line").alias("start"), F.col("line").alias("end"), F.concat(F.lit("transform::"), F.col("path")).alias("t"), F.concat_ws("::", F.lit(python_code.DYNAMIC), "path", F.col("line").cast("string")).alias("name"))
    n_reads = F.col("flow") == "CONSUMES"
    nb = nb.select(F.when(n_reads, data(F.col("name"))).otherwise(F.col("t")).alias("src"), F.when(n_reads, F.col("t")).otherwise(data(F.col("name"))).alias("dst"), F.col("flow").alias("edge_type"), "path", where("start", "end").alias("line_range"), "class", F.lit("notebook").alias("analysis_method"))
    all_ = e.union(steps).union(config).union(nb).withColumnsRenamed({"path": "source_file", "class": "transformation_type"})
    seq = F.struct("source_file", "line_range", "edge_type", "analysis_method")
    rest = [c for c in all_.columns if c not in ("src", "dst")]
    # few edges are said twice: dealt first, they are sorted once and not before the shuffle too
    return all_.repartition("src", "dst").groupBy("src", "dst").agg(F.max_by(F.struct(*rest), seq).alias("x")).select("src", "dst", "x.*").withColumn("weight", F.lit(1.0))


def lineage_graph(facts: Facts) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of lineage_edges()."""
    edges = cut(lineage_edges(facts))
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), "source_file", "transformation_type"), F.struct(F.col("dst").alias("id"), "source_file", "transformation_type"))).alias("x")).select("x.*")
    nodes = ends.groupBy("id").agg(F.min("source_file").alias("source_file"), F.min("transformation_type").alias("transformation_type"))
    kind = G.node_type_of(F.col("id"))
    own = F.col("node_type") == "transformation"
    nodes = nodes.withColumn("node_type", kind).withColumns({"name": F.regexp_replace("id", "^[a-z]+::", ""), "source_file": F.when(own, F.col("source_file")).otherwise(""), "transformation_type": F.when(own, F.col("transformation_type")).otherwise(""), "unresolved": F.contains("id", F.lit(python_code.DYNAMIC)), "seq": F.lit(0).cast("long")})
    return nodes, edges


def refresh(before: Facts, digests: DataFrame, files: DataFrame) -> tuple[Facts, DataFrame]:
    """(facts, changes): facts of an earlier run (with the digests of its files) brought up to `files`."""
    changes = cut(FS.changed(files, digests))
    fresh = files.join(changes.where("change <> 'removed'").select("path"), "path", "left_semi")
    return before.without(changes).plus(extract(fresh)), changes


def digests(files: DataFrame) -> DataFrame:
    return files.select("path", F.sha2("text", 256).alias("digest"))


def with_domains(modules: DataFrame, wanted: int = 5) -> DataFrame:
    """Modules with `domain`: the name of their cluster, by k-means over the weights of terms in path, purpose and functions."""
    docs = modules.select(F.col("path").alias("id"), search.module_text().alias("text"))
    n = docs.count()
    if not n:
        return modules.withColumn("domain", F.lit(None).cast("string"))
    weights, idf = search.tfidf(docs)
    clusters = search.cluster(search.vectors(docs, weights, idf), search.clusters_for(n, wanted))
    named = clusters.join(search.cluster_names(weights, clusters), "cluster").select(F.col("id").alias("path"), F.col("name").alias("domain"))
    return modules.join(named, "path", "left")


def analyze(spark: SparkSession, root: str, log: str | None = None, progress: Callable[[str], None] | None = None) -> dict[str, DataFrame]:
    """Tables of a source tree: modules, module_edges, nodes, edges, and all errors of files that could not be read.

    progress is told each stage. What fails carries the name of its stage as a note.
    """
    stage = ""

    def on(name: str) -> None:
        nonlocal stage
        stage = name
        if progress:
            progress(name)

    try:
        on("scan")
        files = cut(FS.scan(spark, root))
        on("extraction")
        facts = extract(files)
        on("module graph")
        modules, edges = module_graph(facts, gitlog.commits(gitlog.lines(spark, log)) if log else None)
        on("lineage graph")
        nodes, lineage = lineage_graph(facts)
        on("domains")
        modules = with_domains(cut(modules))
    except Exception as e:
        e.add_note(f"in stage {stage}")
        raise
    return {"files": files, "modules": modules, "module_edges": edges, "nodes": nodes, "edges": lineage, "issues": facts.issues.orderBy("path", "issue")}
