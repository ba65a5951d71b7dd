"""Four tools over the graphs, questions in plain words, and chains of two steps."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import search
from ..operators.tables import table_function
from ..session import cut

TOOLS = ("find_implementation", "trace_lineage", "blast_radius", "explain_module")
#: Openings of questions, each with its tool and direction; the longest that fits wins.
OPENINGS = {
    "find implementation of": ("find_implementation", ""), "find implementation": ("find_implementation", ""), "where is": ("find_implementation", ""), "search for": ("find_implementation", ""), "find": ("find_implementation", ""),
    "trace upstream of": ("trace_lineage", "upstream"), "trace upstream": ("trace_lineage", "upstream"), "what feeds": ("trace_lineage", "upstream"), "upstream of": ("trace_lineage", "upstream"),
    "trace downstream of": ("trace_lineage", "downstream"), "trace downstream": ("trace_lineage", "downstream"), "what depends on": ("trace_lineage", "downstream"), "downstream of": ("trace_lineage", "downstream"),
    "trace lineage of": ("trace_lineage", "upstream"), "trace lineage": ("trace_lineage", "upstream"), "trace": ("trace_lineage", "upstream"),
    "blast radius of": ("blast_radius", ""), "blast radius": ("blast_radius", ""), "impact of": ("blast_radius", ""), "what breaks if i change": ("blast_radius", ""),
    "explain module": ("explain_module", ""), "explain": ("explain_module", ""), "describe": ("explain_module", ""),
}


def question_rows(files: DataFrame) -> DataFrame:
    """(path, step, tool, arg, direction): the steps of each text, taken as a question."""
    def one(text: str) -> list[dict]:
        return [{"step": k, "tool": tool, "arg": arg, "direction": direction} for k, (tool, arg, direction) in enumerate(steps(text), 1)]

    return table_function(files, one, "step int, tool string, arg string, direction string")


def with_evidence(found: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """found(node, depth, parent) with file, lines, method and type: of the edge of discovery, else of the node, else none."""
    e = edges.select(F.col("src").alias("parent"), F.col("dst").alias("node"), "source_file", "line_range", "analysis_method", "transformation_type")
    n = nodes.select(F.col("id").alias("node"), "node_type", F.col("source_file").alias("nf"), F.col("transformation_type").alias("nt"))
    own = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.nullif(F.col(b), F.lit("")), F.lit(""))
    out = found.join(e, ["parent", "node"], "left").join(n, "node", "left")
    return out.select("node", "depth", "parent", "node_type", own("source_file", "nf").alias("source_file"), "line_range", F.coalesce(F.nullif("analysis_method", F.lit("")), F.lit("static_graph_lookup")).alias("analysis_method"), own("transformation_type", "nt").alias("transformation_type"))


def distinct_evidence(rows: DataFrame) -> DataFrame:
    """(source_file, line_range, analysis_method, depth, node): each place once, with the first node by depth that it speaks for."""
    kept = rows.where("source_file <> ''").groupBy("source_file", "line_range", "analysis_method").agg(F.min(F.struct("depth", "node")).alias("x"))
    return kept.select("source_file", "line_range", "analysis_method", "x.depth", "x.node")


def evidence_list(rows: DataFrame, most: int = 50) -> list[dict]:
    found = distinct_evidence(rows).orderBy("depth", "node", "source_file", "line_range").limit(most).collect()
    return [{"source_file": r["source_file"], "line_range": list(r["line_range"] or (1, 1)), "analysis_method": r["analysis_method"], "node": r["node"]} for r in found]


@dataclass
class Answer:
    """ok, the tool and its argument, rows of the result, rows of evidence, and what went wrong."""

    ok: bool
    tool: str
    arg: str
    direction: str = ""
    rows: DataFrame | None = None
    evidence: list[dict] = field(default_factory=list)
    error: str = ""


def parse(question: str) -> tuple[str, str, str]:
    """(tool, argument, direction); the tool is '' if the question is not understood."""
    q = re.sub(r"\s+", " ", question.strip()).rstrip("?").strip()
    m = re.match(r"(\w+)\s+(.+?)(?:\s+(upstream|downstream))?$", q)
    if m and normal_tool(m[1]) in TOOLS and "_" in m[1]:
        return normal_tool(m[1]), m[2].strip("'\"` "), m[3] or ("upstream" if normal_tool(m[1]) == "trace_lineage" else "")
    for opening in sorted(OPENINGS, key=len, reverse=True):
        if q.lower().startswith(opening + " "):
            tool, direction = OPENINGS[opening]
            arg = q[len(opening) :].strip("'\"` ")
            if tool == "trace_lineage" and (m := re.fullmatch(r"(.+?)\s+(upstream|downstream)", arg)):
                arg, direction = m[1], m[2]
            return tool, arg, direction
    return "", q, ""


def normal_tool(name: str) -> str:
    return re.sub(r"[\s-]+", "_", name.strip().lower())


def steps(question: str) -> list[tuple[str, str, str]]:
    """One step, or two: `<trace or blast> then explain [it]`; an empty argument of the second is found from the first."""
    m = re.match(r"(.+?)\s+(?:then|and)\s+explain\b\s*(?:the\s+)?(?:it|module|that|result)?\s*(.*)$", question.strip(), re.I)
    if m and parse(m[1])[0] in ("trace_lineage", "blast_radius"):
        return [parse(m[1]), ("explain_module", m[2].strip("'\"`? "), "")]
    return [parse(question)]


class Navigator:
    """Tools over tables as plans.analyze gives them: modules, module_edges, nodes, edges."""

    def __init__(self, modules: DataFrame, module_edges: DataFrame, nodes: DataFrame, edges: DataFrame):
        self.modules, self.module_edges, self.nodes, self.edges = modules, module_edges, nodes, edges

    def run(self, tool: str, arg: str, direction: str = "") -> Answer:
        tool = normal_tool(tool)
        if tool not in TOOLS:
            return Answer(False, tool, arg, error=f"Unknown tool {tool!r}; there are {', '.join(TOOLS)}.")
        return getattr(self, tool)(arg, direction) if tool == "trace_lineage" else getattr(self, tool)(arg)

    def ask(self, question: str) -> list[Answer]:
        """An answer for each step; stops at the first that fails."""
        out: list[Answer] = []
        for tool, arg, direction in steps(question):
            if not tool:
                return [*out, Answer(False, "", arg, error=f"Not understood. Tools: {', '.join(TOOLS)}.")]
            if not arg and out:
                arg = self._module_of(out[-1])
            out.append(self.run(tool, arg, direction))
            if not out[-1].ok:
                break
        return out

    def _module_of(self, answer: Answer) -> str:
        files = [e["source_file"] for e in answer.evidence if e.get("source_file")]
        known = {r["path"] for r in self.modules.where(F.col("path").isin(files)).select("path").collect()} if files else set()
        return next((f for f in files if f in known), "")

    def resolve_module(self, name: str) -> str | None:
        """Exact path, path without case, then the end of a path; the smallest of several."""
        low = F.lower("path")
        tier = F.when(F.col("path") == name, 0).when(low == name.lower(), 1).when(F.endswith(low, F.lit("/" + name.lower())), 2)
        found = self.modules.select("path", tier.alias("t")).where("t is not null").orderBy("t", "path").limit(1).collect()
        return found[0]["path"] if found else None

    def resolve_node(self, name: str) -> str | None:
        """Exact id, then a dataset of that name, then an id without case, then one that ends in ::name; the smallest of several."""
        found = G.resolve(self.nodes.where(F.col("id") == name), name, prefix="") or G.resolve(self.nodes.where("node_type = 'dataset'"), name)
        if found is not None:
            return found
        low = F.lower("id")
        tier = F.when(low == name.lower(), 0).when(F.endswith(low, F.lit("::" + name.lower())), 1)
        rows = self.nodes.select("id", tier.alias("t")).where("t is not null").orderBy("t", "id").limit(1).collect()
        return rows[0]["id"] if rows else None

    def find_implementation(self, concept: str) -> Answer:
        spark = self.modules.sparkSession
        docs = self.modules.select(F.col("path").alias("id"), search.module_text().alias("text"))
        rows = search.find(docs, spark.createDataFrame([(0, concept)], "id long, text string")).select(F.col("id").alias("path"), "score", "rank")
        evidence = [{"source_file": r["path"], "line_range": [1, 1], "analysis_method": "tfidf_search"} for r in rows.orderBy("rank").limit(5).collect()]
        return Answer(bool(evidence), "find_implementation", concept, rows=rows, evidence=evidence, error="" if evidence else f"Nothing found for {concept!r}.")

    def trace_lineage(self, dataset: str, direction: str = "upstream") -> Answer:
        direction = "downstream" if direction == "downstream" else "upstream"
        node = G.resolve(self.nodes, dataset)
        if node is None:
            return Answer(False, "trace_lineage", dataset, direction, error=f"No dataset like {dataset!r}.")
        edges = self.edges if direction == "downstream" else G.reverse(self.edges)
        found = G.reach(edges, self.nodes.sparkSession.createDataFrame([(node,)], "start string"))
        rows = cut(with_evidence(found, edges, self.nodes))  # read for the evidence, and by the caller
        return Answer(True, "trace_lineage", node, direction, rows=rows, evidence=evidence_list(rows))

    def what_feeds(self, dataset: str) -> dict:
        """target, direct and full upstream rows, and evidence; an unknown dataset has none of them."""
        return self._structured(dataset, "upstream")

    def what_depends_on(self, dataset: str) -> dict:
        return self._structured(dataset, "downstream")

    def _structured(self, dataset: str, direction: str) -> dict:
        a = self.trace_lineage(dataset, direction)
        if not a.ok:
            target = dataset if dataset.startswith("dataset::") else f"dataset::{dataset}"
            return {"target": target, "direct": [], "full": [], "evidence": []}
        rows = a.rows.orderBy("depth", "node")
        return {"target": a.arg, "direct": rows.where("depth = 1"), "full": rows, "evidence": a.evidence}

    def impact_report(self, dataset: str) -> dict:
        """What lies downstream of a node: counts, datasets, sinks, files, and the configs and pipelines of these files."""
        node = self.resolve_node(dataset)
        if node is None:
            return {"target": dataset if "::" in dataset else f"dataset::{dataset}", "impacted": 0, "max_depth": 0, "datasets": 0, "transformations": 0, "sinks": [], "source_files": [], "related_pipelines": []}
        spark = self.nodes.sparkSession
        starts = spark.createDataFrame([(node,)], "start string")
        found = cut(G.impacted(self.edges, self.nodes.select("id", "node_type", "source_file"), starts))  # read for the report, and for what its files declare
        row = G.impact_of(found, starts).first()
        files = found.where("source_file <> ''").select("source_file").distinct()
        near = self.edges.join(G.sent(files, row["impacted"]), "source_file", "left_semi")
        declared = near.select(F.explode(F.array("src", "dst")).alias("id"), "source_file").distinct().join(G.sent(self.nodes.select("id", "node_type")), "id")
        related = [r["id"] for r in G.related_by_file(declared, G.sent(files, row["impacted"])).orderBy("id").limit(50).collect()]
        return {"target": node, "related_pipelines": related} | {k: row[k] for k in ("impacted", "max_depth", "datasets", "transformations", "sinks", "source_files")}

    def blast_radius(self, target: str, dependents: bool = False) -> Answer:
        """What a module imports, directly or not (dependents: what imports it), else what lies downstream of a dataset."""
        path = self.resolve_module(target)
        if path is not None:
            imports = self.module_edges.where("edge_type = 'IMPORTS'")
            rows = G.levels(G.reverse(imports) if dependents else imports, self.modules.sparkSession.createDataFrame([(path,)], "start string")).select("node", "depth")
            return Answer(True, "blast_radius", path, rows=rows, evidence=[{"source_file": path, "line_range": [1, 1], "analysis_method": "module_graph_descendants"}])
        if "/" in target or re.search(r"\.(py|sql|js|ts|ya?ml|ipynb)$", target):
            return Answer(False, "blast_radius", target, error=f"No module found for {target!r}.")
        a = self.trace_lineage(target, "downstream")
        return Answer(a.ok, "blast_radius", a.arg, rows=a.rows, evidence=a.evidence, error=a.error)

    def explain_module(self, name: str) -> Answer:
        path = self.resolve_module(name)
        if path is None:
            return Answer(False, "explain_module", name, error=f"No module found for {name!r}.")
        rows = self.modules.where(F.col("path") == path).select("path", "language", "purpose", "loc", "complexity", "public_functions", "classes", "imports", "rank", "commit_count", "is_dead_code", "cycle_id")
        return Answer(True, "explain_module", path, rows=rows, evidence=[{"source_file": path, "line_range": [1, 1], "analysis_method": "static_graph_lookup"}])
