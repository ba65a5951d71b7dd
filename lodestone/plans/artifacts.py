"""Documents made from the graphs: a codebase overview, a first-day brief, traces; and the way back from their text.

Each document comes from DataFrames that are already cut to a set number of rows.
"""

from __future__ import annotations

import html
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import scoring as S
from ..operators.tables import table_function
from ..session import cut
from ..sources import gitlog
from . import readmodels

QUESTIONS = {"q1_primary_ingestion": "Where does data come in?", "q2_critical_outputs": "What are the critical outputs?", "q3_blast_radius": "What has the largest blast radius?", "q4_logic_concentration": "Where is the logic concentrated?", "q5_change_velocity": "What changes most?"}


def _list(rows: list[str], none: str = "none found") -> str:
    return "\n".join(f"- {r}" for r in rows) or f"- {none}"


def codebase(tables: dict[str, DataFrame]) -> str:
    """A markdown overview in seven sections."""
    m, nodes, edges = tables["modules"], tables["nodes"], tables["edges"]
    ends = G.sources_and_sinks(nodes, edges)
    names = lambda which: [r["id"] for r in ends.where(which).orderBy("id").limit(20).collect()]
    profile = S.profile(m).first()["profile"]
    folders = [f"{r['folder']} ({r['n']})" for r in readmodels.dominant_folders(m).collect()]
    drifted = [f"{r['path']}: {r['s']}" for r in m.where("drift.drift").select("path", F.col("drift.severity").alias("s")).orderBy("path").limit(10).collect()]
    index = [f"`{r['path']}` — {r['purpose']}" for r in m.select("path", "purpose").orderBy("path").limit(200).collect()]
    moved = [f"{r['path']}: {r['commit_count']} commits" for r in m.where("commit_count > 0").orderBy(F.desc("commit_count"), "path").select("path", "commit_count").limit(10).collect()]
    cycles = [f"{r['cycle_id']}: {r['n']} modules" for r in m.where("cycle_id is not null").groupBy("cycle_id").agg(F.count("*").alias("n")).orderBy("cycle_id").collect()]
    parts = {"Architecture": f"A {profile} code base of {m.count()} modules. Main folders:\n{_list(folders)}", "Sources": _list(names("is_source")), "Sinks": _list(names("is_sink")), "Import cycles": _list(cycles), "Documentation drift": _list(drifted), "Change velocity": _list(moved), "Modules": _list(index)}
    return "# CODEBASE\n\n" + "\n\n".join(f"## {k}\n\n{v}" for k, v in parts.items()) + "\n"


def answers(tables: dict[str, DataFrame], status: str = "complete", snapshot: DataFrame | None = None) -> list[dict]:
    """The five first-day answers with evidence and confidence.

    Ingestion that the lineage graph hardly shows is completed with entrypoint modules. snapshot: (path, commit_count,
    last_commit) of a commit log; without it the modules' own counts are taken.
    """
    m, nodes, edges = tables["modules"], tables["nodes"], tables["edges"]
    spark = m.sparkSession
    one = lambda c, *a: spark.range(1).select(c(*a).alias("x")).first()["x"]
    repo = S.profile(m).first()["profile"]
    d = G.degrees(nodes, edges).join(nodes.select("id", "name", "node_type"), "id").where("node_type = 'dataset'")
    down, up = G.descendants(edges, nodes), G.descendants(G.reverse(edges), nodes).withColumnRenamed("descendants", "ancestors")
    datasets = [tuple(r) for r in S.primary_ingestion(d.join(down, "id"), 5).select("id", "name").collect()]
    q1, q2 = [i for i, _ in datasets], [r["id"] for r in S.critical_outputs(d.join(up, "id"), 5).collect()]
    imports = tables["module_edges"].where("edge_type = 'IMPORTS'")
    reach = G.descendants(imports, m.select(F.col("path").alias("id"))).withColumnRenamed("id", "path")
    scored = cut(m.join(reach, "path").select("path", "purpose", "descendants", "complexity", F.col("commit_count").alias("velocity"), "last_commit", F.coalesce("rank", F.lit(0.0)).alias("pagerank"), "calls", "deprecated"))

    def at(ids: list[str]) -> list[dict]:
        e = G.touching(edges.select("src", "dst", "source_file", "line_range", "analysis_method"), ids, 5).collect() if ids else []
        return [{"source_file": r["source_file"], "line_range": list(r["line_range"]), "analysis_method": r["analysis_method"]} for r in e]

    files = lambda ps, method: [{"source_file": p, "line_range": [1, 1], "analysis_method": method} for p in ps]
    seen = at(q1)
    strings = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    entrypoint = False
    if one(S.weak_ingestion, strings([n for _, n in datasets]), strings([e["analysis_method"] for e in seen])):
        score = S.entrypoint_score(*map(F.col, ("path", "purpose", "pagerank", "calls", "velocity")), repo_profile=repo)
        found = [r["path"] for r in scored.withColumn("score", score).where("score is not null").orderBy(F.desc("score"), "path").limit(5).collect()]
        if found:
            entrypoint, seen = True, [*seen, *files(found, "module_entrypoint_ingestion_heuristic")][:5]
            q1 = one(T.ordered_union, strings(q1), strings(found))[:5]
    q3, gap = S.blast_module(scored).collect(), False
    if q3 and q3[0]["descendants"] == 0:
        n, e, reaching = m.count(), imports.count(), reach.where("descendants > 0").count()
        alone = imports.where((F.col("src") == q3[0]["path"]) | (F.col("dst") == q3[0]["path"])).isEmpty()
        gap = one(S.coverage_gap, *map(F.lit, (0, n, e, reaching, alone)))
    blast = "no modules"
    if q3:
        p, k = q3[0]["path"], q3[0]["descendants"]
        blast = f"{p} reaches {k} modules" if k else f"{p} reaches no module that the import graph shows" + ("; the graph may miss some" if gap else "")
        blast += " (a deprecated guard)" if q3[0]["deprecated"] else ""
    logic = scored.where(~T.is_excluded(F.col("path")) & ~T.is_support(F.col("path")) & T.is_logic(F.col("path"))).withColumn("score", S.logic_score(*map(F.col, ("path", "complexity", "velocity", "pagerank", "calls"))))
    focus = logic.orderBy(F.desc("score"), "path").limit(5).collect()
    q4 = [r["path"] for r in focus]
    told = F.array(*[F.struct(F.lit(float(r["complexity"])).alias("complexity"), F.lit(float(r["pagerank"])).alias("pagerank"), F.lit(r["calls"]).alias("calls")) for r in focus])
    strong = bool(focus) and one(S.strong_business, told)
    changes = gitlog.velocity_rows(snapshot, m)
    totals = changes.agg(F.count("*").alias("active"), F.coalesce(F.sum("commit_count"), F.lit(0)).alias("changes")).first()
    active = changes.join(scored.drop("velocity", "last_commit"), "path", "left").withColumn("score", S.onboarding_score(*map(F.col, ("path", "commit_count", "pagerank", "complexity", "calls")), repo_profile=repo))
    q5 = [r["path"] for r in active.orderBy(F.desc("score"), F.desc("commit_count"), F.desc("path")).limit(5).collect()]
    low = one(S.low_velocity, F.lit(status), F.lit(totals["active"]), F.lit(totals["changes"]))
    raw = [
        ("q1_primary_ingestion", ", ".join(q1) or "no source dataset found", seen),
        ("q2_critical_outputs", ", ".join(q2) or "no obvious output dataset detected", at(q2)),
        ("q3_blast_radius", blast, files([r["path"] for r in q3], "module_graph_descendants")),
        ("q4_logic_concentration", ", ".join(q4) or "no logic found", files(q4, "complexity_and_velocity_signals")),
        ("q5_change_velocity", ", ".join(q5) or "no changes known", files(q5, "git_log_frequency")),
    ]
    rows = spark.createDataFrame([(q, a, [e["analysis_method"] for e in ev], [e["source_file"] for e in ev]) for q, a, ev in raw], "q string, answer string, methods array<string>, files array<string>")
    kinds = {r["node_type"]: r["count"] for r in nodes.groupBy("node_type").count().collect()}
    stats = {"module_nodes": m.count(), "module_edges": imports.count(), "lineage_nodes": sum(kinds.values()), "lineage_edges": edges.count(), "datasets": kinds.get("dataset", 0), "transformations": kinds.get("transformation", 0), "sinks": d.where("out_degree = 0 AND in_degree > 0").count()}
    q, me, scanned = F.col("q"), F.col("methods"), F.lit(stats["lineage_nodes"] > 0)
    git, verified = q == "q5_change_velocity", (q == "q2_critical_outputs") & F.lit(not q2)
    used, weak, hole, firm, little = F.lit(entrypoint), F.lit(entrypoint), F.lit(bool(gap)), F.lit(bool(strong)), F.lit(bool(low))
    ratio = F.lit(totals["active"] / max(1, stats["module_nodes"]))
    factors = {
        "evidence_count": S.evidence_count(q, me, verified, weak, hole, firm, git), "evidence_diversity": S.evidence_diversity(q, me, verified, hole, firm, git),
        "graph_coverage": S.graph_coverage(q, {k: F.lit(v) for k, v in stats.items()}, used, verified, scanned, F.lit(bool(q3)), hole, F.lit(len(q4)), firm, F.least(F.lit(1.0), ratio), F.lit(status), git, little), "heuristic_reliability": S.heuristic_reliability(q, me, verified, used, hole, firm),
        "signal_agreement": S.signal_agreement(q, me, verified, used, hole), "repo_type_fit": S.repo_fit(q, F.lit(repo), F.col("files"), used, verified, S.mentions_operations(F.col("answer"))),
    }
    score = S.confidence(**factors)
    score = F.when(git, S.git_only_cap(score, F.lit(status), little, F.size(me) > 0)).otherwise(score)
    made = rows.select("q", F.round(T.clamp01(score), 4).alias("score"), S.label(score).alias("label"), S.reason(S.label(score), factors).alias("reason"), *[F.round(v, 4).alias(k) for k, v in factors.items()]).collect()
    by = {r["q"]: r.asDict() for r in made}
    return [{"question_id": k, "answer": a, "evidence": ev, "confidence_label": by[k]["label"], "confidence_score": by[k]["score"], "confidence_reason": by[k]["reason"], "confidence_factors": {f: by[k][f] for f in factors}} for k, a, ev in raw]


def brief(found: list[dict]) -> str:
    """A markdown brief with a section for each answer."""
    by, out = {a["question_id"]: a for a in found}, ["# ONBOARDING BRIEF"]
    for k, title in QUESTIONS.items():
        a = by.get(k, {"answer": "", "evidence": [], "confidence_label": "low", "confidence_score": 0.0, "confidence_factors": {}})
        factors = "; ".join(f"{f}={v:.2f}" for f, v in a["confidence_factors"].items())
        out.append(f"## {title}\n\nQuestion: {k}\n\n{a['answer']}\n\nConfidence: {a['confidence_label']} ({a['confidence_score']:.4f})\n\nReason: {a.get('confidence_reason', '')}\n\nFactors: {factors}\n\nEvidence:\n" + "\n".join(f"- {json.dumps(e, sort_keys=True)}" for e in a["evidence"]))
    return "\n\n".join(out) + "\n"


def sections(markdown: str) -> dict[str, str]:
    """Sections under `## ` headings that have a body."""
    found = re.split(r"(?m)^## +(.+)$", markdown)[1:]
    return {k.strip(): v.strip() for k, v in zip(found[::2], found[1::2]) if v.strip()}


def section_rows(files: DataFrame) -> DataFrame:
    """(path, title, body): the sections of each markdown text."""
    return table_function(files, lambda t: [{"title": k, "body": v} for k, v in sections(t).items()], "title string, body string")


def brief_rows(files: DataFrame) -> DataFrame:
    """(path, question_id, answer, confidence_label, confidence_score, evidence): the answers of each brief; evidence as JSON."""
    def one(text: str) -> list[dict]:
        return [{k: json.dumps(v, sort_keys=True) if k == "evidence" else v for k, v in a.items()} for a in parse_brief(text)]

    kept = "question_id string, answer string, confidence_label string, confidence_score double, evidence string"
    names = [x.split()[0] for x in kept.split(", ")]
    return table_function(files, lambda t: [{n: a[n] for n in names} for a in one(t)], kept)


def drawn(nodes: DataFrame, edges: DataFrame, modules_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """What is drawn of a graph: no blank ids, no dangling edges; of a module graph only modules and their imports."""
    n = nodes.where("id is not null AND id <> ''")
    if modules_only:
        n, edges = n.where("node_type = 'module'"), edges.where("edge_type = 'IMPORTS'")
    return n, G.within(edges, n)


def parse_brief(markdown: str) -> list[dict]:
    """The answers that brief() wrote."""
    out = []
    for title, body in sections(markdown).items():
        m = re.search(r"^Confidence: (\w+) \(([\d.]+)\)$", body, re.M)
        q = re.search(r"^Question: (\w+)$", body, re.M)
        factors = re.search(r"^Factors: (.*)$", body, re.M)
        pairs = [p.split("=") for p in (factors[1].split("; ") if factors and factors[1] else [])]
        text = body.split("\n\n")[1] if q and body.count("\n\n") else ""
        out.append({"title": title, "question_id": q[1] if q else "", "answer": text, "confidence_label": m[1] if m else "low", "confidence_score": float(m[2]) if m else 0.0, "confidence_factors": {k: float(v) for k, v in pairs}, "evidence": [json.loads(x) for x in re.findall(r"^- (\{.*\})$", body, re.M)]})
    return out


#: How each agent looks at code, for traces that do not say.
TRACE_METHODS = {"surveyor": "static_analysis", "hydrologist": "lineage_analysis", "semanticist": "semantic_heuristics", "archivist": "artifact_generation", "navigator": "graph_query"}


def enriched_trace(events: DataFrame, most: int = 50) -> DataFrame:
    """events(timestamp, agent, action, evidence JSON text, confidence) with a method and the files that evidence names."""
    table = F.create_map(*[F.lit(x) for pair in TRACE_METHODS.items() for x in pair])
    named = T.paths_in(F.col("evidence"))
    return events.withColumns({"analysis_method": F.coalesce(F.get_json_object("evidence", "$.analysis_method"), table[F.lower("agent")], F.lit("pipeline_step")), "source_files": F.slice(named, 1, most)})


def graph_page(nodes: DataFrame, edges: DataFrame, most: int = 300) -> str:
    """A small HTML page of a graph's best connected nodes: labels by degree, edges as a list."""
    nodes, edges = drawn(nodes, edges)
    d = G.degrees(nodes, edges).select("id", (F.col("in_degree") + F.col("out_degree")).alias("degree"))
    kept = [(r["id"], r["degree"]) for r in d.orderBy(F.desc("degree"), "id").limit(most).collect()]
    if not kept:
        return "<!doctype html><title>Graph</title><p>The graph is empty.</p>"
    ids = {k for k, _ in kept}
    links = [(r["src"], r["dst"]) for r in edges.select("src", "dst").where(F.col("src").isin(list(ids)) & F.col("dst").isin(list(ids))).orderBy("src", "dst").limit(10 * most).collect()]
    rows = "".join(f"<tr><td>{html.escape(k)}</td><td>{v}</td></tr>" for k, v in kept)
    return f"<!doctype html><meta charset='utf-8'><title>Graph</title><table><tr><th>node</th><th>degree</th></tr>{rows}</table><ul>" + "".join(f"<li>{html.escape(a)} → {html.escape(b)}</li>" for a, b in links) + "</ul>"
