"""Command line: analyze a tree, ask about it, draw it.

    python -m lodestone.cli analyze PATH [--output DIR] [--days N]
    python -m lodestone.cli query DIR TOOL ARG [--direction upstream|downstream]
    python -m lodestone.cli ask DIR QUESTION...
    python -m lodestone.cli visualize DIR

Exit 0; 1: there is no analysis; 2: the question failed.
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .plans import analyze, artifacts, readmodels
from .plans.navigator import Answer, Navigator
from .session import session
from .sources import gitlog, graph_files, repositories

TABLES = ("modules", "module_edges", "nodes", "edges")


def save(tables: dict[str, DataFrame], out: str, status: str = "complete") -> None:
    """The tables and all issues as Parquet, graphs as JSON, the semantic index as JSON lines, and the two documents."""
    for name in (*TABLES, "issues"):
        tables[name].write.mode("overwrite").parquet(f"{out}/{name}.parquet")
    graph_files.write_graph(tables["nodes"].select("id", "node_type", "name", "source_file", "transformation_type"), tables["edges"].select("src", "dst", "edge_type", "weight", "source_file", "analysis_method"), f"{out}/lineage_graph.json")
    graph_files.write_lines(readmodels.semantic_index(tables), f"{out}/semantic_index.jsonl")
    found = artifacts.answers(tables, status)
    for name, text in (("CODEBASE.md", artifacts.codebase(tables)), ("onboarding_brief.md", artifacts.brief(found)), ("day_one.json", json.dumps(found, indent=2))):
        Path(out, name).write_text(text)


def load(spark: SparkSession, out: str) -> dict[str, DataFrame] | None:
    if not all(graph_files.exists(spark, f"{out}/{n}.parquet") for n in TABLES):
        return None
    return {n: spark.read.parquet(f"{out}/{n}.parquet") for n in TABLES}


def payload(a: Answer, most: int | None = None) -> dict:
    """An answer as JSON; `most` rows of it are shown, or all, one after the other."""
    shown = a.rows if a.rows is None or most is None else a.rows.limit(most)
    rows = [r.asDict(recursive=True) for r in shown.toLocalIterator()] if shown is not None else []
    return {"ok": a.ok, "tool": a.tool, "arg": a.arg, "direction": a.direction, "result": rows, "evidence": a.evidence, "error": a.error}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze")
    a.add_argument("path")
    a.add_argument("--output")
    a.add_argument("--days", type=int, default=90)
    q = sub.add_parser("query")
    q.add_argument("folder")
    q.add_argument("tool")
    q.add_argument("arg")
    q.add_argument("--direction", default="upstream")
    k = sub.add_parser("ask")
    k.add_argument("folder")
    k.add_argument("question", nargs="+")
    for x in (q, k):
        x.add_argument("--rows", type=int, help="rows that are shown (all)")
    sub.add_parser("visualize").add_argument("folder")
    o = p.parse_args(argv)
    spark = session()
    if o.command == "analyze":
        out = o.output or f"{o.path}/.lodestone"
        Path(out).mkdir(parents=True, exist_ok=True)
        status, log = gitlog.capture(o.path, o.days)
        began = time.time()
        save(analyze.analyze(spark, o.path, log, progress=lambda stage: print(stage, file=sys.stderr)), out, status)
        Path(out, "state.json").write_text(json.dumps(repositories.state(o.path, began), indent=2))
        print(json.dumps({"output": out, "history": status}))
        return 0
    tables = load(spark, o.folder)
    if tables is None:
        print(f"no analysis in {o.folder}", file=sys.stderr)
        return 1
    if o.command == "visualize":
        Path(o.folder, "lineage.html").write_text(artifacts.graph_page(tables["nodes"], tables["edges"]))
        return 0
    nav = Navigator(*(tables[n] for n in TABLES))
    answers = [nav.run(o.tool, o.arg, o.direction)] if o.command == "query" else nav.ask(" ".join(o.question))
    print(json.dumps([payload(x, o.rows) for x in answers], default=str, indent=2))
    return 0 if all(x.ok for x in answers) else 2


if __name__ == "__main__":
    sys.exit(main())
