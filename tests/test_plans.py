"""The whole way on a small tree of our own: scan, graphs, tools, documents, incremental runs."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph as G
from lodestone.plans import analyze, artifacts, navigator
from lodestone.sources import files as FS
from lodestone.sources import gitlog, graph_files, repositories

TREE = {
    "pipeline.py": '"""Reads orders."""\nimport pandas as pd\nfrom helpers import clean\nSRC = "data/orders.csv"\n\nclass Job(Base):\n    pass\n\ndef _build():\n    df = pd.read_csv(SRC)\n    return clean(df)\n\ndef run():\n    _build().to_csv("data/clean.csv")\n',
    "helpers.py": "def clean(x):\n    return x\n",
    "sub/__init__.py": "",
    "sub/a.py": "from . import b\nimport helpers\n",
    "sub/b.py": "from .a import thing\n",
    "model.sql": "with a as (select * from orders_raw), b as (select * from a)\nselect * from b\n",
    "mart.sql": "insert into mart.daily (x)\nselect x from model join dim using (id)\n",
    "schema.yml": "models:\n  - name: model\n    depends_on:\n      nodes: [orders_raw]\n",
    "dag.py": "extract >> transform\n",
    "bad.py": "def (:\n",
    "web/app.ts": "import { x } from './x';\nexport class App extends Base {}\n",
    "node_modules/skip.js": "function no() {}",
    "notes.md": "nothing",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in TREE.items():
        os.makedirs(root / os.path.dirname(name), exist_ok=True)
        (root / name).write_text(text)
    return str(root)


@pytest.fixture(scope="module")
def tables(spark, tree):
    log = f"{gitlog.HEADER}a|2024-01-01T00:00:00+00:00\npipeline.py\nhelpers.py\n\n{gitlog.HEADER}b|2024-01-02T00:00:00+00:00\npipeline.py\n"
    made = analyze.analyze(spark, tree, log)
    return {k: v.cache() for k, v in made.items()}


def test_modules(tables):
    m = {r.path: r for r in tables["modules"].collect()}
    assert set(m) == {k for k in TREE if k not in ("node_modules/skip.js", "notes.md")}
    assert m["pipeline.py"].public_functions == ["build", "run"] and m["pipeline.py"].commit_count == 2 and m["pipeline.py"].velocity_rank == 1
    assert m["helpers.py"].imported_by == 2 and not m["helpers.py"].is_dead_code and m["pipeline.py"].is_dead_code
    assert m["sub/a.py"].cycle_id == m["sub/b.py"].cycle_id == "cycle_1"
    assert m["pipeline.py"].doc == "Reads orders." and m["web/app.ts"].classes == ["App(Base)"]
    assert [r.path for r in tables["issues"].collect()] == ["bad.py"]
    e = {(r.src, r.dst, r.edge_type) for r in tables["module_edges"].collect()}
    assert ("pipeline.py", "helpers.py", "IMPORTS") in e and ("pipeline.py::run", "pipeline.py::_build", "CALLS") in e


def test_lineage(tables):
    e = {(r.src, r.dst, r.edge_type) for r in tables["edges"].collect()}
    assert ("dataset::data/orders.csv", "transform::pipeline.py", "CONSUMES") in e and ("transform::pipeline.py", "dataset::data/clean.csv", "PRODUCES") in e
    assert ("config::orders_raw", "config::model", "CONFIGURES") in e and ("pipeline::extract", "pipeline::transform", "CONFIGURES") in e
    kinds = {r.id: r.transformation_type for r in tables["nodes"].where("node_type = 'transformation'").collect()}
    assert kinds["transform::pipeline.py"] == "python_file_transform" and {"sql_model_select", "sql_insert"} <= set(kinds.values())


def nav(tables):
    return navigator.Navigator(*(tables[k] for k in ("modules", "module_edges", "nodes", "edges")))


def test_tools(tables):
    n = nav(tables)
    up = {(r.node, r.depth) for r in n.run("trace_lineage", "MART.daily").rows.collect()}
    assert {("dataset::model", 2), ("dataset::dim", 2), ("dataset::orders_raw", 4)} <= up
    down = n.ask("what depends on orders_raw?")[0]
    assert down.ok and "dataset::mart.daily" in {r.node for r in down.rows.collect()} and down.evidence
    assert {r.node for r in n.run("blast_radius", "pipeline.py").rows.collect()} == {"helpers.py"}
    assert {r.node for r in n.blast_radius("helpers.py", dependents=True).rows.collect()} == {"pipeline.py", "sub/a.py", "sub/b.py"}
    assert n.run("explain_module", "a.py").arg == "sub/a.py" and not n.run("explain_module", "nope.py").ok
    assert "No module found" in n.run("blast_radius", "x/nope.py").error and not n.run("bogus", "x").ok
    assert n.run("find_implementation", "clean helpers").rows.orderBy("rank").first().path == "helpers.py"
    two = n.ask("trace lineage of data/clean.csv then explain it")
    assert [a.tool for a in two] == ["trace_lineage", "explain_module"] and two[1].arg == "pipeline.py"


def test_questions():
    assert navigator.parse("find implementation of the parser?") == ("find_implementation", "the parser", "")
    assert navigator.parse("trace_lineage orders downstream") == ("trace_lineage", "orders", "downstream")
    assert navigator.parse("Trace lineage of mart.t downstream") == ("trace_lineage", "mart.t", "downstream")
    assert navigator.parse("explain_module  'a.py'") == ("explain_module", "a.py", "")
    assert navigator.parse("tell me a joke")[0] == ""


def test_documents(tables):
    text = artifacts.codebase(tables)
    assert list(artifacts.sections(text)) == ["Architecture", "Sources", "Sinks", "Import cycles", "Documentation drift", "Change velocity", "Modules"]
    found = artifacts.answers(tables)
    assert [a["question_id"] for a in found] == list(artifacts.QUESTIONS)
    assert "dataset::orders_raw" in found[0]["answer"] and 0.52 <= found[4]["confidence_score"] <= 0.74
    back = artifacts.parse_brief(artifacts.brief(found))
    assert [(b["question_id"], b["confidence_score"], b["evidence"]) for b in back] == [(a["question_id"], a["confidence_score"], a["evidence"]) for a in found]
    assert "mart.daily" in artifacts.graph_page(tables["nodes"], tables["edges"])


def test_traces(spark):
    rows = [("t", "Surveyor", "x", json.dumps({"a": ["src/a.py", "b.sql"], "n": {"f": "src/a.py"}}), 1.0), ("t", "other", "y", json.dumps({"analysis_method": "m"}), 0.5)]
    got = artifacts.enriched_trace(spark.createDataFrame(rows, "timestamp string, agent string, action string, evidence string, confidence double")).collect()
    assert [(r.analysis_method, r.source_files) for r in got] == [("static_analysis", ["src/a.py", "b.sql"]), ("m", [])]


def test_incremental_equals_full(spark, tree):
    files = FS.scan(spark, tree)
    old = files.where("path <> 'mart.sql'").withColumn("text", F.when(F.col("path") == "helpers.py", F.lit("def old(): pass\n")).otherwise(F.col("text")))
    old = old.unionByName(spark.createDataFrame([("gone.sql", "sql", "sql", "select * from zzz", 1)], "path string, ext string, language string, text string, size long").withColumn("mtime", F.lit(None).cast("timestamp")))
    facts, changes = analyze.refresh(analyze.extract(old), analyze.digests(old), files)
    assert {(r.path, r.change) for r in changes.collect()} == {("mart.sql", "added"), ("helpers.py", "modified"), ("gone.sql", "removed")}
    full = analyze.extract(files)
    for build in (analyze.module_graph, analyze.lineage_graph):
        a, b = build(facts), build(full)
        assert {(r.src, r.dst, r.edge_type) for r in a[1].collect()} == {(r.src, r.dst, r.edge_type) for r in b[1].collect()}


def test_graph_operators_on_odd_graphs(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "c"), ("x", "a")], "src string, dst string").withColumn("weight", F.lit(1.0))
    n = spark.createDataFrame([(k,) for k in "abcxz"], "id string")
    reach = {(r.start, r.node, r.depth, r.parent) for r in G.reach(e, n.withColumnRenamed("id", "start")).collect()}
    assert ("x", "c", 3, "b") in reach and not any(s == t for s, t, _, _ in reach)
    assert [r.members for r in G.strong_components(n, e).collect()] == [["a", "b"]]
    assert abs(sum(r.rank for r in G.pagerank(n, e).collect()) - 1) < 1e-9
    empty = e.limit(0)
    assert G.reach(empty, n.withColumnRenamed("id", "start")).count() == 0 and G.strong_components(n, empty).count() == 0
    assert G.betweenness(n, e, most=2) is None and {r.id for r in G.betweenness(n, e).where("betweenness > 0").collect()} == {"a", "b"}
    named = spark.createDataFrame([("dataset::Sales", "Sales", 1), ("dataset::sales_raw", "sales_raw", 2)], "id string, name string, seq long")
    assert [G.resolve(named, x) for x in ("dataset::Sales", "sales", "raw", "nothing")] == ["dataset::Sales", "dataset::Sales", "dataset::sales_raw", None]


def test_repositories_and_files(spark, tmp_path):
    assert repositories.normalize_url("git@host.org:me/code.git") == "https://host.org/me/code" == repositories.normalize_url("https://host.org/me/code/")
    assert repositories.owner_and_name("ssh://git@host.org/me/code.git") == ("me", "code") and repositories.is_remote("git@host.org:a/b")
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("x")
    to = repositories.mirror(str(tmp_path / "src"), tmp_path / "w")
    (to / ".lodestone").mkdir()
    repositories.mirror(str(tmp_path / "src"), tmp_path / "w")
    assert sorted(p.name for p in to.iterdir()) == [".lodestone", "a.py"] and repositories.metadata(to)["owner"] == "local"
    old = tmp_path / "old.json"
    old.write_text(json.dumps({"nodes": [{"id": "dataset::a"}, {"id": "m.py"}], "links": [{"source": "m.py", "target": "dataset::a", "edge_type": "PRODUCES", "weight": -1}]}))
    nodes, edges = graph_files.read_graph(spark, str(old))
    assert {(r.id, r.node_type) for r in nodes.collect()} == {("dataset::a", "dataset"), ("m.py", "module")} and edges.first().weight == 0.0
    with pytest.raises(ValueError):
        graph_files.artifact(spark, str(tmp_path), "../x")
    assert graph_files.read_lines(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0


def test_read_models_and_sessions(tables, tmp_path):
    from lodestone.plans import readmodels as R

    s = R.summary(tables).first()
    assert s.modules == 11 and s.datasets >= 5 and s.transformations == 3
    assert R.hubs(tables).first().path == "helpers.py" and R.module_graph(tables).count() == 11
    by = {r.id: (r.upstream, r.downstream) for r in R.lineage_graph(tables).collect()}
    assert by["dataset::orders_raw"] == (0, 4) and by["dataset::mart.daily"][1] == 0
    named = {r.domain: r.n for r in R.domains(tables).collect()}
    assert sum(named.values()) == 11 and 5 <= len(named) <= 8 and all(k.startswith("domain_") for k in named)
    folders = {**tables, "modules": tables["modules"].drop("domain")}
    assert {r.domain: r.n for r in R.domains(folders).collect()}["sub"] == 3
    assert [r.path for r in R.find_text(tables, "helpers").collect()] == ["helpers.py"] and R.find_text(tables, "").count() == 11
    assert {(r.direction, r.id) for r in R.node_details(tables, "helpers.py").collect()} >= {("upstream", "pipeline.py"), ("downstream", "helpers.py::clean")}
    assert R.drift_flags(tables).count() >= 1 and "public_functions" in R.semantic_index(tables).columns
    store = R.Sessions(tmp_path / "s.json")
    (tmp_path / "a").mkdir()
    first = store.register(tmp_path / "a", tmp_path, 1.0)
    store.register(tmp_path, tmp_path, 2.0)
    assert [x["last_analysis_epoch"] for x in store.list()] == [2.0, 1.0] and store.select(first["repo_id"])["path"].endswith("a") and store.active()["repo_id"] == first["repo_id"]
    with pytest.raises(ValueError):
        store.select("none")


def test_command_line(spark, tree, tmp_path, capsys):
    from lodestone import cli

    out = str(tmp_path / "out")
    assert cli.main(["analyze", tree, "--output", out]) == 0 and cli.main(["visualize", str(tmp_path)]) == 1
    capsys.readouterr()
    assert cli.main(["query", out, "trace_lineage", "mart.daily"]) == 0
    shown = json.loads(capsys.readouterr().out)
    assert shown[0]["ok"] and {"dataset::orders_raw"} <= {r["node"] for r in shown[0]["result"]}
    assert cli.main(["query", out, "explain_module", "nope"]) == 2 and cli.main(["visualize", out]) == 0
    assert json.loads((tmp_path / "out/state.json").read_text())["repository"]["owner"]
    assert "<table>" in (tmp_path / "out/lineage.html").read_text() and (tmp_path / "out/CODEBASE.md").exists()


def test_structured_lineage_and_drawn_graphs(tables):
    n = nav(tables)
    fed = n.what_feeds("mart.daily")
    assert fed["target"] == "dataset::mart.daily" and fed["direct"].count() == 1 and fed["full"].count() > 1 and fed["evidence"]
    assert n.what_depends_on("nothing_like_it") == {"target": "dataset::nothing_like_it", "direct": [], "full": [], "evidence": []}
    report = n.impact_report("orders_raw")
    assert report["impacted"] == 4 and "dataset::mart.daily" in report["sinks"] and n.impact_report("zzz")["impacted"] == 0
    assert [n.resolve_node(x) for x in ("transform::pipeline.py", "MART.daily", "Extract", "nothing at all")] == ["transform::pipeline.py", "dataset::mart.daily", "pipeline::extract", None]
    assert n.impact_report("extract")["impacted"] == 1
    nodes, edges = artifacts.drawn(tables["modules"].select("id", F.lit("module").alias("node_type")), tables["module_edges"], modules_only=True)
    assert nodes.count() == 11 and {r.edge_type for r in edges.collect()} == {"IMPORTS"}


def test_first_day_signals(tables):
    found = {a["question_id"]: a for a in artifacts.answers(tables)}
    q1 = found["q1_primary_ingestion"]
    assert any(e["analysis_method"] in ("sql", "python") for e in q1["evidence"])
    assert all(0 <= v <= 1 for a in found.values() for v in a["confidence_factors"].values())


def test_deep_nesting_and_failures_are_no_end_of_a_run(spark):
    deep = "select * from " + "(select * from " * 3000 + "t" + ")" * 3000
    files = spark.createDataFrame([("a.sql", "sql", "sql", deep), ("b.py", "py", "python", "x = " + "(" * 5000 + ")" * 5000), ("c.sql", "sql", "sql", "select * from u")], "path string, ext string, language string, text string")
    facts = analyze.extract(files)
    assert {(r.path, tuple(r.sources)) for r in facts.sql.collect()} == {("a.sql", ("t",)), ("c.sql", ("u",))}
    assert {r.path for r in facts.issues.collect()} == {"b.py"}


def test_issues_are_all_told(spark, tmp_path):
    for k in range(130):
        (tmp_path / f"m{k}.py").write_text("def (:")
    assert analyze.analyze(spark, str(tmp_path))["issues"].count() == 130


def test_components_by_colours_equal_mutual_reach(spark):
    import random

    r = random.Random(4)
    pairs = {(r.randrange(60), r.randrange(60)) for _ in range(85)}
    e = spark.createDataFrame([(f"{a:02d}", f"{b:02d}") for a, b in pairs], "src string, dst string")
    n = e.selectExpr("explode(array(src, dst)) AS id").distinct()
    a, b = (sorted(map(tuple, G.strong_components(n, e, few).collect())) for few in (1000, 0))
    assert a == b and len(a) >= 1


def test_numbered_discovery(spark):
    e = spark.createDataFrame([("a", "c"), ("a", "b"), ("c", "d"), ("b", "z"), ("b", "e"), ("d", "y"), ("x", "a")], "src string, dst string")
    got = {(r.start, r.node): r.position for r in G.numbered(G.reach(e, spark.createDataFrame([("a",), ("x",)], "start string"))).collect()}
    assert got == {("a", k): i for i, k in enumerate("bcezdy", 1)} | {("x", k): i for i, k in enumerate("abcezdy", 1)}
