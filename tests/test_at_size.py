"""What queries over many files must not do: what no result needs, or the same again for each row."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph as G
from lodestone.operators import python_code
from lodestone.plans import analyze, navigator
from lodestone.sources import files as FS


@pytest.fixture(scope="module")
def files(spark):
    a = 'import b\nclass A:\n    def f(self):\n        go()\n        A.f()\ndef go(): f(); print(1)\ndef go(): go()\n'
    b = 'import a, c\ndef f():\n    pd.read_csv("x.csv")\nx >> y\n'
    return spark.createDataFrame([("a.py", "py", "python", a), ("b.py", "py", "python", b)], "path string, ext string, language string, text string")


def rows(df):
    return sorted(map(str, df.collect()))


def test_each_name_is_resolved_once(spark):
    imports = spark.createDataFrame([(f"p/m{i}.py", "lib.x") for i in range(50)] + [("p/m1.py", ".lib")] * 2, "importer string, name string")
    found = FS.import_targets(imports, spark.createDataFrame([("lib.py",), ("p/lib.py",)], "path string"))
    assert found.count() == 51 and {(r.name, r.target) for r in found.collect()} == {("lib.x", "lib.py"), (".lib", "p/lib.py")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [full" in plan[plan.index("Generate posexplode") :]


def test_files_are_parsed_for_what_is_asked(files, monkeypatch):
    asked, facts = [], python_code.facts
    monkeypatch.setattr(python_code, "facts", lambda f, *kinds: asked.append(kinds) or facts(f, *kinds))
    some, whole = analyze.extract(files, "modules"), analyze.extract(files)
    assert asked == [("module",), ("module", "functions", "flows", "orders")] and some.functions is None
    assert rows(some.modules) == rows(whole.modules)
    part = analyze.extract(files, *analyze.LINEAGE)
    assert asked[2] == ("flows", "orders") and rows(analyze.lineage_edges(part)) == rows(analyze.lineage_edges(whole))


def test_calls_of_a_file_need_no_join(files):
    f = analyze.extract(files, *analyze.MODULES)
    edges = analyze.module_edges(f)
    named = f.functions.withColumn("id", F.concat_ws("::", "path", "qualified"))
    calls = edges.where("edge_type = 'CALLS'").select("src", "dst", "edge_type")
    assert rows(calls) == rows(analyze.call_edges(named)) and calls.count() == 2
    assert {(r.qualified, *r.local) for r in f.functions.collect() if r.local} == {("A.f", "go"), ("go", "go")}
    assert {(r.src, r.dst) for r in analyze.import_edges(f.modules).collect()} == {("a.py", "b.py"), ("b.py", "a.py")}


def test_ranks_are_left_out_where_not_asked(files, monkeypatch):
    f = analyze.extract(files, *analyze.MODULES)
    whole = analyze.module_graph(f)[0]
    monkeypatch.setattr(G, "pagerank", None)
    some = analyze.module_graph(f, ranked=False)[0]
    assert set(some.columns) == set(whole.columns)
    same = [c for c in whole.columns if c not in ("rank", "cycle_id", "size")]
    assert rows(some.select(*same)) == rows(whole.select(*same))
    assert some.where("rank is not null or cycle_id is not null").count() == 0


@pytest.mark.parametrize("small", [0, G.SMALL])
def test_small_frontiers_go_to_the_edges(spark, monkeypatch, small):
    monkeypatch.setattr(G, "SMALL", small)
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("x", "a")], "src string, dst string")
    starts = spark.createDataFrame([("a",)], "start string")
    assert {(r.node, r.depth) for r in G.levels(edges, starts).collect()} == {("b", 1), ("c", 1)}
    assert {(r.node, r.depth, r.parent) for r in G.reach(edges, starts).collect()} == {("b", 1, "a"), ("c", 1, "a")}
    plan = G._met(starts.withColumn("node", F.col("start")), 1, edges)._jdf.queryExecution().optimizedPlan().toString()
    assert ("broadcast" in plan) == (small > 0)


def test_classes_of_files_need_no_join(spark):
    py = 'a = pd.read_csv("x.csv")\nb = pd.read_sql("select * from t", con)\na.to_parquet("y.parquet")\n'
    nb = '{"cells": [{"cell_type": "code", "source": ["read_csv\\n", "to_sql read_csv"]}]}'
    made = [("a.py", "py", "python", py), ("b.py", "py", "python", 'pd.read_csv("x.csv")\n'), ("c.py", "py", "python", "f(1)\n"), ("n.ipynb", "ipynb", "notebook", nb), ("o.ipynb", "ipynb", "notebook", nb.replace("read_csv", "x"))]
    files = spark.createDataFrame(made, "path string, ext string, language string, text string")
    edges = analyze.lineage_edges(analyze.extract(files, *analyze.LINEAGE))
    assert "Join" not in edges._jdf.queryExecution().optimizedPlan().toString()
    found = [(r.source_file, r.edge_type, r.transformation_type) for r in edges.collect()]
    want = [("a.py", "CONSUMES", "python_file_transform")] * 2 + [("a.py", "PRODUCES", "python_file_transform"), ("b.py", "CONSUMES", "python_file_read")]
    assert sorted(found) == want + [("n.ipynb", "CONSUMES", "notebook_etl"), ("n.ipynb", "PRODUCES", "notebook_etl"), ("o.ipynb", "PRODUCES", "notebook_export")]


@pytest.mark.parametrize("small", [0, G.SMALL])
def test_guessed_sizes_send_no_graph_through_the_driver(spark, monkeypatch, small):
    monkeypatch.setattr(G, "SMALL", small)
    # a size is guessed of these, by what they are made of, and it is small
    edges = spark.range(40).selectExpr("concat('dataset::', id) AS src", "concat('dataset::', id + 20) AS dst", "concat('f', id % 3, '.py') AS source_file")
    steps = spark.range(3).selectExpr("concat('pipeline::', id) AS src", "concat('pipeline::', id + 10) AS dst", "concat('f', id, '.py') AS source_file")
    edges = edges.union(steps)
    nodes = edges.selectExpr("explode(array(src, dst)) AS id").distinct().selectExpr("id", "CASE WHEN id LIKE 'pipeline%' THEN 'pipeline' ELSE 'dataset' END AS node_type", "IF(id = 'dataset::40', 'f1.py', '') AS source_file", "CAST(NULL AS STRING) AS name", "0L AS seq")
    found = G.impact(edges, nodes, spark.createDataFrame([("dataset::0",)], "start string"))
    assert [(r.impacted, r.max_depth, r.sinks) for r in found.collect()] == [(2, 2, ["dataset::40"])]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    report = navigator.Navigator(None, None, nodes, edges).impact_report("0")
    assert report == {"target": "dataset::0", "impacted": 2, "max_depth": 2, "datasets": 2, "transformations": 0, "sinks": ["dataset::40"], "source_files": ["f1.py"], "related_pipelines": ["pipeline::1", "pipeline::11"]}
