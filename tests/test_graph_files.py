"""Graphs as files."""

import json

from lodestone.sources import graph_files


def test_large_graphs_are_several_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(graph_files, "MOST", 100)
    edges = spark.range(1050).selectExpr("concat('a', id % 7) AS src", "concat('b', id) AS dst", "'CALLS' AS edge_type", "1.0D AS weight")
    nodes = edges.selectExpr("dst AS id", "'say \"x\",\n' AS name").union(edges.selectExpr("src", "cast(null as string)").distinct())
    graph_files.write_graph(nodes, edges, str(tmp_path / "g"))
    docs = [json.loads(f.read_text()) for f in (tmp_path / "g").glob("part-*") if f.stat().st_size]
    assert len(docs) > 20 and max(len(d["nodes"]) + len(d["edges"]) for d in docs) <= 100
    n, e = graph_files.read_graph(spark, str(tmp_path / "g"))
    assert n.count() == 1057 and set(n.select("id", "name").collect()) == set(nodes.collect())
    got = e.orderBy("seq").select("src", "dst", "edge_type", "weight").collect()
    assert got == edges.orderBy("src", "dst").collect() and e.select("seq").distinct().count() == 1050
    graph_files.write_graph(nodes.limit(40), edges.limit(50), str(tmp_path / "small"))
    assert [len(json.loads(f.read_text())["edges"]) for f in (tmp_path / "small").glob("part-*")] == [50]
