"""Extractors on small sources of our own."""

import json
import textwrap

from lodestone.operators import other_code, python_code, sql_code
from lodestone.sources import files as FS
from lodestone.sources import gitlog


def sources(spark, **texts):
    return spark.createDataFrame([(k.replace("__", "."), k.rsplit("__", 1)[-1], textwrap.dedent(v)) for k, v in texts.items()], "path string, ext string, text string")


def test_python_structure():
    s = python_code.structure(textwrap.dedent("""
        from __future__ import annotations
        import os, a.b as c
        from ..pkg import thing as t
        from m import *
        class Base(Parent, x.Other):
            @classmethod
            def run(cls, n=1):
                if n:
                    helper(n)
                elif os.name:
                    self.go()
                else:
                    for i in n:
                        pass
        @deco.rated(3)
        def _load(a, *b):
            return Base.run()
    """))
    assert s["imports"] == ["..pkg.thing", "a.b", "m", "os"]
    assert s["complexity"] == 3  # one if with its elif, one for
    assert [f["signature"] for f in s["functions"]] == ["Base.run(cls, n=1)", "_load(a, *b)"]
    assert [f["decorators"] for f in s["functions"]] == [["classmethod"], ["deco.rated"]]
    assert s["functions"][0]["calls"] == ["go", "helper"] and s["classes"] == [{"name": "Base", "bases": ["Parent", "x.Other"]}]
    broken = python_code.structure("import os\nclass A:\ndef f(x:\n")
    assert broken["issues"] and broken["imports"] == ["os"] and not broken["functions"]


def test_python_data_flow():
    flows = python_code.data_flow(textwrap.dedent("""
        BASE = "data/"
        PATH = BASE + "in.csv"
        df = pd.read_csv(PATH)
        df.to_parquet(path="out.parquet")
        df.to_csv(f"x{n}.csv")
        x = pd.read_sql("select * from raw.a join b on 1=1", con)
        con.execute("INSTALL httpfs")
        con.execute(text("insert into mart.t select * from s"))
        spark.read.parquet("lake/p")
        df.write.mode("append").saveAsTable("gold.t")
        handle.read()
    """))
    got = [(f["flow"], f["dataset"], f["storage"], f["unresolved"]) for f in flows]
    assert got == [
        ("CONSUMES", "data/in.csv", "file", False), ("PRODUCES", "out.parquet", "file", False), ("PRODUCES", python_code.DYNAMIC, "file", True),
        ("CONSUMES", "b", "table", False), ("CONSUMES", "raw.a", "table", False), ("CONSUMES", "s", "table", False), ("PRODUCES", "mart.t", "table", False),
        ("CONSUMES", "lake/p", "file", False), ("PRODUCES", "gold.t", "table", False),
    ]


def test_task_order():
    e = python_code.task_order("a >> [b, c]\nd << a\nx.set_downstream([y, z])\np.set_upstream(q)\nm >> n >> o\n")
    assert {(x["source"], x["target"]) for x in e} == {("a", "b"), ("a", "c"), ("a", "d"), ("x", "y"), ("x", "z"), ("q", "p"), ("m", "n"), ("n", "o")}


def test_sql_lineage():
    def one(sql, stem="model"):
        return [(r["sources"], r["targets"], r["operation"], r["class"]) for r in sql_code.lineage(sql, stem)]

    assert one("with a as (select * from orders_raw), b as (select * from a) select * from b") == [(["orders_raw"], ["model"], "read", "sql_model_select")]
    assert one("with u as (select * from unused), c as (select 1 from dim_customers) select * from c, orders_raw o where o.x in (select y from z.k)") == [(["dim_customers", "orders_raw", "z.k"], ["model"], "read", "sql_model_select")]
    assert one("INSERT INTO mart.t (a, b) SELECT a, b FROM staging.s") == [(["staging.s"], ["mart.t"], "write", "sql_insert")]
    assert one('create or replace table "x"."y" as select * from (with q as (select * from r1) select * from q) s left join r2 using (id)') == [(["r1", "r2"], ["x.y"], "write", "sql_ctas")]
    assert one("merge into t using (select * from s) u on t.a = u.a when matched then update set b = 1") == [(["s"], ["t"], "write", "sql_merge_upsert")]
    assert one("with t as (select * from t) select extract(year from d) from t") == [(["t"], ["model"], "read", "sql_model_select")]
    assert one("delete from a where x in (select x from b); update c set y = 1") == [(["b"], ["a"], "write", "sql_delete"), ([], ["c"], "write", "sql_update")]
    assert one("-- from nothing\nselect 'from x' as a") == []
    dbt = sql_code.lineage("select * from {{ ref('pkg', 'orders') }} join {{ source('raw', 'customers') }} using (id)", "m")
    assert dbt[0]["sources"] == ["pkg.orders", "raw.customers"] and dbt[0]["dialect"] == "dbt_template" and dbt[0]["targets"] == ["m"]


def test_lines_of_a_part():
    assert sql_code.lines_of("a\nselect 1\nfrom t\n", "select 1\nfrom t") == (2, 3)
    assert sql_code.lines_of("a\nSELECT   1\nFROM t", "select 1 from t") == (2, 3)
    assert sql_code.lines_of("a\nb", "zzz") == (1, 2)


def test_yaml_and_javascript(spark):
    text = "models:\n  - name: m\n    depends_on:\n      nodes: [orders_raw]\ntasks:\n  - name: extract\n    downstream: [transform]\n"
    assert [(e["source"], e["target"], e["method"]) for e in other_code.yaml_dependencies(text)] == [("orders_raw", "m", "dbt_schema_dependency"), ("extract", "transform", "yaml_task_dependency")]
    keys, paths, n = other_code.yaml_keys(text)
    assert "models[].depends_on.nodes" in paths and n == 1 + 7 and keys == sorted(set(keys))
    files = sources(spark, a__ts="""import x from 'lib';\nconst y = require("dep");\nclass A extends B.C {}\nexport function _go() { if (a) { for (;;) {} } }\nconst arrow = async (q) => 1;\n""")
    r = other_code.js_structure(files).first()
    assert (r.imports, r.public_functions, r.classes, r.complexity) == (["dep", "lib"], ["arrow", "go"], ["A(B.C)"], 3.0)


def test_table_functions_and_import_targets(spark):
    files = sources(spark, **{"src/pkg/a__py": "from . import b\nfrom .b import f\nimport pkg.c.g\nimport os\n", "src/pkg/b__py": "def f(): pass\n", "src/pkg/c/__init____py": "", "bad__py": "def (:\n"})
    files = files.withColumn("path", __import__("pyspark").sql.functions.regexp_replace("path", r"c/\.init\.\.py", "c/__init__.py"))
    m = python_code.modules(python_code.facts(files))
    assert {r.path: bool(r.issues) for r in m.collect()}["bad.py"]
    imports = m.selectExpr("path AS importer", "explode(imports) AS name")
    got = {(r.importer, r.name, r.target) for r in FS.import_targets(imports, files).collect()}
    assert ("src/pkg/a.py", ".b", "src/pkg/b.py") in got or ("src/pkg/a.py", ".b.f", "src/pkg/b.py") in got
    assert all(t != "os" for _, _, t in got)


def test_notebooks_and_commit_log(spark):
    nb = json.dumps({"cells": [{"cell_type": "markdown", "source": ["read_csv"]}, {"cell_type": "code", "source": ["x = 1\n", "df = pd.read_csv('a')\n"]}, {"cell_type": "code", "source": ["df.to_csv('b')"]}]})
    found = {(r.token, r.flow, r.line) for r in FS.notebook_io(sources(spark, n__ipynb=nb)).collect()}
    assert found == {("read_csv", "CONSUMES", 2), ("to_csv", "PRODUCES", 4)}
    log = f"{gitlog.HEADER}aa|2024-01-02T00:00:00+00:00\nx.py\ny.py\n\n{gitlog.HEADER}bb|2024-01-02T01:00:00+02:00\nx.py\nx.py\n"
    rows = {r.path: (r.commit_count, r.last_commit) for r in gitlog.velocity(gitlog.commits(gitlog.lines(spark, log))).collect()}
    assert rows == {"x.py": (2, "2024-01-02T00:00:00+00:00"), "y.py": (1, "2024-01-02T00:00:00+00:00")}


def test_docstrings():
    assert python_code.without_docstrings('"""Doc."""\n# c\ndef f():\n    "d"\n    return 1\n') == "def f():\n    return 1"
