"""Files that are made of parts, and what reading many of them costs."""

import ast

import pyarrow as pa

from lodestone import code_queries
from lodestone.operators import python_code, tables


def test_many_parts_are_read_in_many_tasks(spark, tmp_path):
    n = 2 * code_queries.TASK_PARTS + 1
    spark.range(n).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    files = code_queries.tree(spark, str(tmp_path), "py")
    each = [r["count"] for r in files.selectExpr("spark_partition_id() AS p", "length(text)").groupBy("p").count().collect()]
    assert len(each) == 3 and sum(each) == n


def test_some_kinds_of_facts(spark):
    files = spark.createDataFrame([("a.py", "x = pd.read_csv('a')\nb >> c\ndef f(): g()\n"), ("b.py", "def (:")], "path string, text string")
    whole = python_code.facts(files)
    for kind in python_code.KINDS:
        some = python_code.facts(files, kind)
        assert some.columns == ["path", kind, "issue"]
        assert sorted(map(str, some.collect())) == sorted(map(str, whole.select(*some.columns).collect()))


def test_parameters_are_written_like_unparse():
    for head in ("", "a", "a, *b", "cls, n=1", "a, b=None, *c, **d", "a=-1", "a='x'", "a, /, b", "*, k=1", "a: int = 2", "a=b.c", "a=...", "a=1.5", "a=True", "*a: int", "**k"):
        a = ast.parse(f"def f({head}): pass").body[0].args
        assert python_code.parameters(a) == ast.unparse(a)
    for base in ("A", "a.b.C", "B[int]", "f().g", "a.b[c].d"):
        node = ast.parse(base).body[0].value
        assert python_code.written(node) == ast.unparse(node)


def test_columns_equal_those_of_dicts():
    inner = pa.struct([("a", pa.string()), ("n", pa.int32())])
    schema = pa.schema([("path", pa.string()), ("rows", pa.list_(inner)), ("one", inner), ("m", pa.map_(pa.string(), pa.list_(pa.string())))])
    rows = [{"path": "x", "rows": [{"a": "b", "n": 1}, None, {"a": None}], "one": {"n": 2}, "m": [("k", ["v"])]}, {"rows": [], "one": None}, {}]
    for some in (rows, []):
        got = pa.RecordBatch.from_arrays([tables.column([r.get(f.name) for r in some], f.type) for f in schema], schema=schema)
        got.validate(full=True)
        assert got.to_pylist() == pa.Table.from_pylist(some, schema).to_pylist()


def test_relative_imports_read_no_more_than_imports(spark, tmp_path, monkeypatch):
    asked, facts = [], python_code.facts
    monkeypatch.setattr(python_code, "facts", lambda f, *kinds: asked.append(kinds) or facts(f, *kinds))
    spark.range(3).selectExpr("id AS p_partkey", "CAST(id AS INT) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    found = {(r.path, r.name, r.full_name) for r in code_queries.e5_relative_imports(spark, str(tmp_path)).collect()}
    assert asked == [("imports",)] and len(found) == 12
    assert {x[1:] for x in found if x[0] == "pkg2/m2.py"} == {("..shared.thing_2", "shared.thing_2"), (".near.sib", "pkg2.near.sib"), ("lib_2", "lib_2"), ("pkg1.m1", "pkg1.m1")}


def test_imports_are_those_of_the_structure(spark):
    texts = ["", "import a.b, c as d\nfrom . import e\nfrom ..f import *\nfrom __future__ import g\n", "import a\nfrom .b import c\ndef (:", "if x:\n  def f():\n    import y1\n", "import y2\x00", "x = " + "(" * 500 + "1" + ")" * 500 + "\nimport z\n", None]
    files = spark.createDataFrame([(f"{k}.py", t) for k, t in enumerate(texts)], "path string, text string")
    some = {r.path: r.imports for r in python_code.facts(files, "imports").collect()}
    assert some == {r.path: r.module.imports for r in python_code.facts(files, "module").collect()} and len(some) == len(texts)
    assert some["1.py"] == ["..f", ".e", "a.b", "c"] and some["2.py"] == [".b", "a"]
