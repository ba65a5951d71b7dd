"""Queries over a source tree that is made of the part table: for each part a Python, an SQL, a YAML, a TypeScript file and a notebook.

What the files say follows from the part's key and size, so SQL can tell what the extractors, the graphs and the tools
have to find. Templates name columns of PARTS as <name>; code() fills them in Spark, said() in SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import text as T
from .operators import other_code, python_code, sql_code
from .plans import analyze, artifacts, navigator
from .registry import query, table
from .session import cut
from .sources import files as FS

_COLUMNS = {"k": "p_partkey", "s": "p_size", "s5": "p_size % 5", "k3": "p_partkey % 3", "k4": "p_partkey % 4", "k9": "p_partkey % 9", "k10": "p_partkey % 10", "h": "p_partkey div 2", "h10": "p_partkey div 2 % 10"}
PARTS = "p AS (SELECT " + ", ".join(f"CAST({v.replace('div', '//')} AS BIGINT) AS {k}" for k, v in _COLUMNS.items()) + " FROM part)"

PY_PATH, SQL_PATH, YML_PATH, TS_PATH, NB_PATH = "pkg<k10>/m<k>.py", "sql/s<k>.sql", "conf/c<k>.yml", "web/w<k>.ts", "nb/n<k>.ipynb"
PY = '''"""Reads part <k>."""
from __future__ import annotations
import lib_<s>, pkg<h10>.m<h> as up
from ..shared import thing_<s5>
from .near import sib

SRC = "data/in_" + "<k>.csv"

class Part<k>(Base<s>, other.Mixin):
    @classmethod
    def load(cls, n=1):
        if n:
            helper_<s>(n)
        elif cls:
            cls.go()
        return pd.read_csv(SRC)

@deco.rated(3)
def _run(a, *b):
    df = pd.read_sql("select * from raw.t_<s> join dim_<k4> using (id)", con)
    df.to_parquet(path="out/p_<k>.parquet")
    return check(Part<k>.load())

def check(x):
    for i in x:
        pass
<more>
extract_<k> >> [load_<k>, test_<k>]
'''
MORE = "    if x:\n        pass\n"
SQL = (
    "with a as (select * from raw.t_<s>), unused as (select * from nope)\nselect * from a join (select id from dim_<k4>) d using (id)\n",
    "insert into mart.m_<k9> (x, y)\nselect x, y from raw.t_<s>, dim_<k4>\n",
    "-- by key\nmerge into mart.m_<k9> t\nusing (select * from {{ ref('pkg', 'm_<s>') }}) u on t.id = u.id\nwhen matched then update set x = 1\n",
)
YML = "models:\n  - name: model_<k>\n    depends_on:\n      nodes: [src_<s>, dim_<k4>]\ntasks:\n  - name: t_<k>\n    downstream: [u_<k>, v_<k>]\n"
TS = "import x from 'lib<s>';\nconst y = require(\"dep<k3>\");\nexport class W<k> extends Base<s> {}\nexport function _go<k>() { if (a) { for (;;) {} } }\nconst arrow<s> = async (q) => 1;\n"
NB = ('{"cells": [{"cell_type": "markdown", "source": ["read_csv"]}, {"cell_type": "code", "source": ["x = 1\\n"', '"df = pd.read_csv(1)\\n"', ']}, {"cell_type": "code", "source": ["df.to_sql(2)"]}]}')


def code(template: str, **more: Column) -> Column:
    pieces = re.split(r"<(\w+)>", template)
    return F.concat(*[more.get(x, F.col(x).cast("string")) if i % 2 else F.lit(x) for i, x in enumerate(pieces) if x])


def said(template: str) -> str:
    pieces = re.split(r"<(\w+)>", template)
    return "(" + " || ".join(x if i % 2 else "'" + x.replace("'", "''") + "'" for i, x in enumerate(pieces) if x) + ")"


def joined(*templates: str) -> str:
    return " || '|' || ".join(map(said, templates))


#: Parts that make the files of one task.
TASK_PARTS = 5_000


def tree(spark, d, *kinds: str) -> DataFrame:
    """files(path, ext, language, text) of all parts, of the given extensions or all.

    A file of keys is small, and what is made of it is not: keys are dealt to as many tasks as their number asks for
    before texts are made.
    """
    keys = table(spark, d, "part").select("p_partkey", "p_size")
    keys = keys.repartition(max(1, -(-keys.count() // TASK_PARTS)))
    p = keys.select(*[F.expr(v).cast("long").alias(k) for k, v in _COLUMNS.items()])
    more = F.repeat(F.lit(MORE), F.col("k4").cast("int"))
    sql = F.when(F.col("k3") == 0, code(SQL[0])).when(F.col("k3") == 1, code(SQL[1])).otherwise(code(SQL[2]))
    nb = F.concat(F.lit(NB[0]), F.when(F.col("k") % 2 == 0, F.lit(", " + NB[1])).otherwise(F.lit("")), F.lit(NB[2]))
    made = {"py": (PY_PATH, code(PY, more=more)), "sql": (SQL_PATH, sql), "yml": (YML_PATH, code(YML)), "ts": (TS_PATH, code(TS)), "ipynb": (NB_PATH, nb)}
    out = None
    for ext in kinds or made:
        path, text = made[ext]
        rows = p.select(code(path).alias("path"), F.lit(ext).alias("ext"), F.lit(FS.LANGUAGES[ext]).alias("language"), text.alias("text"))
        out = rows if out is None else out.union(rows)
    return out


def bars(c: str) -> Column:
    return F.array_join(c, "|").alias(c)


# Extractors.


@query("e2_python_modules", f"""WITH {PARTS} SELECT {said(PY_PATH)} AS path, {joined("..shared.thing_<s5>", ".near.sib", "lib_<s>", "pkg<h10>.m<h>")} AS imports, 'check|load|run' AS public_functions,
    {said("Part<k>(Base<s>, other.Mixin)")} AS classes, {joined("Base<s>", "other.Mixin")} AS bases, 3.0 + k4 AS complexity, 0 AS issues FROM p""")
def e2_python_modules(spark, d):
    m = python_code.modules(python_code.facts(tree(spark, d, "py"), "module"))
    return m.select("path", bars("imports"), bars("public_functions"), bars("classes"), F.array_join(F.map_values("class_inheritance")[0], "|").alias("bases"), "complexity", F.size("issues").alias("issues"))


@query("e7_python_functions", f"""WITH {PARTS} SELECT {said(PY_PATH)} AS path, {said("Part<k>.load")} AS qualified, {said("Part<k>.load(cls, n=1)")} AS signature, 'classmethod' AS decorators, {joined("go", "helper_<s>", "read_csv")} AS calls, 11 AS line, 16 AS end_line FROM p
    UNION ALL SELECT {said(PY_PATH)}, '_run', '_run(a, *b)', 'deco.rated', 'check|load|read_sql|to_parquet', 19, 22 FROM p UNION ALL SELECT {said(PY_PATH)}, 'check', 'check(x)', '', '', 24, 26 + 2 * k4 FROM p""")
def e7_python_functions(spark, d):
    f = python_code.functions(python_code.facts(tree(spark, d, "py"), "functions"))
    return f.select("path", "qualified", "signature", bars("decorators"), bars("calls"), "line", "end_line")


@query("e5_relative_imports", f"""WITH {PARTS} SELECT {said(PY_PATH)} AS path, {said(".near.sib")} AS name, {said("pkg<k10>.near.sib")} AS full_name FROM p UNION ALL SELECT {said(PY_PATH)}, {said("..shared.thing_<s5>")}, {said("shared.thing_<s5>")} FROM p
    UNION ALL SELECT {said(PY_PATH)}, {said("lib_<s>")}, {said("lib_<s>")} FROM p UNION ALL SELECT {said(PY_PATH)}, {said("pkg<h10>.m<h>")}, {said("pkg<h10>.m<h>")} FROM p""")
def e5_relative_imports(spark, d):
    m = python_code.facts(tree(spark, d, "py"), "imports").select("path", F.explode("imports").alias("name"))
    return m.select("path", "name", FS.resolve_relative(F.col("path"), F.col("name")).alias("full_name"))


@query("j1_import_targets", f"""WITH {PARTS} SELECT {said(PY_PATH)} AS importer, {said("pkg<h10>.m<h>")} AS name, {said("pkg<h10>/m<h>.py")} AS target FROM p
    UNION ALL SELECT {said(PY_PATH)}, '.near.sib', {said("src/pkg<k10>/__init__.py")} FROM p WHERE k10 = 3
    UNION ALL SELECT {said(PY_PATH)}, {said("..shared.thing_<s5>")}, {said("shared/thing_<s5>.py")} FROM p WHERE s5 < 2""")
def j1_import_targets(spark, d):
    files = tree(spark, d, "py")
    found = cut(python_code.facts(files, "module"))  # read twice
    imports = python_code.modules(found).select(F.col("path").alias("importer"), F.explode("imports").alias("name"))
    others = spark.createDataFrame([("src/pkg3/__init__.py",), ("shared/thing_0.py",), ("shared/thing_1.py",), ("shared/thing_1/__init__.py",)], "path string")
    return FS.import_targets(imports, files.select("path").union(others))


@query("e21_python_io", f"""WITH {PARTS} SELECT {said(PY_PATH)} AS path, 'CONSUMES' AS flow, {said("data/in_<k>.csv")} AS dataset, 'file' AS storage, 'python' AS method, 16 AS start FROM p
    UNION ALL SELECT {said(PY_PATH)}, 'CONSUMES', {said("raw.t_<s>")}, 'table', 'python_sql', 20 FROM p UNION ALL SELECT {said(PY_PATH)}, 'CONSUMES', {said("dim_<k4>")}, 'table', 'python_sql', 20 FROM p
    UNION ALL SELECT {said(PY_PATH)}, 'PRODUCES', {said("out/p_<k>.parquet")}, 'file', 'python', 21 FROM p""")
def e21_python_io(spark, d):
    return python_code.flows(python_code.facts(tree(spark, d, "py"), "flows")).where("not unresolved").select("path", "flow", "dataset", "storage", "method", "start")


@query("e24_task_order", f"""WITH {PARTS} SELECT {said(PY_PATH)} AS path, {said("extract_<k>")} AS source, {said("load_<k>")} AS target, 28 + 2 * k4 AS start FROM p UNION ALL SELECT {said(PY_PATH)}, {said("extract_<k>")}, {said("test_<k>")}, 28 + 2 * k4 FROM p""")
def e24_task_order(spark, d):
    return python_code.orders(python_code.facts(tree(spark, d, "py"), "orders")).select("path", "source", "target", "start")


@query("e27_docstrings", f"""WITH {PARTS} SELECT {said(PY_PATH)} AS path, {said("Reads part <k>.")} AS doc FROM p""")
def e27_docstrings(spark, d):
    return tree(spark, d, "py").select("path", T.docstring(F.col("text")).alias("doc"))


@query("e28_excerpts", f"""WITH {PARTS} SELECT {said(SQL_PATH)} AS path, replace(CASE k3 WHEN 0 THEN {said(SQL[0].rstrip(chr(10)))} WHEN 1 THEN {said(SQL[1].rstrip(chr(10)))} ELSE {said(SQL[2].split(chr(10), 1)[1].rstrip(chr(10)))} END, chr(10), '/') AS excerpt FROM p
    UNION ALL SELECT {said(PY_PATH)}, 'from __future__ import annotations/import lib_' || s FROM p""")
def e28_excerpts(spark, d):
    found = python_code.excerpts(tree(spark, d, "py", "sql"))
    text = F.replace("excerpt", F.lit("\n"), F.lit("/"))
    return found.select("path", F.when(F.endswith("path", F.lit(".py")), F.regexp_extract(text, "^([^,]*),", 1)).otherwise(text).alias("excerpt"))


@query("e11_javascript", f"""WITH {PARTS} SELECT {said(TS_PATH)} AS path, {joined("dep<k3>", "lib<s>")} AS imports, {joined("arrow<s>", "go<k>")} AS public_functions, {said("W<k>(Base<s>)")} AS classes, 3.0 AS complexity FROM p""")
def e11_javascript(spark, d):
    return other_code.js_structure(tree(spark, d, "ts")).select("path", bars("imports"), bars("public_functions"), bars("classes"), "complexity")


@query("e12_sql_structure", f"""WITH {PARTS} SELECT {said(SQL_PATH)} AS path, CASE k3 WHEN 0 THEN 'cte|join|select' WHEN 1 THEN 'insert|select' ELSE 'merge|select|update' END AS operations, CASE k3 WHEN 0 THEN 7 WHEN 1 THEN 3 ELSE 4 END AS complexity FROM p""")
def e12_sql_structure(spark, d):
    return sql_code.structures(tree(spark, d, "sql")).select("path", bars("operations"), "complexity")


@query("e13_yaml", f"""WITH {PARTS} SELECT {said(YML_PATH)} AS path, 'depends_on|downstream|models|name|nodes|tasks' AS public_functions, 'models|models[].depends_on|models[].depends_on.nodes|models[].name|tasks|tasks[].downstream|tasks[].name' AS key_paths, 8.0 AS complexity FROM p""")
def e13_yaml(spark, d):
    return other_code.yaml_structure(tree(spark, d, "yml")).select("path", bars("public_functions"), bars("key_paths"), "complexity")


LINEAGE = f"""sql_rows AS (SELECT {said(SQL_PATH)} AS path, CASE k3 WHEN 2 THEN [{said("pkg.m_<s>")}] ELSE [{said("dim_<k4>")}, {said("raw.t_<s>")}] END AS sources, CASE k3 WHEN 0 THEN {said("s<k>")} ELSE {said("mart.m_<k9>")} END AS target,
    CASE k3 WHEN 0 THEN 'read' ELSE 'write' END AS operation, CASE k3 WHEN 0 THEN 'sql_model_select' WHEN 1 THEN 'sql_insert' ELSE 'sql_merge_upsert' END AS class, CASE k3 WHEN 2 THEN 'dbt_template' ELSE 'sql' END AS dialect, 1 AS start, CASE k3 WHEN 2 THEN 4 ELSE 2 END AS "end" FROM p)"""


@query("e14_sql_lineage", f"""WITH {PARTS}, {LINEAGE} SELECT path, array_to_string(sources, '|') AS sources, target AS targets, operation, class, dialect, start, "end" FROM sql_rows""")
def e14_sql_lineage(spark, d):
    return sql_code.lineages(tree(spark, d, "sql")).where("issue is null").select("path", bars("sources"), bars("targets"), "operation", "class", "dialect", "start", "end")


@query("e19_template_refs", f"""WITH {PARTS} SELECT {said(SQL_PATH)} AS path, CASE k3 WHEN 2 THEN {said("pkg.m_<s>")} ELSE '' END AS refs FROM p""")
def e19_template_refs(spark, d):
    return sql_code.references(tree(spark, d, "sql")).select("path", bars("refs"))


@query("e20_line_ranges", f"""WITH {PARTS} SELECT {said(SQL_PATH)} AS path, CASE k3 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 1 END AS start, CASE k3 WHEN 1 THEN 2 WHEN 2 THEN 5 ELSE 3 END AS "end" FROM p""")
def e20_line_ranges(spark, d):
    # found with white space and case folded in the inserts only: the others are told as a whole
    return sql_code.places(tree(spark, d, "sql").withColumn("text", F.regexp_replace("text", r"mart\.m_\d+", "mart.m")), "INSERT   into MART.m (x,y) select x")


@query("e23_config_edges", f"""WITH {PARTS} SELECT {said(YML_PATH)} AS path, {said("src_<s>")} AS source, {said("model_<k>")} AS target, 'dbt_schema_dependency' AS method, 2 AS start FROM p UNION ALL SELECT {said(YML_PATH)}, {said("dim_<k4>")}, {said("model_<k>")}, 'dbt_schema_dependency', 2 FROM p
    UNION ALL SELECT {said(YML_PATH)}, {said("t_<k>")}, {said("u_<k>")}, 'yaml_task_dependency', 6 FROM p UNION ALL SELECT {said(YML_PATH)}, {said("t_<k>")}, {said("v_<k>")}, 'yaml_task_dependency', 6 FROM p""")
def e23_config_edges(spark, d):
    return other_code.yaml_edges(tree(spark, d, "yml")).select("path", "source", "target", "method", "start")


@query("e25_notebook_io", f"""WITH {PARTS} SELECT {said(NB_PATH)} AS path, 'to_sql' AS token, 'PRODUCES' AS flow, CASE WHEN k % 2 = 0 THEN 4 ELSE 3 END AS line FROM p UNION ALL SELECT {said(NB_PATH)}, 'read_csv', 'CONSUMES', 2 FROM p WHERE k % 2 = 0""")
def e25_notebook_io(spark, d):
    return FS.notebook_io(tree(spark, d, "ipynb")).select("path", "token", "flow", "line")


# Graphs and tools.

IMPORTS = f"""imports AS (SELECT {said(PY_PATH)} AS src, {said("pkg<h10>/m<h>.py")} AS dst FROM p WHERE k > 0)"""
_ID = said(PY_PATH + "::")


@query("g21_module_edges", f"""WITH {PARTS}, {IMPORTS} SELECT src, dst, 'IMPORTS' AS edge_type FROM imports UNION ALL SELECT {said(PY_PATH)}, {_ID} || unnest(['Part' || k || '.load', '_run', 'check']), 'CONFIGURES' FROM p UNION ALL SELECT {_ID} || '_run', {_ID} || 'check', 'CALLS' FROM p""")
def g21_module_edges(spark, d):
    return analyze.module_edges(analyze.extract(tree(spark, d, "py"), *analyze.MODULES)).select("src", "dst", "edge_type")


@query("g21_module_metrics", f"""WITH {PARTS}, {IMPORTS}, n AS (SELECT dst, count(*) AS n FROM imports GROUP BY dst) SELECT {said(PY_PATH)} AS path, 28 + 2 * k4 AS loc, coalesce(n, 0) AS imported_by, n IS NULL AS is_dead_code, 2 AS calls FROM p LEFT JOIN n ON dst = {said(PY_PATH)}""")
def g21_module_metrics(spark, d):
    return analyze.module_graph(analyze.extract(tree(spark, d, "py"), *analyze.MODULES), ranked=False)[0].select("path", "loc", "imported_by", "is_dead_code", "calls")


@query("g23_drawn_modules", f"WITH {PARTS}, {IMPORTS} SELECT src, dst FROM imports")
def g23_drawn_modules(spark, d):
    modules = analyze.extract(tree(spark, d, "py"), "modules").modules
    return artifacts.drawn(modules.select(F.col("path").alias("id"), F.lit("module").alias("node_type")), cut(analyze.import_edges(modules)), modules_only=True)[1].select("src", "dst")


EDGES = f"""{PARTS}, {LINEAGE}, s AS (SELECT *, 'transform::' || path || '::' || substr(sha256(path || '|' || array_to_string(sources, ',') || '|' || target || '|' || '{{' || start || ', ' || "end" || '}}'), 1, 12) AS t FROM sql_rows),
    edges AS (SELECT 'dataset::' || unnest(sources) AS src, t AS dst, 'CONSUMES' AS edge_type, 'sql' AS method FROM s UNION SELECT t, 'dataset::' || target, 'PRODUCES', 'sql' FROM s
    UNION SELECT 'dataset::' || unnest([{said("data/in_<k>.csv")}, {said("raw.t_<s>")}, {said("dim_<k4>")}]), 'transform::' || {said(PY_PATH)}, 'CONSUMES', unnest(['python', 'python_sql', 'python_sql']) FROM p
    UNION SELECT 'transform::' || {said(PY_PATH)}, 'dataset::' || {said("out/p_<k>.parquet")}, 'PRODUCES', 'python' FROM p
    UNION SELECT 'pipeline::' || {said("extract_<k>")}, 'pipeline::' || unnest([{said("load_<k>")}, {said("test_<k>")}]), 'CONFIGURES', 'python_ast' FROM p
    UNION SELECT 'config::' || unnest([{said("src_<s>")}, {said("dim_<k4>")}]), 'config::' || {said("model_<k>")}, 'CONFIGURES', 'dbt_schema_dependency' FROM p
    UNION SELECT 'config::' || {said("t_<k>")}, 'config::' || unnest([{said("u_<k>")}, {said("v_<k>")}]), 'CONFIGURES', 'yaml_task_dependency' FROM p
    UNION SELECT 'dataset::<dynamic>::' || {said(NB_PATH)} || '::2', 'transform::' || {said(NB_PATH)}, 'CONSUMES', 'notebook' FROM p WHERE k % 2 = 0
    UNION SELECT 'transform::' || {said(NB_PATH)}, 'dataset::<dynamic>::' || {said(NB_PATH)} || CASE WHEN k % 2 = 0 THEN '::4' ELSE '::3' END, 'PRODUCES', 'notebook' FROM p)"""


def lineage(spark, d) -> tuple[DataFrame, DataFrame]:
    return analyze.lineage_graph(analyze.extract(tree(spark, d), *analyze.LINEAGE))


def tools(spark, d) -> navigator.Navigator:
    """The tools over the lineage graph, whose nodes they read several times."""
    nodes, edges = lineage(spark, d)
    return navigator.Navigator(None, None, cut(nodes), edges)


@query("g22_lineage_edges", f"WITH {EDGES} SELECT src, dst, edge_type, method FROM edges")
def g22_lineage_edges(spark, d):
    return analyze.lineage_edges(analyze.extract(tree(spark, d), *analyze.LINEAGE)).select("src", "dst", "edge_type", F.col("analysis_method").alias("method"))


@query("g22_lineage_nodes", f"""WITH {EDGES} SELECT id, CASE split_part(id, '::', 1) WHEN 'transform' THEN 'transformation' ELSE split_part(id, '::', 1) END AS node_type,
    CASE WHEN id LIKE 'transform::nb/%' THEN max(CASE WHEN e = 'CONSUMES' THEN 'notebook_etl' ELSE 'notebook_export' END) ELSE '' END AS notebook FROM (SELECT src AS id, edge_type AS e FROM edges UNION ALL SELECT dst, edge_type FROM edges) GROUP BY id
    ORDER BY id""".replace("max(CASE", "min(CASE"))
def g22_lineage_nodes(spark, d):
    nodes = lineage(spark, d)[0]
    return nodes.select("id", "node_type", F.when(F.startswith("id", F.lit("transform::nb/")), F.col("transformation_type")).otherwise("").alias("notebook"))


DOWN = "RECURSIVE " + EDGES + ", r AS (SELECT 'dataset::raw.t_7' AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN edges ON src = node)"


@query("n2_trace_lineage", f"WITH {DOWN} SELECT node, min(depth) AS depth FROM r WHERE depth > 0 GROUP BY node")
def n2_trace_lineage(spark, d):
    return tools(spark, d).trace_lineage("RAW.t_7", "downstream").rows.select("node", "depth")


@query("g17_direct_dependents", f"WITH {DOWN} SELECT node, min(depth) AS depth FROM r GROUP BY node HAVING min(depth) = 1")
def g17_direct_dependents(spark, d):
    return tools(spark, d).what_depends_on("raw.t_7")["direct"].select("node", "depth")


@query("g20_impact_report", f"""WITH {DOWN}, q AS (SELECT node, min(depth) AS depth FROM r WHERE depth > 0 GROUP BY node) SELECT 'dataset::raw.t_7' AS target, count(*) AS impacted, max(depth) AS max_depth, count(*) FILTER (node LIKE 'dataset::%') AS datasets,
    count(*) FILTER (node NOT IN (SELECT src FROM edges)) AS sinks FROM q""")
def g20_impact_report(spark, d):
    x = tools(spark, d).impact_report("raw.t_7")
    return spark.createDataFrame([(x["target"], x["impacted"], x["max_depth"], x["datasets"], len(x["sinks"]))], "target string, impacted long, max_depth int, datasets long, sinks long")


@query("n3_blast_radius", f"WITH RECURSIVE {PARTS}, {IMPORTS}, r AS (SELECT 'pkg5/m5.py' AS node, 0 AS depth UNION SELECT src, depth + 1 FROM r JOIN imports ON dst = node WHERE src <> 'pkg5/m5.py') SELECT node, min(depth) AS depth FROM r WHERE depth > 0 GROUP BY node")
def n3_blast_radius(spark, d):
    modules = analyze.extract(tree(spark, d, "py"), "modules").modules
    return navigator.Navigator(modules, cut(analyze.import_edges(modules)), None, None).blast_radius("M5.PY", dependents=True).rows.select("node", "depth")


@query("n4_explain_module", f"WITH {PARTS} SELECT {said(PY_PATH)} AS path, 28 + 2 * k4 AS loc, 3.0 + k4 AS complexity, {said('Part<k>(Base<s>, other.Mixin)')} AS classes FROM p WHERE k = 7")
def n4_explain_module(spark, d):
    modules, edges = analyze.module_graph(analyze.extract(tree(spark, d, "py"), *analyze.MODULES), ranked=False)
    return navigator.Navigator(modules, edges, None, None).explain_module("m7.py").rows.select("path", "loc", "complexity", bars("classes"))


@query("n6_questions", f"""WITH {PARTS} SELECT k, 1 AS step, ['find_implementation', 'trace_lineage', 'trace_lineage', 'blast_radius'][1 + k4] AS tool,
    [{said("part <s>")}, {said("raw.t_<s>")}, {said("mart.m_<k9>")}, {said("pkg/m<k>.py")}][1 + k4] AS arg, ['', 'upstream', 'downstream', ''][1 + k4] AS direction FROM p UNION ALL SELECT k, 2, 'explain_module', '', '' FROM p WHERE k4 = 2""")
def n6_questions(spark, d):
    p = table(spark, d, "part").select(*[F.expr(v).cast("long").alias(k) for k, v in _COLUMNS.items()])
    asked = [code(t) for t in ("Find implementation of  part <s>?", "what feeds 'raw.t_<s>'?", "Trace downstream of mart.m_<k9> then explain it", "blast_radius pkg/m<k>.py")]
    text = F.element_at(F.array(*asked), (F.col("k4") + 1).cast("int"))
    rows = navigator.question_rows(p.select(F.col("k").cast("string").alias("path"), text.alias("text")))
    return rows.select(F.col("path").cast("long").alias("k"), "step", "tool", "arg", "direction")


@query("t10_semantic_pass", f"""WITH {PARTS} SELECT {said(PY_PATH)} AS path, 'This module primarily handles ' || CASE WHEN s = 7 THEN 'pipeline orchestration, ' ELSE '' END || '3 public entry points. It appears in the python layer and exposes key behaviors through code-defined interfaces. [Documentation Drift Suspected]' AS purpose, 'medium' AS severity FROM p""")
def t10_semantic_pass(spark, d):
    files = tree(spark, d, "py")
    files = files.withColumn("text", F.replace("text", F.lit("import lib_7,"), F.lit("import airflow_7,")))
    return analyze.semantics(analyze.extract(files, "modules").modules).select("path", "purpose", F.col("drift.severity").alias("severity"))
