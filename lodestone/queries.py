"""Registered queries: each operator on the driver's tables, beside the SQL that gives the same rows.

Keys start with the operator's id in the blueprint; ext_ marks what goes beyond it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import graph as G
from .operators import scoring as S
from .operators import search
from .plans import analyze, artifacts, navigator
from .plans import readmodels as R
from .registry import ORACLES, QUERIES, query, table  # noqa: F401  the first two are read here by others
from .session import shared_folder
from .sources import files as FS
from .sources import gitlog, graph_files, repositories

def ident(prefix: str, column: str):
    return F.concat(F.lit(prefix + "::"), F.col(column).cast("string"))


# Carriers: graphs made of the tables.

STAR = """star AS (
    SELECT 'region::' || n_regionkey AS src, 'nation::' || n_nationkey AS dst FROM nation
    UNION ALL SELECT 'nation::' || c_nationkey, 'customer::' || c_custkey FROM customer
    UNION ALL SELECT 'nation::' || s_nationkey, 'supplier::' || s_suppkey FROM supplier
    UNION ALL SELECT 'customer::' || o_custkey, 'order::' || o_orderkey FROM orders
), star_nodes AS (SELECT src AS id FROM star UNION SELECT dst FROM star)"""


def star(spark: SparkSession, d: str) -> DataFrame:
    n, c, s, o = (table(spark, d, t) for t in ("nation", "customer", "supplier", "orders"))
    return (
        n.select(ident("region", "n_regionkey").alias("src"), ident("nation", "n_nationkey").alias("dst"))
        .union(c.select(ident("nation", "c_nationkey"), ident("customer", "c_custkey")))
        .union(s.select(ident("nation", "s_nationkey"), ident("supplier", "s_suppkey")))
        .union(o.select(ident("customer", "o_custkey"), ident("order", "o_orderkey")))
    )


def star_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


TRADE = """trade AS (
    SELECT 'n' || c_nationkey AS src, 'n' || s_nationkey AS dst, CAST(count(*) AS DOUBLE) AS weight
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    GROUP BY 1, 2
), heavy AS (SELECT * FROM trade WHERE weight > 1.35 * (SELECT avg(weight) FROM trade) AND src <> dst)"""


def trade(spark: SparkSession, d: str) -> DataFrame:
    li, o, c, s = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "supplier"))
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(s, li["l_suppkey"] == s["s_suppkey"])
    n = lambda col: F.concat(F.lit("n"), F.col(col).cast("string"))
    return j.groupBy(n("c_nationkey").alias("src"), n("s_nationkey").alias("dst")).agg(F.count("*").cast("double").alias("weight"))


def heavy(spark: SparkSession, d: str) -> DataFrame:
    t = trade(spark, d)
    mean = t.agg(F.avg("weight").alias("mean"))
    return t.join(F.broadcast(mean)).where("weight > 1.35 * mean AND src <> dst").drop("mean")


def nations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"))


def _reach_sql(edges: str, start: str, forward: bool = True) -> str:
    a, b = ("src", "dst") if forward else ("dst", "src")
    return f"r AS (SELECT {start} AS node, 0 AS depth UNION SELECT {edges}.{b}, r.depth + 1 FROM r JOIN {edges} ON {edges}.{a} = r.node WHERE r.depth < 8)"


# Graph algebra.


@query("g3_downstream", f"WITH RECURSIVE {STAR}, {_reach_sql('star', chr(39) + 'region::0' + chr(39))} SELECT DISTINCT node FROM r WHERE depth > 0")
def g3_downstream(spark, d):
    return G.levels(star(spark, d), spark.createDataFrame([("region::0",)], "start string")).select("node")


@query("g3_upstream", f"WITH RECURSIVE {STAR}, {_reach_sql('star', chr(39) + 'order::1' + chr(39), False)} SELECT DISTINCT node FROM r WHERE depth > 0")
def g3_upstream(spark, d):
    return G.levels(G.reverse(star(spark, d)), spark.createDataFrame([("order::1",)], "start string")).select("node")


@query("g4_bfs_levels", f"WITH RECURSIVE {STAR}, {_reach_sql('star', chr(39) + 'region::1' + chr(39))} SELECT r.node, min(r.depth) AS depth, min(star.src) AS parent FROM r JOIN star ON star.dst = r.node WHERE r.depth > 0 GROUP BY r.node")
def g4_bfs_levels(spark, d):
    return G.reach(star(spark, d), spark.createDataFrame([("region::1",)], "start string")).select("node", "depth", "parent")


@query("g5_direct_neighbours", f"WITH {STAR} SELECT 'upstream' AS direction, src AS id, 1 AS depth FROM star WHERE dst = 'nation::3' UNION SELECT 'downstream', dst, 1 FROM star WHERE src = 'nation::3'")
def g5_direct_neighbours(spark, d):
    return G.neighbours(star(spark, d), "nation::3")


@query("g6_blast_radius_order", f"""WITH {STAR}, a AS (SELECT dst, row_number() OVER (ORDER BY dst) AS p FROM star WHERE src = 'region::2'),
    b AS (SELECT s.dst, row_number() OVER (ORDER BY a.p, s.dst) + (SELECT count(*) FROM a) AS p FROM a JOIN star s ON s.src = a.dst),
    c AS (SELECT s.dst, row_number() OVER (ORDER BY b.p, s.dst) + (SELECT count(*) FROM a) + (SELECT count(*) FROM b) AS p FROM b JOIN star s ON s.src = b.dst)
    SELECT dst AS node, p AS position FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""")
def g6_blast_radius_order(spark, d):
    return G.numbered(G.reach(star(spark, d), spark.createDataFrame([("region::2",)], "start string"))).select("node", "position")


@query("g7_sources_sinks", f"WITH {STAR} SELECT id, id NOT IN (SELECT dst FROM star) AS is_source, id NOT IN (SELECT src FROM star) AS is_sink FROM star_nodes")
def g7_sources_sinks(spark, d):
    e = star(spark, d)
    return G.sources_and_sinks(star_nodes(e), e)


@query("g8_pagerank_trade", f"""WITH RECURSIVE {TRADE}, n AS (SELECT 'n' || n_nationkey AS id FROM nation), t AS (SELECT src, sum(weight) AS total FROM trade GROUP BY src),
    m AS (SELECT n.id AS src, o.id AS dst, CASE WHEN t.total IS NULL THEN 1.0 / (SELECT count(*) FROM n) ELSE coalesce(e.weight, 0) / t.total END AS w
          FROM n CROSS JOIN n AS o LEFT JOIN t ON t.src = n.id LEFT JOIN trade e ON e.src = n.id AND e.dst = o.id),
    p AS (SELECT 0 AS k, map_from_entries(list((id, 1.0 / 25))) AS r FROM n
          UNION ALL SELECT k + 1, (SELECT map_from_entries(list((dst, v))) FROM (SELECT dst, 0.15 / 25 + 0.85 * sum(w * p.r[src]) AS v FROM m GROUP BY dst)) FROM p WHERE k < 60)
    SELECT id, round((SELECT r FROM p WHERE k = 60)[id], 6) AS rank FROM n""")
def g8_pagerank_trade(spark, d):
    return G.pagerank(nations(spark, d), trade(spark, d), tolerance=1e-12).select("id", F.round("rank", 6).alias("rank"))


@query("g9_cycles_trade", f"""WITH RECURSIVE {TRADE}, c AS (SELECT src, dst FROM heavy UNION SELECT c.src, h.dst FROM c JOIN heavy h ON h.src = c.dst),
    m AS (SELECT a.src, least(min(a.dst), a.src) AS component FROM c a JOIN c b ON b.src = a.dst AND b.dst = a.src WHERE a.src <> a.dst GROUP BY a.src),
    g AS (SELECT component, count(*) AS size, string_agg(src, ',' ORDER BY src) AS members FROM m GROUP BY component)
    SELECT 'cycle_' || row_number() OVER (ORDER BY size DESC, component) AS cycle_id, size, members FROM g""")
def g9_cycles_trade(spark, d):
    return G.strong_components(nations(spark, d), heavy(spark, d)).select("cycle_id", "size", F.array_join("members", ",").alias("members"))


@query("g10_dead_symbols", f"WITH {STAR} SELECT id, id NOT IN (SELECT src FROM star) AS is_dead FROM star_nodes WHERE id LIKE 'customer::%'")
def g10_dead_symbols(spark, d):
    e = star(spark, d)
    return G.sources_and_sinks(star_nodes(e), e).where("id LIKE 'customer::%'").select("id", F.col("is_sink").alias("is_dead"))


@query("g11_descendant_counts", f"""WITH RECURSIVE {STAR}, c AS (SELECT src, dst FROM star UNION SELECT c.src, s.dst FROM c JOIN star s ON s.src = c.dst)
    SELECT n.id, count(DISTINCT c.dst) AS descendants FROM star_nodes n LEFT JOIN c ON c.src = n.id GROUP BY n.id""")
def g11_descendant_counts(spark, d):
    e = star(spark, d)
    return G.descendants(e, star_nodes(e))


@query("g12_shortest_paths", f"""WITH RECURSIVE {TRADE}, r AS (SELECT 'n' || n_nationkey AS start, 'n' || n_nationkey AS node, 0 AS depth FROM nation
    UNION SELECT r.start, h.dst, r.depth + 1 FROM r JOIN heavy h ON h.src = r.node WHERE r.depth < 25)
    SELECT start, node, min(depth) AS depth FROM r GROUP BY start, node HAVING node <> start""")
def g12_shortest_paths(spark, d):
    return G.levels(heavy(spark, d), nations(spark, d).withColumnRenamed("id", "start")).select("start", "node", "depth")


@query("g13_degree_centrality", f"""WITH {STAR}, i AS (SELECT dst AS id, count(*) AS n FROM star GROUP BY 1), o AS (SELECT src AS id, count(*) AS n FROM star GROUP BY 1)
    SELECT s.id, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree, round((coalesce(i.n, 0) + coalesce(o.n, 0)) / ((SELECT count(*) FROM star_nodes) - 1), 9) AS degree_centrality
    FROM star_nodes s LEFT JOIN i ON i.id = s.id LEFT JOIN o ON o.id = s.id""")
def g13_degree_centrality(spark, d):
    e = star(spark, d)
    return G.degrees(star_nodes(e), e).withColumn("degree_centrality", F.round("degree_centrality", 9))


@query("g14_betweenness_trade", f"""WITH RECURSIVE {TRADE}, walk AS (SELECT src AS s, dst AS t, 1 AS d, 1.0 AS paths FROM heavy
    UNION ALL SELECT w.s, h.dst, w.d + 1, w.paths FROM walk w JOIN heavy h ON h.src = w.t WHERE w.d < 6 AND h.dst <> w.s),
    best AS (SELECT s, t, min(d) AS d FROM walk GROUP BY s, t), sp AS (SELECT w.s, w.t, w.d, sum(w.paths) AS p FROM walk w JOIN best b ON b.s = w.s AND b.t = w.t AND b.d = w.d GROUP BY w.s, w.t, w.d),
    v AS (SELECT a.t AS id, sum(a.p * b.p / c.p) AS x FROM sp a JOIN sp b ON b.s = a.t JOIN sp c ON c.s = a.s AND c.t = b.t AND a.d + b.d = c.d WHERE a.s <> b.t GROUP BY a.t)
    SELECT 'n' || n_nationkey AS id, round(coalesce(v.x, 0) / (24.0 * 23.0), 6) AS betweenness FROM nation LEFT JOIN v ON v.id = 'n' || n_nationkey""")
def g14_betweenness_trade(spark, d):
    return G.betweenness(nations(spark, d), heavy(spark, d)).withColumn("betweenness", F.round("betweenness", 6))


@query("g15_labelled_nodes", f"""WITH {STAR}, d AS (SELECT id, (SELECT count(*) FROM star WHERE src = id) + (SELECT count(*) FROM star WHERE dst = id) AS degree FROM star_nodes WHERE id LIKE 'nation::%' OR id LIKE 'region::%')
    SELECT id, degree FROM d ORDER BY degree DESC, id LIMIT 8""")
def g15_labelled_nodes(spark, d):
    e = star(spark, d)
    rows = G.degrees(star_nodes(e), e).where("id LIKE 'nation::%' OR id LIKE 'region::%'")
    n = rows.count()
    return rows.select("id", (F.col("in_degree") + F.col("out_degree")).alias("degree")).orderBy(F.desc("degree"), "id").limit(min(18, max(8, int(n**0.5))))


@query("g16_suspicious_hubs", f"""WITH {STAR}, d AS (SELECT id, (SELECT count(*) FROM star WHERE src = id) + (SELECT count(*) FROM star WHERE dst = id) AS degree FROM star_nodes), m AS (SELECT max(degree) AS degree, count(*) AS n FROM d)
    SELECT d.id, d.degree, round(d.degree / greatest(1, m.n - 1), 6) AS ratio, d.degree >= 10 AND d.degree / greatest(1, m.n - 1) >= 0.6 AND m.n > 2 AS suspicious FROM d, m WHERE d.degree = m.degree""")
def g16_suspicious_hubs(spark, d):
    e = star(spark, d)
    rows = G.degrees(star_nodes(e), e).select("id", (F.col("in_degree") + F.col("out_degree")).alias("degree"))
    most = rows.agg(F.max("degree").alias("degree"), F.count("*").alias("n"))
    ratio = F.col("degree") / F.greatest(F.lit(1), F.col("n") - 1)
    return rows.join(F.broadcast(most), "degree").select("id", "degree", F.round(ratio, 6).alias("ratio"), ((F.col("degree") >= 10) & (ratio >= 0.6) & (F.col("n") > 2)).alias("suspicious"))


IMPACT = f"""WITH RECURSIVE {STAR}, r AS (SELECT dst AS start, dst AS node, 0 AS depth FROM star WHERE dst LIKE 'nation::%' UNION SELECT r.start, s.dst, r.depth + 1 FROM r JOIN star s ON s.src = r.node),
    p AS (SELECT start, node, depth FROM r WHERE depth > 0)"""


@query("g18_impact_reports", IMPACT + """ SELECT s.id AS start, count(p.node) AS impacted, coalesce(max(p.depth), 0) AS max_depth, count(p.node) FILTER (p.node LIKE 'customer::%') AS datasets,
    count(p.node) FILTER (p.node LIKE 'order::%') AS transformations, count(p.node) FILTER (p.node NOT IN (SELECT src FROM star)) AS n_sinks FROM (SELECT id FROM star_nodes WHERE id LIKE 'nation::%') s LEFT JOIN p ON p.start = s.id GROUP BY s.id""")
def g18_impact_reports(spark, d):
    e = star(spark, d)
    kind = F.when(F.startswith("id", F.lit("customer::")), "dataset").when(F.startswith("id", F.lit("order::")), "transformation").otherwise("config")
    nodes = star_nodes(e).select("id", kind.alias("node_type"), F.lit("").alias("source_file"))
    starts = nodes.where("id LIKE 'nation::%'").select(F.col("id").alias("start"))
    return G.impact(e, nodes, starts).select("start", F.col("impacted").cast("long"), F.col("max_depth").cast("int"), F.col("datasets").cast("long"), F.col("transformations").cast("long"), F.size("sinks").cast("long").alias("n_sinks"))


@query("g19_top_impacts", IMPACT + " SELECT start, count(*) AS impacted FROM p GROUP BY start ORDER BY impacted DESC, start LIMIT 10")
def g19_top_impacts(spark, d):
    e = star(spark, d)
    starts = e.where("dst LIKE 'nation::%'").select(F.col("dst").alias("start"))
    return G.levels(e, starts).groupBy("start").agg(F.count("*").alias("impacted")).orderBy(F.desc("impacted"), "start").limit(10)


@query("g2_edges_last_wins", "SELECT 'c' || o_custkey AS src, o_orderstatus AS dst, max_by(o_orderpriority, o_orderkey) AS edge_type, max(o_orderkey) AS seq FROM orders GROUP BY 1, 2")
def g2_edges_last_wins(spark, d):
    o = table(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.col("o_orderstatus").alias("dst"), F.col("o_orderpriority").alias("edge_type"), F.col("o_orderkey").alias("seq"))
    return G.last_wins(o.withColumn("at", F.col("seq")), ["src", "dst"], "at").select("src", "dst", "edge_type", "seq")


@query("g1_nodes_merged", "SELECT user_id AS id, max_by(event_type, event_id) AS kind, max_by(value, event_id) FILTER (event_type = 'purchase') AS last_purchase FROM events GROUP BY user_id")
def g1_nodes_merged(spark, d):
    ev = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("kind"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("last_purchase"), F.col("event_id").alias("seq"))
    return G.merge_nodes(ev, ["id"], ["kind"], ["last_purchase"])


@query("g1_auto_endpoints", f"WITH {STAR} SELECT id, id LIKE 'nation::%' AS known FROM star_nodes")
def g1_auto_endpoints(spark, d):
    known = table(spark, d, "nation").select(ident("nation", "n_nationkey").alias("id"), F.lit(True).alias("known"))
    return G.with_endpoints(known, star(spark, d)).select("id", F.coalesce("known", F.lit(False)).alias("known"))


# Joins.


@query("j2_call_edges", """WITH f AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n FROM lineitem), c AS (SELECT o, n, unnest([n + 1, n * 2]) AS m FROM f)
    SELECT DISTINCT 'o' || c.o || '::f' || c.n AS src, 'o' || c.o || '::f' || c.m AS dst FROM c JOIN f ON f.o = c.o AND f.n = c.m""")
def j2_call_edges(spark, d):
    f = table(spark, d, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey")).alias("path"), F.col("l_linenumber").cast("int").alias("n")).distinct()
    name = lambda n: F.concat(F.lit("f"), n.cast("string"))
    functions = f.select("path", F.concat_ws("::", "path", name(F.col("n"))).alias("id"), F.array(name(F.col("n") + 1), name(F.col("n") * 2)).alias("calls"))
    return analyze.call_edges(functions).select("src", "dst")


@query("j3_velocity_join", "SELECT c_custkey AS path, coalesce(n, 0) AS commit_count, coalesce(last, '') AS last_commit FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, strftime(max(o_orderdate), '%Y-%m-%d') AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def j3_velocity_join(spark, d):
    v = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("path")).agg(F.count("*").alias("commit_count"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_commit"))
    return gitlog.with_velocity(table(spark, d, "customer").select(F.col("c_custkey").alias("path")), v).select("path", "commit_count", "last_commit")


@query("j4_metadata_upsert", "SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN upper(c_mktsegment) || '!' ELSE c_mktsegment END AS segment, c_nationkey AS nation FROM customer")
def j4_metadata_upsert(spark, d):
    c = table(spark, d, "customer")
    update = c.where("c_acctbal < 0").select(F.col("c_custkey").alias("id"), F.concat(F.upper("c_mktsegment"), F.lit("!")).alias("segment"))
    update = update.union(spark.createDataFrame([(-1, "none"), (0, None)], "id long, segment string"))
    return G.updated(c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")), update)


@query("j5_import_subgraph", f"WITH {STAR} SELECT src, dst FROM star WHERE src LIKE 'nation::%' AND dst LIKE 'customer::%' AND dst LIKE '%7'")
def j5_import_subgraph(spark, d):
    e = star(spark, d).withColumn("edge_type", F.when(F.endswith("dst", F.lit("7")), "IMPORTS").otherwise("CALLS"))
    modules = star_nodes(e).where("id LIKE 'nation::%' OR id LIKE 'customer::%'").select(F.col("id").alias("path"))
    return analyze.import_graph(e, modules).select("src", "dst")


@query("j6_evidence_precedence", """WITH l AS (SELECT DISTINCT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS node, l_orderkey, l_returnflag, l_linestatus FROM lineitem)
    SELECT node, CASE WHEN l_returnflag = 'R' THEN 'edge.sql' WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE '' END AS source_file,
    CASE WHEN l_returnflag = 'R' THEN 'sql' ELSE 'static_graph_lookup' END AS analysis_method, CASE WHEN l_linestatus = 'F' THEN 'edge type' ELSE o_orderpriority END AS transformation_type
    FROM l JOIN orders ON l_orderkey = o_orderkey""")
def j6_evidence_precedence(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    rows = li.select(F.concat_ws("-", *[F.col(c).cast("string") for c in keys]).alias("node"), "l_orderkey", "l_returnflag", "l_linestatus").distinct()
    rows = rows.join(o, rows["l_orderkey"] == o["o_orderkey"]).withColumn("parent", F.concat(F.lit("o"), F.col("l_orderkey")))
    sql = F.col("l_returnflag") == "R"
    edges = rows.select(F.col("parent").alias("src"), F.col("node").alias("dst"), F.when(sql, "edge.sql").otherwise("").alias("source_file"), F.struct(F.lit(1).alias("start"), F.lit(2).alias("end")).alias("line_range"), F.when(sql, "sql").alias("analysis_method"), F.when(F.col("l_linestatus") == "F", "edge type").otherwise("").alias("transformation_type"))
    nodes = rows.select(F.col("node").alias("id"), F.lit("dataset").alias("node_type"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise("").alias("source_file"), F.col("o_orderpriority").alias("transformation_type"))
    found = navigator.with_evidence(rows.select("node", F.lit(1).alias("depth"), "parent"), edges, nodes)
    return found.select("node", "source_file", "analysis_method", "transformation_type")


@query("j7_edges_of_nodes", f"WITH {STAR} SELECT DISTINCT src, dst FROM star WHERE src IN ('nation::1', 'region::1') OR dst IN ('nation::1', 'region::1') ORDER BY src, dst LIMIT 50")
def j7_edges_of_nodes(spark, d):
    return G.touching(star(spark, d), ["nation::1", "region::1"], 50)


@query("j8_related_by_file", "SELECT p_partkey AS id FROM part WHERE p_partkey % 3 <> 0 AND p_brand IN (SELECT p_brand FROM part WHERE p_size = 50 AND p_partkey % 4 = 1)")
def j8_related_by_file(spark, d):
    p = table(spark, d, "part")
    kinds = F.element_at(F.array(*map(F.lit, ("module", "config", "pipeline"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    nodes = p.select(F.col("p_partkey").alias("id"), kinds.alias("node_type"), F.col("p_brand").alias("source_file"))
    return G.related_by_file(nodes, p.where("p_size = 50 AND p_partkey % 4 = 1").select(F.col("p_brand").alias("source_file")))


@query("j9_prune_changed", "SELECT o_orderkey, o_custkey AS path FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def j9_prune_changed(spark, d):
    changes = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("path"))
    return G.without(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("path")), changes)


@query("j10_known_datasets", "SELECT DISTINCT l_partkey AS id FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_partkey % 7 <> 0 AND p_size > 10")
def j10_known_datasets(spark, d):
    name = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("set "), F.col("p_name"))).otherwise(F.col("p_name"))
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 10, "dataset").otherwise("config").alias("node_type"), name.alias("name"))
    return S.known_datasets(table(spark, d, "lineitem").select(F.col("l_partkey").alias("id")), nodes)


@query("j11_paths_in_text", "SELECT p_partkey AS id, unnest(['src/m' || p_size || '.py', 'models/' || replace(p_brand, '#', '_') || '.sql', 'a-b/conf.yml']) AS path FROM part")
def j11_paths_in_text(spark, d):
    p = table(spark, d, "part")
    model = F.concat(F.lit("models/"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit(".sql"))
    py = F.concat(F.lit("src/m"), F.col("p_size"), F.lit(".py"))
    text = F.concat(F.lit("See `"), py, F.lit("` and ("), model, F.lit("), then a-b/conf.yml, again "), py, F.lit("; not x.pyc, nor .txt files: "), F.col("p_name"))
    return p.select(F.col("p_partkey").alias("id"), F.explode(T.paths_in(text)).alias("path"))


# Aggregations, ranks, sets.


@query("a1_type_counts", "SELECT CASE WHEN event_type = 'view' THEN 'unknown' ELSE event_type END AS kind, count(*) AS n FROM events WHERE event_type <> 'click' GROUP BY 1")
def a1_type_counts(spark, d):
    e = F.col("event_type")
    return R.type_counts(table(spark, d, "events").select(F.when(e == "click", "dataset").otherwise("transformation").alias("node_type"), F.when(e == "view", " ").otherwise(e).alias("transformation_type")))


@query("a2_impact_summary", f"""WITH RECURSIVE {STAR}, r AS (SELECT 'region::3' AS node, 0 AS depth UNION SELECT s.dst, r.depth + 1 FROM r JOIN star s ON s.src = r.node)
    SELECT split_part(node, '::', 1) AS kind, count(*) AS n, max(depth) AS max_depth FROM r WHERE depth > 0 GROUP BY 1""")
def a2_impact_summary(spark, d):
    r = G.levels(star(spark, d), spark.createDataFrame([("region::3",)], "start string"))
    return r.groupBy(F.split_part("node", F.lit("::"), F.lit(1)).alias("kind")).agg(F.count("*").alias("n"), F.max("depth").alias("max_depth"))


CALLS = "calls AS (SELECT user_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS dst FROM events)"


def calls(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").select("user_id", F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst")).where("dst is not null")


@query("a3_call_centrality", f"WITH {CALLS} SELECT id, count(*) AS calls FROM (SELECT src AS id FROM calls WHERE dst IS NOT NULL AND user_id % 2 = 0 UNION ALL SELECT dst FROM calls WHERE dst IS NOT NULL AND user_id % 2 = 0) GROUP BY id")
def a3_call_centrality(spark, d):
    kind = F.when(F.col("user_id") % 2 == 0, "CALLS").otherwise("IMPORTS")
    inside = lambda c: F.concat_ws("::", c, F.col("user_id").cast("string"))
    return analyze.call_centrality(calls(spark, d).select(inside("src").alias("src"), inside("dst").alias("dst"), kind.alias("edge_type")))


@query("a4_repo_profile", """WITH s AS (SELECT sum(greatest(1, n_chars)) FILTER (lang = 'en') AS s, sum(greatest(1, n_chars)) FILTER (lang = 'fr') AS p FROM documents)
    SELECT CASE WHEN s / (s + p) >= 0.6 THEN 'sql_heavy' WHEN p / (s + p) >= 0.6 THEN 'python_heavy' ELSE 'mixed' END AS profile FROM s""")
def a4_repo_profile(spark, d):
    ext = F.when(F.col("lang") == "en", "x.sql").when(F.col("lang") == "fr", "x.py").otherwise("x")
    return S.profile(table(spark, d, "documents").select(ext.alias("path"), F.col("n_chars").alias("loc")))


@query("a4_profile_by_count", """WITH s AS (SELECT count(*) FILTER (lang = 'en') AS s, count(*) FILTER (lang = 'fr') AS p FROM documents)
    SELECT CASE WHEN s / (s + p) >= 0.6 THEN 'sql_heavy' WHEN p / (s + p) >= 0.6 THEN 'python_heavy' ELSE 'mixed' END AS profile FROM s""")
def a4_profile_by_count(spark, d):
    ext = F.when(F.col("lang") == "en", "x.sql").when(F.col("lang") == "fr", "x.py").otherwise("x")
    return S.profile(table(spark, d, "documents").select(ext.alias("path"), F.lit(1).alias("loc")))


@query("a5_graph_stats", f"WITH {STAR} SELECT (SELECT count(*) FROM star_nodes) AS nodes, (SELECT count(*) FROM star) AS edges, (SELECT count(*) FROM star_nodes WHERE id LIKE 'customer::%') AS datasets, (SELECT count(*) FROM star_nodes WHERE id NOT IN (SELECT src FROM star)) AS sinks")
def a5_graph_stats(spark, d):
    e = star(spark, d)
    kind = F.when(F.startswith("id", F.lit("customer::")), "dataset").otherwise("config")
    return R.graph_stats(star_nodes(e).withColumn("node_type", kind), e)


@query("a6_domain_counts", "SELECT coalesce(lang, 'none') || '/' || coalesce(source, 'none') AS domain, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, domain LIMIT 20")
def a6_domain_counts(spark, d):
    other = F.lit("none")
    path = F.concat_ws("/", F.coalesce("lang", other), F.coalesce("source", other), F.col("doc_id").cast("string"))
    return R.domains({"modules": table(spark, d, "documents").select(path.alias("path"))})


@query("a7_dominant_folders", r"SELECT folder, count(*) AS n FROM (SELECT regexp_extract(regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1), '^(.*)/[^/]*$', 1) AS folder FROM pages) WHERE folder <> '' GROUP BY 1 ORDER BY n DESC, folder LIMIT 5")
def a7_dominant_folders(spark, d):
    return R.dominant_folders(table(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1).alias("path")))


@query("a8_summary", """SELECT (SELECT count(*) FROM part) AS modules, (SELECT CAST(sum(p_size % 5) AS BIGINT) FROM part) AS public_functions, (SELECT count(*) FROM part WHERE p_size > 40) AS dead_code,
    (SELECT count(*) FROM supplier) AS datasets, (SELECT count(*) FROM customer) AS transformations, (SELECT count(*) FROM nation) AS lineage_edges""")
def a8_summary(spark, d):
    names = F.transform(F.sequence(F.lit(1), F.col("p_size") % 5 + 1), lambda k: k.cast("string"))
    modules = table(spark, d, "part").select(F.slice(names, 1, (F.col("p_size") % 5).cast("int")).alias("public_functions"), (F.col("p_size") > 40).alias("is_dead_code"))
    nodes = table(spark, d, "supplier").select(F.lit("dataset").alias("node_type")).union(table(spark, d, "customer").select(F.lit("transformation")))
    return R.summary({"modules": modules, "nodes": nodes, "edges": table(spark, d, "nation")})


COMMITS = "v AS (SELECT user_id AS path, count(DISTINCT event_id) AS commit_count, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_commit FROM events GROUP BY user_id)"


def commits(spark, d):
    e = table(spark, d, "events")
    return gitlog.velocity(e.select(F.col("event_id").cast("string").alias("hash"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("committed_at"), F.col("user_id").alias("path")))


@query("a9_file_velocity", f"WITH {COMMITS} SELECT * FROM v")
def a9_file_velocity(spark, d):
    return commits(spark, d)


@query("a11_distinct_evidence", "SELECT 'f' || user_id AS source_file, event_type AS analysis_method, CAST(min(event_id % 7) AS INTEGER) AS depth, min_by(lpad(CAST(event_id AS VARCHAR), 9, '0'), (event_id % 7, event_id)) AS node FROM events WHERE user_id % 5 <> 0 GROUP BY user_id, event_type")
def a11_distinct_evidence(spark, d):
    k = F.col("event_id")
    file = F.when(F.col("user_id") % 5 == 0, "").otherwise(F.concat(F.lit("f"), F.col("user_id")))
    rows = table(spark, d, "events").select(file.alias("source_file"), F.struct(F.lit(1).alias("start"), F.lit(9).alias("end")).alias("line_range"), F.col("event_type").alias("analysis_method"), (k % 7).cast("int").alias("depth"), F.lpad(k.cast("string"), 9, "0").alias("node"))
    return navigator.distinct_evidence(rows).drop("line_range")


@query("a12_token_spend", "SELECT role, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS tokens, round(sum(greatest(1, length(text) // 4)) / 1000.0 * 0.5, 6) AS cost FROM conversations GROUP BY role")
def a12_token_spend(spark, d):
    t = table(spark, d, "conversations").groupBy("role").agg(F.sum(T.token_estimate(F.col("text"))).alias("tokens"))
    return t.withColumn("cost", F.round(F.col("tokens") / 1000.0 * 0.5, 6))


@query("w1_velocity_rank", f"WITH {COMMITS} SELECT path, commit_count, row_number() OVER (ORDER BY commit_count DESC, path) AS velocity_rank FROM v")
def w1_velocity_rank(spark, d):
    return gitlog.ranked(commits(spark, d)).select("path", "commit_count", "velocity_rank")


@query("w2_velocity_core", f"""WITH {COMMITS}, r AS (SELECT path, commit_count, row_number() OVER w AS k, coalesce(sum(commit_count) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(commit_count) OVER () AS total, count(*) OVER () AS n FROM v WINDOW w AS (ORDER BY commit_count DESC, path))
    SELECT path, commit_count FROM r WHERE NOT (k - 1 >= greatest(1, ceil(n / 5.0)) AND before >= 0.8 * total)""")
def w2_velocity_core(spark, d):
    return gitlog.ranked(commits(spark, d)).where("is_core").select("path", "commit_count")


@query("w4_forward_fill", """WITH l AS (SELECT user_id, event_id, 'p' || event_id % 10 AS path, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS head FROM events)
    SELECT DISTINCT CAST(head AS VARCHAR) AS hash, path FROM l WHERE head IS NOT NULL""")
def w4_forward_fill(spark, d):
    e = table(spark, d, "events")
    head = F.when(F.col("event_type") == "signup", F.concat(F.lit(gitlog.HEADER), F.col("event_id").cast("string"), F.lit("|2024-01-01T00:00:00")))
    said = F.array_compact(F.array(head, F.concat(F.lit("p"), (F.col("event_id") % 10).cast("string"))))
    lines = e.select(F.col("user_id").cast("string").alias("log"), "event_id", F.posexplode(said).alias("p", "line")).select("log", (F.col("event_id") * 2 + F.col("p")).alias("line_no"), "line")
    return gitlog.commits(lines).select("hash", "path")


@query("l1_top_k", "SELECT p_partkey AS path, p_retailprice AS rank FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def l1_top_k(spark, d):
    return R.hubs({"modules": table(spark, d, "part").select(F.col("p_partkey").alias("path"), F.col("p_retailprice").alias("rank"))}, 10)


@query("l3_recent_sessions", "SELECT user_id, max(event_id) AS last FROM events GROUP BY 1 ORDER BY last DESC, user_id LIMIT 25")
def l3_recent_sessions(spark, d):
    return R.recent(table(spark, d, "events"), "user_id", "event_id")


@query("u1_graph_upsert", "SELECT o_custkey AS id, max_by(o_totalprice, (o_orderdate >= TIMESTAMP '1997-01-01', o_orderkey)) AS price FROM orders GROUP BY 1")
def u1_graph_upsert(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("seq"), (F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")).alias("fresh"))
    return G.upsert(o.where("not fresh").drop("fresh"), o.where("fresh").drop("fresh"), ["id"]).select("id", "price")


@query("u2_changed_union", "SELECT user_id AS path FROM events WHERE event_type = 'error' UNION SELECT user_id FROM events WHERE value > 90")
def u2_changed_union(spark, d):
    e = table(spark, d, "events").withColumnRenamed("user_id", "path")
    return FS.either(e.where("event_type = 'error'"), e.where("value > 90"))


@query("u3_set_difference", "SELECT l_partkey AS path FROM lineitem WHERE l_quantity > 49 AND l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45")
def u3_set_difference(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_partkey", "path")
    return G.without(li.where("l_quantity > 49 AND l_returnflag = 'R'").select("path").distinct(), li.where("l_returnflag = 'A' AND l_quantity > 45"))


@query("u4_ordered_union", "SELECT p_partkey AS id, array_to_string(list_filter(x, lambda v, i: list_position(x, v) = i), ',') AS names FROM (SELECT p_partkey, ['a' || p_size % 3, 'a' || p_size % 5, 'a' || p_size % 7, 'a' || p_partkey % 3] AS x FROM part)")
def u4_ordered_union(spark, d):
    a = lambda c, n: F.concat(F.lit("a"), (F.col(c) % n).cast("string"))
    both = T.ordered_union(F.array(a("p_size", 3), a("p_size", 5)), F.array(a("p_size", 7), a("p_partkey", 3)))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(both, ",").alias("names"))


# Scores.

LABELLED = "(SELECT p_partkey AS id, lower(p_name) AS name, p_size % 3 AS in_degree, p_size % 4 AS out_degree, p_size AS reach FROM part)"


def labelled(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("name"), (F.col("p_size") % 3).alias("in_degree"), (F.col("p_size") % 4).alias("out_degree"), F.col("p_size").alias("descendants"))


def _count_sql(column: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({column}, '{w}') AS INT)" for w in words) + ")"


@query("r1_primary_ingestion", f"SELECT id, 5 * {_count_sql('name', S.INGESTION)} + least(out_degree, 5) + least(reach, 30) AS score FROM {LABELLED} WHERE in_degree = 0 AND out_degree > 0 ORDER BY score DESC, out_degree DESC, reach DESC, id LIMIT 50")
def r1_primary_ingestion(spark, d):
    return S.primary_ingestion(labelled(spark, d), 50).select("id", "score")


@query("r2_critical_outputs", f"SELECT id, 4 * {_count_sql('name', S.OUTPUT)} + least(in_degree, 10) + least(reach, 30) AS score FROM {LABELLED} WHERE out_degree = 0 AND in_degree > 0 ORDER BY score DESC, in_degree DESC, reach DESC, id LIMIT 50")
def r2_critical_outputs(spark, d):
    return S.critical_outputs(labelled(spark, d).withColumnRenamed("descendants", "ancestors"), 50).select("id", "score")


PATHS = r"(SELECT page_id AS id, lower(regexp_extract(url, '^[a-z]+://[^/]+/?([^?#]*)', 1)) || CASE page_id % 5 WHEN 0 THEN '/utils/a.py' WHEN 1 THEN '/pipeline/base.py' WHEN 2 THEN '/tests/test_b.py' WHEN 3 THEN '/plugins/tap.sql' ELSE '/src/main.py' END AS path, page_id % 7 AS vel, (page_id % 10) / 100.0 AS pr, page_id % 90 AS calls, CAST(page_id % 13 AS DOUBLE) AS cx FROM pages)"


def paths(spark, d):
    p = table(spark, d, "pages")
    tail = F.element_at(F.array(*map(F.lit, ("/utils/a.py", "/pipeline/base.py", "/tests/test_b.py", "/plugins/tap.sql", "/src/main.py"))), (F.col("page_id") % 5 + 1).cast("int"))
    k = F.col("page_id")
    return p.select(k.alias("id"), F.concat(F.lower(F.regexp_extract("url", "^[a-z]+://[^/]+/?([^?#]*)", 1)), tail).alias("path"), (k % 7).alias("vel"), ((k % 10) / 100.0).alias("pr"), (k % 90).alias("calls"), (k % 13).cast("double").alias("cx"))


PRIORITY_SQL = f"CASE WHEN {_count_sql('path', T.STRONG_EXECUTION)} > 0 THEN 2 WHEN {_count_sql('path', T.SOME_EXECUTION)} > 0 THEN 1 ELSE 0 END"
EXCLUDED_SQL = "(list_has_any(string_split(path, '/'), ['tests', 'migrations', 'alembic', 'fixtures']) OR starts_with(regexp_extract(path, '([^/]*)$', 1), 'test_'))"
SUPPORT_SQL = f"({_count_sql('path', T.SUPPORT)} > 0)"
ABSTRACT_SQL = "(regexp_extract(path, '([^/]*)$', 1) IN ('base.py', 'types.py', 'constants.py'))"


@query("p6_path_predicates", f"SELECT id, {EXCLUDED_SQL} AS excluded, {SUPPORT_SQL} AS support, {ABSTRACT_SQL} AS abstraction, {PRIORITY_SQL} AS priority FROM {PATHS}")
def p6_path_predicates(spark, d):
    p = F.col("path")
    return paths(spark, d).select("id", T.is_excluded(p).alias("excluded"), T.is_support(p).alias("support"), T.is_abstraction(p).alias("abstraction"), T.execution_priority(p).alias("priority"))


@query("r3_entrypoints", f"SELECT id, round(score, 6) AS score FROM (SELECT *, 3.0 * {_count_sql('path', S.ENTRYPOINT)} + 80.0 * pr + 0.5 * least(calls, 80) + 0.25 * vel + 3.0 * {PRIORITY_SQL} AS score FROM {PATHS} WHERE {_count_sql('path', S.ENTRYPOINT)} > 0 AND NOT {EXCLUDED_SQL} AND NOT {SUPPORT_SQL} AND regexp_matches(path, '[.](py|js|ts|java|scala)$'))")
def r3_entrypoints(spark, d):
    score = S.entrypoint_score(F.col("path"), F.lit(""), F.col("pr"), F.col("calls"), F.col("vel"))
    return paths(spark, d).select("id", F.round(score, 6).alias("score")).where("score is not null")


@query("r5_blast_module", f"""WITH p AS (SELECT *, CASE WHEN NOT {SUPPORT_SQL} AND NOT {EXCLUDED_SQL} THEN {PRIORITY_SQL} ELSE 0 END AS strong,
    35.0 * ln(1 + id % 40) + 0.5 * cx + 0.3 * vel + 180.0 * pr + 0.6 * least(calls, 80) + 8.0 * {PRIORITY_SQL} - CASE WHEN {SUPPORT_SQL} THEN 8 ELSE 0 END - CASE WHEN {ABSTRACT_SQL} THEN 14 ELSE 0 END - CASE WHEN {EXCLUDED_SQL} THEN 12 ELSE 0 END AS score FROM {PATHS})
    SELECT path, round(score, 6) AS score FROM p ORDER BY strong DESC, p.score DESC, path DESC LIMIT 1""")
def r5_blast_module(spark, d):
    m = paths(spark, d).select("path", (F.col("id") % 40).alias("descendants"), F.col("cx").alias("complexity"), F.col("vel").alias("velocity"), F.col("pr").alias("pagerank"), "calls")
    return S.blast_module(m).select("path", F.round("score", 6).alias("score"))


@query("r6_logic_rank", f"SELECT id, round(2.0 * cx + 0.4 * least(vel, 50) + 180.0 * pr + 0.6 * least(calls, 80) + {_count_sql('path', S.LOGIC)} - {_count_sql('path', S.NOT_LOGIC)}, 6) AS score FROM {PATHS} ORDER BY score DESC, id LIMIT 20")
def r6_logic_rank(spark, d):
    score = S.logic_score(F.col("path"), F.col("cx"), F.col("vel"), F.col("pr"), F.col("calls"))
    return paths(spark, d).select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(20)


ACTIVE_SQL = f"({_count_sql('path', S.ACTIVE)} - 1.5 * {_count_sql('path', S.NOT_ACTIVE)})"


@query("r7_onboarding_velocity", f"SELECT id, round(12.0 * vel + 2.5 * {ACTIVE_SQL} + 100.0 * pr + 0.6 * cx + 0.35 * least(calls, 80) - CASE WHEN {EXCLUDED_SQL} THEN 10 ELSE 0 END - CASE WHEN {SUPPORT_SQL} THEN 6 ELSE 0 END, 6) AS score FROM {PATHS}")
def r7_onboarding_velocity(spark, d):
    return paths(spark, d).select("id", F.round(S.onboarding_score(F.col("path"), F.col("vel"), F.col("pr"), F.col("cx"), F.col("calls")), 6).alias("score"))


@query("r8_velocity_priority", f"SELECT id, round(8.0 * vel + 120.0 * pr + 0.4 * least(calls, 80) + 0.8 * cx + {ACTIVE_SQL}, 6) AS score FROM {PATHS}")
def r8_velocity_priority(spark, d):
    return paths(spark, d).select("id", F.round(S.velocity_priority(F.col("path"), F.col("vel"), F.col("pr"), F.col("calls"), F.col("cx")), 6).alias("score"))


@query("r10_coverage_gap", "SELECT page_id AS id, page_id % 3 = 0 AND (page_id % 20 <= 1 OR page_id % 11 = 0 OR page_id % 6 <= greatest(1, (page_id % 20) // 10) OR (page_id % 2 = 0 AND page_id % 11 < greatest(1, page_id % 20 - 1))) AS gap FROM pages")
def r10_coverage_gap(spark, d):
    k = F.col("page_id")
    return table(spark, d, "pages").select(k.alias("id"), S.coverage_gap(k % 3, k % 20, k % 11, k % 6, k % 2 == 0).alias("gap"))


_METHODS = ("sqlglot", "tree_sitter_python", "git_log_frequency", "other")
ANSWERS = "(SELECT doc_id AS id, ['q1_primary_ingestion', 'q2_critical_outputs', 'q3_blast_radius', 'q4_logic_concentration'][1 + doc_id % 4] AS q, list_distinct([['sqlglot', 'tree_sitter_python', 'git_log_frequency', 'other'][1 + doc_id % 4], ['sqlglot', 'tree_sitter_python', 'git_log_frequency', 'other'][1 + doc_id % 3]]) AS methods, quality = 0 AS a, toxic = 1 AS b FROM labels)"


def answers(spark, d):
    k = F.col("doc_id")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (k % n + 1).cast("int"))
    qs = ("q1_primary_ingestion", "q2_critical_outputs", "q3_blast_radius", "q4_logic_concentration")
    return table(spark, d, "labels").select(k.alias("id"), pick(qs, 4).alias("q"), F.array_distinct(F.array(pick(_METHODS, 4), pick(_METHODS, 3))).alias("methods"), (F.col("quality") == 0).alias("a"), (F.col("toxic") == 1).alias("b"))


REL = "CASE m WHEN 'sqlglot' THEN 0.92 WHEN 'tree_sitter_python' THEN 0.70 WHEN 'git_log_frequency' THEN 0.78 ELSE 0.55 END"


@query("r14_evidence_count", f"""SELECT id, round(least(1.0, greatest(0.0, CASE WHEN q = 'q2_critical_outputs' AND a THEN 0.95 WHEN q = 'q1_primary_ingestion' AND a THEN x * 0.75 WHEN q = 'q3_blast_radius' AND b THEN x * 0.55 WHEN q = 'q4_logic_concentration' AND a THEN greatest(x, 0.9) ELSE x END)), 6) AS factor
    FROM (SELECT *, least(1.0, list_sum(list_transform(methods, lambda m: {REL})) / 3.0) AS x FROM {ANSWERS})""")
def r14_evidence_count(spark, d):
    a, b = F.col("a"), F.col("b")
    return answers(spark, d).select("id", F.round(S.evidence_count(F.col("q"), F.col("methods"), a, a, b, a, F.lit(False)), 6).alias("factor"))


@query("r15_evidence_diversity", f"""SELECT id, round(CASE WHEN q = 'q2_critical_outputs' AND a THEN 0.85 WHEN q = 'q4_logic_concentration' AND a THEN greatest(x, 0.7) WHEN q = 'q3_blast_radius' AND b THEN least(x, 0.3) ELSE x END, 6) AS factor
    FROM (SELECT *, 0.6 * least(1.0, len(methods) / 4.0) + 0.4 * list_avg(list_transform(methods, lambda m: CAST({REL} AS DOUBLE))) AS x FROM {ANSWERS})""")
def r15_evidence_diversity(spark, d):
    return answers(spark, d).select("id", F.round(S.evidence_diversity(F.col("q"), F.col("methods"), F.col("a"), F.col("b"), F.col("a"), F.lit(False)), 6).alias("factor"))


@query("r17_reliability", f"""SELECT id, round(CASE WHEN q = 'q2_critical_outputs' AND a THEN 0.9 WHEN q = 'q1_primary_ingestion' AND b THEN least(x, 0.42) WHEN q = 'q3_blast_radius' AND b THEN least(x, 0.2) WHEN q = 'q4_logic_concentration' AND a THEN greatest(x, 0.88) ELSE x END, 6) AS factor
    FROM (SELECT *, list_avg(list_transform(methods, lambda m: CAST({REL} AS DOUBLE))) AS x FROM {ANSWERS})""")
def r17_reliability(spark, d):
    return answers(spark, d).select("id", F.round(S.heuristic_reliability(F.col("q"), F.col("methods"), F.col("a"), F.col("b"), F.col("b"), F.col("a")), 6).alias("factor"))


@query("r18_agreement", f"""WITH f AS (SELECT *, list_transform(methods, lambda m: CASE WHEN m IN ('sqlglot', 'tree_sitter_python') THEN 'lineage' WHEN m = 'git_log_frequency' THEN 'git' ELSE 'heuristic' END) AS fam,
    CASE q WHEN 'q1_primary_ingestion' THEN ['lineage', 'heuristic'] WHEN 'q2_critical_outputs' THEN ['lineage'] ELSE ['module'] END AS want FROM {ANSWERS}),
    g AS (SELECT *, 0.6 * len(list_intersect(want, fam)) / len(want) + 0.4 * len(list_filter(methods, lambda m: {REL} >= 0.75)) / len(methods) AS x FROM f)
    SELECT id, round(CASE WHEN q = 'q2_critical_outputs' AND a THEN 0.95 WHEN q = 'q3_blast_radius' AND b THEN 0.25 WHEN q = 'q1_primary_ingestion' AND b THEN least(x, 0.6) ELSE x END, 6) AS factor FROM g""")
def r18_agreement(spark, d):
    return answers(spark, d).select("id", F.round(S.signal_agreement(F.col("q"), F.col("methods"), F.col("a"), F.col("b"), F.col("b")), 6).alias("factor"))


@query("r16_graph_coverage", f"""WITH s AS (SELECT id, q, a, b, id % 9 AS mn, id % 14 AS me, id % 12 AS ln, id % 16 AS le, id % 5 AS dn, id % 4 AS tn, least(id % 5, id % 3) AS sk FROM {ANSWERS}), d AS (SELECT *, least(1.0, le / greatest(1.0, dn + tn)) AS dl, least(1.0, me / greatest(1.0, mn)) AS dm FROM s)
    SELECT id, round(CASE q WHEN 'q1_primary_ingestion' THEN CASE WHEN b THEN CASE WHEN mn > 0 THEN 0.55 ELSE 0.35 END WHEN dn > 0 THEN least(1, 0.55 + 0.45 * dl) WHEN ln > 0 THEN 0.65 WHEN mn > 0 THEN 0.5 ELSE 0.2 END
    WHEN 'q2_critical_outputs' THEN CASE WHEN a THEN 0.95 WHEN dn > 0 THEN least(1, 0.4 + 0.35 * sk / greatest(1.0, dn) + 0.25 * dl) WHEN ln > 0 THEN 0.6 ELSE 0.25 END
    WHEN 'q3_blast_radius' THEN CASE WHEN mn <= 0 THEN 0.2 WHEN b THEN least(0.3, 0.25 + 0.45 * dm + 0.3) ELSE least(1, 0.25 + 0.45 * dm + 0.3) END
    ELSE CASE WHEN a THEN greatest(0.82, least(1, 0.45 + 0.35 * 0.6 + 0.2 * dm)) ELSE least(1, 0.45 + 0.35 * 0.6 + 0.2 * dm) END END, 6) AS factor FROM d""")
def r16_graph_coverage(spark, d):
    k, no = F.col("id"), F.lit(False)
    stats = {"module_nodes": k % 9, "module_edges": k % 14, "lineage_nodes": k % 12, "lineage_edges": k % 16, "datasets": k % 5, "transformations": k % 4, "sinks": F.least(k % 5, k % 3)}
    f = S.graph_coverage(F.col("q"), stats, entrypoint=F.col("b"), verified_none=F.col("a"), scan_complete=no, has_module=F.lit(True), gap=F.col("b"), focus=F.lit(3), strong=F.col("a"), active_ratio=F.lit(0.5), status=F.lit("complete"), git_only=no, low_signal=no)
    return answers(spark, d).select("id", F.round(f, 6).alias("factor"))


@query("r13_confidence", """SELECT doc_id AS id, CAST(round(s, 4) AS DOUBLE) AS score, CASE WHEN round(s, 6) >= 0.75 THEN 'high' WHEN round(s, 6) >= 0.45 THEN 'medium' ELSE 'low' END AS label
    FROM (SELECT doc_id, CAST(0.25 AS DOUBLE) * (doc_id % 11) / 10.0 + 0.2 * (doc_id % 7) / 6.0 + 0.2 * (doc_id % 5) / 4.0 + 0.15 * quality + 0.1 * toxic + 0.1 * (doc_id % 3) / 2.0 AS s FROM labels)""")
def r13_confidence(spark, d):
    k = F.col("doc_id")
    s = S.confidence(evidence_count=(k % 11) / 10.0, evidence_diversity=(k % 7) / 6.0, graph_coverage=(k % 5) / 4.0, heuristic_reliability=F.col("quality"), signal_agreement=F.col("toxic"), repo_type_fit=(k % 3) / 2.0)
    return table(spark, d, "labels").select(k.alias("id"), F.round(s, 4).alias("score"), S.label(F.round(s, 6)).alias("label"))


# Texts.


@query("e1_text_metrics", r"""WITH l AS (SELECT doc_id, CASE WHEN s[-1] = '' THEN s[:-2] ELSE s END AS lines FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS s FROM documents))
    SELECT doc_id, len(lines) AS loc, round(CASE WHEN len(lines) > 0 THEN len(list_filter(lines, lambda x: regexp_matches(x, '^\s*(#|//|--)'))) / len(lines) ELSE 0 END, 6) AS comment_ratio FROM l""")
def e1_text_metrics(spark, d):
    return table(spark, d, "documents").select("doc_id", T.loc(F.col("text")).cast("long").alias("loc"), F.round(T.comment_ratio(F.col("text")), 6).alias("comment_ratio"))


@query("t2_keyword_score", "SELECT doc_id, ((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3 + (length(lower(text)) - length(replace(lower(text), 'tion', ''))) / 4) / 2 AS score FROM documents")
def t2_keyword_score(spark, d):
    return table(spark, d, "documents").select("doc_id", search.keyword_score(F.col("text"), "the tion a").alias("score"))


@query("t3_semantic_search", "SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'der', ''))) / 3 AS BIGINT) AS score FROM documents WHERE contains(lower(text), 'der') ORDER BY score DESC, doc_id LIMIT 25")
def t3_semantic_search(spark, d):
    return search.substring_search(table(spark, d, "documents"), F.col("text"), " Der", "doc_id").select("doc_id", "score")


KEYWORDS = "list_sort(list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z_]+'), lambda w: length(w) >= 3 AND w NOT IN (" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "))))"


@query("t4_keywords", f"SELECT item_id, array_to_string({KEYWORDS.format('text')}, ',') AS words FROM benchmark")
def t4_keywords(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(T.keywords(F.col("text")), ",").alias("words"))


@query("t5_doc_drift", f"""WITH x AS (SELECT conv_id, turn, split_part(text, '.', 1) AS doc, text AS purpose FROM conversations), k AS (SELECT *, {KEYWORDS.format('doc')} AS d, {KEYWORDS.format('purpose')} AS p FROM x),
    s AS (SELECT conv_id, turn, doc, abs(len(d) - len(p)) AS imbalance, len(list_intersect(d, p)) AS overlap,
    CAST(list_has_any(d, ['api', 'http']) AND list_has_any(p, ['sql', 'table', 'pipeline']) AS INT) + CAST(list_has_any(d, ['read', 'reader', 'ingest']) AND list_has_any(p, ['write', 'writer', 'export']) AS INT) + CAST(list_has_any(d, ['write', 'writer', 'export']) AND list_has_any(p, ['read', 'reader', 'ingest']) AS INT) AS n FROM k),
    f AS (SELECT *, trim(doc) <> '' AND (n > 0 OR (imbalance >= 4 AND overlap <= 1)) AS drift FROM s)
    SELECT conv_id, turn, drift, CASE WHEN NOT drift THEN 'none' WHEN n >= 2 THEN 'high' WHEN n > 0 OR imbalance >= 6 THEN 'medium' ELSE 'low' END AS severity FROM f""")
def t5_doc_drift(spark, d):
    x = table(spark, d, "conversations").select("conv_id", "turn", T.drift(F.split_part("text", F.lit("."), F.lit(1)), F.col("text")).alias("x"))
    return x.select("conv_id", "turn", "x.drift", "x.severity")


@query("t6_purpose", """SELECT conv_id, turn, 'This module primarily handles ' || CASE WHEN len(s) = 0 THEN 'general application or utility logic' ELSE array_to_string(s, ', ') END || '. It appears in the ' || role || ' layer and exposes key behaviors through code-defined interfaces.' AS purpose
    FROM (SELECT *, list_filter([CASE WHEN contains(lower(text), 'sql') THEN 'SQL transformation or query logic' END, CASE WHEN contains(lower(text), 'airflow') OR contains(lower(text), 'dag') THEN 'pipeline orchestration' END, CASE WHEN contains(lower(text), 'pandas') OR contains(lower(text), 'spark') THEN 'data processing' END, CASE WHEN turn > 0 THEN turn || ' public entry points' END], lambda x: x IS NOT NULL) AS s FROM conversations)""")
def t6_purpose(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.purpose(F.col("text"), F.col("role"), F.col("turn")).alias("purpose"))


_ENGLISH = ", ".join(f"'{w}'" for w in search.ENGLISH)


@query("t1_find_implementation", rf"""WITH x AS (SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({_ENGLISH})) AS w FROM documents
    UNION ALL SELECT 'q', item_id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({_ENGLISH})) FROM benchmark),
    toks AS (SELECT kind, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM x),
    t AS (SELECT kind, id, term, count(*) AS tf FROM toks GROUP BY ALL), f AS (SELECT term, count(*) AS df, sum(tf) AS total FROM t WHERE kind = 'd' GROUP BY term ORDER BY total DESC, term LIMIT 2048),
    w AS (SELECT kind, id, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1) AS w FROM t JOIN f USING (term)), n AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY kind, id)) AS x FROM w),
    s AS (SELECT q.id AS query, d.id, round(sum(q.x * d.x), 6) AS score FROM n q JOIN n d ON d.term = q.term AND d.kind = 'd' WHERE q.kind = 'q' GROUP BY ALL HAVING score > 0)
    SELECT query, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS k FROM s) WHERE k <= 20""")
def t1_find_implementation(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return search.find(docs, table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")).select("query", "id", "score")


@query("t7_domain_clusters")
def t7_domain_clusters(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return search.cluster(v, search.clusters_for(v.count()))


@query("t9_drift_flags", """SELECT path, severity FROM (SELECT lpad(CAST(conv_id AS VARCHAR), 8, '0') || '-' || lpad(CAST(turn AS VARCHAR), 4, '0') AS path,
    CASE WHEN turn % 5 = 0 THEN 'medium' WHEN turn % 5 = 1 THEN 'low' WHEN role = 'assistant' THEN 'high' END AS severity FROM conversations) WHERE severity IS NOT NULL ORDER BY path LIMIT 30""")
def t9_drift_flags(spark, d):
    c, k = table(spark, d, "conversations"), F.col("turn") % 5
    path = F.concat_ws("-", F.lpad(F.col("conv_id").cast("string"), 8, "0"), F.lpad(F.col("turn").cast("string"), 4, "0"))
    purpose = F.when(k == 0, "  ").when(k == 1, "It has general application or utility logic.").otherwise("x")
    return R.drift_flags({"modules": c.select(path.alias("path"), purpose.alias("purpose"), F.struct((F.col("role") == "assistant").alias("drift"), F.lit("high").alias("severity")).alias("drift"))})


@query("e26_commit_log", "SELECT user_id AS path, count(DISTINCT event_id) AS commit_count FROM events GROUP BY 1")
def e26_commit_log(spark, d):
    e = table(spark, d, "events").select(F.array(F.concat(F.lit(gitlog.HEADER), F.col("event_id").cast("string"), F.lit("|"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")), F.col("user_id").cast("string"), F.lit("")).alias("x"), "event_id")
    lines = e.select(F.pmod("event_id", F.lit(16)).cast("string").alias("log"), "event_id", F.posexplode("x").alias("p", "line")).select("log", (F.col("event_id") * 3 + F.col("p")).alias("line_no"), "line")
    return gitlog.velocity(gitlog.commits(lines)).select(F.col("path").cast("long").alias("path"), "commit_count")


@query("p2_node_types", f"WITH {STAR} SELECT id, CASE WHEN id LIKE 'region::%' OR contains(id, '::') THEN 'function' ELSE 'module' END AS node_type FROM star_nodes")
def p2_node_types(spark, d):
    return star_nodes(star(spark, d)).select("id", G.node_type_of(F.col("id")).alias("node_type"))


@query("p3_sql_classes", "SELECT doc_id, CASE WHEN contains(lower(text), 'merge ') THEN 'sql_merge_upsert' WHEN contains(lower(text), 'insert ') THEN 'sql_insert' WHEN contains(lower(text), 'update ') THEN 'sql_update' WHEN contains(lower(text), 'delete ') THEN 'sql_delete' WHEN regexp_matches(lower(text), 'create .*\\bas select') THEN 'sql_ctas' WHEN lang = 'en' THEN 'sql_write' ELSE 'sql_model_select' END AS class FROM documents")
def p3_sql_classes(spark, d):
    return table(spark, d, "documents").select("doc_id", T.sql_class(F.col("text"), F.col("lang") == "en").alias("class"))


@query("p8_trace_events", """SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'static_analysis' WHEN 1 THEN 'given' ELSE 'pipeline_step' END AS analysis_method, 'src/m' || turn || '.py,lib/' || role || '.sql' AS files FROM conversations""")
def p8_trace_events(spark, d):
    c, k = table(spark, d, "conversations"), F.col("turn") % 3
    file, other = F.concat(F.lit("src/m"), F.col("turn"), F.lit(".py")), F.concat(F.lit("lib/"), F.col("role"), F.lit(".sql"))
    evidence = F.to_json(F.struct(F.when(k == 1, "given").alias("analysis_method"), F.array(file, other, file).alias("at"), F.struct(file.alias("x")).alias("deep")))
    events = c.select("conv_id", "turn", F.when(k == 0, "Surveyor").otherwise("someone").alias("agent"), evidence.alias("evidence"))
    return artifacts.enriched_trace(events).select("conv_id", "turn", "analysis_method", F.array_join("source_files", ",").alias("files"))


@query("p9_clean_labels", r"""SELECT item_id, CASE WHEN length(x) <= 180 AND x <> '' THEN x END AS label FROM (SELECT item_id, trim(regexp_replace(regexp_replace(text, '[`"'']', '', 'g'), '\s+', ' ', 'g')) AS x FROM benchmark)""")
def p9_clean_labels(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.clean_label(F.col("text")).alias("label"))


@query("p1_clamped", "SELECT event_id, greatest(0.0, value) AS weight, greatest(0.0, least(1.0, value / 50)) AS ratio FROM events")
def p1_clamped(spark, d):
    return table(spark, d, "events").select("event_id", F.greatest(F.lit(0.0), "value").alias("weight"), T.clamp01(F.col("value") / 50).alias("ratio"))


@query("p15_filtered_trace", "SELECT conv_id, turn FROM conversations WHERE role = 'assistant'")
def p15_filtered_trace(spark, d):
    return R.trace_of(table(spark, d, "conversations").withColumnRenamed("role", "agent"), "assistant").select("conv_id", "turn")


@query("p14_sessions_under_root", r"SELECT page_id, url = 'http:/' OR starts_with(url, 'https://m.') AS under FROM pages WHERE url IS NOT NULL")
def p14_sessions_under_root(spark, d):
    path = F.regexp_replace("url", r"^https://m\.", "https://m/")
    return table(spark, d, "pages").where("url is not null").select("page_id", R.under(path, "https://m/").alias("under"))


@query("p4_python_class", """SELECT event_id, CASE WHEN a AND c THEN 'python_sql_etl' WHEN b AND e THEN 'python_file_transform' WHEN b AND c THEN 'python_ingestion' WHEN a AND e THEN 'python_export' WHEN c THEN 'python_table_write'
    WHEN e THEN 'python_file_write' WHEN a THEN 'python_sql_read' WHEN b THEN 'python_file_read' ELSE 'python_other' END AS class FROM (SELECT event_id, event_id % 2 = 0 AS a, event_id % 3 = 0 AS b, event_id % 5 = 0 AS c, event_id % 7 = 0 AS e FROM events)""")
def p4_python_class(spark, d):
    k = F.col("event_id")
    return table(spark, d, "events").select("event_id", T.python_class(k % 2 == 0, k % 3 == 0, k % 5 == 0, k % 7 == 0).alias("class"))


@query("p5_notebook_class", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'notebook_etl' WHEN 1 THEN 'notebook_export' WHEN 2 THEN 'notebook_ingestion' ELSE 'notebook_analysis' END AS class FROM events")
def p5_notebook_class(spark, d):
    k = F.col("event_id") % 4
    return table(spark, d, "events").select("event_id", T.notebook_class(k.isin(0, 2), k.isin(0, 1)).alias("class"))


@query("p7_deprecation", "SELECT p_partkey AS id, p_partkey % 6 IN (0, 2) AS deprecated FROM part")
def p7_deprecation(spark, d):
    k = F.col("p_partkey")
    text = F.concat(F.when(k % 3 == 0, "# Deprecated\n").when(k % 3 == 2, "# Do not import\n").otherwise("# fine\n"), F.when(k % 2 == 0, "raise ImportError(1)").otherwise("pass"))
    return table(spark, d, "part").select(k.alias("id"), T.is_deprecated(text).alias("deprecated"))


@query("r4_weak_ingestion", "SELECT p_partkey AS id, NOT (p_partkey % 3 >= 2 AND p_partkey % 5 >= 2) AS weak FROM part")
def r4_weak_ingestion(spark, d):
    k = F.col("p_partkey")
    some = lambda n, name: F.transform(F.filter(F.array(*map(F.lit, range(4))), lambda i: i < n), lambda i: F.concat(F.lit(name), i.cast("string")))
    labels = F.concat(F.array(F.lit("tmp_x"), F.lit("job")), some(k % 3, "orders_raw"))
    methods = F.concat(F.array(F.lit("python")), F.transform(some(k % 5, "m"), lambda _: F.lit("sql")))
    return table(spark, d, "part").select(k.alias("id"), S.weak_ingestion(labels, methods).alias("weak"))


@query("r9_velocity_source", "SELECT user_id AS path, count(DISTINCT event_id) AS commit_count FROM events GROUP BY 1 HAVING commit_count > 0")
def r9_velocity_source(spark, d):
    modules = commits(spark, d).union(spark.createDataFrame([(-1, 0, "")], "path long, commit_count long, last_commit string"))
    return gitlog.velocity_rows(None, modules).select("path", "commit_count")


@query("r11_strong_business", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_size > 20 AND (p_size > 30 OR p_partkey % 4 = 0) ELSE false END AS strong FROM part")
def r11_strong_business(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size")
    module = F.struct((n > 20).cast("int").alias("complexity"), (n > 30).cast("double").alias("pagerank"), (k % 4 == 0).cast("int").alias("calls"))
    dull = F.struct(F.lit(0).alias("complexity"), F.lit(0.0).alias("pagerank"), F.lit(0).alias("calls"))
    return table(spark, d, "part").select(k.alias("id"), S.strong_business(F.when(k % 2 == 0, F.array(module, dull, dull)).otherwise(F.array(dull))).alias("strong"))


@query("r19_repo_fit", """SELECT id, round(CASE WHEN p = 'sql_heavy' THEN CASE WHEN q <> 'q3_blast_radius' THEN 0.55 + 0.45 * sq ELSE 0.7 END
    WHEN p = 'python_heavy' THEN CASE WHEN q = 'q1_primary_ingestion' AND b THEN 0.85 WHEN q = 'q1_primary_ingestion' THEN 0.55 + 0.35 * py WHEN q = 'q2_critical_outputs' AND a THEN 0.8 WHEN q = 'q2_critical_outputs' THEN 0.45 + 0.35 * py ELSE 0.55 + 0.35 * py END
    ELSE 0.55 + 0.25 * greatest(sq, py) END, 6) AS factor FROM (SELECT *, ['sql_heavy', 'python_heavy', 'mixed'][1 + id % 3] AS p, (id % 4) / 4.0 AS sq, (4 - id % 4) / 4.0 AS py FROM """ + ANSWERS + ")")
def r19_repo_fit(spark, d):
    k = F.col("id")
    kind = F.element_at(F.array(*map(F.lit, ("sql_heavy", "python_heavy", "mixed"))), (k % 3 + 1).cast("int"))
    files = F.transform(F.array(*map(F.lit, range(4))), lambda i: F.when(i < k % 4, "a.SQL").otherwise("b.py"))
    return answers(spark, d).select("id", F.round(S.repo_fit(F.col("q"), kind, files, F.col("b"), F.col("a"), F.lit(False)), 6).alias("factor"))


@query("s3_language_routing", r"SELECT page_id, CASE regexp_extract(url, '[.]([a-z]+)$', 1) WHEN 'py' THEN 'python' WHEN 'sql' THEN 'sql' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'yml' THEN 'yaml' WHEN 'yaml' THEN 'yaml' WHEN 'ipynb' THEN 'notebook' ELSE 'unknown' END AS language FROM pages")
def s3_language_routing(spark, d):
    return table(spark, d, "pages").select("page_id", FS.language(F.col("url")).alias("language"))


@query("s5_graph_round_trip", f"WITH {STAR} SELECT src, dst FROM star")
def s5_graph_round_trip(spark, d):
    e = star(spark, d).withColumns({"edge_type": F.lit("CONFIGURES"), "weight": F.lit(1.0)})
    out = scratch(spark, "graph")
    graph_files.write_graph(star_nodes(e), e, out)
    return graph_files.read_graph(spark, out)[1].select("src", "dst")


@query("s7_index_round_trip", "SELECT doc_id, lang, n_chars FROM documents")
def s7_index_round_trip(spark, d):
    out = scratch(spark, "index")
    graph_files.write_lines(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), out)
    return graph_files.read_lines(spark, out, "doc_id long, lang string, n_chars long")


@query("s13_repository_names", r"SELECT page_id, regexp_extract(u, '[:/]([^/:]+)/[^/]+/?$', 1) AS owner, regexp_extract(u, '([^/:]+)/?$', 1) AS name FROM (SELECT page_id, regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '[.]git/?$', '') AS u FROM pages)")
def s13_repository_names(spark, d):
    u = F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    return table(spark, d, "pages").select("page_id", repositories.owner_column(u).alias("owner"), repositories.name_column(u).alias("name"))


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("d4_sections", "SELECT p_partkey AS path, unnest(['Part ' || p_size, 'Names']) AS title, unnest(['It is a ' || p_name || '.', '- ' || p_brand]) AS body FROM part")
def d4_sections(spark, d):
    text = F.concat(F.lit("# Title\n\n## Part "), F.col("p_size"), F.lit("\n\nIt is a "), F.col("p_name"), F.lit(".\n\n## Empty\n\n##  Names \n- "), F.col("p_brand"), F.lit("\n\n"))
    return artifacts.section_rows(table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), text.alias("text"))).withColumn("path", F.col("path").cast("long"))


@query("d5_parsed_brief", """SELECT event_id AS path, 'q1_primary_ingestion' AS question_id, 'found ' || event_type AS answer, 'high' AS confidence_label, (event_id % 100) / 100.0::DOUBLE AS confidence_score,
    '[{"line_range": [1, 2], "source_file": "' || event_type || '.sql"}]' AS evidence FROM events""")
def d5_parsed_brief(spark, d):
    k, kind = F.col("event_id"), F.col("event_type")
    text = F.concat(
        F.lit("# ONBOARDING BRIEF\n\n## Where does data come in?\n\nQuestion: q1_primary_ingestion\n\nfound "), kind, F.lit("\n\nConfidence: high ("), F.format_number((k % 100) / 100, 4),
        F.lit(")\n\nReason: none\n\nFactors: a=0.50; b=0.25\n\nEvidence:\n- {\"line_range\": [1, 2], \"source_file\": \""), kind, F.lit('.sql"}\n'),
    )
    rows = artifacts.brief_rows(table(spark, d, "events").select(k.cast("string").alias("path"), text.alias("text")))
    return rows.withColumn("path", F.col("path").cast("long"))


@query("o2_changed_files", "SELECT coalesce(n.doc_id, o.doc_id) AS path, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' ELSE 'modified' END AS change FROM (SELECT doc_id, text FROM documents WHERE doc_id % 7 <> 0) n FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE text END AS text FROM documents WHERE doc_id % 3 <> 0) o ON n.doc_id = o.doc_id WHERE n.text IS DISTINCT FROM o.text")
def o2_changed_files(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), "text")
    before = docs.where("path % 3 <> 0").select("path", F.sha2(F.when(F.col("path") % 5 == 0, F.lit("x")).otherwise(F.col("text")), 256).alias("digest"))
    return FS.changed(docs.where("path % 7 <> 0"), before)


@query("o5_read_model", f"""WITH {TRADE}, e AS (SELECT src AS id, 1 AS o, 0 AS i FROM heavy UNION ALL SELECT dst, 0, 1 FROM heavy), g AS (SELECT id, CAST(sum(i) AS BIGINT) AS i, CAST(sum(o) AS BIGINT) AS o FROM e GROUP BY id)
    SELECT 'n' || n_nationkey AS path, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree, round((coalesce(i, 0) + coalesce(o, 0)) / 24.0, 6) AS degree_centrality FROM nation LEFT JOIN g ON id = 'n' || n_nationkey""")
def o5_read_model(spark, d):
    n = F.lit(0)
    modules = nations(spark, d).select(F.col("id").alias("path"), F.lit("python").alias("language"), n.alias("complexity"), n.alias("rank"), n.alias("commit_count"), F.lit(False).alias("is_dead_code"))
    found = R.module_graph({"modules": modules, "module_edges": heavy(spark, d).withColumn("edge_type", F.lit("IMPORTS"))})
    return found.select("path", "in_degree", "out_degree", F.round("degree_centrality", 6).alias("degree_centrality"))


# Extensions.


@query("ext_rollup", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def ext_rollup(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"))


@query("ext_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def ext_cube(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("ext_asof_join", "SELECT e.event_id, p.event_id AS before FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') p ON e.user_id = p.user_id AND e.event_id > p.event_id")
def ext_asof_join(spark, d):
    e = table(spark, d, "events").where("event_type IN ('purchase', 'view')")
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    return e.withColumn("before", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w)).where("event_type = 'purchase'").select("event_id", "before")


@query("ext_range_join", "SELECT e.event_id, count(*) AS near FROM events e JOIN events f ON f.user_id = e.user_id AND f.event_id > e.event_id AND f.event_id <= e.event_id + 200 GROUP BY 1")
def ext_range_join(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id")
    w = Window.partitionBy("user_id").orderBy("event_id").rangeBetween(1, 200)
    return e.select("event_id", F.count("*").over(w).alias("near")).where("near > 0")


@query("ext_session_windows", """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts > lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def ext_session_windows(spark, d):
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.coalesce(F.col("ts") > F.lag("ts").over(w) + F.expr("INTERVAL 6 HOURS"), F.lit(True)).cast("int")
    s = e.withColumn("new", new).withColumn("k", F.sum("new").over(w))
    return s.groupBy("user_id", "k").agg(F.min("ts").alias("start"), F.count("*").alias("n")).select("user_id", "start", "n")


@query("ext_tumbling_window", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def ext_tumbling_window(spark, d):
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("ext_lag_lead_ntile", "SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after, ntile(4) OVER w AS quarter FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def ext_lag_lead_ntile(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey").over(w).alias("after"), F.ntile(4).over(w).cast("long").alias("quarter"))


@query("ext_intersect", "SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def ext_intersect(spark, d):
    o = table(spark, d, "orders")
    return o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")).intersect(o.where("o_orderstatus = 'O'").select("o_custkey"))


@query("ext_except_all", "SELECT l_suppkey AS id FROM lineitem WHERE l_returnflag = 'R' EXCEPT ALL SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A'")
def ext_except_all(spark, d):
    li = table(spark, d, "lineitem")
    return li.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("id")).exceptAll(li.where("l_returnflag = 'A'").select("l_suppkey"))


@query("ext_merge_join", "SELECT o_orderpriority, sum(l_quantity) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def ext_merge_join(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    return o.hint("merge").join(li, o["o_orderkey"] == li["l_orderkey"]).groupBy("o_orderpriority").agg(F.sum("l_quantity").alias("quantity"))


@query("ext_pricing_summary", """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_extendedprice), 4) AS avg_price, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def ext_pricing_summary(spark, d):
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(revenue, 2).alias("revenue"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.count("*").alias("n"))


from . import code_queries  # noqa: E402, F401  registers queries over a generated source tree
