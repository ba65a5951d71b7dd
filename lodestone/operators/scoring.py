"""Scores of modules and datasets, and the confidence of answers: arithmetic over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of, clamp01, execution_priority, how_many, is_abstraction, is_excluded, is_noise, is_support, is_weak_label

#: Words of labels and paths that speak for a role.
INGESTION = ("raw", "source", "ingest", "landing", "bronze", "staging", "s3", "gcs", "csv", "json", "parquet", "api", "stream", "event", "log")
OUTPUT = ("report", "dashboard", "mart", "fact", "dim", "dataset", "export", "serving")
ENTRYPOINT = ("plugin", "connector", "pipeline", "ingest", "extract", "source", "loader", "tap", "api", "client", "orchestr", "dagster", "airflow", "entrypoint", "job", "executor", "invoke")
ENTRYPOINT_BY_PROFILE = {"sql_heavy": ("dbt", "elt", "load", "staging"), "python_heavy": ("cli",)}
LOGIC = ("models", "marts", "dimensional", "reporting", "pipeline", "orchestr", "jobs", "tasks", "plugins", "connectors", "assets", "etl", "elt")
NOT_LOGIC = ("utils", "helpers")
ACTIVE = ("src/", "core/", "pipeline", "orchestr", "plugin", "block/", "runner", "invoke", "models/", "marts/", "reporting/")
ACTIVE_BY_PROFILE = {"sql_heavy": ("sql", "dbt", "staging/", "dimensional/"), "python_heavy": ("cli/", "state", "job", "extract_load")}
NOT_ACTIVE = ("docs/", "documentation/", "scripts/", ".github/", ".gitlab/", "examples/", "fixtures/", "migrations/", "alembic/", "noxfile.py", "docusaurus", "sidebars.js")
#: How far a method of analysis is trusted; others 0.55.
RELIABILITY = {"sqlglot": 0.92, "tree_sitter_python+sqlglot": 0.88, "tree_sitter_python": 0.70, "lineage_graph_sources": 0.82, "lineage_graph_sinks": 0.86, "module_graph_descendants": 0.86, "complexity_and_velocity_signals": 0.84, "git_log_frequency": 0.78, "module_entrypoint_ingestion_heuristic": 0.35}
FAMILIES = {"sqlglot": "lineage", "tree_sitter_python+sqlglot": "lineage", "tree_sitter_python": "lineage", "lineage_graph_sources": "lineage", "lineage_graph_sinks": "lineage", "module_graph_descendants": "module", "complexity_and_velocity_signals": "module", "git_log_frequency": "git"}
#: Our own names of methods, as the fixed values above know them.
OWN = {"sql": "sqlglot", "python_sql": "tree_sitter_python+sqlglot", "python": "tree_sitter_python", "python_ast": "tree_sitter_python"}
RELIABILITY |= {own: RELIABILITY[known] for own, known in OWN.items()}
FAMILIES |= {own: FAMILIES[known] for own, known in OWN.items()}
#: Methods that speak for an ingestion dataset, under either name.
STRONG_METHODS = ("sqlglot", "tree_sitter_python+sqlglot", "lineage_graph", "sql", "python_sql")
EXPECTED = {"q1_primary_ingestion": ("lineage", "heuristic"), "q2_critical_outputs": ("lineage",), "q3_blast_radius": ("module",), "q4_logic_concentration": ("module",), "q5_change_velocity": ("git",)}
WEIGHTS = {"evidence_count": 0.25, "evidence_diversity": 0.20, "graph_coverage": 0.20, "heuristic_reliability": 0.15, "signal_agreement": 0.10, "repo_type_fit": 0.10}


def _map(table: dict, key: Column, other) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[F.lower(F.trim(key))], F.lit(other))


def reliability(method: Column) -> Column:
    return _map(RELIABILITY, method, 0.55)


def family(method: Column) -> Column:
    return _map(FAMILIES, method, "heuristic")


def profile(modules: DataFrame, path: str = "path", weight: str = "loc") -> DataFrame:
    """One row (profile): sql_heavy or python_heavy from 0.6 of the weight of both on, SQL first, else mixed."""
    ext, w = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)), F.greatest(F.lit(1.0), F.coalesce(F.col(weight).cast("double"), F.lit(0.0)))
    s = modules.agg(F.sum(F.when(ext == "sql", w)).alias("s"), F.sum(F.when(ext == "py", w)).alias("p"))
    share = lambda c: F.coalesce(F.col(c), F.lit(0.0)) / F.nullif(F.coalesce("s", F.lit(0.0)) + F.coalesce("p", F.lit(0.0)), F.lit(0.0))
    return s.select(F.when(share("s") >= 0.6, "sql_heavy").when(share("p") >= 0.6, "python_heavy").otherwise("mixed").alias("profile"))


def ingestion_score(label: Column, out_degree: Column, descendants: Column) -> Column:
    return 5 * how_many(F.lower(label), INGESTION) + F.least(out_degree, F.lit(5)) + F.least(descendants, F.lit(30))


def output_score(label: Column, in_degree: Column, ancestors: Column) -> Column:
    return 4 * how_many(F.lower(label), OUTPUT) + F.least(in_degree, F.lit(10)) + F.least(ancestors, F.lit(30))


def primary_ingestion(datasets: DataFrame, limit: int) -> DataFrame:
    """datasets(id, name, in_degree, out_degree, descendants) -> the best sources, score first."""
    good = datasets.where(~is_noise(F.col("name")) & (F.col("in_degree") == 0) & (F.col("out_degree") > 0))
    return good.withColumn("score", ingestion_score(F.col("name"), F.col("out_degree"), F.col("descendants"))).orderBy(F.desc("score"), F.desc("out_degree"), F.desc("descendants"), "id").limit(limit)


def critical_outputs(datasets: DataFrame, limit: int) -> DataFrame:
    """datasets(id, name, in_degree, out_degree, ancestors) -> the best sinks, score first."""
    good = datasets.where(~is_noise(F.col("name")) & (F.col("out_degree") == 0) & (F.col("in_degree") > 0))
    return good.withColumn("score", output_score(F.col("name"), F.col("in_degree"), F.col("ancestors"))).orderBy(F.desc("score"), F.desc("in_degree"), F.desc("ancestors"), "id").limit(limit)


def entrypoint_score(path: Column, purpose: Column, pagerank: Column, calls: Column, velocity: Column, repo_profile: str = "mixed") -> Column:
    """Null for paths that are no entrypoint: excluded, support, of another language, or without a telling word."""
    words, low = ENTRYPOINT + ENTRYPOINT_BY_PROFILE.get(repo_profile, ()), F.lower(path)
    n = how_many(low, words) + how_many(F.lower(F.coalesce(purpose, F.lit(""))), words)
    score = 3.0 * n + 80.0 * pagerank + 0.5 * F.least(calls, F.lit(80)) + 0.25 * velocity + 3.0 * execution_priority(path)
    good = ~is_excluded(path) & ~is_support(path) & F.rlike(low, F.lit(r"\.(py|js|ts|java|scala)$")) & (n > 0) & (score > 0)
    return F.when(good, score)


def blast_score(path: Column, descendants: Column, complexity: Column, velocity: Column, pagerank: Column, calls: Column) -> Column:
    penalty = F.when(is_support(path), 8.0).otherwise(0.0) + F.when(is_abstraction(path), 14.0).otherwise(0.0) + F.when(is_excluded(path), 12.0).otherwise(0.0)
    return 35.0 * F.log1p(F.greatest(descendants, F.lit(0))) + 0.5 * complexity + 0.3 * velocity + 180.0 * pagerank + 0.6 * F.least(calls, F.lit(80)) + 8.0 * execution_priority(path) - penalty


def blast_module(modules: DataFrame) -> DataFrame:
    """modules(path, descendants, complexity, velocity, pagerank, calls) -> the one row whose failure would matter most.

    Only modules of the highest execution priority that there is (1 at least), if any good ones have it.
    """
    m = modules.withColumn("priority", F.when(~is_support(F.col("path")) & ~is_excluded(F.col("path")), execution_priority(F.col("path"))).otherwise(0))
    m = m.withColumn("score", blast_score(*map(F.col, ("path", "descendants", "complexity", "velocity", "pagerank", "calls"))))
    return m.orderBy(F.desc("priority"), F.desc("score"), F.desc("path")).limit(1)


def logic_location(path: Column) -> Column:
    return (how_many(F.lower(path), LOGIC) - how_many(F.lower(path), NOT_LOGIC)).cast("double")


def logic_score(path: Column, complexity: Column, velocity: Column, pagerank: Column, calls: Column) -> Column:
    return 2.0 * complexity + 0.4 * F.least(velocity, F.lit(50)) + 180.0 * pagerank + 0.6 * F.least(calls, F.lit(80)) + logic_location(path)


def activity_location(path: Column, repo_profile: str = "mixed") -> Column:
    low = F.lower(path)
    return how_many(low, ACTIVE + ACTIVE_BY_PROFILE.get(repo_profile, ())) - 1.5 * how_many(low, NOT_ACTIVE)


def onboarding_score(path: Column, commits: Column, pagerank: Column, complexity: Column, calls: Column, repo_profile: str = "mixed") -> Column:
    penalty = F.when(is_excluded(path), 10.0).otherwise(0.0) + F.when(is_support(path), 6.0).otherwise(0.0)
    known = F.coalesce(100.0 * pagerank + 0.6 * complexity + 0.35 * F.least(calls, F.lit(80)), F.lit(0.0))
    return 12.0 * F.greatest(F.lit(0), commits) + 2.5 * activity_location(path, repo_profile) + known - penalty


def velocity_priority(path: Column, velocity: Column, pagerank: Column, calls: Column, complexity: Column, repo_profile: str = "mixed") -> Column:
    return 8.0 * velocity + 120.0 * pagerank + 0.4 * F.least(calls, F.lit(80)) + 0.8 * complexity + activity_location(path, repo_profile)


def weak_ingestion(labels: Column, methods: Column) -> Column:
    """Whether the ingestion datasets (their labels, and the methods of their evidence) say little: fewer than two of either that count."""
    good = F.size(F.filter(labels, lambda x: ~is_weak_label(x)))
    strong = F.size(F.filter(methods, lambda m: m.isin(*STRONG_METHODS)))
    return (F.size(labels) == 0) | (good < 2) | (strong < 2)


def strong_business(focus: Column) -> Column:
    """Whether half of the focus modules (structs of complexity, pagerank, calls), one at least, are complex and central."""
    told = F.size(F.filter(focus, lambda m: (m["complexity"] > 0) & ((m["pagerank"] > 0) | (m["calls"] > 0))))
    return (F.size(focus) > 0) & (told >= F.greatest(F.lit(1), F.floor(F.size(focus) / 2)))


def known_datasets(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """The distinct ids(id) that are datasets with a telling name among nodes(id, node_type, name)."""
    good = nodes.where((F.col("node_type") == "dataset") & ~is_noise(F.col("name"))).select("id").distinct()
    return ids.select("id").distinct().join(good, "id", "left_semi")


def low_velocity(status: Column, active: Column, changes: Column) -> Column:
    """Whether the commit log says little about where changes happen."""
    return status.isin("shallow", "missing", "unavailable") | (active <= 1) | (changes <= F.greatest(F.lit(3), active))


def coverage_gap(affected: Column, nodes: Column, edges: Column, reaching: Column, isolated: Column) -> Column:
    """Whether no effect downstream says more about the graph than about the module."""
    sparse = (nodes <= 1) | (edges == 0) | (reaching <= F.greatest(F.lit(1), F.floor(nodes / 10))) | (isolated & (edges < F.greatest(F.lit(1), nodes - 1)))
    return (affected == 0) & sparse


# The six factors of confidence. q: question id; methods: array of analysis methods; flags: booleans of the section.


def _methods(methods: Column) -> Column:
    return F.filter(F.transform(methods, lambda m: F.lower(F.trim(m))), lambda m: m != "")


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b) / F.greatest(F.size(values), F.lit(1))


def evidence_count(q: Column, methods: Column, verified_none: Column, weak: Column, gap: Column, strong: Column, git_only: Column) -> Column:
    base = F.least(F.lit(1.0), F.aggregate(F.transform(methods, reliability), F.lit(0.0), lambda a, b: a + b) / 3.0)
    base = F.when((q == "q1_primary_ingestion") & weak, base * 0.75).when((q == "q3_blast_radius") & gap, base * 0.55).when((q == "q4_logic_concentration") & strong, F.greatest(base, F.lit(0.90))).when((q == "q5_change_velocity") & git_only, F.least(base, F.lit(0.82))).otherwise(base)
    return F.when((q == "q2_critical_outputs") & verified_none, F.lit(0.95)).when(F.size(methods) == 0, F.lit(0.0)).otherwise(clamp01(base))


def evidence_diversity(q: Column, methods: Column, verified_none: Column, gap: Column, strong: Column, git_only: Column) -> Column:
    kinds = F.array_distinct(_methods(methods))
    base = 0.6 * F.least(F.lit(1.0), F.size(kinds) / 4.0) + 0.4 * _mean(F.transform(kinds, reliability))
    base = F.when((q == "q4_logic_concentration") & strong, F.greatest(base, F.lit(0.70))).when((q == "q3_blast_radius") & gap, F.least(base, F.lit(0.30))).when((q == "q5_change_velocity") & git_only, F.least(F.greatest(base, F.lit(0.35)), F.lit(0.45))).otherwise(base)
    return F.when((q == "q2_critical_outputs") & verified_none, F.lit(0.85)).when(F.size(kinds) == 0, F.lit(0.0)).otherwise(clamp01(base))


def heuristic_reliability(q: Column, methods: Column, verified_none: Column, entrypoint: Column, gap: Column, strong: Column) -> Column:
    said = _methods(methods)
    base = F.when(F.size(said) > 0, _mean(F.transform(said, reliability))).otherwise(F.lit(0.30))
    return clamp01(
        F.when((q == "q2_critical_outputs") & verified_none, F.lit(0.90)).when((q == "q1_primary_ingestion") & entrypoint, F.least(base, F.lit(0.42)))
        .when((q == "q3_blast_radius") & gap, F.least(base, F.lit(0.20))).when((q == "q4_logic_concentration") & strong, F.greatest(base, F.lit(0.88))).otherwise(base)
    )


def signal_agreement(q: Column, methods: Column, verified_none: Column, entrypoint: Column, gap: Column) -> Column:
    said = _methods(methods)
    present = F.array_distinct(F.transform(said, family))
    expected = F.coalesce(F.create_map(*[x for k, v in EXPECTED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[q], F.array(F.lit("heuristic")))
    hit = F.size(F.array_intersect(expected, present)) / F.greatest(F.lit(1), F.size(expected))
    strong = F.size(F.filter(said, lambda m: reliability(m) >= 0.75)) / F.greatest(F.lit(1), F.size(said))
    base = 0.60 * hit + 0.40 * strong
    base = F.when((q == "q1_primary_ingestion") & entrypoint, F.least(base, F.lit(0.60))).otherwise(base)
    return F.when((q == "q2_critical_outputs") & verified_none, F.lit(0.95)).when((q == "q3_blast_radius") & gap, F.lit(0.25)).when(F.size(said) == 0, F.lit(0.20)).otherwise(clamp01(base))


def graph_coverage(q: Column, stats: dict[str, Column], entrypoint: Column, verified_none: Column, scan_complete: Column, has_module: Column, gap: Column, focus: Column, strong: Column, active_ratio: Column, status: Column, git_only: Column, low_signal: Column) -> Column:
    """How much of the code the graphs cover, seen from a question. stats: counts of nodes and edges by name."""
    s = {k: v.cast("double") for k, v in stats.items()}
    one = lambda x: F.greatest(F.lit(1.0), x)
    lineage = F.least(F.lit(1.0), s["lineage_edges"] / one(s["datasets"] + s["transformations"]))
    module = F.least(F.lit(1.0), s["module_edges"] / one(s["module_nodes"]))
    some = s["module_nodes"] > 0
    q1 = F.when(entrypoint, F.when(some, 0.55).otherwise(0.35)).when(s["datasets"] > 0, 0.55 + 0.45 * lineage).when(s["lineage_nodes"] > 0, 0.65).when(some, 0.50).otherwise(0.20)
    q2 = F.when(verified_none, 0.95).when(s["datasets"] > 0, 0.40 + 0.35 * s["sinks"] / one(s["datasets"]) + 0.25 * lineage).when(s["lineage_nodes"] > 0, 0.60).when(scan_complete, 0.75).otherwise(0.25)
    q3 = 0.25 + 0.45 * module + F.when(has_module, 0.30).otherwise(0.10)
    q3 = F.when(~some, 0.20).when(gap, F.least(q3, F.lit(0.30))).otherwise(q3)
    q4 = 0.45 + 0.35 * F.least(F.lit(1.0), focus / 5.0) + 0.20 * module
    q4 = F.when(strong, F.greatest(q4, F.lit(0.82))).otherwise(q4)
    q5 = 0.45 + 0.35 * active_ratio + 0.20 * module
    q5 = F.when(status == "shallow", F.least(q5, F.lit(0.44))).when(git_only, F.least(q5, F.lit(0.70))).otherwise(q5)
    q5 = F.when(status.isin("missing", "unavailable"), 0.22).when(low_signal | (status == "shallow"), F.least(q5, F.lit(0.58))).otherwise(q5)
    out = F.when(q == "q1_primary_ingestion", q1).when(q == "q2_critical_outputs", q2).when(q == "q3_blast_radius", q3).when(q == "q4_logic_concentration", q4).when(q == "q5_change_velocity", q5).otherwise(0.50)
    return clamp01(out)


def reason(label: Column, factors: dict[str, Column]) -> Column:
    """A sentence on a confidence: its strongest and its weakest factor (ties: the first by name)."""
    ranked = F.array_sort(F.array(*[F.struct(v.alias("v"), F.lit(k.replace("_", " ")).alias("k")) for k, v in sorted(factors.items())]))
    strongest = F.array_max(F.transform(ranked, lambda x: F.struct(x["v"].alias("v"), F.negative(F.length(x["k"])).alias("n"), x["k"].alias("k"))))
    say = lambda x: F.concat(x["k"], F.lit(" ("), F.format_number(x["v"], 2), F.lit(")"))
    return F.concat(F.initcap(label), F.lit(" confidence: strongest is "), say(strongest), F.lit(", weakest is "), say(ranked[0]), F.lit("."))


def repo_fit(q: Column, repo_profile: Column, files: Column, entrypoint: Column, verified_none: Column, operational: Column) -> Column:
    low = F.transform(files, F.lower)
    share = lambda ext: F.size(F.filter(low, lambda f: F.endswith(f, F.lit(ext)))) / F.greatest(F.lit(1), F.size(low))
    sql, py = share(".sql"), share(".py")
    by_sql = F.when(q.isin("q1_primary_ingestion", "q2_critical_outputs", "q4_logic_concentration"), 0.55 + 0.45 * sql).otherwise(0.70)
    by_py = (
        F.when((q == "q1_primary_ingestion") & entrypoint, 0.85).when(q == "q1_primary_ingestion", 0.55 + 0.35 * py)
        .when((q == "q2_critical_outputs") & verified_none, F.when(operational, 0.90).otherwise(0.80)).when(q == "q2_critical_outputs", 0.45 + 0.35 * py)
        .when(q.isin("q3_blast_radius", "q4_logic_concentration", "q5_change_velocity"), 0.55 + 0.35 * py).otherwise(0.70)
    )
    mixed = F.when(F.size(low) > 0, 0.55 + 0.25 * F.greatest(sql, py)).otherwise(0.60)
    return clamp01(F.when(repo_profile == "sql_heavy", by_sql).when(repo_profile == "python_heavy", by_py).when(repo_profile == "mixed", mixed).otherwise(0.60))


def confidence(**factors: Column) -> Column:
    return sum((F.lit(w) * factors[n] for n, w in WEIGHTS.items()), F.lit(0.0))


def git_only_cap(score: Column, status: Column, low_signal: Column, has_evidence: Column) -> Column:
    """The score of a question that only the commit log answers."""
    return F.when(status.isin("missing", "unavailable"), F.least(score, F.lit(0.40))).when((status == "shallow") | low_signal, F.least(score, F.lit(0.54))).when(has_evidence, F.greatest(F.lit(0.52), F.least(score, F.lit(0.74)))).otherwise(score)


def label(score: Column) -> Column:
    return F.when(clamp01(score) >= 0.75, "high").when(clamp01(score) >= 0.45, "medium").otherwise("low")


def mentions_operations(answer: Column) -> Column:
    return any_of(F.lower(answer), ("plugin runs", "state", "job metadata", "orchestration"))
