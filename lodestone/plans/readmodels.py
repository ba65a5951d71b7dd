"""Read models over the tables of an analysis: what a client shows. Each gives a DataFrame; and the store of sessions."""

from __future__ import annotations

import hashlib
import json
import time
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import search
from ..sources.repositories import metadata

MOST_SESSIONS = 25


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """One row of counts: modules, public functions, datasets, transformations, edges, dead code."""
    m = tables["modules"].agg(F.count("*").alias("modules"), F.coalesce(F.sum(F.size("public_functions")), F.lit(0)).alias("public_functions"), F.count_if("is_dead_code").alias("dead_code"))
    n = tables["nodes"].agg(F.count_if(F.col("node_type") == "dataset").alias("datasets"), F.count_if(F.col("node_type") == "transformation").alias("transformations"))
    e = tables["edges"].agg(F.count("*").alias("lineage_edges"))
    k = F.lit(0).alias("k")
    return m.select("*", k).join(n.select("*", k), "k").join(e.select("*", k), "k").drop("k")


def hubs(tables: dict[str, DataFrame], k: int = 8) -> DataFrame:
    return tables["modules"].select("path", "rank").orderBy(F.desc("rank"), "path").limit(k)


def module_graph(tables: dict[str, DataFrame]) -> DataFrame:
    """Modules with degree centrality over imports, most central first."""
    m, e = tables["modules"], tables["module_edges"].where("edge_type = 'IMPORTS'")
    d = G.degrees(m.select(F.col("path").alias("id")), e).withColumnRenamed("id", "path")
    return m.select("path", "language", "complexity", "rank", "commit_count", "is_dead_code").join(d, "path").orderBy(F.desc("degree_centrality"), "path")


def lineage_graph(tables: dict[str, DataFrame]) -> DataFrame:
    """Nodes with how many others they reach and are reached by."""
    n, e = tables["nodes"], tables["edges"]
    up = G.descendants(G.reverse(e), n).withColumnRenamed("descendants", "upstream")
    down = G.descendants(e, n).withColumnRenamed("descendants", "downstream")
    return n.select("id", "name", "node_type").join(up, "id").join(down, "id")


def _folder() -> Column:
    return F.coalesce(F.nullif(T.folder(F.col("path")), F.lit("")), F.lit("."))


def domains(tables: dict[str, DataFrame], k: int = 20) -> DataFrame:
    """Domains by number of modules: named clusters where the analysis made any, else folders."""
    m = tables["modules"]
    name = F.coalesce("domain", _folder()) if "domain" in m.columns else _folder()
    return m.groupBy(name.alias("domain")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(k)


def dominant_folders(modules: DataFrame, k: int = 5) -> DataFrame:
    """(folder, n): the folders of most modules, without the root."""
    return modules.groupBy(T.folder(F.col("path")).alias("folder")).agg(F.count("*").alias("n")).where("folder <> ''").orderBy(F.desc("n"), "folder").limit(k)


def type_counts(nodes: DataFrame) -> DataFrame:
    """(kind, n) of transformations by their type; a blank type is unknown."""
    kind = F.coalesce(F.nullif(F.trim("transformation_type"), F.lit("")), F.lit("unknown"))
    return nodes.where("node_type = 'transformation'").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts of a lineage graph: nodes, edges, datasets, sinks."""
    ends = G.sources_and_sinks(nodes, edges).join(nodes.select("id", "node_type"), "id")
    n = ends.agg(F.count("*").alias("nodes"), F.count_if(F.col("node_type") == "dataset").alias("datasets"), F.count_if("is_sink").alias("sinks"))
    k = F.lit(0).alias("k")
    return n.select("*", k).join(edges.agg(F.count("*").alias("edges")).select("*", k), "k").select("nodes", "edges", "datasets", "sinks")


def trace_of(events: DataFrame, agent: str = "all") -> DataFrame:
    """The events of an agent, or of all."""
    return events if agent == "all" else events.where(F.col("agent") == agent)


def recent(rows: DataFrame, key: str, at: str, k: int = MOST_SESSIONS) -> DataFrame:
    """The k keys of latest time: (key, last)."""
    return rows.groupBy(key).agg(F.max(at).alias("last")).orderBy(F.desc("last"), key).limit(k)


def under(path: Column, root: str) -> Column:
    """Whether a path is a folder or lies under it."""
    top = root.rstrip("/")
    return (path == top) | F.startswith(path, F.lit(top + "/"))


def drift_flags(tables: dict[str, DataFrame], k: int = 30) -> DataFrame:
    """(path, severity): modules without a purpose (medium) or with a general one (low), and drifted docstrings."""
    general = F.contains("purpose", F.lit("general application or utility logic"))
    flag = F.when(F.trim("purpose") == "", "medium").when(general, "low").when(F.col("drift.drift"), F.col("drift.severity"))
    return tables["modules"].select("path", flag.alias("severity")).where("severity is not null").orderBy("path").limit(k)


def find_text(tables: dict[str, DataFrame], query: str) -> DataFrame:
    m = tables["modules"]
    return search.substring_search(m.select("path", "purpose"), F.concat_ws(" ", m["path"], m["purpose"], F.array_join(m["public_functions"], " ")), query) if not query.strip() else search.substring_search(m.withColumn("hay", F.concat_ws(" ", "path", "purpose", F.array_join("public_functions", " "))), F.col("hay"), query).select("path", "purpose", "score")


def node_details(tables: dict[str, DataFrame], node: str) -> DataFrame:
    """The neighbours of a node of either graph."""
    return G.neighbours(tables["edges"].select("src", "dst").union(tables["module_edges"].select("src", "dst")), node).orderBy("direction", "id")


def semantic_index(tables: dict[str, DataFrame]) -> DataFrame:
    """What a semantic index holds of each module."""
    return tables["modules"].select("path", "language", "purpose", "public_functions", "complexity", "rank", (F.coalesce("domain", _folder()) if "domain" in tables["modules"].columns else _folder()).alias("domain"))


class Sessions:
    """Repositories that were analysed, in a JSON file: the latest first, MOST_SESSIONS at most, one of them active."""

    def __init__(self, path: str | Path):
        self.path = Path(path)

    def _load(self) -> dict:
        try:
            return json.loads(self.path.read_text())
        except (OSError, ValueError):
            return {"active_repo_id": "", "sessions": []}

    def register(self, repo: str | Path, artifacts: str | Path, at: float | None = None) -> dict:
        repo_id = hashlib.sha1(str(Path(repo).resolve()).encode()).hexdigest()[:12]
        files = sorted(p for p in Path(artifacts).glob("*") if p.is_file()) if Path(artifacts).is_dir() else []
        row = {"repo_id": repo_id, "path": str(repo), **metadata(repo), "last_analysis_epoch": at or time.time(), "artifacts": [{"name": p.name, "exists": True, "size_bytes": p.stat().st_size} for p in files]}
        kept = sorted([row, *(s for s in self._load()["sessions"] if s["repo_id"] != repo_id)], key=lambda s: -s["last_analysis_epoch"])[:MOST_SESSIONS]
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.path.write_text(json.dumps({"active_repo_id": repo_id, "sessions": kept}, indent=2))
        return row

    def list(self, root: str | Path | None = None) -> list[dict]:
        rows = self._load()["sessions"]
        return [s for s in rows if root is None or Path(s["path"]).resolve().is_relative_to(Path(root).resolve())]

    def active(self) -> dict | None:
        state = self._load()
        return next((s for s in state["sessions"] if s["repo_id"] == state["active_repo_id"]), state["sessions"][0] if state["sessions"] else None)

    def select(self, repo_id: str) -> dict:
        state = self._load()
        row = next((s for s in state["sessions"] if s["repo_id"] == repo_id), None)
        if row is None:
            raise ValueError(f"no session {repo_id!r}")
        self.path.write_text(json.dumps(state | {"active_repo_id": repo_id}, indent=2))
        return row
