"""Commit logs as rows, and how often and how lately files change."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEADER = "__COMMIT__"


def capture(repo: str, days: int = 90) -> tuple[str, str]:
    """(status, log): missing, unavailable, shallow or complete; the log of the last days with the files of each commit."""
    def git(*a: str) -> subprocess.CompletedProcess:
        return subprocess.run(["git", "-C", repo, *a], capture_output=True, text=True, check=False)

    try:
        if git("rev-parse", "--git-dir").returncode:
            return "missing", ""
        shallow = git("rev-parse", "--is-shallow-repository").stdout.strip() == "true"
        log = git("log", f"--since={days if days > 0 else 90} days ago", "--name-only", f"--pretty=format:{HEADER}%H|%cI")
    except OSError:
        return "unavailable", ""
    return ("unavailable", "") if log.returncode else ("shallow" if shallow else "complete", log.stdout)


def lines(spark: SparkSession, log: str) -> DataFrame:
    """(log, line_no, line) of a captured log's text."""
    return spark.createDataFrame([("log", log)], "log string, text string").select("log", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def commits(rows: DataFrame) -> DataFrame:
    """(hash, committed_at, path) from numbered lines: a header holds for the paths below it. Repeats in a commit count once."""
    w = Window.partitionBy("log").orderBy("line_no")
    head = F.when(F.startswith("line", F.lit(HEADER)), F.substring("line", len(HEADER) + 1, 10_000))
    held = rows.withColumn("head", F.last(head, ignorenulls=True).over(w)).where(~F.startswith("line", F.lit(HEADER)) & (F.trim("line") != "") & F.col("head").isNotNull())
    return held.select(F.split_part("head", F.lit("|"), F.lit(1)).alias("hash"), F.split_part("head", F.lit("|"), F.lit(2)).alias("committed_at"), F.trim("line").alias("path")).distinct()


def velocity(rows: DataFrame) -> DataFrame:
    """(path, commit_count, last_commit): commits of each file, and the latest time as an instant (as text if none parses)."""
    at = F.try_to_timestamp("committed_at")
    g = rows.groupBy("path").agg(F.count_distinct("hash").alias("commit_count"), F.max_by("committed_at", at).alias("by_time"), F.max("committed_at").alias("by_text"))
    return g.select("path", "commit_count", F.coalesce("by_time", "by_text").alias("last_commit"))


def velocity_rows(snapshot: DataFrame | None, modules: DataFrame) -> DataFrame:
    """(path, commit_count, last_commit) of what changed: the snapshot's rows if there is one, else the modules' own counts."""
    rows = snapshot if snapshot is not None else modules
    return rows.where("commit_count > 0").select("path", "commit_count", "last_commit")


def with_velocity(modules: DataFrame, velocity: DataFrame) -> DataFrame:
    """Modules with the commits of their path: none, and no last one, where the log has none."""
    found = modules.join(velocity, "path", "left")
    return found.withColumns({"commit_count": F.coalesce("commit_count", F.lit(0)), "last_commit": F.coalesce("last_commit", F.lit(""))})


def ranked(counts: DataFrame, path: str = "path", count: str = "commit_count") -> DataFrame:
    """Adds velocity_rank (by falling count, then path) and is_core: the smallest head that has a fifth of the files and
    four fifths of the commits. No core if nothing was committed.

    Ranks are global, so they are made from one row for each distinct count, and within counts.
    """
    by_count = counts.groupBy(count).agg(F.count("*").alias("same"))
    up = Window.orderBy(F.desc(count)).rowsBetween(Window.unboundedPreceding, -1)
    before = by_count.withColumns({"rank_before": F.coalesce(F.sum("same").over(up), F.lit(0)), "sum_before": F.coalesce(F.sum(F.col("same") * F.col(count)).over(up), F.lit(0))})
    total = counts.agg(F.count("*").alias("n"), F.coalesce(F.sum(count), F.lit(0)).alias("total")).first()
    least = max(1, -(-total["n"] // 5))
    within = F.row_number().over(Window.partitionBy(count).orderBy(path))
    out = counts.withColumn("nth", within).join(before, count)
    rank, done = F.col("rank_before") + F.col("nth"), F.col("sum_before") + (F.col("nth") - 1) * F.col(count)
    core = (F.lit(total["total"]) > 0) & ~((rank - 1 >= least) & (done >= 0.8 * total["total"]))
    return out.withColumns({"velocity_rank": rank, "is_core": core}).drop("nth", "same", "rank_before", "sum_before")
