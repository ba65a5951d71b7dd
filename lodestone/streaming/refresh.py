"""Keeps extracted facts up to date as source files arrive: each batch replaces the facts of the files it brings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from ..sources import files as FS

FILES = "path string, text string"


def watch(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of rows (path, text) from JSON lines files that name sources and bring their texts."""
    return spark.readStream.schema(FILES).json(folder)


def keep_latest(held: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The files of `held` with those of `batch` over them; a null text removes a file."""
    last = batch.groupBy("path").agg(F.max("text").alias("text"), F.count("text").alias("there"))
    kept = last.where("there > 0").select("path", "text")
    return kept if held is None else held.join(last, "path", "left_anti").unionByName(kept)


def run(stream: DataFrame, apply: Callable[[DataFrame, DataFrame], None], checkpoint: str):
    """Starts a query that, for each batch, calls apply(all files, changes since the batch before)."""
    held: list[DataFrame] = []

    def batch(rows: DataFrame, _: int) -> None:
        before = held[0] if held else rows.sparkSession.createDataFrame([], FILES)
        now = cut(keep_latest(before, rows))
        digests = before.select("path", F.sha2("text", 256).alias("digest"))
        apply(now, FS.changed(now, digests))
        held[:] = [now]

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
