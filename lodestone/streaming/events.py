"""Windows over event streams. Times are cast to timestamps, as watermarks need them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, folder: str, files_at_once: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder, with the event time in `at`."""
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).parquet(folder)
    return rows.withColumn("at", F.col("ts").cast("timestamp"))


def windows(rows: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) of tumbling windows, sliding ones with `slide`; rows later than `late` are left out."""
    w = F.window("at", length, slide) if slide else F.window("at", length)
    g = rows.withWatermark("at", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(rows: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n) of runs of a user's events without a pause of `gap`."""
    g = rows.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(rows: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Rows without repeats of an event within the watermark."""
    return rows.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])
