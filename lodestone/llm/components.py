"""Connected components of links between integer ids, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, unstage


def _mark(e: DataFrame):
    return e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"))


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(u, v) links of longs -> (id, component_id) for each linked id, with the smallest id of its component.

    Each round is two aggregations and joins on narrow rows; minima are combined before the shuffle,
    and the joins leave a hub's rows to be split as skew. Rounds are staged, so no lineage builds up.
    Ids in no link and self links give no row; an empty input gives an empty result.
    """
    e = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e = stage(spark, e, "links")
    last = _mark(e).first()
    while last["n"]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("x"))
        after = stage(spark, small.select("x.u", "x.v").where("u <> v").distinct(), "links")
        unstage(spark, e)
        e, now = after, _mark(after).first()
        if now == last:
            break
        last = now
    star = e.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return star.union(roots)
