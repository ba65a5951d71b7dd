"""Token ids in Parquet files: one row for each document, in id order.

The ids are a list column, delta-encoded (bit-packed: about 17 bits for an id of a vocabulary of 50,000), in row
groups and pages of set sizes with column and offset indexes, so that a reader can take metadata without token pages, or
the pages of some documents only. Each row names its file (part) and its place there (pos).
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch, picked, small_batches
from .tokens import encoder

#: Bytes of a row group and of a page, and rows of a page at most.
ROW_GROUP, PAGE, PAGE_ROWS = 32 << 20, 1 << 18, 2_000
SCHEMA = "id long, part int, pos long, n_tokens long, tokens array<int>"


def _encode_batches(path: str, end_id: int):
    schema = pa.schema([("id", pa.int64()), ("part", pa.int32()), ("pos", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.list_(pa.int32()))])

    def run(batches):
        encode, end, part, pos = encoder(path), end_id.to_bytes(4, "little"), TaskContext.get().partitionId(), 0
        for b in batches:
            ids = [encode(x) + end for x in b.column(1).fill_null("").to_pylist()]
            n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            yield batch(schema, b.column(0), np.full(len(n), part), np.arange(pos, pos + len(n)), n, tokens)
            pos += len(n)

    return run


def range_of(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are at most the value (null: none), found among groups of cuts and then in one group."""
    if not cuts:
        return F.lit(0)
    width = math.isqrt(len(cuts) - 1) + 1
    groups = [cuts[k : k + width] for k in range(0, len(cuts), width)]
    many = lambda xs: F.coalesce(F.size(F.filter(xs, lambda c: c <= value)), F.lit(0))
    group = many(F.array(*[F.lit(g[0]).cast("long") for g in groups]))
    inside = many(F.element_at(F.array(*[F.array(*[F.lit(c).cast("long") for c in g]) for g in groups]), F.greatest(group, F.lit(1))))
    return F.when(value.isNull() | (group < 1), 0).otherwise((group - 1) * width + inside)


def write_tokens(docs: DataFrame, out: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes each text (null: empty), appends end_id, and writes the files in ascending id order.

    Rows are dealt by ranges of the id before they are encoded, so only texts are shuffled, once; the ranges' ends come
    from a scan of the ids alone (one number for each shuffle partition). Null ids come first; repeated ids stay
    together, in the order of their texts. An empty table gives a file without rows.
    """
    spark = docs.sparkSession
    small_batches(spark, 500)
    rows = picked(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / parts for k in range(1, parts)]
    cuts = (rows.agg(F.percentile_approx("id", shares, 100 * parts)).first()[0] if shares else None) or []
    rows = rows.repartitionById(parts, range_of(F.col("id"), cuts).cast("int")).sortWithinPartitions("id", "text")
    made = rows.mapInArrow(_encode_batches(path, end_id), SCHEMA)
    (
        made.write.option("compression", "none")  # packed ids hardly shrink
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.block.size", str(ROW_GROUP))
        .option("parquet.page.size", str(PAGE))
        .option("parquet.page.row.count.limit", str(PAGE_ROWS))
        .parquet(out)
    )


def read_tokens(spark: SparkSession, out: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """id, part, pos, n_tokens, tokens of the ids from `first` to `last` (both included; null ids only without bounds).

    Columns that are not selected are not read. Of the others, row groups and pages outside the bounds are skipped by
    their statistics and indexes, as files are in id order.
    """
    rows = spark.read.schema(SCHEMA).parquet(out)
    if first is not None:
        rows = rows.where(F.col("id") >= first)
    return rows if last is None else rows.where(F.col("id") <= last)


def starts(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds start: the number of ids of all rows before.

    Sums of whole files come first (from the n_tokens column of the stored rows, without their ids), then a running
    sum in each file.
    """
    files = stored.groupBy("part").agg(F.sum("n_tokens").alias("in_file"))
    files = files.withColumn("before", F.sum("in_file").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    in_file = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    here = rows.withColumn("start", F.coalesce(F.sum("n_tokens").over(in_file), F.lit(0)))
    return here.join(files.select("part", F.coalesce("before", F.lit(0)).alias("before")), "part").withColumn("start", F.col("start") + F.col("before")).drop("before")


def _crc_batches(batches):
    schema = pa.schema([("id", pa.int64()), ("part", pa.int32()), ("pos", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for b in batches:
        tokens = b.column(3)
        at = np.asarray(tokens.offsets)
        data = memoryview(np.asarray(tokens.values, dtype="<i4")).cast("B") if len(tokens.values) else b""
        crc = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(at.tolist(), at[1:].tolist())]
        yield batch(schema, b.column(0), b.column(1), b.column(2), np.diff(at).astype(np.int64), crc)


def checksums(rows: DataFrame) -> DataFrame:
    """read_tokens() rows -> id, part, pos, n_tokens (of the ids read) and ids_crc32 (over them as unsigned 32-bit)."""
    small_batches(rows.sparkSession, 500)
    return rows.select("id", "part", "pos", "tokens").mapInArrow(_crc_batches, "id long, part int, pos long, n_tokens long, ids_crc32 long")
