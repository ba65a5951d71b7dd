"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Lengths are integers up to the capacity, so documents sorted by length, and gaps sorted by size, form at most
`capacity` runs of equal keys each, whatever the number of documents. The packing goes in supersteps over runs
from the longest down: a run of documents meets the sorted gaps in a successor sweep (the smallest gap that
holds the length, then the next), rank in the run decides which document gets which gap, the gaps shrink, and
the next run follows; documents that no gap holds open new sequences. The sweeps work on counts (bounded by
the capacity, not by the data); ranks and places of documents are computed where their rows lie.
"""

from __future__ import annotations

import bisect
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, picked, small_batches, stage
from .tokens import encoder

CAPACITY, END_ID = 4096, 1
#: Distinct pieces of text that a worker keeps: it may have other work to do besides.
PIECES = 600_000


def _piece_batches(path: str, capacity: int, end_id: int):
    schema = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64())])

    def run(batches):
        encode, end, task = encoder(path, PIECES), end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).fill_null("").to_pylist()):
                ids = encode(text) + end
                n = len(ids) // 4
                for k, s in enumerate(range(0, n, capacity)):
                    m = min(capacity, n - s)
                    rows.append((i, k, s, m, zlib.crc32(ids[4 * s : 4 * (s + m)]), task, seen[m]))
                    seen[m] += 1
            yield batch(schema, *(zip(*rows) if rows else [[]] * len(schema)))

    return run


def plan(counts: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """counts of documents by length -> their places, by runs.

    Each place: documents of `length` from rank `rank` on, `each` of them side by side in a sequence from
    `offset` on, sequence by sequence from `sequence` on. Sorted by length and rank.
    """
    sizes: list[int] = []  # the sizes of gaps, sorted
    gaps: dict[int, deque] = {}  # size -> runs of sequences (first, number)
    places, opened = [], 0

    def put(size: int, first: int, number: int) -> None:
        if size and number:
            if size not in gaps:
                gaps[size] = deque()
                bisect.insort(sizes, size)
            gaps[size].append((first, number))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect.bisect_left(sizes, length)
            if k < len(sizes):
                size = sizes[k]
                first, number = gaps[size].popleft()
                if not gaps[size]:
                    del gaps[size]
                    sizes.pop(k)
            else:
                each = capacity // length
                size, first, number = capacity, opened, -(-left // each)
                opened += number
            each = size // length
            full, rest = divmod(left, each)
            if full >= number:
                full, rest = number, 0
            used = full * each + rest
            places.append((length, rank, first, each, capacity - size))
            put(size - each * length, first, full)
            if rest:
                put(size - rest * length, first + full, 1)
            put(size, first + full + bool(rest), number - full - bool(rest))
            left, rank = left - used, rank + used
    places.sort()
    return {n: np.array(x, np.int64) for n, x in zip(("length", "rank", "sequence", "each", "offset"), zip(*places) if places else [[]] * 5)}


def _place_batches(p: dict[str, np.ndarray]):
    schema = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches):
        key = (p["length"] << 48) | p["rank"]
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            k = np.searchsorted(key, (length << 48) | rank, "right") - 1
            nth = rank - p["rank"][k]
            yield batch(schema, *[b.column(i) for i in range(5)], p["sequence"][k] + nth // p["each"][k], p["offset"][k] + nth % p["each"][k] * length)

    return run


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids (null: empty) and end_id; only documents above the capacity are cut, into
    pieces of the capacity and a last, shorter one. Repeated rows and rows with a null id are packed like others;
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = picked(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    pieces = stage(spark, rows.mapInArrow(_piece_batches(path, capacity, end_id), "id long, piece int, start long, length long, ids_crc32 long, task int, nth long"), "pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = by_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row for each length at most
    ranked = pieces.join(before, ["task", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.coalesce("before", F.lit(0))).alias("rank"))
    return ranked.mapInArrow(_place_batches(plan(counts, capacity)), "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("id", id_col)
