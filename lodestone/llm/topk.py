"""Exact top-k by inner product of integer vectors, with block-at-a-time pruning.

Vectors are sparse documents whose terms are dimensions. Candidates are dealt to groups of about GROUP rows. In a group
they are numbered anew, vectors of like direction side by side, and blocks are ranges of BLOCK rows in that order; a
block keeps its forward index (a dense matrix) and, for each dimension, its largest and smallest value. For a query, a
block's bound is the sum over dimensions of the best that these allow. A group takes a query's blocks in order of
falling bounds and scores whole blocks, until the next bound is below the query's k-th score.

Two passes over the groups, whose vectors are shuffled once in each; only queries are copied:

1. Each query meets the group it lies in. Its k-th score there is a floor for all its answers.
2. Each query meets every other group with that floor, so most blocks are passed over from the start. Groups whose own
   bound is below the floor don't even get the query: the bounds of all groups are sent to the workers as long as they
   fit in BOUNDS bytes; beyond, each group tests the bound itself.

A group reads its vectors first and then the queries, in batches, so that a task holds one group and one batch. A last
selection by rank joins the groups' answers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, picked, small_batches, stage

K, SCALE, EVERY = 20, 64, 20
#: Candidates in a group, about, and in a block; queries that a group scores at a time.
GROUP, BLOCK, QUERIES = 16_384, 128, 2_048
#: Bytes of bounds of groups that are sent to all workers at most.
BOUNDS = 16 << 20
#: Vectors with a component of this size or more are scored apart, by limbs of LIMB bits. Dimensions of a sum that is exact in floats.
LARGE, LIMB, DIMENSIONS = 1 << 20, 21, 512
_MOST, _LEAST = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """id and v = floor(scale * x) of each component; rows with a null id, vector or component, or a non-finite one, go.

    So do empty vectors. A component beyond the range of a long is the nearest long.
    """
    v = F.transform("v", lambda x: x.cast("double"))
    rows = picked(rows, id=id_col, v=vector_col).where("id is not null and v is not null and size(v) > 0")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = lambda x: F.when(x * scale >= 2.0**63, F.lit(_MOST)).when(x * scale <= -(2.0**63), F.lit(_LEAST)).otherwise(F.floor(x * scale))
    return rows.select(F.col("id").cast("long").alias("id"), v.alias("v")).where(good).select("id", F.transform("v", whole).alias("v"))


def is_large(m: np.ndarray) -> np.ndarray:
    """Rows whose products may not be exact in floating point."""
    most = LARGE if m.shape[1] <= 4 * DIMENSIONS else 0
    return ((m >= most) | (m <= -most)).any(1)


class Group:
    """Candidates of one length of vectors (64-bit integers), in blocks; those with large components apart."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, block: int = 0):
        block, large = block or BLOCK, is_large(m)
        self.large_ids, self.large = ids[large], m[large]
        ids, m = ids[~large], m[~large]
        order = np.argsort(ids, kind="stable")
        ids, m = ids[order], m[order].astype(np.float64)
        near = _like(m, max(1, len(m) // block))
        order = np.lexsort((ids, near))
        self.ids, self.m = ids[order], m[order]
        self.cut = [*range(0, len(ids), block), len(ids)] if len(ids) else [0]
        at = self.cut[:-1]
        self.high = np.maximum.reduceat(self.m, at, axis=0) if at else self.m[:0]
        self.low = np.minimum.reduceat(self.m, at, axis=0) if at else self.m[:0]

    def answers(self, qids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray | None = None):
        """Parts of (query's place, candidate's id, score as a long, exact score where that is clipped) with each query's best k.

        q: 64-bit integers. floor: scores below it are not wanted (one for each query).
        """
        large = is_large(q)
        usual, floor = np.flatnonzero(~large), np.full(len(q), _LEAST) if floor is None else floor
        at, who, score = self.search(qids[usual], q[usual].astype(np.float64), k, floor[usual])
        yield usual[at], who, score.astype(np.int64), [None] * len(at)
        ids, m = (np.concatenate(x) for x in ((self.ids, self.large_ids), (self.m.astype(np.int64), self.large)))
        for some, i, x in ((usual, self.large_ids, self.large), (np.flatnonzero(large), ids, m)):
            if len(some) and len(i):
                at, who, score, exact = search_wide(i, x, qids[some], q[some], k)
                yield some[at], who, score, exact

    def search(self, qids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, candidate's id, score) of each query's best k in the blocks, ties to smaller ids, its own id left out."""
        n = len(q)
        if not n or len(self.cut) < 2:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        best = np.full((n, k), -np.inf)
        who = np.full((n, k), _MOST)
        least = np.full(n, -np.inf) if floor is None else np.where(floor == _LEAST, -np.inf, floor.astype(np.float64))
        bound = np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T
        order = np.argsort(-bound, axis=1, kind="stable")
        active = np.arange(n)
        for step in range(bound.shape[1]):
            b = order[active, step]
            on = bound[active, b] >= np.maximum(best[active, k - 1], least[active])  # an equal score may have a smaller id
            active, b = active[on], b[on]
            if not active.size:
                break
            by = np.argsort(b, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(b[by])) + 1):
                rows, at = active[part], b[part[0]]
                lo, hi = self.cut[at], self.cut[at + 1]
                s = q[rows] @ self.m[lo:hi].T
                ids = np.broadcast_to(self.ids[lo:hi], s.shape)
                s = np.where((ids == qids[rows, None]) | (s < least[rows, None]), -np.inf, s)
                s, ids = np.concatenate([best[rows], s], 1), np.concatenate([who[rows], ids], 1)
                ids = np.where(s == -np.inf, _MOST, ids)
                top = _first(s, ids, k)
                best[rows], who[rows] = np.take_along_axis(s, top, 1), np.take_along_axis(ids, top, 1)
        r, c = np.nonzero(best > -np.inf)
        return r, who[r, c], best[r, c]


def wide_scores(m: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact products of 64-bit integers, as digits: top * 2**84 + middle * 2**21 + low, where the last two are not negative."""
    mask = (1 << LIMB) - 1

    def limbs(x):
        return [y.astype(np.float64) for y in (x & mask, (x >> LIMB) & mask, x >> (2 * LIMB))]

    sums = [np.zeros((len(q), len(m)), np.int64) for _ in range(5)]
    for a in range(0, m.shape[1], DIMENSIONS):
        left, right = limbs(q[:, a : a + DIMENSIONS]), limbs(m[:, a : a + DIMENSIONS])
        for i in range(3):
            for j in range(3):
                sums[i + j] += (left[i] @ right[j].T).astype(np.int64)
    for i in range(4):
        sums[i + 1] += sums[i] >> LIMB
        sums[i] &= mask
    return sums[4], (sums[3] << (2 * LIMB)) | (sums[2] << LIMB) | sums[1], sums[0]


def search_wide(ids: np.ndarray, m: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes | None]]:
    """Like Group.search() of all candidates one after another, with exact products of any size."""
    none = -(1 << 62)
    best = [np.full((len(q), 0), x, np.int64) for x in (0, 0, 0, 0)]  # top, middle, low, id
    for a in range(0, len(ids), 1024):
        new = [*wide_scores(m[a : a + 1024], q), np.broadcast_to(ids[a : a + 1024], (len(q), len(ids[a : a + 1024])))]
        new[0] = np.where(new[3] == qids[:, None], none, new[0])
        best = [np.concatenate(x, 1) for x in zip(best, new)]
        order = np.lexsort((best[3], -best[2], -best[1], -best[0]), axis=1)[:, :k]
        best = [np.take_along_axis(x, order, 1) for x in best]
    r, c = np.nonzero(best[0] > none)
    exact = [(int(t) << 84) + (int(x) << 21) + int(y) for t, x, y in zip(*(b[r, c].tolist() for b in best[:3]))]
    score = np.array([min(max(x, _LEAST), _MOST) for x in exact], np.int64)
    return r, best[3][r, c], score, [None if _LEAST < x < _MOST else (x + (1 << 159)).to_bytes(20) for x in exact]


def _first(s: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first of each row by falling score, then rising id."""
    kth = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
    width = int((s >= kth).sum(1).max())
    if width <= max(2 * k, 64):  # few ties: sort only those
        some = np.argpartition(-s, min(width, s.shape[1]) - 1, axis=1)[:, :width]
        inner = np.lexsort((np.take_along_axis(ids, some, 1), -np.take_along_axis(s, some, 1)), axis=1)[:, :k]
        return np.take_along_axis(some, inner, 1)
    return np.lexsort((ids, -s), axis=1)[:, :k]


def _like(m: np.ndarray, parts: int) -> np.ndarray:
    """A number for each vector, alike for vectors of like direction: halving by the widest dimension, again and again."""
    out = np.zeros(len(m), np.int64)
    todo = [np.arange(len(m))]
    for _ in range(max(0, math.ceil(math.log2(parts)))):
        after = []
        for rows in todo:
            x = m[rows]
            d = int(np.argmax(x.max(0) - x.min(0))) if len(rows) else 0
            by = rows[np.argsort(x[:, d], kind="stable")]
            after += [by[: len(by) // 2], by[len(by) // 2 :]]
        todo = after
    for number, rows in enumerate(todo):
        out[rows] = number
    return out


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(n, -1) if n else np.empty((0, 0), np.int64)


#: Rows that groups get: their cell, whether they ask, id, vector and floor (null: none).
_CELLS = "cell long, asks boolean, id long, v array<long>, floor long"
_ANSWERS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("exact", pa.binary())])
_ANSWER = "query_id long, vec_id long, score long, exact binary"


def _runs(batches, key: int) -> Iterator[pa.RecordBatch]:
    """Batches cut where the key changes."""
    for b in batches:
        k = b.column(key).to_numpy(zero_copy_only=False)
        edge = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        yield from (b.slice(x, y - x) for x, y in zip(edge, edge[1:]) if y > x)


def _search_batches(k: int):
    def run(batches):
        cell, group, held = None, None, []
        for b in _runs(batches, 0):
            if b.column(0)[0].as_py() != cell:
                cell, group, held = b.column(0)[0].as_py(), None, []
            asks = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            ids, m = b.column(2).to_numpy(), _matrix(b.column(3), b.num_rows)
            if not asks.all():  # a cell's candidates come first
                held.append((ids[~asks], m[~asks]))
            ids, m, floor = ids[asks], m[asks], b.column(4).fill_null(_LEAST).to_numpy()[asks]
            if not len(ids) or not held:
                continue
            group = group or Group(*(np.concatenate(x) for x in zip(*held)))
            for a in range(0, len(ids), QUERIES):
                part = slice(a, a + QUERIES)
                for at, who, score, exact in group.answers(ids[part], m[part], k, floor[part]):
                    yield batch(_ANSWERS, ids[part][at], who, score, exact)

    return run


def _bound_batches(batches):
    """Largest and smallest component by dimension of each cell's candidates."""
    schema = pa.schema([("cell", pa.int64()), ("n", pa.int32()), ("high", pa.list_(pa.int64())), ("low", pa.list_(pa.int64()))])
    cell, high, low = None, None, None
    for b in _runs(batches, 0):
        m = _matrix(b.column(1), b.num_rows)
        if b.column(0)[0].as_py() != cell:
            if cell is not None:
                yield batch(schema, [cell], [len(high)], [high.tolist()], [low.tolist()])
            cell, high, low = b.column(0)[0].as_py(), m.max(0), m.min(0)
        else:
            high, low = np.maximum(high, m.max(0)), np.minimum(low, m.min(0))
    if cell is not None:
        yield batch(schema, [cell], [len(high)], [high.tolist()], [low.tolist()])


def _ask_batches(bounds):
    """Queries id, v, cell, floor -> a row for each other cell of their length whose bound reaches the floor."""
    schema = pa.schema([("cell", pa.int64()), ("asks", pa.bool_()), ("id", pa.int64()), ("v", pa.list_(pa.int64())), ("floor", pa.int64())])

    def run(batches):
        cells, high, low = bounds.value
        cells, high, low = np.array(cells), high.astype(np.float64).T, low.astype(np.float64).T
        size = np.maximum(np.abs(high), np.abs(low))
        for b in batches:
            ids, home, floor = b.column(0).to_numpy(), b.column(2).to_numpy(), b.column(3).fill_null(_LEAST).to_numpy()
            whole = _matrix(b.column(1), b.num_rows)
            q = whole.astype(np.float64)
            best = np.maximum(q, 0) @ high + np.minimum(q, 0) @ low + 1 + 1e-9 * (np.abs(q) @ size)  # never too low
            on = (cells[None, :] != home[:, None]) & ((best >= floor[:, None].astype(np.float64)) | (floor[:, None] == _LEAST))
            r, c = np.nonzero(on)
            for a in range(0, len(r), 5000):
                some = r[a : a + 5000]
                v = pa.ListArray.from_arrays(pa.array(np.arange(0, whole.shape[1] * len(some) + 1, whole.shape[1]), pa.int32()), pa.array(whole[some].reshape(-1)))
                yield batch(schema, cells[c[a : a + 5000]], np.ones(len(some), bool), ids[some], v, pa.array(floor[some], mask=floor[some] == _LEAST))

    return run


def _ranked(answers: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("exact"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def top_k(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k candidates of the largest integer inner products.

    Queries are the rows whose id is divisible by `every`; candidates are all rows but those with the query's own id.
    Ties go to the smaller id. Vectors of another length than a query's are no candidates for it. Repeated rows count
    once; an id with several different vectors is a candidate (and a query) with each of them. Ranks follow the exact
    products of any finite vectors; a score beyond the range of a long is shown as the nearest long.
    """
    spark = rows.sparkSession
    small_batches(spark, 10_000)
    v = integer_vectors(rows, id_col, vector_col, scale).distinct().withColumn("n", F.size("v"))
    v = stage(spark, v, "vectors")
    groups = {r["n"]: max(1, -(-r["count"] // GROUP)) for r in v.groupBy("n").count().collect()}  # a number for each length of vectors
    answers = spark.createDataFrame([], _ANSWER)
    for n, many in groups.items():
        share = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(many)).cast("long")
        mine = v.where(F.col("n") == n).select("id", "v", share.alias("cell"))
        none, yes = F.lit(None).cast("long"), F.lit(True)
        given = mine.select("cell", F.lit(False).alias("asks"), "id", "v", none.alias("floor"))
        asked = mine.where(F.col("id") % every == 0).select("cell", yes.alias("asks"), "id", "v", none.alias("floor"))

        def search(asks: DataFrame, given: DataFrame = given) -> DataFrame:
            dealt = given.unionByName(asks).repartition("cell").sortWithinPartitions("cell", "asks")
            return dealt.mapInArrow(_search_batches(k), _ANSWER)

        first = _ranked(search(asked), k).drop("rank")
        if many > 1:
            first = stage(spark, first, "answers")
            floors = first.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("found"), F.min("score").alias("least"))
            floor = F.when((F.col("found") == k) & (F.col("least") > _LEAST), F.col("least"))
            asked = asked.drop("floor").join(floors, "id", "left").select("id", "v", "cell", floor.alias("floor"))
            if many * n * 16 <= BOUNDS:
                cells = mine.select("cell", "v").repartition("cell").sortWithinPartitions("cell").mapInArrow(_bound_batches, "cell long, n int, high array<long>, low array<long>").collect()
                known = spark.sparkContext.broadcast(([r["cell"] for r in cells], np.array([r["high"] for r in cells], np.int64), np.array([r["low"] for r in cells], np.int64)))
                asks = asked.mapInArrow(_ask_batches(known), _CELLS)
            else:
                other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long")))
                asks = asked.withColumnRenamed("cell", "home").select("*", other.alias("cell")).where("cell <> home").select("cell", yes.alias("asks"), "id", "v", "floor")
            first = first.union(search(asks))
        answers = answers.union(first)
    return _ranked(answers, k).select("query_id", "rank", "vec_id", "score")
