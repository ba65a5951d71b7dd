"""What the operators share: staging in the cluster's folder, Arrow columns as bytes, blobs."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Rows of one Arrow batch: with texts of a few KB a batch is a few MB.
ARROW_ROWS = 1000
#: Bytes of one Arrow batch, so that a run of very long texts is cut into more batches.
ARROW_BYTES = 16 << 20
#: Bits of a filter: so many for each hash, but between these bounds (16 MB at most).
BITS_EACH, LEAST_BITS, FILTER_BITS = 256, 1 << 16, 1 << 27


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BOUNDS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS, size: int = ARROW_BYTES) -> None:
    """Bounds the Arrow batches that Python workers get, in rows and in bytes: lower bounds that are set already stay.

    Plans run after the operator has returned, so the bounds hold for the session; they never change results.
    """
    for key, most in zip(_BOUNDS, (rows, size)):
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


@contextlib.contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Smaller batches for what runs inside."""
    before = spark.conf.get(_BOUNDS[1])
    small_batches(spark, size=size)
    try:
        yield
    finally:
        spark.conf.set(_BOUNDS[1], before)


def trim() -> None:
    """Gives memory that a worker has freed back to the machine, where the C library can."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where the session names none, a temporary folder of this process, if everything runs on this machine.
    """
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_made: dict[str, SparkSession] = {}


@atexit.register
def _tidy() -> None:
    """Deletes what is left of the folders that this process made."""
    for path, spark in [*_made.items()]:
        with contextlib.suppress(Exception):  # the JVM may have gone before
            remove(spark, path)


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def stage(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Writes df in the shared folder and reads it back: cuts lineage and keeps work that later steps reuse.

    What a returned plan still reads stays until the process ends.
    """
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(spark: SparkSession, *staged: DataFrame) -> None:
    """Deletes what stage() wrote, when nothing will read it again."""
    for df in staged:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            remove(spark, folder)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are done with: it does when the driver's garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
    _made.pop(path, None)


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the names that the operator uses; others, clashing or not, stay behind."""
    return df.select(*[df[name].alias(new) for new, name in columns.items()])


def carried(df: DataFrame, names: list[str] | None) -> tuple[list[Column], pa.Schema, str]:
    """Columns that travel with the rows through Python, as c0, c1, ...: to select, and their Arrow and DDL schemas."""
    names = names or []
    kinds = [df.schema[n].dataType for n in names]
    columns = [df[n].alias(f"c{k}") for k, n in enumerate(names)]
    return columns, pa.schema([(f"c{k}", to_arrow_type(t)) for k, t in enumerate(kinds)]), "".join(f", c{k} {t.simpleString()}" for k, t in enumerate(kinds))


def renamed(df: DataFrame, names: list[str] | None, **others: str) -> DataFrame:
    """Gives carried columns their names back; one that has the name of a result column is called <name>_in."""
    names = names or []
    results = {others.get(c, c) for c in df.columns[: len(df.columns) - len(names)]}
    back = {}
    for k, n in enumerate(names):
        while n in results:
            n += "_in"
        results.add(n)
        back[f"c{k}"] = n
    return df.withColumnsRenamed(others | back)


def utf8(column: pa.Array) -> tuple[memoryview, list[int]]:
    """The bytes of a string or binary column (null: empty), and the offsets of its values."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return memoryview(data) if data is not None else memoryview(b""), at.tolist()


def values(column: pa.Array) -> Iterator[bytes]:
    data, at = utf8(column)
    for a, b in zip(at, at[1:]):
        yield bytes(data[a:b])


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def grouped(batches: Iterable[pa.RecordBatch], key: int, least: int) -> Iterator[pa.RecordBatch]:
    """Cuts sorted batches at changes of the key column into pieces of at least `least` rows.

    A piece holds whole groups, so memory is bounded by `least` rows, a batch and the largest group.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < least:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(k, k[-1], "left"))  # the last group may go on in the next batch
        if cut or (len(held) > 1 and held[-2].column(key)[-1].as_py() != k[-1]):
            done = [*held[:-1], b.slice(0, cut)]
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
            held, rows = [b.slice(cut)], b.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class Filter:
    """Bits of a set of hashes; lets every one of them through, and few others."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.last = bits, np.uint64(8 * len(bits) - 1)

    def __call__(self, found: np.ndarray) -> np.ndarray:
        def one(x):
            return (self.bits[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8)) & 1

        ok = one(found & self.last).astype(bool)
        ok[ok] = one((found[ok] >> np.uint64(32)) & self.last).astype(bool)
        return ok


def bit_filter(hashes: DataFrame) -> Filter:
    """hashes(print) -> their filter. At most FILTER_BITS / 32768 rows of 4 KB come to the driver, whatever their number."""
    n = hashes.count()
    size = LEAST_BITS
    while size < min(FILTER_BITS, BITS_EACH * n):
        size *= 2
    places = F.array(*[F.lit(size - 1).bitwiseAND(x) for x in (F.col("print"), F.shiftrightunsigned("print", 32))])
    at = hashes.select(F.explode(places).alias("x")).select((F.col("x") + 1).alias("x"))
    made = at.groupBy(F.bitmap_bucket_number("x").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
    bits = np.zeros(size // 8, np.uint8)
    for r in made.collect():
        a = (r["n"] - 1) * 4096
        bits[a : a + 4096] = np.frombuffer(r["bits"], np.uint8)[: len(bits) - a]
    return Filter(bits)


def pack_ints(a: np.ndarray) -> bytes:
    """A compressed array: byte planes apart, so that sorted or small numbers shrink."""
    import zstandard

    head = np.dtype(a.dtype).str.encode()
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T
    return bytes([len(head)]) + head + len(a).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack_ints(b: bytes) -> np.ndarray:
    import zstandard

    n = b[0]
    kind, size = np.dtype(bytes(b[1 : n + 1]).decode()), int.from_bytes(b[n + 1 : n + 9], "little")
    raw = zstandard.ZstdDecompressor().decompress(b[n + 9 :], max_output_size=max(1, size * kind.itemsize))
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, size).T).reshape(-1).view(kind)


def hex64(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))
