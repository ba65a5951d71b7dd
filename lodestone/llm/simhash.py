"""SimHash near-duplicate groups, searched with sharded BK-trees.

Fingerprints are made in one pass over the texts. Equal fingerprints collapse to one row (the
smallest id stands for them). Shards bring together all fingerprints that can be within the radius:
the 64 bits are cut into `blocks` pieces, and two fingerprints that differ in `radius` bits agree on
`blocks - radius` whole pieces, so each choice of that many pieces gives one shard key. In a shard a
BK-tree holds the fingerprints: children keyed by their integer Hamming distance to the parent; a
search follows only the edges within the radius of the distance just measured. The trees lie where
their shard's rows lie and go to no driver: broadcasting every tree would need a bound on the number
of documents, which there is none. A shard of more than SHARD_ROWS rows is cut into pieces, and each
pair of pieces makes a tree of its own, so the memory of a task is bounded and no link is lost.

A task returns a spanning forest of a shard's links, never all pairs; components() joins the forests.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, bit_filter, grouped, hex64, picked, release, small_batches, stage, unstage, utf8, values
from .components import components

WORDS, RADIUS, SEED = 4, 4, 42
#: A shard with more rows is cut into pieces of about this size.
SHARD_ROWS = 8192
#: Bytes of shingle sets in such a piece.
SHARD_BYTES = 16 << 20
#: Rows that a task holds at once, besides one shard.
HELD_ROWS = 100_000
#: (query, node) pairs that a search holds at once.
FRONTIER = 1 << 20
#: For the pipeline's rule: minima in a shard key, shard keys, bins of the sketch.
BAND_ROWS, BANDS, BINS = 2, 6, 128
#: Similarity that sketches must show for a pair to be compared in full: six standard errors below the rule's 0.8.
LOOSE = 0.6
#: Bits within which distinct shingles' fingerprints are near enough for that without a look at the sketches: unrelated ones differ in 32, with a standard deviation of 4.
NEAR = 20

_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1).astype(np.int64)
_CHUNK = 1 << 20


def shingle_digests(text: bytes, words: int) -> bytes:
    """Big-endian XXH64 of each shingle, one after the other; an item of fewer words is one shingle, no word none."""
    found = text.translate(_FOLD).split()
    if not found:
        return b""
    digest = xxhash.xxh64_digest
    if len(found) <= words:
        return digest(b" ".join(found), SEED)
    line = b" ".join(found)
    ends = (np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) + np.arange(len(found))).tolist()
    starts = [0, *(e + 1 for e in ends[:-words])]
    return b"".join([digest(line[a:b], SEED) for a, b in zip(starts, ends[words - 1 :])])


def fingerprints(digests: list[bytes]) -> np.ndarray:
    """A bit is 1 if more than half of the item's hashes have it; an item without hashes gets 0."""
    n = np.fromiter(map(len, digests), np.int64, len(digests)) // 8
    ones = np.zeros((len(digests), 64), np.int64)
    lanes = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8)
    owner = np.repeat(np.arange(len(digests)), n)
    for a in range(0, len(lanes), _CHUNK):
        part, own = lanes[a : a + _CHUNK], owner[a : a + _CHUNK]
        first, width = own[0], own[-1] - own[0] + 1
        base = (own - first) * 256
        for k in range(8):
            seen = np.bincount(base + part[:, k], minlength=width * 256).reshape(width, 256)
            ones[first : first + width, 8 * k : 8 * k + 8] += seen @ _BITS
    return np.packbits(ones * 2 > n[:, None], axis=1).view(">u8").reshape(-1).astype(np.uint64)


def _fingerprint_batches(words: int):
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b in batches:
            ids, texts = b.column(0), list(values(b.column(1)))
            out, at, size = [], 0, 0
            digests: list[bytes] = []
            for t in texts:
                digests.append(shingle_digests(t, words))
                size += len(digests[-1])
                if size > 8 * _CHUNK:
                    out.append(fingerprints(digests))
                    digests, size = [], 0
            if digests:
                out.append(fingerprints(digests))
            yield batch(schema, ids, np.concatenate(out).view(np.int64) if out else [])

    return run


class Forest:
    """BK-trees of many shards at once, built and searched level by level.

    group and fp are sorted by group. Node numbers are positions; a child's number is above its parent's.
    """

    def __init__(self, group: np.ndarray, fp: np.ndarray):
        self.fp, n = fp, len(fp)
        new = np.ones(n, bool)
        new[1:] = group[1:] != group[:-1]
        self.root = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # (children, their parents), from the roots down
        self.met: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (item, ancestor, distance)
        pending, at, keys, kids = np.flatnonzero(~new), self.root[~new], [], []
        while pending.size:
            d = np.bitwise_count(fp[pending] ^ fp[at]).astype(np.int64)
            self.met.append((pending, at, d))
            key = at * 65 + d
            order = np.argsort(key, kind="stable")
            k, items = key[order], pending[order]
            first = np.ones(len(k), bool)
            first[1:] = k[1:] != k[:-1]
            child = items[first]
            keys.append(k[first])
            kids.append(child)
            self.levels.append((child, k[first] // 65))
            heir = child[np.cumsum(first) - 1]
            pending, at = items[~first], heir[~first]
        keys, kids = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (keys, kids))
        order = np.argsort(keys)
        self.keys, self.kids = keys[order], kids[order]

    def settled(self, label: np.ndarray) -> np.ndarray:
        """Nodes below which, the node included, all carry one label."""
        low, high = label.copy(), label.copy()
        for child, parent in reversed(self.levels):
            np.minimum.at(low, parent, low[child])
            np.maximum.at(high, parent, high[child])
        return low == high

    def links(self, radius: int, same=None) -> np.ndarray:
        """For each item the least position that links within its shard reach. same(a, b): a further test of pairs."""
        n = len(self.fp)
        label = np.arange(n)

        def join(a, b):
            nonlocal label
            if same is not None and a.size:
                ok = same(a, b)
                a, b = a[ok], b[ok]
            label = merged(label, a, b)

        for item, above, d in self.met:
            near = d <= radius
            join(item[near], above[near])
        self.met = []
        if not self.levels:
            return label
        step = 4096
        for q0 in range(0, n, step):
            done = self.settled(label)
            q = np.arange(q0, min(n, q0 + step))
            q = q[self.root[q] != q]
            stack = [(q, self.root[q])]
            while stack:
                q, node = stack.pop()
                if len(q) > FRONTIER:
                    half = len(q) // 2
                    stack += [(q[:half], node[:half]), (q[half:], node[half:])]
                    continue
                keep = ~(done[node] & (label[node] == label[q]))
                q, node = q[keep], node[keep]
                if not q.size:
                    continue
                d = np.bitwise_count(self.fp[q] ^ self.fp[node]).astype(np.int64)
                near = (d <= radius) & (label[node] != label[q])
                if near.any():
                    join(q[near], node[near])
                a = np.searchsorted(self.keys, node * 65 + np.maximum(0, d - radius), "left")
                b = np.searchsorted(self.keys, node * 65 + np.minimum(64, d + radius), "right")
                many = b - a
                some = many > 0
                q, a, many = q[some], a[some], many[some]
                for lo, hi in _slices(many):
                    m = many[lo:hi]
                    at = np.arange(m.sum()) + np.repeat(a[lo:hi] - np.cumsum(m) + m, m)
                    qq, kid = np.repeat(q[lo:hi], m), self.kids[at]
                    earlier = kid < qq  # later items look for this one themselves
                    if earlier.any():
                        stack.append((qq[earlier], kid[earlier]))
        return label


def _slices(many: np.ndarray):
    """Runs of rows that expand to about FRONTIER pairs each."""
    if not many.size:
        return
    total = np.cumsum(many)
    cuts = np.unique(np.concatenate([[0], np.searchsorted(total, np.arange(FRONTIER, total[-1], FRONTIER)), [len(many)]]))
    yield from zip(cuts[:-1].tolist(), cuts[1:].tolist())


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after links a-b: each item has the least label that it can reach."""
    label = label.copy()
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further


def _forest_batches(radius: int, sketched: bool):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        for b in grouped(batches, 0, HELD_ROWS):
            key, fp, rep = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            same = None
            if sketched:
                data, at = utf8(b.column(3))
                sketch = np.frombuffer(data[at[0] : at[-1]], np.uint8).reshape(-1, BINS)
                same = functools.partial(near_or_similar, fp.view(np.uint64), sketch)
            label = Forest(key, fp.view(np.uint64)).links(radius, same)
            linked = np.flatnonzero(label != np.arange(len(label)))
            yield batch(schema, rep[linked], rep[label[linked]])

    return run


def cells(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """rows(shard, ...) -> rows(cell, ...): a shard is a cell, a large one a cell for each pair of its pieces.

    Where rows have a size in bytes, a shard of more than SHARD_BYTES is large too.
    """
    share = F.count("*") / SHARD_ROWS
    if "size" in rows.columns:
        share = F.greatest(share, F.sum(F.col("size").cast("long")) / SHARD_BYTES)
    large = rows.groupBy("shard").agg(F.ceil(share).cast("int").alias("pieces")).where("pieces > 1")
    rest = [c for c in rows.columns if c != "shard"]
    if large.isEmpty():
        return rows.select(F.col("shard").alias("cell"), *rest)
    mine, other = F.pmod(F.xxhash64("fp", "shard"), F.col("pieces")).cast("int"), F.sequence(F.lit(0), F.col("pieces") - 1)
    pairs = F.transform(other, lambda o: F.xxhash64("shard", F.least(o, mine), F.greatest(o, mine)))
    cut = F.when(F.col("pieces").isNull(), F.array("shard")).otherwise(pairs)
    return rows.join(large, "shard", "left").select(F.explode(cut).alias("cell"), *rest)


def forest_links(spark: SparkSession, rows: DataFrame, radius: int, sketched: bool = False) -> DataFrame:
    """rows(shard, fp, rep[, sketch]) -> links (u, v) between reps that span each shard's links."""
    columns = ["cell", "fp", "rep", *(["sketch"] if sketched else [])]
    dealt = cells(spark, rows).select(*columns).repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(_forest_batches(radius, sketched), "u long, v long").distinct()


def block_masks(blocks: int, radius: int) -> list[int]:
    """Masks of blocks - radius whole pieces; two fingerprints within the radius agree under one of them at least."""
    edge = [64 * k // blocks for k in range(blocks + 1)]
    piece = [((1 << (b - a)) - 1) << a for a, b in zip(edge, edge[1:])]
    return [sum(c) for c in itertools.combinations(piece, blocks - radius)]


def blocks_for(n: int, radius: int) -> int:
    """The fewest pieces for which a shard of evenly spread fingerprints has 64 rows at most (12 pieces at most)."""
    for blocks in range(radius + 1, 12):
        if n <= 64 << (64 * (blocks - radius) // blocks):
            return blocks
    return 12


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id (the smallest id that links reach) of each row of docs.

    A-Z are lower-cased; words are runs of bytes other than ASCII white space; shingles of `words` words,
    repeats included. A null or empty text, or one without words, has fingerprint zero and is linked like any
    other. Repeated rows each give a row; a row with a null id keeps it, stands for no group and gets the
    component of its fingerprint's group (null if all its rows have null ids). Empty tables give empty results.
    """
    spark = docs.sparkSession
    small_batches(spark)
    made = picked(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    made = stage(spark, made.mapInArrow(_fingerprint_batches(words), "id long, fp long"), "fingerprints")
    reps = stage(spark, made.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep")), "distinct")
    masks = block_masks(blocks_for(reps.count(), radius), radius)
    shards = F.explode(F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for t, m in enumerate(masks)]))
    links = forest_links(spark, reps.select(shards.alias("shard"), "fp", "rep"), radius)
    found = reps.join(components(spark, links), reps["rep"] == F.col("id"), "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    return made.join(found, "fp", "left").select(F.col("id").alias(id_col), hex64(F.col("fp")).alias("fingerprint"), "component_id")


# The pipeline's rule: Jaccard similarity of the sets of shingles at or above a threshold. Two texts as
# similar as 0.8 differ in about 10 of 64 bits, more than whole pieces can shard, and no number of bits bounds
# them: the trees are searched with a radius of all 64, on fingerprints of distinct shingles. Pairs within NEAR bits
# are compared in full, the others if their sketches ask for it, so no link is lost by its bits. There the
# shard keys are minima of the shingle hashes under several hash functions (two at a time, six times: a pair
# at 0.8 shares one with probability 0.998), and hits beyond NEAR bits are tested loosely on a sketch of 128 bins.
# Texts that loose links connect are then compared by their full sets of shingles, and only that makes a link.

_A = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) & (2**64 - 1) for k in range(1, BAND_ROWS * BANDS + 1)], np.uint64) | np.uint64(1)


def sketches(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Shard keys (items x BANDS) and sketches (items x BINS): the byte 0 is an empty bin, else the bin's least hash."""
    keys = np.zeros((len(digests), BANDS), np.int64)
    sketch = np.zeros((len(digests), BINS), np.uint8)
    for k, d in enumerate(digests):
        if not d:
            continue
        h = np.frombuffer(d, ">u8").astype(np.uint64)
        low = np.array([_mix(h * a).min() for a in _A], np.uint64).reshape(BANDS, BAND_ROWS)
        with np.errstate(over="ignore"):
            keys[k] = _mix(low[:, 0] * np.uint64(31) + low[:, 1] + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
        m = _mix(h)
        bins = (m >> np.uint64(57)).astype(np.int64)
        least = np.full(BINS, 2**64 - 1, np.uint64)
        np.minimum.at(least, bins, m & np.uint64((1 << 57) - 1))
        sketch[k] = np.where(least == 2**64 - 1, 0, _mix(least) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    return keys, sketch


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def similar(sketch: np.ndarray, a: np.ndarray, b: np.ndarray, least: float = LOOSE) -> np.ndarray:
    """Whether the similarity that two sketches show, less chance hits of a byte, is `least` or more."""
    out = np.empty(len(a), bool)
    for k in range(0, len(a), 1 << 16):
        x, y = sketch[a[k : k + (1 << 16)]], sketch[b[k : k + (1 << 16)]]
        used = ((x > 0) | (y > 0)).sum(1)
        hit = ((x == y) & (x > 0)).sum(1)
        share = hit / np.maximum(used, 1)
        out[k : k + (1 << 16)] = (share - 1 / 255) / (1 - 1 / 255) >= least - 1e-9
    return out


def near_or_similar(fp: np.ndarray, sketch: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs to compare in full: fingerprints within NEAR bits, or sketches that show LOOSE. Neither takes a pair from the other."""
    near = np.bitwise_count(fp[a] ^ fp[b]) <= NEAR
    far = np.flatnonzero(~near)
    near[far] = similar(sketch, a[far], b[far])
    return near


def exact_labels(sets: list[np.ndarray]) -> np.ndarray:
    """For each set of hashes the least position that links of similarity 0.8 or more reach."""
    label, size = np.arange(len(sets)), np.array([len(x) for x in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    sets = np.split(codes, np.cumsum(size)[:-1])
    mark = np.zeros(len(codes), bool)
    for x in range(len(sets) - 1):
        if label.max() == label.min():
            break
        rest = x + 1 + np.flatnonzero(label[x + 1 :] != label[x])
        rest = rest[5 * np.minimum(size[rest], size[x]) >= 4 * np.maximum(size[rest], size[x])]
        if not rest.size:
            continue
        mark[sets[x]] = True
        both = np.array([np.count_nonzero(mark[sets[y]]) for y in rest])
        mark[sets[x]] = False
        near = rest[5 * both >= 4 * (size[x] + size[rest] - both)]
        label = merged(label, np.full(len(near), x), near)
    return label


def _exact_batches(batches):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    for b in grouped(batches, 0, 1):
        cell, rep = (b.column(k).to_numpy(zero_copy_only=False) for k in range(2))
        sets = [np.frombuffer(x, np.uint64) for x in values(b.column(2))]
        edge = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
        label = np.concatenate([lo + exact_labels(sets[lo:hi]) for lo, hi in zip(edge, edge[1:])])
        linked = np.flatnonzero(label != np.arange(len(label)))
        yield batch(schema, rep[linked], rep[label[linked]])


def exact_links(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """rows(shard, fp, rep, size, shingles) -> links (u, v) that span each shard's pairs at 0.8 or more."""
    dealt = cells(spark, rows).select("cell", "rep", "shingles").repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(_exact_batches, "u long, v long").distinct()


def _sets(column: pa.Array, words: int) -> tuple[list[bytes], list[bytes], np.ndarray]:
    """Of each text the set of its shingles' hashes, big-endian and as numbers, and a key of that set."""
    distinct = [np.unique(np.frombuffer(shingle_digests(t, words), ">u8")) for t in values(column)]
    sets = [x.astype(np.uint64).tobytes() for x in distinct]
    return [x.tobytes() for x in distinct], sets, np.array([xxhash.xxh64_intdigest(x, 7) for x in sets], np.uint64).view(np.int64)


def _near_batches(words: int):
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64()), ("text_key", pa.int64()), ("keys", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def run(batches):
        for b in batches:
            digests, _, texts = _sets(b.column(1), words)
            keys, sketch = sketches(digests)
            offsets = pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32())
            prints = fingerprints(digests).view(np.int64) if digests else []
            yield batch(schema, b.column(0), prints, texts, pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1))), [x.tobytes() for x in sketch])

    return run


def _set_batches(words: int, passes):
    """Rows id, text, hash of the id -> rep, text_key, size and shingles of those that the filter lets through."""
    schema = pa.schema([("rep", pa.int64()), ("text_key", pa.int64()), ("size", pa.int32()), ("shingles", pa.binary())])

    def run(batches):
        let = passes.value
        for b in batches:
            b = b.filter(pa.array(let(b.column(2).to_numpy().view(np.uint64))))
            _, sets, texts = _sets(b.column(1), words)
            yield batch(schema, b.column(0), texts, [len(x) for x in sets], sets)

    return run


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """id and component_id: groups of rows whose sets of word shingles have a similarity of 0.8 or more.

    Texts without words (null, empty, white space) form one group. A row with a null id is in no group: its
    component_id is null. Texts whose sets of shingles are equal stand as one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = picked(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long")).where("id is not null")
    made = stage(spark, docs.mapInArrow(_near_batches(words), "id long, fp long, text_key long, keys array<long>, sketch binary"), "sketches")
    reps = stage(spark, made.groupBy("text_key").agg(F.min("id").alias("rep")), "distinct")
    first = made.withColumnRenamed("id", "rep")
    full = first.join(reps, ["rep", "text_key"], "left_semi").dropDuplicates(["rep", "text_key"])
    loose = components(spark, forest_links(spark, full.select(F.explode("keys").alias("shard"), "fp", "rep", "sketch"), 64, sketched=True))
    loose = stage(spark, reps.join(loose, reps["rep"] == loose["id"]).select("rep", "text_key", F.col("component_id").alias("shard")), "loose")
    release(spark)
    passes = spark.sparkContext.broadcast(bit_filter(loose.select(F.xxhash64("rep").alias("print"))))  # whole sets only of what is loosely linked
    sets = docs.withColumn("print", F.xxhash64("id")).mapInArrow(_set_batches(words, passes), "rep long, text_key long, size int, shingles binary")
    alike = sets.join(loose.hint("merge"), ["rep", "text_key"])  # grows with the corpus: no broadcast
    alike = stage(spark, alike.select("shard", F.col("text_key").alias("fp"), "rep", "size", "shingles").dropDuplicates(["rep", "fp"]), "alike")
    release(spark)
    joined = components(spark, exact_links(spark, alike))
    unstage(spark, alike, loose)
    found = reps.join(joined, reps["rep"] == F.col("id"), "left").select("text_key", F.coalesce("component_id", "rep").alias("component_id"))
    return made.select("id", "text_key").join(found, "text_key").select(F.col("id").alias(id_col), "component_id")
