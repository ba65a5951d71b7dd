"""Benchmark decontamination by winnowing.

Both sides keep, of each window of consecutive k-gram hashes, the least (ties: all of them). With k-grams of
K words and windows of SPAN - K + 1 of them, two texts that share SPAN words share a kept hash. Items of fewer words
than SPAN are one window: their fingerprint is the hash of all their words.

1. The benchmark's fingerprints are made and staged; a bit filter of a bounded size is built of them.
2. One pass over the documents keeps each text's fingerprints that the filter lets through, with their places. Most
   texts have none, and go no further.
3. The fingerprints left are joined with the benchmark's, which gives pairs of a text and an item.
4. Texts with pairs meet their items one after another. Each hit is extended to the windows of SPAN words that hold it,
   and a window counts if the item has the same words. That is linear in both texts, however repetitive they are.

Only the filter is sent to all workers; neither side's texts or fingerprints go to the driver.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  for pa.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, bit_filter, carried, picked, renamed, small_batches, stage, utf8

SPAN, K = 13, 7
_rng = np.random.default_rng(20240229)
_CODE = _rng.integers(0, 2**64, 256, np.uint64, endpoint=False)
_STEP, _NEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_MOST = np.uint64(2**64 - 1)
#: Bytes of words: digits, letters (A-Z folded) and all above ASCII; the others are 0.
FOLD = np.array([b if b >= 128 or 48 <= b < 58 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 0 for b in range(256)], np.uint8)
_ANY = FOLD.tobytes()


def words_of(text: bytes) -> list[bytes]:
    return [w for w in text.translate(_ANY).split(b"\0") if w]


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _NEXT
        return (x ^ (x >> np.uint64(29))) * _STEP


class Words:
    """The words of several texts: hashes, places, and the first word of each text (with the total at the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.folded = FOLD[data]
        inside = self.folded > 0
        before = np.zeros(len(inside), bool)
        before[1:] = inside[:-1]
        cuts = offsets[(offsets > 0) & (offsets < len(inside))]
        before[cuts] = False  # words don't go on in the next text
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(len(inside), bool)
        after[:-1] = ~inside[1:] | (~before[1:] & inside[1:])
        if len(inside):
            after[-1] = True
        self.end = np.flatnonzero(inside & after) + 1
        self.first = np.searchsorted(self.start, offsets)
        at = np.flatnonzero(inside)
        lengths = self.end - self.start
        power = np.cumprod(np.full(max(1, int(lengths.max(initial=1))), _STEP, np.uint64))
        with np.errstate(over="ignore"):
            value = _CODE[self.folded[at]] * power[at - np.repeat(self.start, lengths)]
        begin = np.cumsum(lengths) - lengths
        self.hash = _mix(np.add.reduceat(value, begin)) if len(begin) else np.empty(0, np.uint64)

    def word(self, k: int) -> bytes:
        return self.folded[self.start[k] : self.end[k]].tobytes()

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; the largest number where the text ends before."""
        n = len(self.hash)
        out = np.full(n, _MOST, np.uint64)
        if n < k:
            return out
        with np.errstate(over="ignore"):
            h = self.hash[: n - k + 1].copy()
            for j in range(1, k):
                h = h * _STEP + self.hash[j : n - k + 1 + j]
        h = np.minimum(_mix(h), _MOST - np.uint64(1))
        last = np.repeat(self.first[1:], np.diff(self.first)) - k  # the last start in each word's text
        out[: n - k + 1] = np.where(np.arange(n - k + 1) <= last[: n - k + 1], h, _MOST)
        return out

    def kept(self, grams: np.ndarray, window: int) -> np.ndarray:
        """Places whose hash is the least of a window that lies in one text."""
        n = len(grams)
        if n < window:
            return np.empty(0, np.int64)
        low = np.lib.stride_tricks.sliding_window_view(grams, window)
        least, full = low[:, 0].copy(), grams[window - 1 :] != _MOST
        for j in range(1, window):
            np.minimum(least, low[:, j], out=least)
        owner = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        full &= owner[: n - window + 1] == owner[window - 1 :]
        chosen = np.zeros(n, bool)
        for j in range(window):
            chosen[j : j + n - window + 1] |= full & (grams[j : j + n - window + 1] == least)
        return np.flatnonzero(chosen)


def _named(hashes: np.ndarray, words: int) -> np.ndarray:
    """Fingerprints: hashes of whole short items of so many words (0: kept k-gram hashes) apart from others."""
    with np.errstate(over="ignore"):
        return _mix(hashes ^ (np.uint64(words) * _STEP))


def prints(w: Words, span: int, k: int, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, place of its first word) of kept k-gram hashes and of all runs of `lengths` words, in any order."""
    grams = w.grams(k)
    at = w.kept(grams, span - k + 1)
    found, places = [_named(grams[at], 0)], [at]
    for m in lengths:
        grams = w.grams(m)
        at = np.flatnonzero(grams != _MOST)
        found.append(_named(grams[at], m))
        places.append(at)
    return np.concatenate(found), np.concatenate(places)


def _words(column: pa.Array) -> Words:
    data, at = utf8(column)
    return Words(np.frombuffer(data[at[0] : at[-1]], np.uint8), np.array(at, np.int64) - at[0])


def union(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _item_batches(span: int, k: int):
    schema = pa.schema([("item", pa.string()), ("words", pa.int32()), ("print", pa.int64())])

    def run(batches):
        for b in batches:
            names, words, found = [], [], []
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = text.encode()
                w = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                n = len(w.hash)
                if n:
                    short = n if n < span else 0
                    mine = _named(w.grams(n)[:1], n) if short else np.unique(prints(w, span, k, [])[0])
                    names += [name] * len(mine)
                    words += [short] * len(mine)
                    found.append(mine)
            yield batch(schema, names, words, np.concatenate(found).view(np.int64) if found else [])

    return run


def _find_batches(passes, lengths: list[int], span: int, k: int, others: pa.Schema):
    """Rows id, text, others... -> key, id, n_words, and of texts with hits the text, fingerprints and places."""
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("n_words", pa.int64()), ("text", pa.string()), ("prints", pa.list_(pa.int64())), ("places", pa.list_(pa.int64())), *others])

    def run(batches):
        let, key = passes.value, TaskContext.get().partitionId() << 40
        for b in batches:
            w = _words(b.column(1))
            found, at = prints(w, span, k, lengths)
            ok = let(found)
            found, at = found[ok].view(np.int64), at[ok]
            owner = np.searchsorted(w.first, at, "right") - 1
            order = np.argsort(owner, kind="stable")
            cut = np.searchsorted(owner[order], np.arange(b.num_rows + 1))
            lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x[order], pa.int64())) for x in (found, at - w.first[owner])]
            text = b.column(1).cast(pa.string())
            text = pa.compute.if_else(pa.array(np.diff(cut) > 0), text, pa.scalar(None, pa.string()))
            yield batch(schema, np.arange(key, key + b.num_rows), b.column(0), np.diff(w.first), text, *lists, *b.columns[2:])
            key += b.num_rows

    return run


class Text:
    """A text's windows of words that hold a hit: by their words, with the places where they start."""

    def __init__(self, text: str, found: list[int], places: list[int], span: int, k: int):
        self.words, self.span, self.hit, self.items = words_of(text.encode()), span, set(), set()
        self.starts: dict[int, set[int]] = defaultdict(set)
        n = len(self.words)
        for p in places:  # a hit may be one of k words or of a short item's; both are tried
            self.starts[span].update(range(max(0, p + k - span), min(p, n - span) + 1))
        self.places, self.windows = places, {}

    def at(self, m: int) -> dict[bytes, list[int]]:
        if m not in self.windows:
            made: dict[bytes, list[int]] = defaultdict(list)
            for s in self.starts[m] if m == self.span else {p for p in self.places if p + m <= len(self.words)}:
                made[b" ".join(self.words[s : s + m])].append(s)
            self.windows[m] = made
        return self.windows[m]

    def meet(self, name: str, item: list[bytes]) -> None:
        m = min(self.span, len(item))
        mine = self.at(m)
        shared = mine.keys() & {b" ".join(item[j : j + m]) for j in range(len(item) - m + 1)} if m else ()
        if shared:
            self.items.add(name)
            self.hit.update((s, s + m) for x in shared for s in mine[x])

    @property
    def runs(self) -> list[tuple[int, int]]:
        return union([*self.hit])


def _extend_batches(span: int, k: int):
    """Rows key, text, prints, places, item, item_text, a text before its items -> key, n_hit, runs, items."""
    schema = pa.schema([("key", pa.int64()), ("n_hit", pa.int64()), ("runs", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])

    def row(key: int, t: Text):
        runs = t.runs
        return key, sum(b - a for a, b in runs), [x for r in runs for x in r], sorted(t.items)

    def run(batches):
        key, here, out = None, None, []
        for b in batches:
            for this, text, found, places, name, item in zip(*(b.column(c).to_pylist() for c in range(6))):
                if this != key:
                    if here is not None and here.items:
                        out.append(row(key, here))
                    key, here = this, Text(text, found, places, span, k)
                else:
                    here.meet(name, words_of(item.encode()))
            if out:
                yield batch(schema, *zip(*out))
                out = []
        if here is not None and here.items:
            yield batch(schema, *zip(*[row(key, here)]))

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, k: int = K, carry: list[str] | None = None) -> DataFrame:
    """id, n_words, n_hit, runs and items of each row of docs, and the columns named in carry.

    runs holds the covered runs of words (from, to, from, to, ...), items the ids (as strings, sorted) of the items
    with occurring windows. Null or empty texts have no words; items without words or with a null id have no window;
    repeated items count once by their id, repeated rows of docs and rows with a null id each give a row. Either table
    may be empty.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = picked(benchmark, id=item_col, text=item_text_col).where("id is not null and length(text) > 0").select(F.col("id").cast("string").alias("item"), F.col("text").cast("string").alias("item_text")).distinct()
    known = stage(spark, items.mapInArrow(_item_batches(span, k), "item string, words int, print long").distinct(), "benchmark")
    lengths = [r["words"] for r in known.select("words").distinct().where("words > 0").orderBy("words").collect()]  # below span
    passes = spark.sparkContext.broadcast(bit_filter(known.select("print").distinct()))
    columns, others, kinds = carried(docs, carry)
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"), *columns)
    rows = stage(spark, rows.mapInArrow(_find_batches(passes, lengths, span, k, others), "key long, id long, n_words long, text string, prints array<long>, places array<long>" + kinds), "words")
    hits = rows.where(F.size("prints") > 0)
    pairs = hits.select("key", F.explode(F.array_distinct("prints")).alias("print")).join(known.select("print", "item"), "print").select("key", "item").distinct()
    asked = pairs.join(items, "item").select("key", F.lit(None).cast("string").alias("text"), F.lit(None).cast("array<long>").alias("prints"), F.lit(None).cast("array<long>").alias("places"), "item", "item_text")
    texts = hits.join(pairs.select("key").distinct(), "key", "left_semi").select("key", "text", "prints", "places", F.lit(None).cast("string").alias("item"), F.lit(None).cast("string").alias("item_text"))
    dealt = texts.unionByName(asked).repartition("key").sortWithinPartitions("key", F.col("item").asc_nulls_first())
    found = dealt.mapInArrow(_extend_batches(span, k), "key long, n_hit long, runs array<long>, items array<string>")
    none = {"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "runs": F.coalesce("runs", F.array().cast("array<long>")), "items": F.coalesce("items", F.array().cast("array<string>"))}
    out = rows.drop("text", "prints", "places").join(found, "key", "left").withColumns(none)
    return renamed(out.select("id", "n_words", "n_hit", "runs", "items", *others.names), carry, id=id_col)
