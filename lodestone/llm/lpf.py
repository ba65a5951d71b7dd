"""Suffix-array deduplication by longest previous factors, dealt by content.

The longest previous factor of a place is the longest string there that also starts in an earlier document.
Of the suffixes in sorted order only the nearest ones from earlier documents on either side (previous and next
smaller positions) can give it: it is the longer of the prefixes shared with them. Removing needs to know only whether
it reaches MIN bytes, so suffixes are compared by their first MIN bytes, lengths are counted up to MIN, and only
suffixes that may be equal so far have to meet:

1. Texts are packed into chunks (rows of a few thousand documents), which are staged.
2. Each MIN-byte string is named after its least k-gram hash (its anchor). Equal strings have equal anchors,
   and neighbouring strings mostly share theirs, so a chunk sends one sorted, packed list of distinct hashes for
   each bucket. A bucket answers which of them occur in two documents or more, as bits.
3. Chunks cut out the contexts of shared anchors (the bytes of all strings named after one). Copies within the
   chunk are settled there; of each distinct context the earliest document's goes to the anchor's bucket.
4. A bucket settles equal contexts the same way (the whole of one is a factor of the other), sorts the suffixes of the
   rest, and makes their longest-previous-factor array from previous and next smaller documents and the prefixes shared
   with neighbours. It returns runs of bytes to remove for each chunk.
5. Chunks cut the runs out.

No step holds more than a chunk, or a bucket of about BUCKET bytes of text; a string that very many documents
share is sent once for each chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, batches_of, carried, pack_ints, release, renamed, small_batches, stage, trim, unpack_ints, unstage, utf8

#: Bytes of the shortest string that counts, and of a k-gram.
MIN, GRAM = 50, 20
#: Bytes of text in a chunk (a longer text is one), and behind a bucket.
CHUNK, BUCKET = 4 << 20, 16 << 20
#: Bytes of chunks that a worker gets at once.
BATCH = 4 << 20
#: Places scanned, contexts compared, and suffixes sorted at a time.
BLOCK, CONTEXTS, SUFFIXES = 1 << 17, 100_000, 1 << 19

#: Groups over which the runs that chunks settle themselves are spread.
SETTLED = 4096

_rng = np.random.default_rng(50)
_CODE = _rng.integers(0, 2**64, 256, np.uint64, endpoint=False)
_ODD = [np.uint64(x | 1) for x in _rng.integers(0, 2**63, 40, np.uint64).tolist()]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[0]
    return x ^ (x >> np.uint64(29))


def _grams(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each place on, put together from hashes of powers of two."""
    part, at, out, size = _CODE[data], 0, None, 1
    while size <= k:
        if k & size:
            n = len(data) - k + 1
            piece = part[at : at + n]
            out = piece.copy() if out is None else out * _ODD[size % 40] + piece
            at += size
        if size * 2 <= k:
            part = part[: len(part) - size] * _ODD[(size + 7) % 40] + part[size:]
        size *= 2
    return _mix(out)


def anchors(data: np.ndarray, valid: np.ndarray, least: int = MIN, k: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of places whose strings have the same anchor: hash, first place, number of places.

    valid: places where a string of `least` bytes lies in one document. The anchor is the leftmost least hash.
    """
    w = least - k + 1
    found = []
    for a in range(0, len(data), BLOCK):
        b = min(len(data), a + BLOCK)
        ok = valid[a:b]
        if not ok.any():
            continue
        h = _grams(data[a : min(len(data), b + least - 1)], k)
        n = len(h) - w + 1
        if n <= 0:
            continue
        at = np.arange(len(h), dtype=np.int32)
        size, value, place = 1, h, at
        while size * 2 <= w:
            value, place = _lesser(value, place, size)
            size *= 2
        if size < w:
            value, place = _lesser(value, place, w - size)
        s = np.flatnonzero(ok[:n])
        p = place[s]
        new = np.ones(len(s), bool)
        new[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)
        first = np.flatnonzero(new)
        found.append((h[p[first]], s[first] + a, np.diff(np.append(first, len(s))), p[first].astype(np.int64) + a))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    h, start, many, p = (np.concatenate(x) for x in zip(*found))
    new = np.ones(len(p), bool)  # runs that go on in the next block
    new[1:] = (p[1:] != p[:-1]) | (start[1:] != start[:-1] + many[:-1])
    first = np.flatnonzero(new)
    return _mix(h[first] * _ODD[3]), start[first], np.add.reduceat(many, first)  # spread evenly again: minima are small


def _lesser(value: np.ndarray, place: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(value) - shift
    left = value[:n] <= value[shift:]
    return np.where(left, value[:n], value[shift:]), np.where(left, place[:n], place[shift:])


class Chunk:
    """The texts of a chunk with a byte between them, where each lies, and their ids (valid: not null)."""

    def __init__(self, ids: pa.Array, lengths: list[int], data: bytes, least: int):
        self.ids = np.asarray(ids.fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        self.data = np.frombuffer(data, np.uint8)
        lengths = np.array(lengths, np.int64)
        self.start = np.cumsum(lengths + 1) - lengths - 1
        self.end = self.start + lengths
        self.valid = np.zeros(len(self.data), bool)
        for a, b, there in zip(self.start.tolist(), self.end.tolist(), ids.is_valid().to_pylist()):
            if there and b - a >= least:
                self.valid[a : b - least + 1] = True

    def doc(self, places: np.ndarray) -> np.ndarray:
        return self.ids[np.searchsorted(self.start, places, "right") - 1]


_CHUNKS = pa.schema([("chunk", pa.int64()), ("size", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("data", pa.binary()), ("rest", pa.binary())])


def _chunk_batches(batches):
    """Packs rows id, text, others... into chunks; the other columns travel as they are."""
    task, seq = TaskContext.get().partitionId(), 0
    press = zstandard.ZstdCompressor(level=3)
    held: list[pa.RecordBatch] = []
    size = 0

    def flush():
        nonlocal seq
        t = pa.Table.from_batches(held).combine_chunks()
        one = t.to_batches()[0]
        raw, at = utf8(one.column(1))
        data = b"\0".join([bytes(raw[a:b]) for a, b in zip(at, at[1:])])
        sink = pa.BufferOutputStream()
        rest = t.drop_columns(t.column_names[:2])
        with pa.ipc.new_stream(sink, rest.schema) as w:
            w.write_table(rest)
        row = batch(_CHUNKS, [task << 32 | seq], [len(data)], [one.column(0).to_pylist()], [np.diff(at).tolist()], [press.compress(data)], [press.compress(sink.getvalue())])
        seq += 1
        return row

    for b in batches:
        _, at = utf8(b.column(1))
        a = 0
        while a < b.num_rows:
            z = max(a + 1, int(np.searchsorted(at, at[a] + CHUNK - size, "right")) - 1)
            z = min(z, b.num_rows)
            held.append(b.slice(a, z - a))
            size += at[z] - at[a]
            a = z
            if size >= CHUNK or a < b.num_rows:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _opened(b: pa.RecordBatch, least: int, columns=(2, 3, 4)):
    unpress = zstandard.ZstdDecompressor()
    for k in range(b.num_rows):
        size = b.column(1)[k].as_py()
        data = unpress.decompress(b.column(columns[2])[k].as_buffer(), max_output_size=max(1, size))
        yield k, Chunk(b.column(columns[0])[k].values, b.column(columns[1])[k].values.to_pylist(), data, least)


def _cut(sorted_hashes: np.ndarray, buckets: int) -> list[int]:
    edges = np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)
    return [0, *np.searchsorted(sorted_hashes, edges).tolist(), len(sorted_hashes)]


_LISTS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("blob", pa.binary()), ("flags", pa.binary())])


def _distinct(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, and whether the chunk has each in two documents."""
    order = np.argsort(h)
    h, doc = h[order], doc[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
    if not len(h):
        return h, np.empty(0, bool)
    return h[first], np.maximum.reduceat(doc, first) != np.minimum.reduceat(doc, first)


def _anchor_batches(least: int, k: int, buckets: int):
    def run(batches):
        for b in batches:
            for row, c in _opened(b, least):
                h, start, _ = anchors(c.data, c.valid, least, k)
                distinct, twice = _distinct(h, c.doc(start))
                cut = _cut(distinct, buckets)
                full = [(n, x, y) for n, (x, y) in enumerate(zip(cut, cut[1:])) if y > x]
                chunk = b.column(0)[row].as_py()
                yield batch(_LISTS, [n for n, _, _ in full], [chunk] * len(full), [pack_ints(distinct[x:y]) for _, x, y in full], [np.packbits(twice[x:y]).tobytes() for _, x, y in full])

    return run


_BITS = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("bits", pa.binary())])


def _shared_groups(t: pa.Table) -> pa.Table:
    """Which hashes of each chunk's list occur in two chunks, or in two documents of one."""
    lists = [unpack_ints(x) for x in t.column("blob").to_pylist()]
    sizes = [len(x) for x in lists]
    h = np.concatenate(lists)
    twice = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=n) for f, n in zip(t.column("flags").to_pylist(), sizes)]).astype(bool)
    order = np.argsort(h)
    s = h[order]
    same = s[1:] == s[:-1]
    often = np.zeros(len(s), bool)
    often[1:] |= same
    often[:-1] |= same
    first = np.cumsum(np.append(True, ~same)) - 1
    flagged = np.zeros(first[-1] + 1, bool)
    flagged[first[twice[order]]] = True
    shared = np.empty(len(s), bool)
    shared[order] = often | flagged[first]
    parts = np.split(shared, np.cumsum(sizes)[:-1])
    keep = [k for k, x in enumerate(parts) if x.any()]
    chunks, buckets = t.column("chunk").to_pylist(), t.column("bucket").to_pylist()
    return pa.Table.from_batches([batch(_BITS, [chunks[k] for k in keep], [buckets[k] for k in keep], [np.packbits(parts[k]).tobytes() for k in keep])], _BITS)


_CONTEXTS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("blob", pa.binary())])


def _rows_of(data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """The bytes of each context in a row of `width` bytes, with zeros after them."""
    out, column = np.zeros((len(start), width), np.uint8), np.arange(width)
    for k in range(0, len(start), 1 << 14):
        at = start[k : k + (1 << 14), None] + column
        inside = column < size[k : k + (1 << 14), None]
        out[k : k + (1 << 14)] = np.where(inside, data[np.minimum(at, len(data) - 1)], 0)
    return out


def _row_hash(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(rows).view(np.uint64)
    h = size.astype(np.uint64) * _ODD[39]
    for j in range(words.shape[1]):
        h = h + _mix(words[:, j] ^ _ODD[j + 1]) * _ODD[j + 2]
    return _mix(h)


def _same_contexts(rows: np.ndarray, size: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each context the number of an equal one with the least document, and the order used."""
    h = _row_hash(rows, size)
    order = np.lexsort((doc, h))
    new = np.append(True, h[order][1:] != h[order][:-1])
    leader = np.empty(len(h), np.int64)
    leader[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
    unequal = (rows != rows[leader]).any(1) | (size != size[leader])
    leader[unequal] = np.flatnonzero(unequal)  # hashes that clash: settled among suffixes
    return leader, h


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs, those that overlap or touch as one."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order]) if len(end) else end
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    first = np.flatnonzero(new)
    return start[first], end[np.append(first[1:], len(start)) - 1] if len(first) else end


def _runs_blob(start: np.ndarray, end: np.ndarray) -> bytes:
    start, end = _merged(start, end)
    return pack_ints(np.concatenate([start, end]))


def _context_batches(least: int, k: int, buckets: int):
    width = -(-(2 * least - k) // 8) * 8

    def run(batches):
        for b in batches:
            for row, c in _opened(b, least):
                chunk = b.column(0)[row].as_py()
                h, start, many = anchors(c.data, c.valid, least, k)
                doc = c.doc(start)
                distinct, _ = _distinct(h, doc)
                cut, shared = _cut(distinct, buckets), np.zeros(len(distinct), bool)
                for bits in b.column(5)[row].as_py():
                    x, y = cut[bits["bucket"]], cut[bits["bucket"] + 1]
                    shared[x:y] = np.unpackbits(np.frombuffer(bits["bits"], np.uint8), count=y - x)
                keep = np.flatnonzero(shared[np.searchsorted(distinct, h)])
                out, h, start, many, doc = [], h[keep], start[keep], many[keep], doc[keep]
                if not len(h):
                    continue
                size = many + least - 1
                rows = _rows_of(c.data, start, size, width)
                leader, _ = _same_contexts(rows, size, doc)
                later = doc > doc[leader]
                if later.any():
                    out.append((-1 - chunk % SETTLED, _runs_blob(start[later], (start + size)[later])))
                send = np.flatnonzero(~later)
                order = send[np.argsort(h[send], kind="stable")]
                cut = _cut(h[order], buckets)
                for n, (x, y) in enumerate(zip(cut, cut[1:])):
                    if y > x:
                        o = order[x:y]
                        body = zstandard.ZstdCompressor(level=1).compress(b"".join([r[:m].tobytes() for r, m in zip(rows[o], size[o].tolist())]))
                        fields = [pack_ints(h[o]), pack_ints(doc[o]), pack_ints(start[o]), pack_ints(many[o].astype(np.uint8)), body]
                        out.append((n, b"".join(len(f).to_bytes(4, "little") + f for f in fields)))
                yield batch(_CONTEXTS, [n for n, _ in out], [chunk] * len(out), [x for _, x in out])
        trim()

    return run


class Part:
    """The contexts that one chunk sent to a bucket, sorted by anchor."""

    def __init__(self, blob: bytes, least: int, width: int):
        fields, at = [], 0
        while at < len(blob):
            n = int.from_bytes(blob[at : at + 4], "little")
            fields.append(blob[at + 4 : at + 4 + n])
            at += 4 + n
        self.h, self.doc, self.start, many = map(unpack_ints, fields[:4])
        self.size, self.width = many.astype(np.int64) + least - 1, width
        self.at = np.cumsum(self.size) - self.size
        self.body = np.frombuffer(zstandard.ZstdDecompressor().decompress(fields[4], max_output_size=max(1, int(self.size.sum()))), np.uint8)

    def between(self, low: int, high: int) -> tuple[np.ndarray, ...]:
        a, b = np.searchsorted(self.h, np.array([low, high], np.uint64), "left") if high < 1 << 64 else (np.searchsorted(self.h, np.uint64(low)), len(self.h))
        return self.h[a:b], self.doc[a:b], self.start[a:b], self.size[a:b], _rows_of(self.body, self.at[a:b], self.size[a:b], self.width)


def common_prefixes(keys: list[np.ndarray], most: int) -> np.ndarray:
    """Bytes (at most `most`) that each of some sorted strings shares with the one before (the first: 0).

    keys: the strings' bytes, eight to a number, the first of them highest.
    """
    n = len(keys[0])
    out, same = np.zeros(n, np.int64), np.arange(1, n)
    for k in keys:
        x = k[same] ^ k[same - 1]
        for shift in range(56, -1, -8):
            out[same] += (x >> np.uint64(shift)) == 0
        same = same[x == 0]
    return np.minimum(out, most)


def nearest_smaller(value: np.ndarray, common: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place in sorted order the nearest one to the left (step -1) or right (1) with a smaller value, and the prefix shared with it.

    common: common_prefixes() of the order. The shared prefix is the least on the way; where it comes to nothing, or the
    order ends, the place is -1 and the prefix 0. Places jump over what their neighbours have already skipped.
    """
    n = len(value)
    to, shared = np.arange(n) + step, common.copy()
    if step > 0:
        shared = np.append(common[1:], 0)[:n]
    active = np.arange(n)
    while active.size:
        t = to[active]
        out = (t < 0) | (t >= n) | (shared[active] == 0)
        to[active[out]], shared[active[out]] = -1, 0
        active, t = active[~out], t[~out]
        on = value[t] >= value[active]
        active, t = active[on], t[on]
        ahead, least = to[t], np.minimum(shared[active], shared[t])
        to[active], shared[active] = ahead, np.where(ahead < 0, 0, least)
        active = active[ahead >= 0]
    return to, shared


def previous_factors(rows: np.ndarray, size: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, offset, length) of each suffix of `least` bytes or more: the longest previous factor, up to `least`.

    All such suffixes are sorted by their first `least` bytes (removal asks for no more). In that order the previous and
    next smaller positions by document are the earlier documents with the longest common prefixes on either side; the
    longer of the two prefixes is the length of the longest factor that also starts in an earlier document.
    """
    many = size - least + 1
    owner = np.repeat(np.arange(len(size)), many)
    offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    flat = np.ascontiguousarray(rows).reshape(-1)
    width = rows.shape[1]
    words = -(-least // 8)
    at = owner * width + offset
    keys = []
    for j in range(words):
        key = np.zeros(len(owner), np.uint64)
        for i in range(8 * j, 8 * j + 8):
            key = key << np.uint64(8)
            if i < least:
                key |= flat[at + i]
        keys.append(key)
    order = np.lexsort(keys[::-1])
    common, rank = common_prefixes([k[order] for k in keys], least), doc[owner[order]]
    length = np.empty(len(order), np.int64)
    length[order] = np.maximum(nearest_smaller(rank, common, -1)[1], nearest_smaller(rank, common, 1)[1])
    return owner, offset, length


def earlier_factors(rows: np.ndarray, size: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, offset) of the suffixes whose longest previous factor reaches `least`."""
    owner, offset, length = previous_factors(rows, size, doc, least)
    hit = length >= least
    return owner[hit], offset[hit]


def _slices(order: np.ndarray, h: np.ndarray, many: np.ndarray) -> list[np.ndarray]:
    """Cuts contexts, sorted by anchor, between anchors into parts of about SUFFIXES suffixes: equal strings stay together."""
    at = np.flatnonzero(h[1:] != h[:-1]) + 1
    at = at[np.append(True, np.diff(np.cumsum(many)[at - 1] // SUFFIXES) > 0)] if len(at) else at
    return np.split(order, at)


_RUNS = pa.schema([("chunk", pa.int64()), ("blob", pa.binary())])


def _settled(h, doc, start, size, rows, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, from, to): runs of places to remove, of all contexts of some anchors."""
    leader, _ = _same_contexts(rows, size, doc)
    later = doc > doc[leader]
    gone = [(np.flatnonzero(later), start[later], (start + size)[later])]
    heads = np.unique(leader)
    order = heads[np.argsort(h[heads], kind="stable")]
    same = h[order][1:] == h[order][:-1]
    contested = np.zeros(len(order), bool)
    contested[1:] |= same
    contested[:-1] |= same
    order = order[contested]
    if len(order):
        slices = _slices(order, h[order], size[order] - least + 1)
        found = [earlier_factors(rows[o], size[o], doc[o], least) for o in slices]
        base = np.repeat(np.cumsum([0, *map(len, slices[:-1])]), [len(w) for w, _ in found])
        which, offset = np.concatenate([w for w, _ in found]) + base, np.concatenate([x for _, x in found])
        number = np.full(len(h), -1)
        number[order] = np.arange(len(order))
        by = np.lexsort((offset, which))
        which, offset = which[by], offset[by]
        new = np.ones(len(which), bool)
        new[1:] = (which[1:] != which[:-1]) | (offset[1:] > offset[:-1] + least)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(which))[: len(first)] - 1
        run_of, a, z = which[first], offset[first], offset[last] + least
        mine = np.flatnonzero(~later & (number[leader] >= 0))  # all copies in the earliest document
        lo, hi = np.searchsorted(run_of, number[leader[mine]], "left"), np.searchsorted(run_of, number[leader[mine]], "right")
        n = hi - lo
        inst = np.repeat(mine, n)
        r = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        gone.append((inst, start[inst] + a[r], start[inst] + z[r]))
    return tuple(np.concatenate(x) for x in zip(*gone))


def _lpf_groups(least: int, k: int):
    width = -(-(2 * least - k) // 8) * 8

    def run(t: pa.Table) -> pa.Table:
        chunks, blobs = t.column("chunk").to_pylist(), t.column("blob").to_pylist()
        if t.column("bucket")[0].as_py() < 0:  # settled within their chunk
            return t.select(["chunk", "blob"])
        parts = [Part(x, least, width) for x in blobs]
        total, low, high = sum(len(p.h) for p in parts), min(int(p.h[0]) for p in parts), max(int(p.h[-1]) for p in parts) + 1
        number = -(-total // CONTEXTS)
        edges = [low + (high - low) * i // number for i in range(number + 1)]
        gone = []
        for a, b in zip(edges, edges[1:]):  # equal strings have equal anchors, so ranges of anchors stand alone
            cut = [p.between(a, b) for p in parts]
            of = np.repeat(np.arange(len(parts)), [len(p[0]) for p in cut])
            which, x, y = _settled(*(np.concatenate(c) for c in zip(*cut)), least)
            gone.append((of[which], x, y))
        who, x, y = (np.concatenate(g) for g in zip(*gone))
        by = np.argsort(who, kind="stable")
        who, x, y = who[by], x[by].astype(np.int64), y[by].astype(np.int64)
        at = np.searchsorted(who, np.arange(len(parts) + 1)).tolist()
        trim()
        out = [(chunks[p], _runs_blob(x[i:j], y[i:j])) for p, (i, j) in enumerate(zip(at, at[1:])) if j > i]
        return pa.Table.from_batches([batch(_RUNS, [c for c, _ in out], [z for _, z in out])], _RUNS)

    return run


def _whole_characters(data: np.ndarray, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs without the characters (UTF-8) that they hold only in part."""
    for _ in range(3):
        a = a + ((data[np.minimum(a, len(data) - 1)] & 0xC0) == 0x80)
        z = z - ((z < len(data)) & ((data[np.minimum(z, len(data) - 1)] & 0xC0) == 0x80))
    return a[a < z], z[a < z]


def _apply_batches(schema: pa.Schema, least: int, whole: bool):
    def run(batches):
        for b in batches:
            for row, c in _opened(b, least):
                blobs = [unpack_ints(x) for x in (b.column(6)[row].as_py() or [])]
                halves = [(x[: len(x) // 2], x[len(x) // 2 :]) for x in blobs]
                a, z = _merged(*(np.concatenate([h[i] for h in halves]).astype(np.int64) if halves else np.empty(0, np.int64) for i in (0, 1)))
                if whole and len(a):
                    a, z = _whole_characters(c.data, a, z)
                kept = np.ones(len(c.data) + 1, bool)
                for x, y in zip(a.tolist(), z.tolist()):
                    kept[x:y] = False
                lo, hi = np.searchsorted(a, c.start, "left"), np.searchsorted(a, c.end, "left")
                ids = b.column(2)[row].values
                out, removed, spans = [], [], []
                for s, e, x, y in zip(c.start.tolist(), c.end.tolist(), lo.tolist(), hi.tolist()):
                    text = c.data[s:e]
                    out.append((text[kept[s:e]] if y > x else text).tobytes())
                    removed.append(e - s - len(out[-1]))
                    spans.append(np.stack([a[x:y] - s, z[x:y] - s], 1).reshape(-1).tolist())
                raw = zstandard.ZstdDecompressor().decompressobj().decompress(b.column(5)[row].as_buffer())
                rest = pa.ipc.open_stream(raw).read_all().combine_chunks()
                others = [x.chunk(0) if x.num_chunks else pa.array([], x.type) for x in rest.columns]
                for k in range(0, len(out), 500):
                    yield batch(schema, ids[k : k + 500], c.end[k : k + 500] - c.start[k : k + 500], removed[k : k + 500], spans[k : k + 500], out[k : k + 500], *[x[k : k + 500] for x in others])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN, gram: int = GRAM, carry: list[str] | None = None, whole_characters: bool = False) -> DataFrame:
    """Removes each byte of a text that a string of `least` bytes covers which also starts in a document of smaller id.

    Gives id, n_bytes, n_removed, spans (removed runs of bytes: from, to, from, to, ...) and kept (the other bytes)
    for each row, and the columns named in carry. Texts are taken as UTF-8 bytes (null: empty) and judged as they
    came in (with whole_characters, a character of which only a part would go stays); overlaps count; no string crosses two texts. Rows with equal ids don't remove from each other. A row
    with a null id has no place in the order: it stays whole and removes nothing. Empty tables give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    columns, others, kinds = carried(docs, carry)
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"), *columns)
    chunks = stage(spark, rows.mapInArrow(_chunk_batches, "chunk long, size long, ids array<long>, lengths array<long>, data binary, rest binary"), "chunks")
    total = chunks.agg(F.sum("size")).first()[0] or 0
    buckets = max(6, -(-total // BUCKET))
    texts = chunks.select("chunk", "size", "ids", "lengths", "data")
    with batches_of(spark, BATCH):
        lists = texts.mapInArrow(_anchor_batches(least, gram, buckets), "bucket int, chunk long, blob binary, flags binary")
        bits = lists.groupBy("bucket").applyInArrow(_shared_groups, "chunk long, bucket int, bits binary")
        bits = bits.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("bits"))
        bits = stage(spark, bits, "shared")
        del lists
        release(spark)
        found = texts.join(bits, "chunk").mapInArrow(_context_batches(least, gram, buckets), "bucket int, chunk long, blob binary")
        runs = found.groupBy("bucket").applyInArrow(_lpf_groups(least, gram), "chunk long, blob binary").groupBy("chunk").agg(F.collect_list("blob").alias("runs"))
        runs = stage(spark, runs, "runs")
        del found
    unstage(spark, bits)
    release(spark)
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.int64())), ("kept", pa.binary()), *others])
    kind = "id long, n_bytes long, n_removed long, spans array<long>, kept binary" + kinds
    cut = chunks.join(runs, "chunk", "left").mapInArrow(_apply_batches(schema, least, whole_characters), kind)
    return renamed(cut, carry, id=id_col)
