"""WARC archives: an exact round trip, revisits, and ranges at every place."""

import gzip
import hashlib
import io
import random

from lodestone.llm import warc
from lodestone.llm.common import new_folder


def rows(seed=0):
    r = random.Random(seed)
    big = ["é" * 600, "x" * 1000, "y" * 999, "z" * 5000]
    out = [(0, None, None), (1, "http://a/\r\nX: 1", ""), (2, "http://é/", "WARC/1.1\r\n\r\n"), (None, "u", "z" * 5000), (None, None, None)]
    for k in range(3, 120):
        t = r.choice(big) if r.random() < 0.5 else "".join(chr(r.randint(1, 0x2FF)) for _ in range(r.randint(0, 3000)))
        out.append((k, f"http://h/{k}", t))
    return [*out, (50, "again", "z" * 5000), out[-1]]


def plain(rows, least=1000):
    best = {}
    for i, _, t in rows:
        p = (t or "").encode()
        if i is not None and len(p) >= least:
            best[p] = max(best.get(p, i), i)
    out = []
    for i, _, t in rows:
        p = (t or "").encode()
        refers = best.get(p) if i is not None and len(p) >= least and i < best[p] else None
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "response" if refers is None else "revisit", refers, p if refers is None else b""))
    return sorted(out, key=str)


def test_round_trip(spark):
    for size in (1 << 23, 1000, 37):
        out = new_folder(spark, "warc")
        data = rows(size)
        warc.write_warc(spark.createDataFrame([(*x, "q") for x in data], "page_id long, url string, html string, digest string").repartition(4), out)
        got = warc.read_warc(spark, out, range_bytes=max(size, 200)).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in got), key=str) == plain(data)
        urls = {r.page_id: r.url for r in got}
        assert urls[1] == "http://a/%0D%0AX: 1" and urls[2] == "http://é/" and urls[0] is None


def test_archives_are_plain_gzip(spark):
    out = new_folder(spark, "warc")
    warc.write_warc(spark.createDataFrame(rows(), "page_id long, url string, html string").coalesce(1), out)
    files = [r.content for r in spark.read.format("binaryFile").load(out).where("length > 0").collect()]
    assert sum(gzip.decompress(f).count(b"WARC-Record-ID: ") for f in files) == len(rows())


def test_every_cut_gives_each_record_once():
    r = random.Random(1)
    members, places, at = [], [], 0
    for k in range(6):
        payload = bytes(r.choices(warc.MAGIC + b"a", k=50)) + gzip.compress(b"WARC/1.1 nested")
        members.append(warc.record(k, "u", payload, hashlib.sha1(payload).hexdigest(), None) + (warc.GAP if k % 2 else b""))
        places.append(at)
        at += len(members[-1])
    data = b"".join(members)
    for cut in range(1, len(data)):
        a = [p for p, _ in warc.records(io.BytesIO(data), len(data), 0, cut)]
        b = [p for p, _ in warc.records(io.BytesIO(data), len(data), cut, len(data))]
        assert a + b == places and all(p < cut for p in a)


def test_a_stored_member_inside_a_payload_is_not_a_record():
    inner = warc.record(7, "inner", b"inner", hashlib.sha1(b"inner").hexdigest(), None)
    payload = b"x" * 10 + inner
    outer = warc.record(1, "outer", payload, hashlib.sha1(payload).hexdigest(), None)
    found = list(warc.records(io.BytesIO(outer), len(outer), 0, len(outer)))
    assert len(found) == 1 and warc.parsed(found[0][1])[2] == payload


def test_no_rows(spark):
    out = new_folder(spark, "warc")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), out)
    assert warc.read_warc(spark, out).count() == 0


def test_a_very_long_payload_and_many_empty_ones(spark):
    long = "é<p>" * 3_000_000
    data = [(1, "a", long), (2, "b", long), *((k, None, None) for k in range(3, 400))]
    out = new_folder(spark, "warc")
    warc.write_warc(spark.createDataFrame(data, "page_id long, url string, html string").repartition(3), out)
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_warc(spark, out, payloads=False, range_bytes=5000).collect()}
    n = len(long.encode())
    assert got == {1: (n, "revisit", 2), 2: (n, "response", None)} | {k: (0, "response", None) for k in range(3, 400)}
