"""Decontamination against a search for every window at every word."""

import random
import re
import time

import pytest

from lodestone.llm import common, winnow


def plain_words(text):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", folded)


def plain(docs, items, span=13):
    out = {}
    for i, text in docs:
        w, hit, names = plain_words(text), set(), set()
        for name, other in items:
            v = plain_words(other)
            m = min(span, len(v))
            windows = {tuple(v[k : k + m]) for k in range(len(v) - m + 1)} if m and name is not None else set()
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in windows:
                    hit |= set(range(k, k + m))
                    names.add(str(name))
        out[i] = (len(w), len(hit), sorted(names))
    return out


def cases(seed):
    r = random.Random(seed)
    vocabulary = ["a", "B", "é", "Ñu", "x1", "日本", "the", "of"]
    line = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", ", ", "\n", "_", "-"]) for _ in range(n))
    items = [(k, line(r.choice([1, 3, 6, 7, 12, 13, 14, 20, 40]))) for k in range(30)]
    items += [(30, None), (31, "!!"), (None, line(20)), (5, items[5][1]), (32, items[7][1])]
    docs = [(0, None), (1, ""), (2, "...")]
    for k in range(3, 90):
        text = line(r.randint(0, 40))
        for _ in range(r.randint(0, 3)):
            v = (r.choice(items)[1] or "").split(" ")
            a = r.randint(0, len(v) - 1)
            text += " ".join(v[a : a + r.randint(1, 30)]).upper() + " " + line(r.randint(0, 10))
        docs.append((k, text))
    return docs, items


@pytest.mark.parametrize("bits", [1 << 20, 1 << 9, 8])
def test_counts_equal_a_search_of_every_window(spark, monkeypatch, bits):
    monkeypatch.setattr(common, "LEAST_BITS", min(bits, common.LEAST_BITS))
    monkeypatch.setattr(common, "FILTER_BITS", bits)
    docs, items = cases(bits)
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, items int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in winnow.contamination(df, bench).collect()}
    assert got == plain(docs, items)


def words(text):
    raw = text.encode()
    return winnow.Words(winnow.np.frombuffer(raw, winnow.np.uint8), winnow.np.array([0, len(raw)]))


def test_kept_hashes_find_every_shared_span():
    for seed in range(20):
        r = random.Random(seed)
        vocabulary = [f"w{k}" for k in range(r.choice([2, 5, 1000]))]
        item = [r.choice(vocabulary) for _ in range(60)]
        known = set(winnow.prints(words(" ".join(item)), 13, 7, [])[0].tolist())
        for k in range(48):
            text = " ".join(["q", *item[k : k + 13], "q"])
            found, at = (x.tolist() for x in winnow.prints(words(text), 13, 7, []))
            hits = [(h, p) for h, p in zip(found, at) if h in known]
            t = winnow.Text(text, [h for h, _ in hits], [p for _, p in hits], 13, 7)
            t.meet("0", winnow.words_of(" ".join(item).encode()))
            assert hits and t.runs and t.runs[0][0] <= 1 and t.runs[-1][1] >= 14


def test_one_word_over_and_over_is_linear(spark):
    n = 60_000
    docs = spark.createDataFrame([(1, "a " * n), (2, "b"), (None, "a " * 13), (2, "b"), (3, "a " * 12)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "a " * n)], "item_id long, text string")
    start = time.perf_counter()
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in winnow.contamination(docs, bench).collect()), key=str)
    assert got == sorted([(1, n, n, ["7"]), (2, 1, 0, []), (2, 1, 0, []), (None, 13, 13, ["7"]), (3, 12, 0, [])], key=str)
    assert time.perf_counter() - start < 60


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in winnow.contamination(docs, bench).collect()] == [(1, 2, 0, [], [])]
    assert winnow.contamination(docs.limit(0), bench).count() == 0
