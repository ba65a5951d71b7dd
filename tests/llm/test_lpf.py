"""Removal of repeats against a dictionary of all strings."""

import random

import numpy as np
import pytest

from lodestone.llm import lpf


def plain(rows, least):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - least + 1) if i is not None else ():
            s = b[k : k + least]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - least + 1) if i is not None else ():
            if first[b[k : k + least]] < i:
                gone[k : k + least] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out.append((i, len(b), int(gone.sum()), edges.tolist(), bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


def corpus(seed, n=80):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdeéñ,", k=r.randint(1, 8)))
    passages = [" ".join(word() for _ in range(r.randint(5, 40))) for _ in range(12)]
    rows = [(900, None), (901, ""), (902, "a" * 300), (903, "a" * 120), (904, "ab" * 100), (905, "x" + "ab" * 80), (None, passages[0]), (None, passages[0])]
    for k in range(n):
        text = ""
        for _ in range(r.randint(0, 6)):
            p = r.choice(passages) if r.random() < 0.6 else " ".join(word() for _ in range(r.randint(1, 30)))
            a = r.randint(0, len(p) // 2) if r.random() < 0.4 else 0
            text += p[a : len(p) - r.randint(0, a)]
        rows.append((r.randint(0, 60) if r.random() < 0.2 else 1000 - k, text))
    rows += [rows[-1], (5000, rows[-1][1])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "chunk", "block"), [(1, 2 << 20, 1 << 17), (2, 900, 1 << 17), (3, 3000, 257)])
def test_removal_equals_a_dictionary_of_all_strings(spark, monkeypatch, seed, chunk, block):
    monkeypatch.setattr(lpf, "CHUNK", chunk)
    monkeypatch.setattr(lpf, "BLOCK", block)
    monkeypatch.setattr(lpf, "SUFFIXES", block)
    monkeypatch.setattr(lpf, "CONTEXTS", block)
    rows = corpus(seed)
    df = spark.createDataFrame([(*x, f"s{k}", None) for k, x in enumerate(rows)], "doc_id long, text string, kept string, chunk int").repartition(3)
    got = lpf.remove_repeats(df, carry=["chunk"]).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, list(r.spans), bytes(r.kept)) for r in got), key=str) == plain(rows, 50)


def test_anchors_name_equal_strings_alike():
    r = random.Random(0)
    data = np.frombuffer(bytes(r.choices(b"ab", k=3000)), np.uint8)
    valid = np.zeros(3000, bool)
    valid[: 3000 - 49] = True
    h, start, many = lpf.anchors(data, valid)
    assert many.sum() == valid.sum() and (np.cumsum(many)[:-1] == start[1:]).all()
    name = np.repeat(h, many)
    seen = {}
    for k in range(2951):
        assert seen.setdefault(data[k : k + 50].tobytes(), name[k]) == name[k]


def test_nearest_smaller():
    for seed in range(50):
        r = np.random.default_rng(seed)
        v, common = r.integers(0, 6, 40), r.integers(0, 5, 40)
        common[0] = 0
        for step in (-1, 1):
            places, prefixes = [], []
            for i in range(40):
                j, least = i, 99
                while True:
                    least = min(least, common[j] if step < 0 else common[j + 1] if j < 39 else 0)
                    j += step
                    if least == 0 or not 0 <= j < 40 or v[j] < v[i]:
                        break
                there = least > 0 and 0 <= j < 40
                places.append(j if there else -1)
                prefixes.append(int(least) if there else 0)
            to, shared = lpf.nearest_smaller(v, common, step)
            assert to.tolist() == places and shared.tolist() == prefixes


def test_longest_previous_factors():
    """The array against a comparison of every suffix with every other of an earlier document."""
    for seed in range(12):
        r = random.Random(seed)
        least = r.choice([5, 8, 13])
        texts = ["".join(r.choices("ab", k=r.randint(least, 30))) for _ in range(14)]
        texts += [texts[0], texts[3][2:] + "b" * least, texts[5][: least + 2]]
        doc = np.array([r.randint(0, 9) for _ in texts])
        rows = np.zeros((len(texts), 64), np.uint8)
        for k, t in enumerate(texts):
            rows[k, : len(t)] = np.frombuffer(t.encode(), np.uint8)
        suffixes = [(k, o) for k, t in enumerate(texts) for o in range(len(t) - least + 1)]

        def shared(a, b, texts=texts, least=least):
            n = 0
            while n < least and texts[a[0]][a[1] + n] == texts[b[0]][b[1] + n]:
                n += 1
            return n

        want = {a: max([0, *(shared(a, b) for b in suffixes if doc[b[0]] < doc[a[0]])]) for a in suffixes}
        owner, offset, length = lpf.previous_factors(rows, np.array([len(t) for t in texts]), doc, least)
        assert dict(zip(zip(owner.tolist(), offset.tolist()), length.tolist())) == want


def test_no_rows(spark):
    assert lpf.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
