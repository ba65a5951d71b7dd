"""Top-k against a sort of all scores."""

import math
import random

import numpy as np
import pytest

from lodestone.llm import topk


def plain(rows, k=20, every=20):
    good = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        good[i] = [min(max(math.floor(64 * x), -(2**63)), 2**63 - 1) for x in v]
    out = []
    for q, a in good.items():
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good.items() if i != q and len(b) == len(a))
            out += [(q, r, i, min(max(-s, -(2**63)), 2**63 - 1)) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["spread", "ties", "few", "alone", "large", "huge"])
def test_equal_to_a_sort_of_all_scores(spark, monkeypatch, kind):
    r = random.Random(kind)
    for name, n in (("GROUP", 150), ("BLOCK", 16), ("QUERIES", 8), ("BOUNDS", 0 if kind == "alone" else topk.BOUNDS)):
        monkeypatch.setattr(topk, name, n)
    value = (lambda: r.choice([-0.5, 0.0, 0.5])) if kind in ("ties", "few") else (lambda: r.gauss(0, 1))
    if kind == "large":
        value = lambda: r.gauss(0, 1) * r.choice([1, 1, 1, 1, 1, 1, 1, 1, 1e4, 200_000.0, 1e6])
    if kind == "huge":
        value = lambda: r.gauss(0, 1) * r.choice([1] * 30 + [1e9, 1e15, 1e20, 1e37])
    rows = [(i, [float(np.float32(value())) for _ in range(8)]) for i in range(7 if kind == "few" else 500)]
    rows += [(None, [1.0] * 8), (1001, None), (1020, [None] * 8), (1040, [float("nan")] * 8), (1060, [float("inf")] * 8), (1080, []), (1100, [1.0, 2.0]), (1101, [1.0, 2.0])]
    rows += rows[:5]
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    assert sorted(map(tuple, topk.top_k(df).collect())) == plain(rows)


def test_blocks_are_passed_over():
    r = np.random.default_rng(0)
    centre = r.integers(-40, 40, (20, 32))
    m = np.concatenate([c + r.integers(-2, 3, (200, 32)) for c in centre]).astype(float)
    g = topk.Group(np.arange(len(m)), m.astype(np.int64), 64)
    seen = []
    g.m = type("Counted", (np.ndarray,), {"__getitem__": lambda self, k: (seen.append(k), np.ndarray.__getitem__(self, k))[1]})((m.shape), buffer=g.m.copy())
    q = centre[:3].astype(float)
    rows, ids, scores = g.search(np.array([-1, -2, -3]), q, 20)
    assert len(seen) < 3 * (len(g.cut) - 1) / 2
    for k in range(3):
        want = sorted(zip(-(m @ q[k]), range(len(m))))[:20]
        assert sorted(zip(-scores[rows == k], ids[rows == k])) == want


def test_no_rows(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_wide_scores_are_exact():
    r = random.Random(3)
    number = lambda: r.choice([r.randint(-100, 100), r.randint(-(2**63), 2**63 - 1), -(2**63), 2**63 - 1])
    m, q = ([[number() for _ in range(70)] for _ in range(n)] for n in (9, 5))
    top, middle, low = topk.wide_scores(np.array(m, np.int64), np.array(q, np.int64))
    for i in range(5):
        for j in range(9):
            assert (int(top[i, j]) << 84) + (int(middle[i, j]) << 21) + int(low[i, j]) == sum(x * y for x, y in zip(q[i], m[j]))


def test_very_long_vectors(spark):
    rows = [(i, [float(i % 7 - j % 3) for j in range(5000)]) for i in range(0, 60)]
    got = sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()))
    assert got == plain(rows)
