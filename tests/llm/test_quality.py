"""The quality classifier: the label model on made-up votes, held-out accuracy, and odd rows."""

import math
import random

import numpy as np

from lodestone.llm import quality


def test_label_model_recovers_accuracies():
    r = random.Random(0)
    counts = {}
    for _ in range(40_000):
        bad = r.random() < 0.15
        v = "".join(("b" if r.random() < (0.6 if bad else 0.03) else "g") for _ in range(4))
        v += "-" if r.random() < 0.7 else "b" if bad else "g"
        counts[v] = counts.get(v, 0) + 1
    post, share, p = quality.fit_labellers(counts)
    assert abs(share - 0.15) < 0.01
    assert all(abs(x[1, 2] - 0.6) < 0.02 and abs(x[0, 2] - 0.03) < 0.01 for x in p[:4])
    assert post["bbbb-"] > 0.99 and post["gggg-"] < 0.02 and post["ggggb"] > 0.9


def plain_em(rows, rounds=60):
    """Expectation-maximisation over single documents, with plain sums: posteriors and the share of bad ones."""
    labellers = len(rows[0])
    p = [[{"-": 0.2, "g": 0.79, "b": 0.01}, {"-": 0.2, "g": 0.5, "b": 0.3}] for _ in range(labellers)]
    right = ({"g": 1 - quality.ERR, "b": quality.ERR}, {"g": quality.ERR, "b": 1 - quality.ERR})
    p[-1] = [{"-": 0.5} | {v: 0.5 * x for v, x in right[k].items()} for k in (0, 1)]
    share = 0.2
    for _ in range(rounds):
        post = []
        for v in rows:
            good, bad = 1 - share, share
            for j, x in enumerate(v):
                good, bad = good * p[j][0][x], bad * p[j][1][x]
            post.append(bad / (good + bad))
        for j in range(labellers):
            for k in (0, 1):
                sums = {x: 0.5 + sum((q if k else 1 - q) for q, v in zip(post, rows) if v[j] == x) for x in "-gb"}
                total = sum(sums.values())
                p[j][k] = {x: s / total for x, s in sums.items()}
        for k in (0, 1):
            p[-1][k] |= {v: (1 - p[-1][k]["-"]) * x for v, x in right[k].items()}
        share = min(max(sum(post) / len(post), 1e-4), 1 - 1e-4)
    return dict(zip(rows, post)), share


def test_label_model_equals_sums_over_documents():
    r = random.Random(2)
    rows = []
    for _ in range(700):
        bad = r.random() < 0.2
        v = "".join(r.choices("-gb", (2, 2, 6) if bad else (2, 7, 1))[0] for _ in range(3))
        rows.append(v + ("-" if r.random() < 0.6 else "b" if bad else "g"))
    post, share, _ = quality.fit_labellers({v: rows.count(v) for v in set(rows)})
    want, other = plain_em(rows)
    assert abs(share - other) < 1e-9 and all(abs(post[v] - want[v]) < 1e-9 for v in want)


def test_scores_are_the_sums_of_the_scorers_weights(spark):
    """The registered query's rows from votes, label model, training and sums made plainly from all documents at once."""
    rows = corpus(400, 9)
    labels = {i: (q, t) for i, _, q, t in rows if i % 3 == 0}
    got = {r.doc_id: (r.p_junk, r.p_toxic, r.keep) for r in quality.judge_quality(spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string").repartition(3), spark.createDataFrame([(i, *x) for i, x in labels.items()], "doc_id long, quality int, toxic int")).collect()}
    found = {}
    for head, rules, which, bad in (("junk", quality.JUNK, 0, 0), ("toxic", quality.TOXIC, 1, 1)):
        votes = {i: quality.votes(quality.measures(t), rules) + ("-" if i not in labels else "b" if labels[i][which] == bad else "g") for i, t, _, _ in rows}
        counts = {v: list(votes.values()).count(v) for v in set(votes.values())}
        post = quality.corrected(plain_em(list(votes.values()))[0], counts)
        chosen = [(post[votes[i]], votes[i][-1] != "-", t) for i, t, _, _ in rows if post[votes[i]] >= 0.5 or post[votes[i]] <= 0.1]
        model = quality.train_twice(*quality._in_order([np.array(sorted(quality.features(t)), np.int32) for _, _, t in chosen], [p for p, _, _ in chosen], [g for _, g, _ in chosen]))
        weight = dict(zip(model[0].tolist(), model[1].tolist()))
        found[head] = {i: 1 / (1 + math.exp(-(model[2] + sum(weight.get(f, 0.0) for f in quality.features(t))))) for i, t, _, _ in rows}
    for i, (junk, toxic, keep) in got.items():
        assert abs(junk - found["junk"][i]) < 1e-6 and abs(toxic - found["toxic"][i]) < 1e-6
        assert keep == (junk < 0.5 and toxic < 0.5)


def corpus(n, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=r.randint(2, 8)))
    rows = []
    for i in range(n):
        w = [word() for _ in range(r.randint(30, 200))]
        kind = r.random()
        bad, toxic = kind < 0.15, 0.15 <= kind < 0.3
        if kind < 0.05:
            w = [r.choice(w[:3]) for _ in w]
        elif kind < 0.1:
            w = [x.upper() + "!!" for x in w]
        elif bad:
            w = [x + r.choice(["***", "%%%", "###"]) for x in w]
        elif toxic:
            for _ in range(r.randint(3, 8)):
                w.insert(r.randrange(len(w)), r.choice(["idiot", "stupid", "moron"] if kind < 0.22 else ["zuqqa", "zuqqe", "zuqqi"]))
        rows.append((i, " ".join(w), 0 if bad else 1, 1 if toxic else 0))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(3000, 1)
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows if i % 2], "doc_id long, quality int, toxic int")
    keep = {r.doc_id: r.keep for r in quality.judge_quality(docs, labels).collect()}
    held = [x for x in rows if x[0] % 2 == 0]
    good = [keep[i] for i, _, q, t in held if q and not t]
    bad = [not keep[i] for i, _, q, t in held if not q or t]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) > 0.95


def test_junk_that_no_label_covers_is_learnt_from_the_heuristics(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=r.randint(2, 8)))
    rows, labels = [], []
    for i in range(2400):
        w = [word() for _ in range(r.randint(60, 200))]
        if i % 2:  # the labelled source: junk is one word over and over
            bad = i % 8 == 1
            labels.append((i, 0 if bad else 1, 0))
            rows.append((i, " ".join([w[0]] * len(w) if bad else w), bad))
        else:  # the other: junk shouts
            bad = i % 8 == 0
            rows.append((i, " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w), bad))
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string").repartition(4)
    keep = {x.doc_id: x.keep for x in quality.judge_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    shouts, good = [not keep[i] for i, _, bad in rows if bad and i % 2 == 0], [keep[i] for i, _, bad in rows if not bad]
    assert sum(shouts) / len(shouts) > 0.95 and sum(good) / len(good) > 0.99


def test_odd_rows_and_carried_columns(spark):
    rows = [(i, t, "k") for i, t, _, _ in corpus(300, 2)] + [(None, "a b", "n"), (1000, None, None), (1001, "", "e"), (1002, "word " * 30_000, "l"), (5, "again", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep string")
    got = quality.judge_quality(docs, carry=["text"]).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(((i, t) for i, t, _ in rows), key=str)
    by = {r.doc_id: r for r in got}
    assert by[1000].keep and by[1001].keep and not by[1002].keep
    labels = spark.createDataFrame([(None, 0, None), (3, None, None)], "doc_id long, quality int, toxic int")
    assert quality.judge_quality(docs.limit(0), labels).count() == 0
    assert quality.judge_quality(docs.where("doc_id = 1001"), labels).collect()[0].keep
