"""Quality classifier from weak labels: junk and toxic texts.

1. Heuristic labellers vote on each whole text (bad, good, or no opinion); rows of a table of labels vote too,
   where there are any.
2. Votes are counted by pattern over all documents (at most 3 ** labellers patterns). Expectation-maximisation on
   these counts estimates how each labeller votes on good and on bad documents, and the share of bad ones; that gives
   each pattern's posterior. Junk and toxicity are judged apart.
   Where given labels speak for a part of the documents on which the heuristics vote alike, their shares correct the
   posterior of the rest.
3. Documents with clear posteriors, at most TRAIN of each kind with a given label and TRAIN without, train a hashed
   linear scorer: presence of words and their first letters (hashed; only slots that tell the kinds apart in either part) and levels
   of style. A first scorer, of the sure ones, revises the posteriors of the others; all train the second. Where it
   cuts is set on the same documents, as far as they are sure.
4. The scorer reads every whole text, and decides.
"""

from __future__ import annotations

import itertools
import math
import string
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, carried, picked, renamed, small_batches, stage, unstage

#: Documents of each kind (bad, good) that a scorer is trained on at most, with given labels and as many without.
TRAIN = 2_000
#: An estimated posterior counts as much as so many given labels on the same votes.
PRIOR = 10
#: A document without a given label whose chance of being the other kind is above this is not sure.
SURE = 0.01
#: Slots of hashed words; a slot counts if its shares among bad and good texts differ by so many standard errors.
SLOTS, CLEAR, FEWEST = 1 << 18, 6.0, 10
#: And a word's shares must differ by this factor, so that a line that is merely common tells nothing.
FACTOR = 5.0
#: A good text rejected costs as much as so many bad ones missed (in shares of their kinds).
COST = 10.0
#: Share of given labels that are taken to be wrong.
ERR = 0.00005
#: Words of abuse that the toxic labellers know.
ABUSE = frozenset("clown disgusting dumb filth fool garbage idiot jerk loser moron pathetic scum stupid trash vermin worthless".split())
#: (name, good up to, bad from) of each labeller of junk; the measure in between is no opinion. Turned: good from, bad up to.
JUNK = (("top_word", 0.15, 0.25), ("distinct", -0.45, -0.3), ("upper", 0.1, 0.4), ("signs", 0.08, 0.15), ("exclaims", 0.1, 0.5), ("repeated_lines", 0.4, 0.7))
#: The same for toxicity: different words of abuse, and the share of such words (they speak for one language only).
TOXIC = (("abuse_kinds", 0.0, 2.0), ("abuse_share", 0.0, 0.01))
STYLE = [n for n, _, _ in JUNK]
#: Edges of the levels of style measures.
LEVELS = np.array([0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.6, 0.7, 0.8, 0.9])
HEADS = ("junk", "toxic")
_STRIP = string.punctuation + "«»“”„…¿¡"
_UPPER, _LETTERS, _SIGNS = string.ascii_uppercase.encode(), string.ascii_letters.encode(), bytes(c for c in range(33, 127) if not chr(c).isalnum())


def words_of(text: str) -> list[str]:
    return [w.strip(_STRIP) for w in text.lower().split()]


def measures(text: str) -> dict[str, float]:
    """Style and abuse measures of a whole text; an empty one has none of anything (and is all distinct)."""
    raw, found, n = text.encode(), text.split(), 0
    counts = Counter(found)
    n = max(1, len(found))
    letters = len(raw) - len(raw.translate(None, _LETTERS))
    lines = [x for x in text.split("\n") if x.strip()]
    few = len(found) < 20  # shares of a few words tell nothing
    out = {
        "top_word": 0.0 if few else max(counts.values()) / n,
        "distinct": -1.0 if few else -len(counts) / n,
        "upper": (len(raw) - len(raw.translate(None, _UPPER))) / letters if letters > 40 else 0.0,
        "signs": (len(raw) - len(raw.translate(None, _SIGNS))) / max(20, len(raw)),
        "exclaims": text.count("!") / n if not few else 0.0,
        "repeated_lines": 1 - len(set(lines)) / len(lines) if len(lines) > 4 else 0.0,
    }
    abuse = Counter({w: c for w, c in Counter(x.lower().strip(_STRIP) for x in counts).items() if w in ABUSE})
    hits = sum(c for w, c in counts.items() if w.lower().strip(_STRIP) in abuse) if abuse else 0
    return out | {"abuse": float(hits), "abuse_kinds": float(len(abuse)), "abuse_share": hits / n}


def votes(m: dict[str, float], rules) -> str:
    return "".join("b" if m[k] >= bad else "g" if m[k] <= good else "-" for k, good, bad in rules)


def _vote_batches(batches):
    schema = pa.schema([("id", pa.int64()), ("junk", pa.string()), ("toxic", pa.string())])
    for b in batches:
        ms = [measures(t) for t in b.column(1).fill_null("").to_pylist()]
        yield batch(schema, b.column(0), [votes(m, JUNK) for m in ms], [votes(m, TOXIC) for m in ms])


def fit_labellers(counts: dict[str, int], rounds: int = 60) -> tuple[dict[str, float], float, np.ndarray]:
    """Posterior of bad for each pattern of votes, the share of bad documents, and P(vote | kind) by labeller.

    Labellers are taken to be independent given the kind. Each starts as one that knows some of the bad documents and
    seldom accuses a good one, which fixes what bad means: there are many ways to be bad. The last is the given labels: how often
    they speak is estimated, but not that they are right (all but ERR of them). They anchor the others, which may well
    be wrong together.
    """
    if not counts:
        return {}, 0.0, np.empty((0, 2, 3))
    patterns = sorted(counts)
    v = np.array([["-gb".index(c) for c in p] for p in patterns])
    n = np.array([counts[p] for p in patterns], float)
    seen = np.stack([(v == k) for k in range(3)], 2)  # pattern, labeller, vote
    p = np.tile(np.array([[0.2, 0.79, 0.01], [0.2, 0.5, 0.3]]), (v.shape[1], 1, 1))
    right = np.array([[1 - ERR, ERR], [ERR, 1 - ERR]])
    p[-1] = np.concatenate([[[0.5], [0.5]], 0.5 * right], 1)
    share, post = 0.2, np.zeros(len(n))
    for _ in range(rounds):
        log = np.einsum("plv,lkv->pk", seen, np.log(p)) + np.log([1 - share, share])
        post = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        weight = np.stack([n * (1 - post), n * post], 1)
        p = np.einsum("pk,plv->lkv", weight, seen) + 0.5
        p /= p.sum(2, keepdims=True)
        p[-1, :, 1:] = (1 - p[-1, :, :1]) * right
        share = min(max(weight[:, 1].sum() / n.sum(), 1e-4), 1 - 1e-4)
    return dict(zip(patterns, post.tolist())), share, p


def corrected(post: dict[str, float], counts: dict[str, int]) -> dict[str, float]:
    """Posteriors in which patterns without a given label follow the labels given to documents with the same votes.

    The labellers see the same words, so they err together more than fit_labellers() takes them to; whether a document
    has a label is taken to be independent of its kind.
    """
    out = dict(post)
    for p in post:
        if p[-1] == "-":
            bad, good = counts.get(p[:-1] + "b", 0), counts.get(p[:-1] + "g", 0)
            out[p] = (PRIOR * post[p] + bad) / (PRIOR + bad + good)
    return out


def features(text: str, m: dict[str, float] | None = None) -> list[int]:
    """Slots of a text: its distinct words and their first letters, then a level of each style measure."""
    m = m or measures(text)
    words = set(words_of(text))
    words |= {w[:4] + "*" for w in words} | {w[:5] + "*" for w in words if len(w) > 4}
    slots = {zlib.crc32(w.encode()) % SLOTS for w in words if w}
    width = len(LEVELS) + 1
    return [*slots, *(SLOTS + k * width + int(np.searchsorted(LEVELS, abs(m[name]), "right")) for k, name in enumerate(STYLE))]


def train(rows: list[np.ndarray], target: np.ndarray, given: np.ndarray, steps: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """(slots, weights, bias) of a logistic scorer that rejects above zero. target: posteriors of bad; given: has a label."""
    bad = target > 0.5
    if not bad.any() or bad.all():
        return np.empty(0, np.int64), np.empty(0), -20.0
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    size = SLOTS + len(STYLE) * (len(LEVELS) + 1)
    telling = np.zeros(size, bool)
    for part in (given, ~given, np.ones(len(rows), bool)):
        n1, n0 = (bad & part).sum(), (~bad & part).sum()
        if not n1 or not n0:
            continue
        c1, c0 = np.bincount(flat[(bad & part)[owner]], minlength=size), np.bincount(flat[(~bad & part)[owner]], minlength=size)
        mean = (c1 + c0) / (n1 + n0)
        z = (c1 / n1 - c0 / n0) / np.sqrt(np.maximum(mean * (1 - mean), 1e-9) * (1 / n1 + 1 / n0))
        ratio = np.abs(np.log(((c1 + 0.5) / (n1 + 1)) / ((c0 + 0.5) / (n0 + 1))))
        telling |= (np.abs(z) >= CLEAR) & (ratio >= math.log(FACTOR)) & (c1 + c0 >= FEWEST)
    telling[SLOTS:] = np.bincount(flat, minlength=size)[SLOTS:] >= FEWEST
    slots = np.flatnonzero(telling)
    number = np.full(size, -1)
    number[slots] = np.arange(len(slots))
    col, row = number[flat], owner
    row, col = row[col >= 0], col[col >= 0]
    w, b = np.zeros(len(slots)), 0.0
    gw, gb = np.full(len(slots), 1e-8), 1e-8
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(row, w[col], len(rows)), -30, 30)))
        e = (p - target) / len(rows)
        g, h = np.bincount(col, e[row], len(slots)) + 1e-4 * w, e.sum()
        gw, gb = gw + g * g, gb + h * h
        w, b = w - 0.5 * g / np.sqrt(gw), b - 0.5 * h / math.sqrt(gb)
    logit, sure = b + np.bincount(row, w[col], len(rows)), given | (np.minimum(target, 1 - target) <= SURE)
    if not (bad[sure].any() and (~bad[sure]).any()):
        sure = np.ones(len(rows), bool)
    return slots, w, b - _cut_point(logit[sure], bad[sure])


def _cut_point(logit: np.ndarray, bad: np.ndarray) -> float:
    """Where the share of missed bad texts plus COST times that of good ones rejected is least, in the middle of a gap."""
    order = np.argsort(logit)
    x, is_bad = logit[order], bad[order]
    missed = np.concatenate([[0], np.cumsum(is_bad)]) / is_bad.sum()
    wrong = 1 - np.concatenate([[0], np.cumsum(~is_bad)]) / (~is_bad).sum()
    edge = np.concatenate([[x[0] - 1], x, [x[-1] + 1]])
    cost = np.where(np.concatenate([[True], x[1:] > x[:-1], [True]]), missed + COST * wrong, np.inf)
    k = int(np.argmin(cost))
    return float((edge[k] + edge[k + 1]) / 2)


def _feature_batches(batches):
    """Rows text, (posterior, given) of each head -> the text's slots, and the rest as it is."""
    said = [(f"{h}_{c}", t) for h in HEADS for c, t in (("post", pa.float64()), ("given", pa.bool_()))]
    schema = pa.schema([("slots", pa.list_(pa.int32())), *said])
    for b in batches:
        yield batch(schema, [sorted(features(t)) for t in b.column(0).fill_null("").to_pylist()], *b.columns[1:])


def _train_batches(batches):
    schema = pa.schema([("head", pa.string()), ("slots", pa.list_(pa.int64())), ("weights", pa.list_(pa.float64())), ("bias", pa.float64())])
    rows = {h: ([], [], []) for h in HEADS}
    for b in batches:
        for slots, *said in zip(*[c.to_pylist() for c in b.columns]):
            f = np.array(slots, np.int32)
            for k, h in enumerate(HEADS):
                if said[2 * k] is not None:
                    for kept, x in zip(rows[h], (f, *said[2 * k : 2 * k + 2])):
                        kept.append(x)
    made = [(h, *train_twice(*_in_order(*x))) for h, x in rows.items()]
    yield batch(schema, [m[0] for m in made], [m[1].tolist() for m in made], [m[2].tolist() for m in made], [m[3] for m in made])


def train_twice(rows: list[np.ndarray], target: np.ndarray, given: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """train() on all rows, where a scorer of the sure ones speaks as one more labeller for the others."""
    sure = given | (np.minimum(target, 1 - target) <= SURE)
    slots, w, b = train([x for x, ok in zip(rows, sure) if ok], target[sure], given[sure])
    if sure.all() or not len(slots):
        return train(rows, target, given)
    weight = dict(zip(slots.tolist(), w.tolist()))
    logit = np.array([b + sum(filter(None, map(weight.get, x.tolist()))) for x, ok in zip(rows, sure) if not ok])
    prior = np.clip(target[~sure], 1e-6, 1 - 1e-6)
    target = target.copy()
    target[~sure] = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + logit, -30, 30)))
    return train(rows, target, given)


def _in_order(rows, targets, given):
    order = sorted(range(len(rows)), key=lambda k: (targets[k], rows[k].tobytes()))  # the same sums whatever the order of rows
    return [rows[k] for k in order], np.array([targets[k] for k in order]), np.array([given[k] for k in order], bool)


def _score_batches(models: dict[str, tuple[dict[int, float], float]], others: pa.Schema):
    schema = pa.schema([("id", pa.int64()), ("p_junk", pa.float64()), ("p_toxic", pa.float64()), *others])

    def run(batches):
        for b in batches:
            out = []
            for text in b.column(1).fill_null("").to_pylist():
                f = features(text)
                out.append([1 / (1 + math.exp(-max(-500, min(500, bias + sum(filter(None, map(w.get, f))))))) for w, bias in (models[h] for h in HEADS)])
            yield batch(schema, b.column(0), [x for x, _ in out], [x for _, x in out], *b.columns[2:])

    return run


def judge_quality(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """id, p_junk, p_toxic and keep (both below a half) of each row of docs, and the columns named in carry.

    labels: (id_col, quality 0/1, toxic 0/1), one more labeller of each kind; ids without a label, and nulls, are no
    opinion, and the worst of repeated labels counts. A null or empty text is judged like any other (it has no word and
    no style, and is kept unless labellers say otherwise); repeated rows and rows with a null id each give a row. If the
    label model finds no clear bad (or good) documents, none are rejected; empty tables give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = picked(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    voted = rows.mapInArrow(_vote_batches, "id long, junk string, toxic string")
    given = labels.select(F.col(id_col).cast("long").alias("id"), F.col("quality").alias("quality"), F.col("toxic").alias("harm")) if labels is not None else spark.createDataFrame([], "id long, quality int, harm int")
    given = given.where("id is not null").groupBy("id").agg(F.min("quality").alias("quality"), F.max("harm").alias("harm"))
    said = lambda c, bad: F.when(F.col(c).isNull(), "-").when(F.col(c) == bad, "b").otherwise("g")
    voted = voted.join(given, "id", "left").select("id", F.concat("junk", said("quality", 0)).alias("junk"), F.concat("toxic", said("harm", 1)).alias("toxic"))
    voted = stage(spark, voted, "votes")
    chosen = []
    for head in HEADS:
        counts = {r[head]: r["count"] for r in voted.groupBy(head).count().collect()}
        post = corrected(fit_labellers(counts)[0], counts)
        for clear in ({p: x for p, x in post.items() if x >= 0.5}, {p: x for p, x in post.items() if x <= 0.1}):
            for part in ({p: x for p, x in clear.items() if p[-1] != "-"}, {p: x for p, x in clear.items() if p[-1] == "-"}):
                if part:
                    names = F.create_map(*itertools.chain.from_iterable((F.lit(p), F.lit(x)) for p, x in part.items()))
                    best = voted.where(F.col("id").isNotNull() & F.col(head).isin(*part)).select("id", F.lit(head).alias("head"), names[F.col(head)].alias("post"), (~F.endswith(head, F.lit("-"))).alias("given"))
                    chosen.append(best.orderBy(F.xxhash64("id"), "id").limit(TRAIN))
    models = {h: ({}, -20.0) for h in HEADS}
    if chosen:
        sample = chosen[0]
        for x in chosen[1:]:
            sample = sample.union(x)
        sample = sample.groupBy("id").agg(*[F.max(F.when(F.col("head") == h, F.col(c))).alias(f"{h}_{c}") for h in HEADS for c in ("post", "given")])  # 8 * TRAIN ids at most
        chosen_rows = rows.join(F.broadcast(sample), "id").select("text", *sample.columns[1:])
        sample = stage(spark, chosen_rows.mapInArrow(_feature_batches, "slots array<int>, " + ", ".join(f"{h}_post double, {h}_given boolean" for h in HEADS)), "training")
        fitted = sample.coalesce(1).mapInArrow(_train_batches, "head string, slots array<long>, weights array<double>, bias double")
        models = {r["head"]: (dict(zip(r["slots"], r["weights"])), r["bias"]) for r in fitted.collect()}
        unstage(spark, sample)
    unstage(spark, voted)
    columns, others, kinds = carried(docs, carry)
    whole = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"), *columns)
    scored = whole.mapInArrow(_score_batches(models, others), "id long, p_junk double, p_toxic double" + kinds)
    kept = (F.col("p_junk") < 0.5) & (F.col("p_toxic") < 0.5)
    return renamed(scored.select("id", "p_junk", "p_toxic", kept.alias("keep"), *others.names), carry, id=id_col)
