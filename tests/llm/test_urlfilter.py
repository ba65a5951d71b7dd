"""URL rules against plain Python, and the models' accuracy on URLs held out from the rules."""

import math
import random
from collections import Counter

from lodestone.llm import urlfilter


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fits = [r for r, _ in urlfilter.RULES if (host == (n := r.split("/")[0]) or host.endswith("." + n)) and path.startswith(r[len(n) :])]
    return max(fits, key=len, default=None)


URLS = [None, "", "no scheme", "http://", "http://NET/", "http://net", "HTTP://a.Example.NET/en/x?y#z", "http://example.net/EN/", "https://example.com/de/1", "ftp://x.org/fr/", "http://x.org#/fr/", "http://x.org?/fr/", "http://internet/", "a://b://net/", "http://x.org/fr\n/", "http://ÄB.org/fr/é", "http://h\n.net/p\nq?z", "http://example.net/en/" + "a" * 5000]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r.page_id: r for r in urlfilter.judge_urls(df).collect()}
    for k, u in enumerate(URLS):
        h, p = parts(u)
        assert (got[k].host, got[k].path, got[k].rule) == (h, p, rule(h, p)), u
        if got[k].rule:
            assert got[k].verdict == dict(urlfilter.RULES)[got[k].rule]
        assert got[k].verdict in ("allow", "block")


def plain_ratio(texts):
    """Witten-Bell models in plain Python: the mean log ratio of a text."""
    def classes(t):
        t = "".join("0" if c in "123456789" else c.lower() if c.isascii() else c for c in t)
        return [39, 39, *[urlfilter.ALPHABET.find(c) if c in urlfilter.ALPHABET else 38 for c in t]]

    def model(those):
        tri, bi, uni = Counter(), Counter(), Counter()
        for t in those:
            c = classes(t)
            for a, b, d in zip(c, c[1:], c[2:]):
                tri[a, b, d] += 1
                bi[b, d] += 1
                uni[d] += 1

        def p(a, b, d):
            q = 1 / 40
            for counts, context in ((uni, ()), (bi, (b,)), (tri, (a, b))):
                follow = {k: n for k, n in counts.items() if (k[:-1] if isinstance(k, tuple) else ()) == context}
                t = sum(follow.values())
                key = (*context, d) if context else d
                q = (follow.get(key, 0) + len(follow) * q) / (t + len(follow)) if t else q
            return q

        return p

    pa, pb = model(texts["allow"]), model(texts["block"])

    def score(t):
        c = classes(t)
        x = [math.log(pa(*g) / pb(*g)) for g in zip(c, c[1:], c[2:])]
        return sum(x) / len(x) if x else 0.0

    return score


def test_scores_equal_plain_models(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    got = urlfilter.judge_urls(df).collect()
    texts = {"allow": [], "block": []}
    held = {r.t for r in spark.createDataFrame([(r.host, r.path) for r in got], "host string, path string").selectExpr("concat(host, path) AS t", f"pmod(xxhash64(host, path), {urlfilter.HELD}) = 0 AS held").where("held").collect()}
    assert held
    for r in got:
        if r.rule and r.host + r.path not in held:
            texts[r.verdict].append(r.host + r.path)
    score = plain_ratio(texts)
    for r in got:
        assert abs(r.score - score(r.host + r.path)) < 1e-6


def test_held_out_accuracy(spark):
    r = random.Random(1)
    word = lambda kind: "".join(r.choices("aeioulmn" if kind else "xzkqwvjy", k=8))
    rows = []
    for k in range(600):
        good = r.random() < 0.5
        seen = k < 400
        host = f"{word(good)}.{'org' if good else 'net'}" if seen else f"{word(good)}.info"
        rows.append((k, f"http://{host}/{'fr/' if good and seen else ''}{word(good)}", good))
    got = urlfilter.judge_urls(spark.createDataFrame([x[:2] for x in rows], "page_id long, url string")).collect()
    right = [(x.verdict == "allow") == rows[x.page_id][2] for x in got if x.rule is None]
    assert len(right) == 200 and sum(right) >= 190


def test_no_rows(spark):
    assert urlfilter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
