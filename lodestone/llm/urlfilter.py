"""URL filter: host rules, then a ratio of two character language models. DataFrame functions only.

The models are variable-order Markov chains over characters of host and path (one for URLs that rules allow, one
for those that rules block), smoothed by backing off with Witten-Bell weights: order 2 over order 1 over order 0
over a uniform alphabet. Characters fall into 40 classes, so a model has at most 64,000 trigrams whatever the
number of URLs: counting is one partially aggregated shuffle, and both models travel as one array in the plan. A
URL's score is the mean of the log-likelihood differences of its characters. One in HELD of the rules' own URLs (by a
hash of the URL, so equal ones go together) is held out of the counts, and the threshold is calibrated on these, from
two histograms of a fixed number of bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import picked, stage

#: (rule, verdict): the host and its subdomains, from the first slash on the path's start.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Classes of characters: these, any other letter or sign (38), and the start of the text (39).
ALPHABET, CLASSES = "abcdefghijklmnopqrstuvwxyz0./-_=?&%:~", 40
OTHER, START = 38, 39
BINS, SPREAD, HELD = 400, 4.0, 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def verdict_of(rule: Column, rules=RULES) -> Column:
    out = F.lit(None).cast("string")
    for name, verdict in rules:
        out = F.when(rule == name, F.lit(verdict)).otherwise(out)
    return out


def trigrams(host: Column, path: Column) -> Column:
    """Numbers of the trigrams of classes, one for each character; digits are one class."""
    text = F.translate(F.concat(host, path), _UPPER + "123456789", _LOWER + "000000000")
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    classes = F.transform(chars, lambda c: F.coalesce(F.nullif(F.instr(F.lit(ALPHABET), c), F.lit(0)) - 1, F.lit(OTHER)))
    padded = F.concat(F.array(F.lit(START), F.lit(START)), classes)
    rest = lambda k: F.slice(padded, k, F.size(chars) + 2)
    pairs = F.zip_with(padded, rest(2), lambda a, b: a * CLASSES + b)  # each array is made once for a row, not for a character
    return F.filter(F.zip_with(pairs, rest(3), lambda p, c: p * CLASSES + c), lambda g: g.isNotNull())


def _model(counts: DataFrame, name: str) -> DataFrame:
    """Log-probability of each class after each pair of classes: rows (trigram, name) for all CLASSES ** 3 trigrams.

    counts: (trigram, n). With a context's total t and number of distinct followers d, the order's own estimate has
    weight t / (t + d), and the next lower order the rest.
    """
    tri = counts.withColumns({"pair": F.expr(f"trigram div {CLASSES}"), "last": F.col("trigram") % CLASSES})
    tri = tri.withColumn("one", F.col("pair") % CLASSES)
    bi = tri.groupBy("one", "last").agg(F.sum("n").alias("n2"))
    uni = bi.groupBy("last").agg(F.sum("n2").alias("n1"))
    all_ = F.broadcast(uni.agg(F.coalesce(F.sum("n1"), F.lit(0)).alias("t0"), F.count("*").alias("d0")).withColumn("k", F.lit(0)))
    grid = counts.sparkSession.range(0, CLASSES**3, 1, 4).select(F.col("id").alias("trigram"), F.expr(f"id div {CLASSES}").alias("pair"), (F.expr(f"id div {CLASSES}") % CLASSES).alias("one"), (F.col("id") % CLASSES).alias("last"), F.lit(0).alias("k"))
    grid = grid.join(F.broadcast(tri.select("trigram", "n")), "trigram", "left").join(F.broadcast(tri.groupBy("pair").agg(F.sum("n").alias("t3"), F.count("*").alias("d3"))), "pair", "left")
    grid = grid.join(F.broadcast(bi), ["one", "last"], "left").join(F.broadcast(bi.groupBy("one").agg(F.sum("n2").alias("t2"), F.count("*").alias("d2"))), "one", "left")
    grid = grid.join(F.broadcast(uni), "last", "left").join(all_, "k")

    def mixed(n: str, t: str, d: str, lower: Column) -> Column:
        t, d = F.coalesce(t, F.lit(0)), F.coalesce(d, F.lit(0))
        return F.when(t == 0, lower).otherwise((F.coalesce(n, F.lit(0)) + d * lower) / (t + d))

    p = mixed("n", "t3", "d3", mixed("n2", "t2", "d2", mixed("n1", "t0", "d0", F.lit(1.0 / CLASSES))))
    return grid.select("trigram", F.log(p).alias(name))


def _threshold(scored: DataFrame) -> float:
    """The score that separates allowed and blocked URLs best: the sum of both shares of right verdicts is largest."""
    width = 2 * SPREAD / BINS
    place = F.least(F.greatest(F.floor((F.col("score") + SPREAD) / width), F.lit(0)), F.lit(BINS - 1))
    bins = {r["bin"]: (r["good"], r["bad"]) for r in scored.groupBy(place.cast("int").alias("bin")).agg(F.sum(F.when(F.col("label") == "allow", 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("label") == "block", 1).otherwise(0)).alias("bad")).collect()}
    good, bad = sum(g for g, _ in bins.values()), sum(b for _, b in bins.values())
    if not good or not bad:
        return 0.0
    passed, best, at, worth = 0, -1.0, 0.0, 0
    low = 0
    for k in range(BINS + 1):
        value = (good - low) / good + worth / bad
        if value > best:
            best, at = value, k * width - SPREAD
        g, b = bins.get(k, (0, 0))
        low, worth, passed = low + g, worth + b, passed + g + b
    return at


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """id, host, path, rule, verdict and score of each row.

    A null url, or one without ://, has an empty host and path, fits no rule, and scores 0. Without URLs that rules
    allow (or block) that model is uniform; without held ones of either kind the threshold is 0. Scores at the threshold
    or above are allowed. Repeated rows, rows with a null id and urls of any length each give a row; empty tables give none.
    """
    spark = pages.sparkSession
    rows = picked(pages, id=id_col, url=url_col)
    rows = rows.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("label", verdict_of(F.col("rule"), rules))
    held = F.pmod(F.xxhash64("host", "path"), F.lit(HELD)) == 0
    counted = rows.where(F.col("label").isNotNull() & ~held).select("label", F.explode(trigrams(F.col("host"), F.col("path"))).alias("trigram")).groupBy("label", "trigram").agg(F.count("*").alias("n"))
    counted = stage(spark, counted, "trigrams")  # 2 * CLASSES ** 3 rows at most
    both = _model(counted.where("label = 'allow'").drop("label"), "a").join(_model(counted.where("label = 'block'").drop("label"), "b"), "trigram")
    table = both.agg(F.array_sort(F.collect_list(F.struct("trigram", (F.col("a") - F.col("b")).alias("d")))).alias("x")).select(F.transform("x", lambda e: e["d"]).alias("ratio"))
    ratio = F.broadcast(stage(spark, table.withColumn("k", F.lit(0)), "ratios"))  # one row of CLASSES ** 3 numbers
    grams = trigrams(F.col("host"), F.col("path"))
    total = F.aggregate(grams, F.lit(0.0), lambda s, g: s + F.element_at(F.col("ratio"), (g + 1).cast("int")))
    score = F.coalesce(F.round(total / F.nullif(F.size(grams), F.lit(0)), 9), F.lit(0.0))
    scored = rows.withColumn("k", F.lit(0)).join(ratio, "k").select("id", "host", "path", "rule", "label", score.alias("score"))
    least = _threshold(scored.where(F.col("label").isNotNull() & held))
    other = F.when(F.col("score") >= least, "allow").otherwise("block")
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("label", other).alias("verdict"), "score")
