"""Search over texts: TF-IDF cosine, keyword and substring scores, clusters and their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: English words that no index keeps.
ENGLISH = "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your".split()


def terms(text: Column, grams: int = 2) -> Column:
    """Words of two letters or more in lower case without English stop words, and pairs of neighbours."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)), lambda w: ~w.isin(*ENGLISH))
    if grams == 1:
        return words
    pairs = F.filter(F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b)), lambda p: p.isNotNull())
    return F.concat(words, pairs)


def tfidf(docs: DataFrame, grams: int = 2, features: int | None = 2048) -> tuple[DataFrame, DataFrame]:
    """docs(id, text) -> weights (id, term, weight) of unit length, and (term, idf) of the most frequent terms.

    idf is ln((1 + n) / (1 + df)) + 1; ties among features go to the term that sorts first.
    """
    n = docs.count()
    said = docs.select("id", F.explode(terms(F.col("text"), grams)).alias("term"))
    if features:  # only these are counted by document
        top = cut(said.groupBy("term").agg(F.count("*").alias("total")).orderBy(F.desc("total"), "term").limit(features).select("term"))
        said = said.join(F.broadcast(top), "term", "left_semi")
    tf = cut(said.groupBy("id", "term").agg(F.count("*").alias("tf")))  # read three times below
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = cut(df.select("term", (F.log((F.lit(1.0) + n) / (1 + F.col("df"))) + 1).alias("idf")))
    raw = tf.join(idf, "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("weight")), idf


def find(docs: DataFrame, queries: DataFrame, k: int = 20, grams: int = 2, features: int | None = 2048) -> DataFrame:
    """(query, id, score, rank): for each of queries(id, text) the k docs of largest cosine above 0, ties by id."""
    weights, idf = tfidf(docs, grams, features)
    tf = queries.select(F.col("id").alias("query"), F.explode(terms(F.col("text"), grams)).alias("term")).groupBy("query", "term").agg(F.count("*").alias("tf"))
    q = tf.join(idf, "term").select("query", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = q.groupBy("query").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    q = q.join(norm, "query").select("query", "term", (F.col("w") / F.col("norm")).alias("wq"))
    score = F.round(F.sum(F.col("wq") * F.col("weight")), 6)
    found = q.join(weights, "term").groupBy("query", "id").agg(score.alias("score")).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def module_text() -> Column:
    """What a module is searched and clustered by: words of its path, its purpose and its public functions."""
    return F.concat_ws(" ", F.regexp_replace("path", r"[/._]", " "), F.col("purpose"), F.array_join("public_functions", " "))


def vectors(docs: DataFrame, weights: DataFrame, idf: DataFrame) -> DataFrame:
    """(id, v): the weights of each doc as an array, by the place of terms in the order of their names; none are zeros."""
    place = idf.select("term", (F.row_number().over(Window.orderBy("term")) - 1).alias("k"))  # 2048 terms at most
    size = max(1, place.count())
    found = weights.join(F.broadcast(place), "term").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "weight"))).alias("x"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.coalesce(F.try_element_at("x", k), F.lit(0.0)))
    return docs.select("id").join(found, "id", "left").select("id", filled.alias("v"))


def keyword_score(text: Column, query: str) -> Column:
    """How often the query's words (of two letters or more) occur, per word."""
    from ..functions.text import occurrences

    words = [w for w in query.lower().split() if len(w) > 1]
    total = F.lit(0)
    for w in words:
        total = total + occurrences(F.lower(text), F.lit(w))
    return total / max(1, len(words))


def substring_search(rows: DataFrame, text: Column, query: str, id_col: str = "path", k: int = 25) -> DataFrame:
    """The k rows in which the lower-cased query occurs most; an empty query gives the first k."""
    from ..functions.text import occurrences

    if not query.strip():
        return rows.withColumn("score", F.lit(0).cast("long")).orderBy(id_col).limit(k)
    return rows.withColumn("score", occurrences(F.lower(text), F.lit(query.strip().lower()))).where("score > 0").orderBy(F.desc("score"), id_col).limit(k)


def clusters_for(n: int, wanted: int = 5) -> int:
    return n if n < 5 else min(8, max(5, wanted))


def cluster(vectors: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """vectors(id, v array<double>) -> (id, cluster) by k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    features = vectors.select("id", array_to_vector("v").alias("features"))
    return KMeans(k=k, seed=seed).fit(features).transform(features).select("id", F.col("prediction").alias("cluster"))


def cluster_names(weights: DataFrame, clusters: DataFrame, top: int = 3) -> DataFrame:
    """(cluster, name): domain_a_b_c of the terms of largest mean weight in a cluster."""
    size = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    mean = weights.join(clusters, "id").groupBy("cluster", "term").agg(F.sum("weight").alias("w")).join(size, "cluster").withColumn("w", F.col("w") / F.col("size"))
    best = mean.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("w"), "term"))).where(F.col("rank") <= top)
    name = F.concat(F.lit("domain_"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: F.regexp_replace(x["term"], r"\W+", "_")), "_"))
    return size.select("cluster").join(best.groupBy("cluster").agg(name.alias("name")), "cluster", "left").select("cluster", F.coalesce("name", F.concat(F.lit("domain_"), F.col("cluster").cast("string"))).alias("name"))
