"""Terms of texts in several languages."""

from pyspark.sql import functions as F

from lodestone.operators import search


def test_terms_keep_letters_beyond_ascii(spark):
    df = spark.createDataFrame([("Größe señal_2 naïve über",)], "text string")
    got = df.select(search.terms(F.col("text"), 1).alias("x")).first().x
    assert got == ["größe", "señal_2", "naïve", "über"]


def test_clusters_and_their_names(spark):
    words = {"north": "snow ice fir", "south": "sand palm sun", "mid": "rain oak fog"}
    docs = spark.createDataFrame([(f"{k}{i}", f"{v} {v}") for k, v in words.items() for i in range(6)], "id string, text string")
    weights, idf = search.tfidf(docs, grams=1)
    got = search.cluster(search.vectors(docs, weights, idf), 3)
    kinds = {}
    for r in got.collect():
        kinds.setdefault(r.cluster, set()).add(r.id[:-1])
    assert sorted(map(sorted, kinds.values())) == [["mid"], ["north"], ["south"]]
    names = {r.cluster: r.name for r in search.cluster_names(weights, got).collect()}
    assert {kinds[c].pop(): n for c, n in names.items()} == {"north": "domain_fir_ice_snow", "south": "domain_palm_sand_sun", "mid": "domain_fog_oak_rain"}
    assert [search.clusters_for(n) for n in (0, 3, 5, 100)] == [0, 3, 5, 5]
