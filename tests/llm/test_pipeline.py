"""Each stage of the pipeline against a plain version on its own input, and the whole of it."""

import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm.common import new_folder

from .test_lpf import plain as plain_repeats
from .test_quality import corpus
from .test_winnow import plain as plain_contamination


def tables(spark):
    """Documents with junk, toxic ones, copies, passages and benchmark items in known places."""
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefghijklmnopé", k=r.randint(2, 9)))
    rows = [(i, t) for i, t, _, _ in corpus(800, 4)]
    labels = [(i, q, t) for i, _, q, t in corpus(800, 4)]
    items = [(k, " ".join(word() for _ in range(30))) for k in range(10)]
    passage = " ".join(word() for _ in range(60))
    plant = {}
    for k in range(12):
        base = [word() for _ in range(150)]
        near = list(base)
        near[70] = word()
        plant |= {1000 + 10 * k: " ".join(base), 1001 + 10 * k: " ".join(base), 1002 + 10 * k: " ".join(near), 1003 + 10 * k: " ".join(word() for _ in range(100)) + " " + passage, 1004 + 10 * k: " ".join(word() for _ in range(20)) + " " + r.choice(items)[1], 1005 + 10 * k: " ".join(word() for _ in range(120))}
    rows += [*plant.items(), (5000, None), (5001, "")]
    where = new_folder(spark, "tables")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where, items, passage


def similarity(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def whole(raw, edges):
    """A text's bytes without the runs between the edges, less the characters that a run holds only in part."""
    gone, inside = [False] * len(raw), lambda k: k < len(raw) and raw[k] & 0xC0 == 0x80
    for a, z in zip(edges[::2], edges[1::2]):
        while inside(a) and a < z:
            a += 1
        while inside(z) and a < z:
            z -= 1
        gone[a:z] = [True] * (z - a)
    return bytes(x for x, g in zip(raw, gone) if not g)


def test_odd_rows_pass_every_stage(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefghijkl", k=r.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    same, item = text(80), text(30)
    rows = [(None, text(50)), (None, None), (7, same), (7, same), (8, same), (9, text(200_000)), (10, ""), (11, item), (None, item), (12, text(60))]
    extra = "keep boolean, p_junk double, kept string, runs int, n_hit int, component_id string, c0 int, id string, rep long, key int"
    where = new_folder(spark, "tables")
    made = spark.createDataFrame([(i, t, None, None, None, *[None] * 10) for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}").repartition(2)
    made.write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(7, None, 0), (None, 1, 1), (9, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, item), (None, same), (2, None)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    got = corpus_pipeline.run(spark, where).collect()
    assert sorted({x.doc_id for x in got}, key=str) == sorted([7, 9, 10, 12, None], key=str)  # 8 is a near copy; 11 is a benchmark item
    assert len([x for x in got if x.doc_id == 7]) == 2 and len([x for x in got if x.doc_id is None]) == 2
    none = new_folder(spark, "tables")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{where}/{name}.parquet").limit(0).write.parquet(f"{none}/{name}.parquet")
    assert corpus_pipeline.run(spark, none).count() == 0


def test_carried_columns_that_clash_get_another_name(spark):
    from lodestone.llm.quality import judge_quality
    from lodestone.llm.winnow import contamination

    docs = spark.createDataFrame([(1, "a b", "x", 5, 6)], "doc_id long, text string, keep string, n_hit int, keep_in int")
    a = judge_quality(docs, carry=["keep", "n_hit", "keep_in"])
    assert a.columns == ["doc_id", "p_junk", "p_toxic", "keep", "keep_in", "n_hit", "keep_in_in"] and a.first().keep_in == "x"
    b = contamination(docs, spark.createDataFrame([], "item_id long, text string"), carry=["n_hit"])
    assert b.columns == ["doc_id", "n_words", "n_hit", "runs", "items", "n_hit_in"] and (b.first().n_hit, b.first().n_hit_in) == (0, 5)


def test_stages(spark):
    sf_dir, items, passage = tables(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = []
    for name, step in corpus_pipeline.STAGES[:-1]:
        after = step(spark, docs, sf_dir)
        assert after.columns == corpus_pipeline.COLUMNS
        out = new_folder(spark, "stage")
        after.write.parquet(out)
        before, docs = {x.doc_id: x.text for x in docs.collect()}, spark.read.parquet(out)
        rows = docs.collect()
        now = {x.doc_id: x.text for x in rows}
        assert len(now) == len(rows) and set(now) <= set(before)
        seen.append((name, before, now))
    (_, b, n) = seen[0]
    clean = {i for i, _, q, t in corpus(800, 4) if q and not t}
    assert len(clean & set(n)) >= 0.99 * len(clean) and {i for i in b if i >= 1000} <= set(n)
    assert len(set(range(800)) - clean - set(n)) >= 0.95 * len(set(range(800)) - clean)
    (_, b, n) = seen[1]
    gone = set(b) - set(n)
    assert {i + k for i in range(1000, 1120, 10) for k in (1, 2)} <= gone
    assert all(any(similarity(b[i] or "", b[j] or "") >= 0.8 for j in n) for i in gone)
    (_, b, n) = seen[2]
    assert {i: t.encode() for i, t in n.items()} == {i: whole((b[i] or "").encode(), edges) for i, _, _, edges, _ in plain_repeats(list(b.items()), 50)}
    assert sum(passage in (t or "") for t in b.values()) > 5 and sum(passage in t for t in n.values()) == 1
    (_, b, n) = seen[3]
    found = plain_contamination(list(b.items()), items)
    assert set(b) - set(n) == {i for i, (words, hit, _) in found.items() if hit and 20 * hit >= words}
    assert len(set(b) - set(n)) >= 5


def test_run_packs_every_token_of_what_is_left(spark):
    sf_dir, _, _ = tables(spark)
    got = corpus_pipeline.run(spark, sf_dir).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, sf_dir)
    want = {r.doc_id: len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect()}
    sums, sequences = {}, {}
    for r in got:
        sums[r.doc_id] = sums.get(r.doc_id, 0) + r.length
        sequences[r.sequence_id] = sequences.get(r.sequence_id, 0) + r.length
    assert sums == want and max(sequences.values()) <= 4096 and len(sequences) == -(-sum(want.values()) // 4096)
    assert corpus_pipeline.ORACLE_SQL is None
