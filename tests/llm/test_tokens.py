"""Token counts, token files and packing against the library itself."""

import functools
import random
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestone.llm import packing, token_files
from lodestone.llm.common import new_folder
from lodestone.llm.tokens import PieceEncoder, count_by_chunks, count_tokens, encoder

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ALPHABET = ["a", "The", " ", " ", "\n", "\t", "\r\n", "  ", "'s", "'r", "e", "é", "é", "́", "ñ", " ", " ", "\x1c", "\x85", "\0", "1", "٣", "²", ",", ".", "!!", "<|endoftext|>", "<|startoftext|>", "<|endo", "日本", "🙂", "ÀB", "ß", "İ", "Σ", "﻿"]


def texts(n, seed, most=40):
    r = random.Random(seed)
    return [None, "", " ", "\n\n", *["".join(r.choices(ALPHABET, k=r.randint(1, most))) for _ in range(n)]]


load = functools.cache(Tokenizer.from_file)


def ids(path, text):
    return load(path).encode(text or "", add_special_tokens=False).ids


def crc(x):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in x))


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_pieces_give_the_librarys_ids(path):
    t, encode = Tokenizer.from_file(path), PieceEncoder(path)
    for text in texts(4000, 1)[1:]:
        want = t.encode(text, add_special_tokens=False).ids
        got = encode(text)
        assert [int.from_bytes(got[k : k + 4], "little") for k in range(0, len(got), 4)] == want, repr(text)


def test_chunks_give_the_librarys_count():
    t = Tokenizer.from_file(BYTES)
    for text in [*texts(300, 2, 400)[1:], "x" * 3000, " " * 3000, "ab " * 1000, "<|endoftext|>" * 200, "a\n" * 900]:
        want = len(t.encode(text, add_special_tokens=False).ids)
        for chunk, overlap in ((150, 40), (150, 70), (200, 120)):
            assert count_by_chunks(t, text, chunk, overlap) == want


def test_counts(spark):
    rows = [(i if i != 5 else None, t, 0) for i, t in enumerate([*texts(200, 3), "word " * 1100])]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)
    got = sorted(map(tuple, count_tokens(df, BYTES, chunk=100, overlap=50).collect()), key=str)
    want = [(i, len((t or "").encode()), n := len(ids(BYTES, t)), n > 1024) for i, t, _ in rows]
    assert got == sorted(want, key=str)
    assert count_tokens(df.limit(0), BYTES).count() == 0


def test_token_files_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(texts(150, 4))]
    random.Random(0).shuffle(rows)
    out = new_folder(spark, "tokens")
    token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), out, BYTES)
    back = token_files.read_tokens(spark, out)
    assert {r.id: list(r.tokens) for r in back.collect()} == {i: [*ids(BYTES, t), 0] for i, t in rows}
    got = {r.id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.starts(token_files.checksums(back), back).collect()}
    at = 0
    for i, t in sorted(rows):
        x = [*ids(BYTES, t), 0]
        assert got[i] == (at, len(x), crc(x))
        at += len(x)
    empty = new_folder(spark, "tokens")
    token_files.write_tokens(spark.createDataFrame([], "doc_id long, text string"), empty, BYTES)
    back = token_files.read_tokens(spark, empty)
    assert token_files.starts(token_files.checksums(back), back).count() == 0


def test_token_files_keep_repeats_and_null_ids(spark):
    out = new_folder(spark, "tokens")
    token_files.write_tokens(spark.createDataFrame([(None, "a"), (2, "b b"), (2, "b b"), (2, None)], "doc_id long, text string"), out, BYTES)
    back = token_files.read_tokens(spark, out)
    rows = token_files.starts(token_files.checksums(back), back).orderBy("start").collect()
    assert [(r.id, r.start, r.n_tokens) for r in rows] == [(None, 0, 2), (2, 2, 1), (2, 3, 3), (2, 6, 3)]


def check_packing(rows, capacity, most):
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) <= most


def test_packing(spark):
    r = random.Random(7)
    rows = [(i, t) for i, t in enumerate([*texts(300, 5), *[" ".join(["word"] * r.randint(1, 90)) for _ in range(400)]])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = packing.pack(df, WORDS, capacity=64).collect()
    want = {}
    for i, t in rows:
        x = [*ids(WORDS, t), 1]
        want |= {(i, k): (64 * k, len(x[64 * k : 64 * k + 64]), crc(x[64 * k : 64 * k + 64])) for k in range(-(-len(x) // 64))}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    total = sum(x[1] for x in want.values())
    check_packing(got, 64, -(-total // 64) + 1)
    assert packing.pack(df.limit(0), WORDS).count() == 0


def test_plan_equals_one_by_one_best_fit():
    for seed in range(30):
        r = random.Random(seed)
        capacity = r.choice([10, 37, 100])
        lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 300))]
        gaps = []
        for n in sorted(lengths, reverse=True):
            fit = [g for g in gaps if g >= n]
            g = min(fit) if fit else capacity
            if fit:
                gaps.remove(g)
            gaps.append(g - n)
        counts = {n: lengths.count(n) for n in set(lengths)}
        p = packing.plan(counts, capacity)
        placed, ends = {}, {n: {} for n in counts}
        for n, rank, s, each, offset in zip(*p.values()):
            ends[n][rank] = (s, each, offset)
        for n, k in counts.items():
            for rank in range(k):
                first = max(x for x in ends[n] if x <= rank)
                s, each, offset = ends[n][first]
                placed.setdefault(s + (rank - first) // each, []).append((offset + (rank - first) % each * n, n))
        for s in placed.values():
            at = 0
            for offset, n in sorted(s):
                assert offset == at
                at += n
            assert at <= capacity
        assert len(placed) == len(gaps)


def test_cache_bound_changes_no_ids(monkeypatch):
    from lodestone.llm import tokens

    monkeypatch.setattr(tokens, "PIECES", 5)
    encode = tokens.PieceEncoder(BYTES)
    for text in texts(50, 9)[1:]:
        assert len(encode(text)) // 4 == len(ids(BYTES, text))
    assert encoder(BYTES) is encoder(BYTES)


def test_encoding_and_page_indexes(spark):
    import pyarrow.parquet as pq

    out = new_folder(spark, "tokens")
    token_files.write_tokens(spark.createDataFrame(list(enumerate(texts(400, 6)))[1:], "doc_id long, text string"), out, BYTES)
    files = [r.path.removeprefix("file:") for r in spark.read.format("binaryFile").load(out).select("path").collect() if r.path.endswith(".parquet")]
    columns = [m.row_group(0).column(m.num_columns - 1) for m in (pq.ParquetFile(f).metadata for f in files) if m.num_row_groups]
    assert columns and all("DELTA_BINARY_PACKED" in c.encodings for c in columns)
    ids = [m.row_group(0).column(0) for m in (pq.ParquetFile(f).metadata for f in files) if m.num_row_groups]
    assert all(c.has_column_index and c.has_offset_index for c in ids)


def test_packing_keeps_repeats_null_ids_and_one_huge_text(spark):
    rows = [(None, "a b", 1), (3, "a b", 2), (3, "a b", 3), (4, "word " * 5000, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = packing.pack(df, WORDS, capacity=4096).collect()
    n = len(ids(WORDS, "word " * 5000)) + 1
    assert sorted(((r.doc_id, r.piece, r.length) for r in got), key=str) == sorted([(None, 0, 3), (3, 0, 3), (3, 0, 3), (4, 0, 4096), (4, 1, n - 4096)], key=str)
    check_packing(got, 4096, 2)


def test_words_straight_from_the_model_have_the_librarys_ids():
    r = random.Random(11)
    letters = "abcdefgXYZ\xe9\xdf\xf1\xd6œŁ\xb5\xaa\xd7\xf7ǅɏɐσ"
    signs = ["", "", ".", ",", "'", "'s", "'re", "$$$", ")]", "…", "1", "<|", "_"]
    for _ in range(300):
        text = "".join(r.choice([" ", " ", "\n"]) + r.choice(signs) + "".join(r.choices(letters, k=r.randint(1, 9))) + r.choice(signs) for _ in range(20))
        for path in (BYTES, WORDS):
            got = encoder(path)(text)
            assert [int.from_bytes(got[k : k + 4], "little") for k in range(0, len(got), 4)] == ids(path, text), repr(text)


def test_selected_ids_read_few_rows(spark):
    out = new_folder(spark, "tokens")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        token_files.write_tokens(spark.range(20_000).selectExpr("id AS doc_id", "concat('word ', id % 7) AS text"), out, BYTES)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    some = token_files.read_tokens(spark, out, 9_000, 9_009).select("id", "n_tokens")
    assert sorted(r.id for r in some.collect()) == [*range(9_000, 9_010)]
    plan = some._jdf.queryExecution().executedPlan()
    if "AdaptiveSparkPlan" in plan.nodeName():
        plan = plan.executedPlan()
    leaf = plan.collectLeaves().head()
    assert leaf.metrics().apply("numOutputRows").value() <= 2 * token_files.PAGE_ROWS
    assert "tokens" not in leaf.simpleString(1000).split("ReadSchema")[1].replace("n_tokens", "")


def test_range_of_counts_cuts(spark):
    cuts = sorted([3, 3, 3, 10, 11, 40, 41, 42, 43, 99])
    rows = spark.createDataFrame([(v,) for v in [None, -5, 2, 3, 4, 10, 42, 98, 99, 1000]], "v long")
    got = {r.v: r.k for r in rows.select("v", token_files.range_of(rows["v"], cuts).alias("k")).collect()}
    assert got == {v: sum(c <= v for c in cuts) if v is not None else 0 for v in got}
