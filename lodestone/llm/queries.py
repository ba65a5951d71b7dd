"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, table
from .lpf import remove_repeats
from .packing import pack
from .quality import judge_quality
from .simhash import simhash_groups
from .token_files import checksums, read_tokens, starts, write_tokens
from .tokens import count_tokens
from .topk import top_k
from .urlfilter import judge_urls
from .warc import read_warc, write_warc
from .winnow import contamination


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), out)
    return read_warc(spark, out, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.expr("size(spans) div 2").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), limit=1024)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), capacity=4096, end_id=1)


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), out, tokenizer("byte_bpe_50k.json"), end_id=0)
    back = read_tokens(spark, out)
    rows = starts(checksums(back), back)
    return rows.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_simhash": op2_simhash,
    "op3_quality": op3_quality,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_url_filter": op6_url_filter,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_decontamination": op9_decontamination,
    "op10_token_files": op10_token_files,
}

_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES: dict[str, str] = {
    "op1_warc": """
        WITH p AS (
            SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
        ), k AS (
            SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
        )
        SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id < keeper THEN keeper END AS refers_to
        FROM p LEFT JOIN k ON k.payload_digest = p.payload_digest AND payload_bytes >= 1000
    """,
    "op9_decontamination": f"""
        WITH d AS (
            SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents
        ), b AS (
            SELECT item_id, w, least(13, len(w)) AS m FROM (SELECT item_id, coalesce({_WORDS}, []) AS w FROM benchmark) WHERE len(w) > 0
        ), bw AS (
            SELECT DISTINCT item_id, m, array_to_string(w[k:k + m - 1], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS k FROM b)
        ), dw AS (
            SELECT doc_id, k, m, array_to_string(w[k:k + m - 1], ' ') AS x
            FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)
        ), h AS (
            SELECT doc_id, k, dw.m, item_id FROM dw JOIN bw ON bw.m = dw.m AND bw.x = dw.x
        ), hit AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS p FROM h) GROUP BY doc_id
        ), it AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
    """,
    "op8_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
            FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
            WHERE q.vec_id % 20 = 0
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT * FROM r WHERE rank <= 20
    """,
}
