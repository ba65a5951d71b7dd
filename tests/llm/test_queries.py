"""The queries that SQL can express beside it in DuckDB, and the shapes of the others, on the smallest tables."""

import os

import duckdb
import pytest

from lodestone.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")

COLUMNS = {
    "op1_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op2_simhash": ["doc_id", "fingerprint", "component_id"],
    "op3_quality": ["doc_id", "p_junk", "p_toxic", "keep"],
    "op4_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op5_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op6_url_filter": ["page_id", "host", "path", "rule", "verdict", "score"],
    "op7_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op8_exact_top_k": ["query_id", "rank", "vec_id", "score"],
    "op9_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op10_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.columns == COLUMNS[name]
    if name not in queries.ORACLES:
        assert df.count() >= 50
        return
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = c.execute(queries.ORACLES[name])
    names = [x[0] for x in cursor.description]
    want = sorted((tuple(dict(zip(names, r))[k] for k in df.columns) for r in cursor.fetchall()), key=str)
    assert sorted(map(tuple, df.collect()), key=str) == want
