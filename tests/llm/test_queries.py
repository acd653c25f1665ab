"""The registered queries: their columns, and their DuckDB answers where they have one."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as driver
from flowloop.llm.queries import ORACLES, QUERIES
from tests.conftest import SF_DIR

COLUMNS = {
    "op1_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op2_simhash": "doc_id fingerprint component_id",
    "op3_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op4_toxicity": "doc_id held_out score predicted",
    "op5_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op6_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op7_quality": "doc_id held_out score predicted",
    "op8_license_scan": "doc_id license containment n_places first_word",
    "op9_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op10_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op11_token_files": "doc_id start n_tokens ids_crc32",
    "op12_hard_negatives": "anchor_id positive_id rank negative_id positive_score negative_score",
    "op13_periodic_runs": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
}


def test_all_are_registered():
    assert set(COLUMNS) == set(QUERIES)
    assert {*QUERIES, "pipeline"} <= set(driver.queries())
    assert set(ORACLES) <= set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    rows = df.collect()
    assert rows
    if name in ORACLES:
        con = duckdb.connect()
        for table in ("documents", "embeddings"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
        answer = con.sql(ORACLES[name])
        order = [answer.columns.index(c) for c in df.columns]
        want = Counter(tuple(row[i] for i in order) for row in answer.fetchall())
        assert Counter(map(tuple, rows)) == want
