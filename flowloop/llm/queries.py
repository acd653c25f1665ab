"""One query per operator, over the whole ``documents`` table; DuckDB answers where SQL has one."""

from pyspark.sql import DataFrame, SparkSession

from flowloop.llm import hard_negatives, license_scan
from flowloop.llm.byte_bpe import round_trips
from flowloop.llm.common import documents
from flowloop.llm.exact_duplicates import exact_duplicates
from flowloop.llm.fingerprints import fingerprints
from flowloop.llm.near_duplicates import near_duplicates
from flowloop.llm.packing import pack_documents
from flowloop.llm.periodic_runs import periodic_runs, repeated_tail, run_digests
from flowloop.llm.personal_data import personal_data
from flowloop.llm.quality import fit_quality, quality
from flowloop.llm.token_counts import token_counts
from flowloop.llm.token_files import token_files
from flowloop.llm.toxicity import fit_toxicity, toxicity


def tokenizer_file(name: str) -> str:
    """Where the installed vocabulary files are, on the driver and on executors alike."""
    import public_tokenizers

    return public_tokenizers.path(name)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity(docs, fit_toxicity(docs, labels(spark, sf_dir)))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    ranks = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    return round_trips(documents(spark, sf_dir), ranks, PATTERN)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality(docs, fit_quality(docs, labels(spark, sf_dir)))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = hard_negatives.vectors(embeddings, changed=hard_negatives.changed_label())
    return hard_negatives.hard_negatives(rows)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(documents(spark, sf_dir), repeated_tail))


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_simhash": op2_simhash,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_pii": op5_pii,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_quality": op7_quality,
    "op8_license_scan": op8_license_scan,
    "op9_packing": op9_packing,
    "op10_token_counts": op10_token_counts,
    "op11_token_files": op11_token_files,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES = {
    "op3_exact_dedup": r"""
        WITH norm AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body
            FROM documents
        ), best AS (
            SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM norm GROUP BY body
        )
        SELECT n.doc_id, b.keep_id, b.group_size, n.doc_id = b.keep_id AS kept,
               sha256(n.body) AS text_sha256
        FROM norm n JOIN best b ON n.body = b.body
    """,
    "op8_license_scan": license_scan.oracle(),
    "op12_hard_negatives": hard_negatives.ORACLE,
}
