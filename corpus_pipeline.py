"""Prepare a corpus: reject poor texts, drop copies and near copies, clean personal data, pack.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet below the shared work
folder and read again as the next stage's ``docs``. All but the last return the columns of ``docs``.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloop.llm.common import documents, free_name, written
from flowloop.llm.exact_duplicates import exact_duplicates
from flowloop.llm.near_duplicates import representatives
from flowloop.llm.packing import pack_documents
from flowloop.llm.personal_data import sanitise
from flowloop.llm.quality import fit_quality, good_rows
from flowloop.llm.queries import labels, tokenizer_file


def _chosen(docs: DataFrame, mark: Column, kept: DataFrame) -> DataFrame:
    """The rows whose id and ``mark`` are in ``kept(doc_id, mark)``; of repeated ones, one each."""
    kept_id, kept_mark, own_mark, place = (
        free_name(docs, name) for name in ("kept_id", "kept_mark", "own_mark", "place")
    )
    kept = kept.select(F.col("doc_id").alias(kept_id), F.col("mark").alias(kept_mark))
    marked = docs.withColumn(own_mark, mark)
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(kept_id))
    met = marked.join(kept, same & (F.col(own_mark) == F.col(kept_mark)), "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id", own_mark).orderBy("text"))
    return met.withColumn(place, first).filter(F.col(place) == 1).select(*docs.columns)


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier accepts."""
    return good_rows(docs, fit_quality(docs, labels(spark, sf_dir)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the smallest id."""
    body = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")
    kept = exact_duplicates(docs).filter("kept")
    return _chosen(docs, F.sha2(body, 256), kept.withColumnRenamed("text_sha256", "mark"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by close fingerprints, that with the smallest id."""
    kept = representatives(docs).withColumnRenamed("hash", "mark")
    return _chosen(docs, F.xxhash64(F.coalesce("text", F.lit(""))), kept)


def clean_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data and what reveals it generalised or removed."""
    return sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 2048 tokens."""
    return pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality", reject_poor),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("personal_data", clean_personal_data),
    ("packing", pack),
]

# No SQL trains a classifier; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
