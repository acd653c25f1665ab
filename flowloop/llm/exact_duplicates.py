"""Exact deduplication by skew-safe combining.

Copies are combined three times, and each time full contents decide, not digests: within a stretch
of an input partition, then by digest and salt, then the winners of the salts by digest alone. A
group that holds a third of all rows is one row per stretch after the first step and at most
``SALTS`` rows after the second, so no task ever meets it whole.

Contents travel compressed. Compression is deterministic and reversible, so equal compressed
contents are equal contents.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloop.llm.common import rows_of, texts, written

SALTS = 32
# A stretch ends when its distinct contents or its rows reach these; both bound a task's memory.
STRETCH_BYTES = 16 << 20
STRETCH_ROWS = 20_000
COMPRESSION = 1

LOCAL = T.StructType(
    [
        T.StructField("digest", T.BinaryType()),
        T.StructField("content", T.BinaryType()),
        T.StructField("members", T.ArrayType(T.LongType())),
    ]
)


def normalised(text: str) -> bytes:
    """The text's UTF-8 with every run of ASCII white space as one space."""
    raw = text.encode()
    words = raw.split()
    if not words:
        return b" " if raw else b""
    head = b" " if raw[:1].isspace() else b""
    tail = b" " if raw[-1:].isspace() else b""
    return head + b" ".join(words) + tail


def _ordered(ids: list) -> list:
    return sorted(ids, key=lambda i: (i is None, i))


def _combine_locally(stretch_rows: int):
    schema = pa.schema(
        [("digest", pa.binary()), ("content", pa.binary()), ("members", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=COMPRESSION)
        groups: dict[bytes, list] = {}
        size = rows = 0

        def combined() -> pa.RecordBatch:
            columns = [
                [hashlib.sha256(content).digest() for content in groups],
                [press.compress(content) for content in groups],
                [_ordered(ids) for ids in groups.values()],
            ]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema
            )

        for doc_id, text in rows_of(batches, "doc_id", "text"):
            content = normalised(text)
            ids = groups.get(content)
            if ids is None:
                groups[content] = [doc_id]
                size += len(content)
            else:
                ids.append(doc_id)
            rows += 1
            if size >= STRETCH_BYTES or rows >= stretch_rows:
                yield combined()
                groups.clear()
                size = rows = 0
        if groups:
            yield combined()

    return run


def exact_duplicates(docs: DataFrame, stretch_rows: int = STRETCH_ROWS) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for every row.

    Texts are equal when identical after each run of ASCII white space became one space; a null
    text is an empty one. The row with the smallest ``doc_id`` stays, a null id only where all are
    null; of repeated rows with that id, exactly one. An empty table gives no rows.
    """
    docs = texts(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    local = docs.mapInArrow(_combine_locally(stretch_rows), LOCAL).select(
        "digest",
        "content",
        "members",
        # Scans cut files alike each time, so a task that runs again gives the same numbers.
        F.monotonically_increasing_id().alias("uid"),
    )
    salted = local.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)))

    same = Window.partitionBy("digest", "salt", "content")
    first = same.orderBy(F.asc_nulls_last(F.col("members")[0]), "uid")
    won = salted.select(
        "digest",
        "content",
        "members",
        "uid",
        F.first("uid").over(first).alias("winner"),
        F.sum(F.size("members").cast("bigint")).over(same).alias("size"),
    )
    # Losers go on without their content.
    won = won.withColumn("content", F.when(F.col("uid") == F.col("winner"), F.col("content")))
    won = written(won, "salt_winners")

    winners = won.filter(F.col("uid") == F.col("winner"))
    same = Window.partitionBy("digest", "content")
    first = same.orderBy(F.asc_nulls_last(F.col("members")[0]), "uid")
    groups = winners.select(
        F.col("winner").alias("salt_winner"),
        F.first("uid").over(first).alias("last_winner"),
        F.first(F.col("members")[0]).over(first).alias("keep_id"),
        F.sum("size").over(same).alias("group_size"),
    )
    rows = won.drop("content", "size").join(groups, F.col("winner") == F.col("salt_winner"))
    rows = rows.select("*", F.posexplode("members").alias("at", "doc_id"))
    return rows.select(
        "doc_id",
        "keep_id",
        "group_size",
        ((F.col("uid") == F.col("last_winner")) & (F.col("at") == 0)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
