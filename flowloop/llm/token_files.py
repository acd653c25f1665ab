"""Token ids of documents in ORC files, in ascending order of their ids.

Texts are dealt by ranges of ``doc_id``, encoded in order, and written as one file a range: files,
and rows within them, ascend. A row holds a document's ids; ORC keeps them, like all its integers,
in run-length encoding. Stripes bound what a reader holds and are read in parallel, also those of
one file. Row indexes and Bloom filters on ``doc_id`` let a look-up skip files, stripes and groups
of rows by their metadata.

The ids before a document are those before its file and those before it in the file. The latter
are written with the document; the former are sums over files, made from one narrow column.
"""

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloop.llm.common import rows_of, short_batches, texts, written
from flowloop.llm.word_bpe import loaded
from flowloop.session import work_path

END = 1
STRIPE_BYTES = 64 << 20
# Rows after which a writer looks whether its stripe is full.
CHECK_ROWS = 100
# Documents of one entry of the row index and one Bloom filter.
INDEX_ROWS = 1000
FALSE_POSITIVES = 0.01
# Ids of one batch that a task hands on.
BATCH_IDS = 1 << 20
# Rows that a scan decodes at once.
READ_ROWS = 256

FILES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("file", T.IntegerType()),
        T.StructField("before", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType(), containsNull=False)),
    ]
)


def encoded(docs: DataFrame, tokenizer: str, end_id: int = END) -> DataFrame:
    """Rows of ``FILES`` in order: partitions by ascending ``doc_id``, and rows within them.

    ``file`` counts partitions. Rows of one id follow each other by their texts; an id with very
    many rows is spread over several partitions. Null ids come first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = TaskContext.get().partitionId()
        before = 0
        for batch in batches:
            rows = list(rows_of(iter([batch]), "doc_id", "text"))
            for part in _bounded(rows):
                coded = loaded(tokenizer).encode([text for _, text in part])
                sizes = np.array([len(ids) // 4 + 1 for ids in coded], dtype=np.int64)
                end = np.array([end_id], dtype="<i4").tobytes()
                values = np.frombuffer(b"".join(ids + end for ids in coded), dtype="<i4")
                stops = np.cumsum(sizes)
                columns = [
                    pa.array([doc_id for doc_id, _ in part], pa.int64()),
                    pa.array(np.full(len(part), file, dtype=np.int32)),
                    pa.array(before + stops - sizes),
                    pa.array(sizes),
                    pa.ListArray.from_arrays(np.r_[0, stops].astype(np.int32), values),
                ]
                before += int(stops[-1])
                yield pa.RecordBatch.from_arrays(columns, names=FILES.names)

    rows = texts(docs).select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "text",
        F.xxhash64("text").alias("tie"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = ["doc_id", "tie", "row"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select("doc_id", "text").mapInArrow(run, FILES)


def _bounded(rows: list[tuple]) -> Iterator[list[tuple]]:
    """Rows whose texts have about ``BATCH_IDS`` characters at most, or one row."""
    part, size = [], 0
    for row in rows:
        if part and size + len(row[1]) > BATCH_IDS:
            yield part
            part, size = [], 0
        part.append(row)
        size += len(row[1])
    if part:
        yield part


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = END,
    stripe_bytes: int = STRIPE_BYTES,
    index_rows: int = INDEX_ROWS,
) -> None:
    """Write the ids of every text, ``end_id`` after them, to ORC files below ``path``.

    A null text is an empty one: its only id is ``end_id``. Repeated rows are written each, an
    empty table gives no rows. A text of any length is one row.
    """
    encoded(docs, tokenizer, end_id).write.options(
        **{
            "compression": "zstd",
            "orc.stripe.size": stripe_bytes,
            "orc.rows.between.memory.checks": CHECK_ROWS,
            "orc.create.index": "true",
            "orc.row.index.stride": index_rows,
            "orc.bloom.filter.columns": "doc_id",
            "orc.bloom.filter.fpp": FALSE_POSITIVES,
        }
    ).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: Sequence[int] | None = None) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` from the files; ``start`` counts the ids of all before.

    With ``doc_ids``, only these documents: the scan skips what the metadata rules out.
    """
    short_batches(spark)
    spark.conf.set("spark.sql.orc.columnarReaderBatchSize", str(READ_ROWS))
    files = spark.read.schema(FILES).orc(path)
    sizes = files.groupBy("file").agg(F.sum("n_tokens").alias("size"))
    # One row a file.
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("first")
    # Written, its size is known: the join broadcasts it while it is small, and no ids are shuffled.
    firsts = written(sizes.select("file", first), "file_starts")
    if doc_ids is not None:
        files = files.filter(F.col("doc_id").isin(list(doc_ids)))
    start = (F.col("first") + F.col("before")).alias("start")
    return files.join(firsts, "file").select("doc_id", start, "n_tokens", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of rows that were read back.

    The checksum is that of the ids as little-endian unsigned 32-bit numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            stops = ids.offsets.to_numpy()
            raw = memoryview(ids.values.to_numpy().astype("<u4", copy=False)).cast("B")
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(stops[:-1], stops[1:])]
            columns = [batch.column("doc_id"), batch.column("start")]
            columns += [pa.array(np.diff(stops).astype(np.int64)), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                columns, names=["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    rows = tokens.select("doc_id", "start", "ids")
    return rows.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = END) -> DataFrame:
    """Write the files to the shared work folder, read them back and give each document's place."""
    spark = docs.sparkSession
    path = work_path(spark, "token_files")
    write_tokens(docs, path, tokenizer, end_id)
    return checksums(read_tokens(spark, path))
