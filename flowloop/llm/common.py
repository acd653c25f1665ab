"""What the operators share: table reads, batches of bounded size, written stages, folds."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloop.session import work_path

# Rows of one Arrow batch. Texts have no bound, so a batch is kept short: 256 texts of a megabyte
# are the most that a Python worker holds at once.
BATCH_ROWS = 256


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def short_batches(spark: SparkSession) -> None:
    """Let Python workers of this session get at most ``BATCH_ROWS`` rows at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def texts(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` alone, null texts as empty ones; other columns cannot clash."""
    short_batches(docs.sparkSession)
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared work folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it, in whatever case."""
    taken = {column.lower() for column in df.columns}
    while name in taken:
        name += "_"
    return name


def held_out(doc_id: Column) -> Column:
    """The fold that no model learns from: crc32 of the id as text, divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(name).to_pylist() for name in names))
