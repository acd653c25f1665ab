"""A bounded sample of labelled texts for fitting a classifier."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloop.llm.common import held_out, texts


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, bound: int, most_chars: int | None = None
) -> DataFrame:
    """``(text, label)`` of at most ``bound`` different texts whose rows are not held out, and of
    ``most_chars`` characters together; none has more than a 64th of these.

    Of equal texts the one with the smallest id counts, so a much copied text is one example. The
    choice follows a hash of the texts: it does not depend on their order or partitions. At most
    ``bound`` ids are broadcast; texts are never shuffled.
    """
    docs = texts(docs)
    known = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    size = F.length("text").cast("bigint").alias("size")
    hashes = docs.select("doc_id", F.xxhash64("text").alias("hash"), size)
    distinct = hashes.join(known, "doc_id").groupBy("hash").agg(
        F.min(F.struct("doc_id", "label", "size")).alias("row")
    )
    if most_chars is not None:
        # One text does not take more than a small share of the room.
        distinct = distinct.filter(F.col("row.size") <= most_chars // 64)
    chosen = distinct.orderBy("hash").limit(bound)
    if most_chars is not None:
        # Over ``bound`` rows at most.
        so_far = F.sum("row.size").over(Window.orderBy("hash"))
        chosen = chosen.withColumn("so_far", so_far).filter(F.col("so_far") <= most_chars)
    chosen = chosen.select("row.doc_id", "row.label", "hash")
    met = docs.join(F.broadcast(chosen), "doc_id")
    # Rows that repeat an id with another text are not the one that was chosen.
    return met.filter(F.xxhash64("text") == F.col("hash")).select("text", "label")
