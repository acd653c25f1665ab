"""Answers to labels as they are submitted."""

from datetime import timedelta

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowloop.operators import labelling
from flowloop.plans.label import parked_candidates
from flowloop.schemas import SUBMISSION
from flowloop.sources.messages import write_kafka
from flowloop.sources.tables import Batch, replace_batch, writer_of
from flowloop.streaming.drain import check_drain

UNKNOWN, LATE = "unknown", "late"


def submission_files(
    spark: SparkSession, path: str, files_per_trigger: int | None = None
) -> DataFrame:
    """A folder of submissions, one JSON object a line, as a stream."""
    reader = spark.readStream.schema(SUBMISSION)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def start_answers(
    submissions: DataFrame,
    candidates: str,
    topic: str,
    labels: str,
    checkpoint: str,
    rejects: str | None = None,
    default_answer: str | None = None,
    late_after: timedelta | None = None,
    servers: str | None = None,
    hours: int = 1,
    trigger: dict | None = None,
    stop_marker: str | None = None,
) -> StreamingQuery:
    """Join every batch of submissions with the candidates it is about, and append the labels.

    Candidates are read anew for each batch, only in the buckets of its answers, so a page that was
    parked a moment ago is known and one that was parked long ago still is. Answers for ids that
    were never parked, and with ``late_after`` those submitted longer than that after parking, go to
    ``rejects`` as ``(id, answer, submitted_at, reason)``. A submission without a time has that of
    its batch. With a ``default_answer``, the rest of each submitted page gets it; a page is
    submitted in one batch. A repeated batch replaces its labels and rejects; sent to ``servers``,
    they are published again.
    """
    spark = submissions.sparkSession
    writer = writer_of(spark, checkpoint)
    label_col = labelling.LABEL_COLUMNS[topic]

    def label_batch(batch: DataFrame, batch_id: int) -> None:
        if stop_marker is not None:
            check_drain(spark, stop_marker)
        now = F.current_timestamp()
        own = batch.withColumn("submitted_at", F.coalesce("submitted_at", now))
        own = own.persist(StorageLevel.MEMORY_AND_DISK)
        parked = parked_candidates(batch.sparkSession, candidates, wanted=own)
        asked = own.select("id", "answer", "submitted_at")
        if default_answer is not None:
            filled = labelling.with_default_answers(own, parked, default_answer)
            added = filled.join(asked.select("id").distinct(), "id", "left_anti")
            asked = asked.unionByName(added.withColumn("submitted_at", now))
        matched = labelling.match_answers(asked, parked, ["submitted_at"])
        matched = matched.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            reason = F.when(~F.col("known"), UNKNOWN)
            if late_after is not None:
                limit = F.expr(f"parked_at + INTERVAL {int(late_after.total_seconds())} SECONDS")
                reason = reason.when(F.col("submitted_at") > limit, LATE)
            told = matched.withColumn("reason", reason)
            good = told.filter(F.col("reason").isNull())
            known = labelling.known_labels(good, label_col, "submitted_at")
            this = Batch(writer, batch_id)
            stored = known.withColumnRenamed("submitted_at", "labelled_at")
            replace_batch(stored, labels, "labelled_at", this, hours)
            if servers is not None:
                write_kafka(labelling.label_messages(known, topic), servers)
            if rejects is not None:
                bad = told.filter(F.col("reason").isNotNull())
                bad = bad.select("id", "answer", "submitted_at", "reason")
                replace_batch(bad, rejects, "submitted_at", this, hours)
        finally:
            matched.unpersist()
            own.unpersist()

    query = submissions.writeStream.foreachBatch(label_batch)
    if trigger:
        query = query.trigger(**trigger)
    return query.option("checkpointLocation", checkpoint).start()
