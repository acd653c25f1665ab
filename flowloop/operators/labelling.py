"""Answers joined back to the candidates they are about."""

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloop.functions import answer_to_bit, as_utc
from flowloop.operators.decode import decode
from flowloop.schemas import CANDIDATE, label_record

# Topic and label column of each label set.
USER_TOPIC = "user_predictions"
VALIDATED_TOPIC = "validated_predictions"
LABEL_COLUMNS = {USER_TOPIC: "label", VALIDATED_TOPIC: "validated_label"}

# Equal answers for one id travel as one row with their number. Where they become rows again, a
# task makes at most so many of one id.
CHUNK = 10_000


def match_answers(
    submissions: DataFrame, candidates: DataFrame, also: Sequence[str] = ()
) -> DataFrame:
    """``(id, answer, known)`` and the candidate's columns for every submission with an id.

    ``also`` are columns of the submissions to carry; of the candidate, ``parked_at`` comes too.
    Equal submissions are counted before any shuffle, so an id answered millions of times is a row
    or two until the end, where its copies are dealt to tasks in chunks. Candidates that nobody
    answered go before anything is sorted or shuffled: for a page of answers, the ids are
    broadcast to the scan. Of an id parked several times the last candidate counts, and of several
    parked at once the largest by its fields.
    """
    submissions = submissions.filter(F.col("id").isNotNull())
    counted = submissions.groupBy("id", "answer", *also).agg(F.count("*").alias("n"))
    wanted = candidates.join(submissions.select("id").distinct(), "id", "left_semi")
    fields = [name for name in CANDIDATE.names if name != "id"]
    last = F.max(F.struct("parked_at", *fields)).alias("last")
    by_id = wanted.groupBy("id").agg(last).select("id", "last.*", F.lit(True).alias("known"))
    met = counted.join(by_id, "id", "left")
    chunks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / CHUNK).cast("bigint"))
    spread = met.withColumn("chunk", F.explode(chunks)).repartition(
        _partitions(met), "id", "answer", "chunk"
    )
    copies = F.least(F.lit(CHUNK), F.col("n") - F.col("chunk") * CHUNK).cast("int")
    rows = spread.withColumn("copy", F.explode(F.array_repeat(F.lit(0), copies)))
    known = F.col("known").isNotNull().alias("known")
    return rows.select("id", "answer", *also, known, "parked_at", *fields)


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def known_labels(matched: DataFrame, label_col: str, *also: str) -> DataFrame:
    labels = matched.filter("known").withColumn(label_col, answer_to_bit(F.col("answer")))
    return labels.select(*label_record(label_col).names, *also)


def unknown_answers(matched: DataFrame) -> DataFrame:
    return matched.filter(~F.col("known")).select("id", "answer")


def resolve_answers(
    submissions: DataFrame, candidates: DataFrame, label_col: str = "label"
) -> DataFrame:
    """The label record of every submission whose id is known.

    An id submitted several times gives as many labels.
    """
    return known_labels(match_answers(submissions, candidates), label_col)


def unknown_submissions(submissions: DataFrame, candidates: DataFrame) -> DataFrame:
    """The submissions whose id was never parked."""
    return unknown_answers(match_answers(submissions, candidates))


def with_default_answers(
    submissions: DataFrame, shown: DataFrame, default: str = "false"
) -> DataFrame:
    """``(id, answer)``: the answers, and ``default`` for the rest of every page that was submitted,
    as a pre-checked form sends it.

    A page was submitted if one of its candidates was answered, or if a submission names it in
    ``page``, with or without an ``id``. Candidates of other pages get no answer.
    """
    answered = submissions.filter(F.col("id").isNotNull())
    ids = answered.select("id").distinct()
    pages = shown.join(ids, "id", "left_semi").select("page")
    if "page" in submissions.columns:
        pages = pages.unionByName(submissions.select("page"))
    on_page = shown.select("id", "page").join(pages.dropna().distinct(), "page", "left_semi")
    untouched = on_page.select("id").distinct().join(ids, "id", "left_anti")
    return answered.select("id", "answer").unionByName(
        untouched.select("id", F.lit(default).alias("answer"))
    )


def label_messages(labels: DataFrame, topic: str) -> DataFrame:
    """``(key, value, topic)`` with one JSON object per label; the key is null."""
    fields = label_record(LABEL_COLUMNS[topic]).names
    return labels.select(
        F.lit(None).cast("string").alias("key"),
        F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"),
        F.lit(topic).alias("topic"),
    )


def labels_from_messages(messages: DataFrame, topic: str) -> DataFrame:
    """Label rows from the topic's messages; ``labelled_at`` is the message time."""
    label_col = LABEL_COLUMNS[topic]
    rows = decode(messages, label_record(label_col))
    return rows.select("data.*", F.col("ts").alias("labelled_at"))


def stamp(labels: DataFrame, labelled_at: datetime | Column) -> DataFrame:
    """Add the event time training filters on."""
    moment = labelled_at if isinstance(labelled_at, Column) else F.lit(as_utc(labelled_at))
    return labels.withColumn("labelled_at", moment)
