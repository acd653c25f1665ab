"""The labelling loop as table jobs: park candidates, turn answers into labels."""

import uuid
from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloop.functions import as_utc
from flowloop.operators.candidates import PAGE_SIZE, in_pages
from flowloop.operators.labelling import (
    LABEL_COLUMNS,
    known_labels,
    match_answers,
    stamp,
    unknown_answers,
)
from flowloop.schemas import CANDIDATE, PREDICTION_CANDIDATE
from flowloop.sources.candidates import BUCKETS, CandidateTable
from flowloop.sources.tables import append_periods


def park_candidates(
    candidates: DataFrame,
    path: str,
    parked_at: datetime | None = None,
    run: str | None = None,
    page_size: int = PAGE_SIZE,
    buckets: int = BUCKETS,
    bulk: bool = True,
) -> None:
    """Give candidates their pages and ids and add them to the candidate table.

    The page shows rows read back from the table: ids are drawn by the write, and
    recomputing the DataFrame would draw others. A repeated ``run`` replaces its rows.
    A few pages need no ``bulk``, which shuffles once to write few files.
    """
    run = uuid.uuid4().hex if run is None else run
    parked_at = F.current_timestamp() if parked_at is None else F.lit(as_utc(parked_at))
    rows = in_pages(candidates, run, page_size).withColumn("parked_at", parked_at)
    if "predictedLabel" not in rows.columns:
        rows = rows.withColumn("predictedLabel", F.lit(None).cast("string"))
    rows = rows.select(*PREDICTION_CANDIDATE.names[1:], "page", "parked_at")
    CandidateTable(rows.sparkSession, path).park(rows, run, buckets, bulk)


def parked_candidates(
    spark: SparkSession,
    path: str,
    predictions: bool = False,
    wanted: DataFrame | None = None,
) -> DataFrame:
    """The candidate table; of it, with ``wanted`` submissions, only what they can be about."""
    schema = PREDICTION_CANDIDATE if predictions else CANDIDATE
    table = CandidateTable(spark, path)
    parked = table.all() if wanted is None else table.holding(wanted)
    return parked.select(*schema.names, "page", "parked_at")


def record_answers(
    submissions: DataFrame,
    candidates: DataFrame,
    topic: str,
    path: str,
    labelled_at: datetime | Column | None = None,
    run: str | None = None,
) -> DataFrame:
    """Append the labels of one set of submissions to that topic's label table.

    Returns the answers for unknown ids. They are matched once: the result is kept with
    spilling until the session ends or the caller unpersists it. A repeated ``run``
    replaces its labels.
    """
    matched = match_answers(submissions, candidates).persist(StorageLevel.MEMORY_AND_DISK)
    moment = F.current_timestamp() if labelled_at is None else labelled_at
    labels = stamp(known_labels(matched, LABEL_COLUMNS[topic]), moment)
    append_periods(labels, path, "labelled_at", run=run)
    return unknown_answers(matched)
