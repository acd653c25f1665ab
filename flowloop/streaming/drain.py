"""Ending a stream between two batches."""

from pyspark.errors import StreamingQueryException
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from flowloop.sources.files import Files

# Text by which the end of a drained stream is told from a failure.
DRAINED = "stream drained by its stop marker"


class Drained(RuntimeError):
    """Raised by a batch that finds the stop marker, before it does anything."""


def check_drain(spark: SparkSession, marker: str) -> None:
    if Files(spark, marker).exists(marker):
        raise Drained(DRAINED)


def drained(query: StreamingQuery, marker: str, poll_seconds: float = 5) -> bool:
    """Wait for the end of a stream; whether ``marker`` ended it.

    A stream at work ends itself at its next batch. An idle one is stopped here; should a batch
    begin just then, it finds the marker first.
    """
    files = Files(SparkSession.active(), marker)
    try:
        while not query.awaitTermination(poll_seconds):
            status = query.status
            idle = not status["isTriggerActive"] and not status["isDataAvailable"]
            if idle and files.exists(marker):
                query.stop()
                return True
    except StreamingQueryException as error:
        if DRAINED in str(error):
            return True
        raise
    return False
