"""Candidate ids."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def random_id() -> Column:
    """A random 48-bit number: the last twelve hex digits of a random UUID.

    Every evaluation draws new numbers, so write rows carrying it to a table
    before anyone refers to the ids.
    """
    return F.conv(F.right(F.uuid(), F.lit(12)), 16, 10).cast("bigint")
