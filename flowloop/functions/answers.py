"""Form answers."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def answer_to_bit(answer: Column) -> Column:
    """1 for exactly ``true``, 0 for every other answer, a missing one included."""
    return F.when(answer == "true", 1).otherwise(0)
