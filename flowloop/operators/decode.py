"""Message text to typed records."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloop.schemas import BEATS


def decode(messages: DataFrame, schema: T.StructType = BEATS) -> DataFrame:
    """Replace ``value`` by the parsed struct ``data``; every message is kept.

    Text that is no JSON object gives a struct of nulls. The parsed record comes
    out of a one-element ``explode``: filters and projections above a generator
    cannot pull ``from_json`` back in, so each message is parsed exactly once.
    """
    others = [F.col(c) for c in messages.columns if c not in ("key", "value")]
    record = F.from_json(F.col("value").cast("string"), schema)
    return messages.select(
        F.col("key").cast("string"), *others, F.explode(F.array(record)).alias("data")
    )
