"""Inputs and outputs."""

from flowloop.sources.messages import (
    distinct_messages,
    kafka_messages,
    table_messages,
    topic_window,
    write_kafka,
)
from flowloop.sources.models import ModelPair, ModelStore
from flowloop.sources.tables import (
    Batch,
    append_periods,
    compact,
    read_table,
    read_window,
    replace_batch,
    writer_of,
)

__all__ = [
    "Batch",
    "ModelPair",
    "ModelStore",
    "append_periods",
    "compact",
    "distinct_messages",
    "kafka_messages",
    "read_table",
    "read_window",
    "replace_batch",
    "table_messages",
    "topic_window",
    "write_kafka",
    "writer_of",
]
