"""Schemas of everything that is read or written."""

import json

from pyspark.sql import SparkSession
from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


_STRING, _INT, _LONG = T.StringType(), T.IntegerType(), T.LongType()
_ENDPOINT = _struct(ip=_STRING, port=_INT)

# Field names and types of the incoming flow record.
BEATS = _struct(
    **{"@timestamp": _STRING},
    bytes_out=_INT,
    ip=_INT,
    client_ip=_INT,
    dest=_ENDPOINT,
    source=_ENDPOINT,
    json=_struct(
        event_type=_STRING,
        src_ip=_STRING,
        dest_ip=_STRING,
        dns=_struct(rrname=_STRING, rrtype=_STRING),
    ),
)

# Stored raw records also carry the record type the labelling page filters on.
RAW_FLOW = T.StructType([*BEATS.fields, T.StructField("type", _STRING)])

# Model inputs, in vector order.
FEATURES = ["source_ip", "source_port", "dest_ip", "dest_port"]
TRAINING_COLUMNS = [*FEATURES, "label"]

MESSAGE = _struct(key=_STRING, value=_STRING, ts=T.TimestampType())

CANDIDATE = _struct(
    id=_LONG,
    source_ipv4=_STRING,
    source_ip=_LONG,
    source_port=_INT,
    dest_ipv4=_STRING,
    dest_ip=_LONG,
    dest_port=_INT,
)
PREDICTION_CANDIDATE = T.StructType([*CANDIDATE.fields, T.StructField("predictedLabel", _STRING)])

# An answer, or with a null id the word that a page was submitted. Page and time may be missing.
SUBMISSION = _struct(id=_LONG, answer=_STRING, page=_STRING, submitted_at=T.TimestampType())


def label_record(label_col: str) -> T.StructType:
    """A labelled candidate; ``label_col`` is ``label`` or ``validated_label``."""
    return T.StructType([*CANDIDATE.fields, T.StructField(label_col, _INT)])


# The table of scored messages, without the partition columns topic, period, batch_id.
SCORED_MESSAGE = _struct(key=_STRING, ts=T.TimestampType(), algo=_STRING, value=_STRING)

# The part of a scored message that is read back to show predictions.
SCORED = _struct(
    data=_struct(source=_struct(ip=_STRING), dest=_struct(ip=_STRING)),
    source_ip=_LONG,
    source_port=_INT,
    dest_ip=_LONG,
    dest_port=_INT,
    algo=_STRING,
    predictedLabel=_STRING,
)


def _file_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def load_schema(spark: SparkSession, path: str) -> T.StructType:
    """Read a record schema stored as Spark's schema JSON; fails if unreadable."""
    return T.StructType.fromJson(json.loads(_file_text(spark, path)))


def load_columns(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Read ``(columns, feature_columns)`` of a training-set description."""
    config = json.loads(_file_text(spark, path))
    return config["columns"], config["feature_columns"]
