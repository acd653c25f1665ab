"""Keyed text messages, ``(key, value, ts)``, from a topic or from files."""

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloop.functions import as_utc, in_window
from flowloop.schemas import MESSAGE

MESSAGE_ID = "message_id"

# Fixed value: consumer poll timeout.
POLL_TIMEOUT_MS = 10_000


def kafka_messages(
    spark: SparkSession,
    servers: str,
    topic: str = "beats",
    streaming: bool = True,
    with_ids: bool = False,
    **options: str,
) -> DataFrame:
    """Messages of one topic; ``ts`` is the broker's message time.

    ``with_ids`` adds the ``message_id`` that the sink put into a header, null where there is none.
    """
    if with_ids:
        options = {**options, "includeHeaders": "true"}
    reader = (spark.readStream if streaming else spark.read).format("kafka")
    raw = (
        reader.option("kafka.bootstrap.servers", servers)
        .option("kafkaConsumer.pollTimeoutMs", POLL_TIMEOUT_MS)
        .option("subscribe", topic)
        .options(**options)
        .load()
    )
    columns = [
        F.col("key").cast("string"), F.col("value").cast("string"), F.col("timestamp").alias("ts")
    ]
    if with_ids:
        own = F.filter("headers", lambda header: header["key"] == MESSAGE_ID)
        columns.append(F.get(own, F.lit(0))["value"].cast("string").alias(MESSAGE_ID))
    return raw.select(*columns)


def distinct_messages(messages: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Messages of a stream or batch, each ``message_id`` once.

    A stream keeps the ids of the last ``delay`` of message time, so its state is bounded; a repeat
    that comes later than that is not known any more. Messages without an id are told apart by key,
    time and text.
    """
    told = F.concat_ws("-", "key", F.unix_micros(F.col("ts").cast("timestamp")), F.sha2("value", 256))
    named = messages.withColumn("ts", F.col("ts").cast("timestamp"))
    named = named.withColumn(MESSAGE_ID, F.coalesce(MESSAGE_ID, told))
    if not messages.isStreaming:
        return named.dropDuplicates([MESSAGE_ID])
    return named.withWatermark("ts", delay).dropDuplicatesWithinWatermark([MESSAGE_ID])


def topic_window(
    spark: SparkSession,
    servers: str,
    topic: str,
    as_of: datetime,
    lookback: timedelta,
    distinct: bool = False,
) -> DataFrame:
    """The messages of ``[as_of - lookback, as_of)`` as a batch; ``distinct`` drops repeats.

    The broker finds the first offset, so older messages are never read. Times need
    not rise along a partition where several producers write: messages of the window
    may stand behind later ones, so everything up to the latest offset is read and
    the filter decides.
    """
    first = str(int(as_utc(as_of - lookback).timestamp() * 1000))
    messages = kafka_messages(
        spark,
        servers,
        topic,
        streaming=False,
        startingTimestamp=first,
        startingOffsetsByTimestampStrategy="latest",
        with_ids=distinct,
    )
    window = messages.filter(in_window(messages, "ts", as_of, lookback))
    return distinct_messages(window).drop(MESSAGE_ID) if distinct else window


def table_messages(
    spark: SparkSession,
    path: str,
    schema: T.StructType = MESSAGE,
    streaming: bool = False,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """The same envelope from Parquet files, as a batch or as a file stream."""
    if not streaming:
        return spark.read.schema(schema).parquet(path)
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def write_kafka(messages: DataFrame, servers: str, **options: str) -> None:
    """Publish ``(key, value, topic)`` rows; each row names its own topic.

    A ``message_id`` goes with them as a header.
    """
    columns = ["key", "value", "topic"]
    if MESSAGE_ID in messages.columns:
        own = F.struct(F.lit(MESSAGE_ID).alias("key"), F.col(MESSAGE_ID).cast("binary").alias("value"))
        messages = messages.withColumn("headers", F.array(own))
        columns.append("headers")
    (
        messages.select(*columns)
        .write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .options(**options)
        .save()
    )
