"""The streaming scoring job."""

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from flowloop.operators.decode import decode
from flowloop.operators.normalize import DOTTED_QUAD, LAST_WINS, with_flow_columns
from flowloop.operators.scoring import score_messages
from flowloop.schemas import BEATS
from flowloop.sources.messages import write_kafka
from flowloop.sources.tables import Batch, replace_batch, writer_of
from flowloop.streaming.drain import check_drain
from flowloop.streaming.registry import ModelRegistry

Sink = Callable[[DataFrame, Batch], None]

# Name of the per-batch counts in the query's progress reports.
FLOW_COUNTS = "flow_counts"


def file_sink(path: str, hours: int = 1) -> Sink:
    """Scored messages as a table; a repeated batch replaces itself, and no other writer's."""
    return lambda scored, batch: replace_batch(scored, path, "ts", batch, hours)


def kafka_sink(servers: str, **options: str) -> Sink:
    """Scored messages to their topics; a repeated batch is published again, under the same ids.

    ``distinct_messages`` drops the repeats on the reading side.
    """

    def sink(scored: DataFrame, batch: Batch) -> None:
        write_kafka(scored, servers, **options)

    sink.wants_ids = True
    return sink


def batch_scorer(
    registry: ModelRegistry,
    sink: Sink,
    writer: str,
    strong_scorer: str = "validated",
    rejects: Sink | None = None,
    stop_marker: str | None = None,
) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` callback: one narrow pass and one write per micro-batch.

    ``writer`` names the stream in its sinks. A batch that finds ``stop_marker`` does nothing and
    ends the stream: it is not committed, and the next start begins with it. With ``rejects``, messages that give no flow go there as ``(key, ts, reason)``; the parsed
    batch is kept for both writes.
    """

    def score_batch(flows: DataFrame, batch_id: int) -> None:
        if stop_marker is not None:
            check_drain(flows.sparkSession, stop_marker)
        user, validated = registry.for_batch(batch_id)
        batch = Batch(writer, batch_id)
        if rejects is not None:
            flows = flows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            usable = flows.filter(F.col("reason").isNull()).drop("reason")
            name = f"{writer}-{batch_id}" if getattr(sink, "wants_ids", False) else None
            sink(score_messages(usable, user, validated, strong_scorer, batch=name), batch)
            if rejects is not None:
                rejected = flows.filter(F.col("reason").isNotNull())
                rejects(rejected.select("key", "ts", "reason"), batch)
        finally:
            flows.unpersist()

    return score_batch


def start_scoring(
    messages: DataFrame,
    registry: ModelRegistry,
    sink: Sink,
    checkpoint: str,
    mode: str = LAST_WINS,
    strong_scorer: str = "validated",
    form: str = DOTTED_QUAD,
    trigger: dict | None = None,
    rejects: Sink | None = None,
    schema: T.StructType = BEATS,
    stop_marker: str | None = None,
) -> StreamingQuery:
    """Start scoring a message stream; call ``awaitTermination()`` to block, or ``drained`` to
    end it with a whole batch when ``stop_marker`` appears.

    The checkpoint stands for the writer that the sinks know the stream by. Messages are parsed and classified once, ahead of ``foreachBatch``; the counts
    of messages and of rejected ones appear in each batch's progress report.
    """
    flows = with_flow_columns(decode(messages, schema), mode, form).observe(
        FLOW_COUNTS,
        F.count(F.lit(1)).alias("messages"),
        F.count("reason").alias("rejected"),
    )
    writer_id = writer_of(messages.sparkSession, checkpoint)
    scorer = batch_scorer(registry, sink, writer_id, strong_scorer, rejects, stop_marker)
    writer = flows.writeStream.foreachBatch(scorer)
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.option("checkpointLocation", checkpoint).start()
