"""Parquet tables partitioned by time, so that a look-back reads only its periods.

A period is ``hours`` long and every writer and reader of one table uses the same
length, which is part of the partition's name: an hour for busy tables, a day for
small ones. Below its period, every batch of every writer has a folder of its own, which a
repeated batch replaces. ``compact`` folds the batches of closed periods into few files.
"""

import uuid
from datetime import UTC, datetime, timedelta
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloop.functions import as_utc, in_window, period_of, periods_between
from flowloop.sources import generations
from flowloop.sources.files import Files

WRITER = "writer"
BATCH = "batch_id"
# Partition folders from a period down to a batch.
UNIT_DEPTH = 2
WRITERS = "_writers"

_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


class Batch(NamedTuple):
    """Who writes, and which of its batches: numbers rise. Writers never touch others' rows."""

    writer: str
    number: int = 0


def writer_of(spark: SparkSession, checkpoint: str) -> str:
    """The writer that a stream's checkpoint stands for: the same after every restart."""
    files, path = Files(spark, checkpoint), f"{checkpoint.rstrip('/')}/writer"
    if not files.exists(path):
        files.publish(path, uuid.uuid4().hex)
    return files.read(path).strip()


def period_name(hours: int) -> str:
    return f"period_{hours}h"


def append_periods(
    df: DataFrame,
    path: str,
    ts_col: str,
    hours: int = 1,
    backfill: bool = False,
    run: str | None = None,
) -> None:
    """Append rows under ``period_<hours>h=<periods since epoch>``.

    A ``run`` is a writer of one batch: run again, it replaces what it wrote, also where it
    writes nothing or to other periods now. Rows of the current period need no shuffle. A
    ``backfill`` spans many: it brings each period's rows together first, which gives
    every period a few files instead of one per task, and lets the adaptive plan split
    a crowded one.
    """
    if run is not None:
        replace_batch(df, path, ts_col, Batch(run), hours, backfill)
        return
    period = period_name(hours)
    rows = df.withColumn(period, period_of(df, ts_col, hours))
    if backfill:
        rows = rows.hint("rebalance", period)
    rows.write.mode("append").partitionBy(period).parquet(path)


def replace_batch(
    df: DataFrame,
    path: str,
    ts_col: str,
    batch: Batch,
    hours: int = 1,
    backfill: bool = False,
) -> None:
    """Write one batch under its period, writer and number, below ``topic`` and above ``algo``
    where there are such columns.

    A batch that was begun before, and may have been scored with other models then, is
    first removed from every partition; another batch's rows, and those of other writers, are
    never touched. A micro-batch is written without a shuffle; ``backfill`` is as in
    ``append_periods``.
    """
    files, period = Files(df.sparkSession, path), period_name(hours)
    above = [c for c in ("topic",) if c in df.columns]
    below = [c for c in ("algo",) if c in df.columns]
    if _begun_before(files, path, batch):
        _remove(files, path, [*above, period], batch)
    rows = df.withColumn(period, period_of(df, ts_col, hours))
    if backfill:
        rows = rows.hint("rebalance", *above, period)
    rows = rows.withColumns(
        {WRITER: F.lit(batch.writer), BATCH: F.lit(batch.number).cast("bigint")}
    )
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*above, period, WRITER, BATCH, *below).parquet(path)


def _begun_before(files: Files, path: str, batch: Batch) -> bool:
    """Note that a batch begins. Of a writer's notes only the last one is kept."""
    folder = f"{path}/{WRITERS}/{batch.writer}"
    begun = [int(name) for name in files.names(folder)]
    files.mark(f"{folder}/{int(batch.number)}")
    for number in begun:
        if number < batch.number:
            files.delete(f"{folder}/{number}")
    return any(number >= batch.number for number in begun)


def _remove(files: Files, path: str, partitions: list[str], batch: Batch) -> None:
    shelves = f"{path}/" + "/".join(f"{name}=*" for name in partitions)
    unit = f"{WRITER}={batch.writer}/{BATCH}={int(batch.number)}"
    for marker in files.matching(f"{shelves}/{generations.MARKER}*"):
        if generations.was_folded(files, marker.rsplit("/", 1)[0], unit):
            raise ValueError(f"{unit} of {path} was compacted and cannot be written again")
    for folder in files.matching(f"{shelves}/{unit}"):
        files.delete(folder)


def read_window(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    ts_col: str,
    as_of: datetime,
    lookback: timedelta,
    hours: int = 1,
    under: str = "",
) -> DataFrame:
    """Rows with ``as_of - lookback <= ts < as_of``.

    Lists only the folders the window touches, so the cost follows the
    window and not the age of the table. ``under`` is a leading partition such
    as ``topic=model_predictions``. A window without rows is empty; a table that does
    not exist, or whose periods have another length, is an error.
    """
    files = Files(spark, path)
    if not files.exists(path):
        raise FileNotFoundError(f"no table at {path}")
    root = f"{path.rstrip('/')}/{under}".rstrip("/")
    period = period_name(hours)
    shelves = [f"{root}/{period}={p}" for p in periods_between(as_of, lookback, hours)]
    shelves = [shelf for shelf in shelves if files.exists(shelf)]
    if not shelves:
        _check_length(files, root, period)
    df = generations.read_shelves(spark, files, path, shelves, schema, UNIT_DEPTH)
    return df.filter(in_window(df, ts_col, as_of, lookback))


def read_table(
    spark: SparkSession, path: str, schema: T.StructType, hours: int = 1, under: str = ""
) -> DataFrame:
    """All rows of a table, or of one topic ``under`` it, compacted or not."""
    files = Files(spark, path)
    shelves = _shelves(files, path, hours, under)
    return generations.read_shelves(spark, files, path, shelves, schema, UNIT_DEPTH)


def _shelves(files: Files, path: str, hours: int, under: str) -> list[str]:
    root = f"{path.rstrip('/')}/{under}".rstrip("/")
    return files.matching(f"{root}/{period_name(hours)}=*")


def _check_length(files: Files, root: str, period: str) -> None:
    found = {name.split("=")[0] for name in files.names(root)}
    others = sorted(name for name in found if name.startswith("period_") and name != period)
    if others and period not in found:
        raise ValueError(f"{root} has {', '.join(others)}, not {period}")


def compact(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    as_of: datetime,
    closed_after: timedelta,
    hours: int = 1,
    under: str = "",
    kept: timedelta = timedelta(hours=1),
) -> list[int]:
    """Fold the batches of periods that ended ``closed_after`` ago; the periods that changed.

    Streams may go on writing, late rows to closed periods too. The last batch that a writer began
    can still be repeated and is left for the next time. What earlier foldings replaced is
    removed when it is older than ``kept``, which must be longer than any read takes.
    """
    files, by = Files(spark, path), [c for c in ("algo",) if c in schema.names]
    closed = as_utc(as_of) - closed_after

    def finished(unit: str) -> bool:
        parts = dict(part.split("=", 1) for part in unit.split("/"))
        begun = [int(name) for name in files.names(f"{path}/{WRITERS}/{parts[WRITER]}")]
        return bool(begun) and int(parts[BATCH]) < max(begun)

    changed = []
    for shelf in _shelves(files, path, hours, under):
        period = int(shelf.rsplit("=", 1)[1])
        if _EPOCH + timedelta(hours=(period + 1) * hours) > closed:
            continue
        generations.sweep(files, shelf, kept.total_seconds())
        if generations.fold(spark, files, path, shelf, schema, UNIT_DEPTH, finished, by):
            changed.append(period)
    return changed
