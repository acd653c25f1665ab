"""Rows shown to a person for labelling."""

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloop.functions import ADDRESS_FORMS, in_window, random_id
from flowloop.operators.decode import decode
from flowloop.operators.normalize import DOTTED_QUAD
from flowloop.operators.scoring import FOREST
from flowloop.schemas import CANDIDATE, PREDICTION_CANDIDATE, RAW_FLOW, SCORED

# Look-backs and page size.
LIVE_LOOKBACK = timedelta(minutes=1)
PREDICTION_LOOKBACK = timedelta(minutes=5)
PAGE_SIZE = 10


# The page needs no other field of a raw flow.
_LIVE_FIELDS = T.StructType([RAW_FLOW[name] for name in ("type", "source", "dest")])


def _newest(df: DataFrame, limit: int | None) -> DataFrame:
    # A bounded page is a distributed top-n; without a limit nothing is sorted.
    return df if limit is None else df.orderBy(F.desc("ts"), "key").limit(limit)


def live_candidates(
    messages: DataFrame,
    as_of: datetime | None = None,
    lookback: timedelta | None = LIVE_LOOKBACK,
    limit: int | None = PAGE_SIZE,
    form: str = DOTTED_QUAD,
) -> DataFrame:
    """The newest raw flows that name a source address and port.

    Returns ``key, ts`` and the candidate columns without ``id``. The
    destination is not checked, so its columns may be null. Without ``lookback``
    the whole table is looked at.
    """
    recent = messages.filter(in_window(messages, "ts", as_of, lookback))
    flows = decode(recent.select("key", "ts", "value"), _LIVE_FIELDS).filter(
        (F.col("data.type") == "flow")
        & F.col("data.source.port").isNotNull()
        & F.col("data.source.ip").isNotNull()
    )
    to_number = ADDRESS_FORMS[form]
    return _newest(flows, limit).select(
        "key",
        "ts",
        F.col("data.source.ip").alias("source_ipv4"),
        to_number(F.col("data.source.ip")).alias("source_ip"),
        F.col("data.source.port").alias("source_port"),
        F.col("data.dest.ip").alias("dest_ipv4"),
        to_number(F.col("data.dest.ip")).alias("dest_ip"),
        F.col("data.dest.port").alias("dest_port"),
    )


def prediction_candidates(
    scored: DataFrame,
    as_of: datetime | None = None,
    lookback: timedelta | None = PREDICTION_LOOKBACK,
    limit: int | None = PAGE_SIZE,
) -> DataFrame:
    """The newest forest predictions, as ``key, ts`` and the candidate columns.

    ``scored`` holds messages of the predictions topic. Its ``algo`` column
    filters before any text is parsed; a bare topic without it is parsed first.
    """
    recent = scored.filter(in_window(scored, "ts", as_of, lookback))
    envelope = [F.col("key"), F.col("ts"), F.col("value")]
    if "algo" in scored.columns:
        recent = recent.filter(F.col("algo") == FOREST).select(*envelope)
        rows = decode(_newest(recent, limit), SCORED)
    else:
        rows = decode(recent.select(*envelope), SCORED).filter(F.col("data.algo") == FOREST)
        rows = _newest(rows, limit)
    return rows.select(
        "key",
        "ts",
        F.col("data.data.source.ip").alias("source_ipv4"),
        "data.source_ip",
        "data.source_port",
        F.col("data.data.dest.ip").alias("dest_ipv4"),
        "data.dest_ip",
        "data.dest_port",
        "data.predictedLabel",
    )


def _shape(candidates: DataFrame):
    return PREDICTION_CANDIDATE if "predictedLabel" in candidates.columns else CANDIDATE


def with_ids(candidates: DataFrame, id_col: Column | None = None) -> DataFrame:
    """Put ``id`` first: a random 48-bit number unless one is given."""
    fields = [F.col(c) for c in _shape(candidates).names if c != "id"]
    rest = [F.col(c) for c in ("ts",) if c in candidates.columns]
    new_id = random_id() if id_col is None else id_col
    return candidates.select(new_id.alias("id"), *fields, *rest)


def in_pages(candidates: DataFrame, run: str, size: int = PAGE_SIZE) -> DataFrame:
    """Add ``page``, which ``size`` rows at most have in common.

    Rows that were sorted and limited are one page in their order; others are dealt as they come.
    """
    number = F.expr(f"monotonically_increasing_id() div {int(size)}")
    return candidates.withColumn("page", F.concat_ws("-", F.lit(run), number))


def encode_parked(candidates: DataFrame) -> DataFrame:
    """``(id, value)`` with the candidate as a positional JSON list."""
    cells = ", ".join(f"cast(`{c}` as variant)" for c in _shape(candidates).names)
    return candidates.select("id", F.expr(f"to_json(array({cells}))").alias("value"))


def decode_parked(parked: DataFrame, with_prediction: bool = False) -> DataFrame:
    """The typed columns back from the positional JSON list."""
    schema = PREDICTION_CANDIDATE if with_prediction else CANDIDATE
    cells = parked.select(F.explode(F.array(F.from_json("value", "array<string>"))).alias("cells"))
    return cells.select(
        *[
            F.get("cells", F.lit(position)).try_cast(field.dataType).alias(field.name)
            for position, field in enumerate(schema.fields)
        ]
    )
