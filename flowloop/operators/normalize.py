"""Decoded records to flows with two addresses and two ports."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloop.functions import ADDRESS_FORMS

LAST_WINS = "last_wins"
COALESCE = "coalesce"
DOTTED_QUAD = "dotted_quad"

FLOW_COLUMNS = ["source_ip", "dest_ip", "dest_port", "source_port"]


def _endpoints(mode: str) -> dict[str, Column]:
    source, dest = F.col("data.source.ip"), F.col("data.dest.ip")
    if mode == COALESCE:
        source = F.coalesce(source, F.col("data.json.src_ip"))
        dest = F.coalesce(dest, F.col("data.json.dest_ip"))
    elif mode != LAST_WINS:
        raise ValueError(f"unknown mode {mode!r}")
    return {
        "source_ip": source,
        "dest_ip": dest,
        "dest_port": F.col("data.dest.port"),
        "source_port": F.col("data.source.port"),
    }


def with_flow_columns(
    decoded: DataFrame, mode: str = LAST_WINS, form: str = DOTTED_QUAD
) -> DataFrame:
    """Add the four flow columns and ``reason``, which is null for a usable flow.

    ``last_wins`` reads addresses only from ``source.ip`` and ``dest.ip``;
    ``coalesce`` falls back to ``json.src_ip`` and ``json.dest_ip``. ``form`` is a key
    of ``ADDRESS_FORMS``.
    """
    endpoints = _endpoints(mode)
    empty = F.lit(True)
    for field in decoded.schema["data"].dataType.names:
        empty = empty & F.col("data").getField(field).isNull()
    absent = F.when(empty, "undecodable")
    for name in ("source_ip", "dest_ip", "source_port", "dest_port"):
        absent = absent.when(endpoints[name].isNull(), f"missing {name}")
    numbers = [
        (ADDRESS_FORMS[form](column) if name.endswith("_ip") else column).alias(name)
        for name, column in endpoints.items()
    ]
    # Like the record itself, the numbers come out of a generator: a filter above
    # tests the finished columns instead of converting the addresses again.
    row = F.struct(*numbers, absent.alias("absent"))
    flows = decoded.select("*", F.inline(F.array(row)))
    reason = F.coalesce(
        "absent",
        F.when(F.col("source_ip").isNull(), "invalid source_ip"),
        F.when(F.col("dest_ip").isNull(), "invalid dest_ip"),
    )
    return flows.withColumn("reason", reason).drop("absent")


def normalize_flows(
    decoded: DataFrame, mode: str = LAST_WINS, form: str = DOTTED_QUAD
) -> DataFrame:
    """The usable flows: both addresses valid, both ports present."""
    return with_flow_columns(decoded, mode, form).filter(F.col("reason").isNull()).drop("reason")


def flow_rejects(
    decoded: DataFrame, mode: str = LAST_WINS, form: str = DOTTED_QUAD
) -> DataFrame:
    """The other messages, with the first reason that rules each out."""
    return with_flow_columns(decoded, mode, form).filter(F.col("reason").isNotNull())
