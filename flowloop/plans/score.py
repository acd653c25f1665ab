"""Scoring a stored table of messages in one batch."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from flowloop.operators.decode import decode
from flowloop.operators.normalize import DOTTED_QUAD, LAST_WINS, normalize_flows
from flowloop.operators.scoring import score_messages
from flowloop.schemas import BEATS
from flowloop.sources.models import ModelPair


def score_table(
    messages: DataFrame,
    user: ModelPair,
    validated: ModelPair | None = None,
    mode: str = LAST_WINS,
    strong_scorer: str = "validated",
    form: str = DOTTED_QUAD,
    schema: T.StructType = BEATS,
    **only: Sequence[str],
) -> DataFrame:
    """Raw messages to scored messages; narrow from scan to output, no shuffle.

    ``only`` are the ``topics`` and ``algos`` to make messages of, if not all.
    """
    flows = normalize_flows(decode(messages, schema), mode, form)
    return score_messages(flows, user, validated, strong_scorer, **only)
