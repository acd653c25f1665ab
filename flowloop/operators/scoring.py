"""Flows to scored messages, one pass for all models and topics."""

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeansModel
from pyspark.ml.feature import StringIndexerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloop.operators.features import assemble
from flowloop.operators.normalize import FLOW_COLUMNS
from flowloop.sources.messages import MESSAGE_ID
from flowloop.sources.models import ModelPair

# Topic names and algorithm tags.
PREDICTIONS_TOPIC = "model_predictions"
STRONG_TOPIC = "strong_predictions"
KMEANS = "kmeans"
FOREST = "rf"

_NO_MESSAGE = "struct<topic: string, algo: string, value: string>"
_FLOW_FIELDS = ["key", "data", *FLOW_COLUMNS, "features"]
_FOREST_FIELDS = [
    "indexedFeatures",
    "rawPrediction",
    "probability",
    "prediction",
    "predictedLabel",
]


def score_kmeans(df: DataFrame, model: KMeansModel, prefix: str = "") -> DataFrame:
    """Add ``<prefix>prediction``, the nearest centre."""
    return model.copy().setPredictionCol(f"{prefix}prediction").transform(df)


def score_forest(df: DataFrame, model: PipelineModel, prefix: str = "") -> DataFrame:
    """Add the forest's five columns, each with ``prefix``."""
    stages = [s.copy() for s in model.stages if not isinstance(s, StringIndexerModel)]
    index, forest, decode = stages
    index.setOutputCol(f"{prefix}indexedFeatures")
    forest.setFeaturesCol(f"{prefix}indexedFeatures")
    forest.setRawPredictionCol(f"{prefix}rawPrediction")
    forest.setProbabilityCol(f"{prefix}probability")
    forest.setPredictionCol(f"{prefix}prediction")
    decode.setInputCol(f"{prefix}prediction").setOutputCol(f"{prefix}predictedLabel")
    return PipelineModel(stages).transform(df)


def _message(topic: str, algo: str, prefix: str, fields: list[str]) -> Column:
    """One message: the flow's text, opened at its end for the model's own fields."""
    added = F.to_json(
        F.struct(*[F.col(f"{prefix}{f}").alias(f) for f in fields], F.lit(algo).alias("algo"))
    )
    value = F.concat(F.col("flow_head"), F.substring(added, 2, 2**31 - 1))
    return F.struct(F.lit(topic).alias("topic"), F.lit(algo).alias("algo"), value.alias("value"))


def score_messages(
    flows: DataFrame,
    user: ModelPair,
    validated: ModelPair | None = None,
    strong_scorer: str = "validated",
    topics: Sequence[str] = (PREDICTIONS_TOPIC, STRONG_TOPIC),
    algos: Sequence[str] = (KMEANS, FOREST),
    batch: str | None = None,
) -> DataFrame:
    """``(key, topic, algo, value)`` plus the other columns of ``flows``, such as ``ts``.

    With the name of a ``batch``, every message also has a ``message_id``: the same when the batch
    is scored again, whatever models score it then. Flows of one batch that are alike in every
    field have the same. Only the messages of ``topics`` and ``algos`` are made, and only their models run.

    Every flow gives one message per algorithm, and two more on the strong topic
    while a validated pair exists. The strong messages are scored by that pair;
    ``strong_scorer="user"`` scores them by the user pair instead.
    """
    if strong_scorer not in ("validated", "user"):
        raise ValueError(f"unknown strong scorer {strong_scorer!r}")
    scored = assemble(flows)
    branches = [(PREDICTIONS_TOPIC, "user_", user)]
    if validated is not None:
        if strong_scorer == "user":
            branches.append((STRONG_TOPIC, "user_", None))
        else:
            branches.append((STRONG_TOPIC, "validated_", validated))
    models = {prefix: pair for _, prefix, pair in branches if pair is not None}
    branches = [(topic, prefix) for topic, prefix, _ in branches if topic in topics]
    for prefix in dict.fromkeys(prefix for _, prefix in branches):
        if KMEANS in algos:
            scored = score_kmeans(scored, models[prefix].kmeans, f"{prefix}{KMEANS}_")
        if FOREST in algos:
            scored = score_forest(scored, models[prefix].forest, f"{prefix}{FOREST}_")
    fields = {KMEANS: ["prediction"], FOREST: _FOREST_FIELDS}
    messages = [
        _message(topic, algo, f"{prefix}{algo}_", fields[algo])
        for topic, prefix in branches
        for algo in (KMEANS, FOREST)
        if algo in algos
    ]
    if not messages:
        messages = [F.lit(None).cast(_NO_MESSAGE)]
        scored = scored.limit(0)
    # The flow part of the text is the same in all its messages: written once, and
    # never empty, so cutting its closing brace and adding a comma is enough.
    flow_text = F.col("flow_text")
    head = F.concat(F.substring(flow_text, F.lit(1), F.length(flow_text) - 1), F.lit(","))
    texts = scored.withColumn("flow_text", F.to_json(F.struct(*_FLOW_FIELDS)))
    texts = texts.withColumn("flow_head", head)
    carried = [c for c in flows.columns if c not in _FLOW_FIELDS]
    if batch is None:
        return texts.select("key", *carried, F.inline(F.array(*messages)))
    flow = [F.col(c) for c in ("key", "flow_text", *carried)]
    # 128 bits: a batch of any size has no two flows of one hash.
    hashes = [F.hex(F.xxhash64(*flow, F.lit(salt))) for salt in (0, 1)]
    flow_id = F.concat_ws("-", F.lit(batch), *hashes).alias("flow_id")
    sent = texts.select("key", *carried, flow_id, F.inline(F.array(*messages)))
    message_id = F.concat_ws("-", "flow_id", "topic", "algo")
    return sent.withColumn(MESSAGE_ID, message_id).drop("flow_id")
