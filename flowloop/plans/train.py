"""The training job: both label sets to published model pairs."""

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame

from flowloop.operators.training import (
    CLUSTERS,
    LABEL_LOOKBACK,
    enough_points,
    fit_forest,
    fit_kmeans,
    in_fixed_order,
    training_set,
)
from flowloop.schemas import FEATURES
from flowloop.sources.models import USER, VALIDATED, ModelPair, ModelStore


@dataclass(frozen=True)
class TrainResult:
    """``version`` of the published pair, or the ``reason`` the old one stays."""

    version: int | None = None
    reason: str | None = None


def fit_pair(data: DataFrame) -> ModelPair:
    """Both models of one training set; their jobs share the cluster."""
    with ThreadPool(2) as pool:
        fits = [inheritable_thread_target(data.sparkSession)(f) for f in (fit_kmeans, fit_forest)]
        kmeans, forest = pool.map(lambda fit: fit(data), fits, chunksize=1)
    return ModelPair(kmeans, forest)


def train_pair(
    data: DataFrame, store: ModelStore, name: str, feature_cols: Sequence[str] = FEATURES
) -> TrainResult:
    """Fit and publish one pair; too little data publishes nothing, a failed fit raises.

    The same rows give the same models, however they are partitioned.
    """
    with in_fixed_order(data, feature_cols) as laid_out:
        if not enough_points(laid_out):
            return TrainResult(reason=f"fewer than {CLUSTERS} distinct feature rows")
        return TrainResult(version=store.publish(name, fit_pair(laid_out)))


def train_all(
    user_labels: DataFrame,
    validated_labels: DataFrame | None,
    store: ModelStore,
    as_of: datetime | None = None,
    lookback: timedelta | None = LABEL_LOOKBACK,
    feature_cols: Sequence[str] = FEATURES,
) -> dict[str, TrainResult]:
    """Train the user pair and, when there are validated labels, the validated pair.

    Serves both the first training and the periodic one: an outside scheduler
    calls it again, and a running stream picks the new versions up. Without ``lookback``
    all labels count.
    """
    labels = {USER: (user_labels, "label"), VALIDATED: (validated_labels, "validated_label")}
    sets = {
        name: training_set(rows, as_of, lookback, label, feature_cols=feature_cols)
        for name, (rows, label) in labels.items()
        if rows is not None
    }
    return {name: train_pair(data, store, name, feature_cols) for name, data in sets.items()}
