"""Training sets and model fits."""

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from datetime import datetime, timedelta

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import IndexToString, StringIndexer, VectorIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloop.functions import in_window
from flowloop.operators.features import assemble
from flowloop.schemas import FEATURES

# Look-back of both label sets and model settings.
LABEL_LOOKBACK = timedelta(hours=1)
CLUSTERS = 10
TREES = 10
MAX_CATEGORIES = 4
SEED = 1

# Rows of one part of a training set, and copies of one row that stay together.
PART_ROWS = 100_000
CHUNK = 10_000


def training_set(
    labels: DataFrame,
    as_of: datetime | None = None,
    lookback: timedelta | None = LABEL_LOOKBACK,
    label_col: str = "label",
    ts_col: str = "labelled_at",
    feature_cols: Sequence[str] = FEATURES,
) -> DataFrame:
    """Labelled rows of ``[as_of - lookback, as_of)`` as features and ``label``.

    Without ``lookback`` all rows count. Rows whose label is not 0 or 1, or whose
    feature is no number, are left out.
    """
    rows = labels.filter(in_window(labels, ts_col, as_of, lookback)).select(
        *[F.col(c).try_cast("bigint").alias(c) for c in feature_cols],
        F.col(label_col).try_cast("int").alias("label"),
    )
    return assemble(rows.dropna().filter(F.col("label").isin(0, 1)), feature_cols)


@contextmanager
def in_fixed_order(
    data: DataFrame,
    feature_cols: Sequence[str] = FEATURES,
    part_rows: int = PART_ROWS,
    kept: bool = False,
) -> Iterator[DataFrame]:
    """Features, and ``label`` if there is one, in a layout that depends on nothing but the rows.

    Fits draw samples and initial centres by partition and place in it, so the layout decides what
    they learn. Rows are dealt by their content to a number of parts that follows their number, and
    sorted there: any input layout gives the same models. Equal rows travel as one with their
    number and become rows again in chunks, so a row with most of the copies fills many parts.
    They are grouped in as many parts too: in the layout that they come in, one task could have to
    group them all. The rows are kept, with spilling, while the context is open; those that are
    ``kept`` by the caller are not kept twice.
    """
    columns = [*feature_cols, *(c for c in ("label",) if c in data.columns)]
    given = data.select(*columns)
    if not kept:
        given = given.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        parts = max(1, -(-given.count() // part_rows))
        dealt = given.repartition(parts, *columns)
        counted = dealt.groupBy(*columns).agg(F.count("*").alias("n"))
        last = F.floor((F.col("n") - 1) / CHUNK).cast("bigint")
        chunks = F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("chunk")
        spread = counted.select("*", chunks).repartition(parts, *columns, "chunk")
        copies = F.least(F.lit(CHUNK), F.col("n") - F.col("chunk") * CHUNK).cast("int")
        rows = spread.sortWithinPartitions(*columns, "chunk")
        rows = rows.select(*columns, F.explode(F.array_repeat(F.lit(0), copies)))
        laid_out = assemble(rows.select(*columns), feature_cols)
        laid_out = laid_out.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            # Once they are laid out, the room of the given rows is free for the fits.
            laid_out.count()
            given.unpersist()
            yield laid_out
        finally:
            laid_out.unpersist()
    finally:
        given.unpersist()


def enough_points(data: DataFrame, k: int = CLUSTERS) -> bool:
    """Whether there are at least ``k`` distinct feature rows."""
    return data.select("features").distinct().limit(k).count() >= k


def fit_kmeans(data: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> KMeansModel:
    """Cluster the raw, unscaled feature vectors; labels play no part."""
    return KMeans(k=k, seed=seed).fit(data.select("features"))


def fit_forest(
    data: DataFrame,
    trees: int = TREES,
    max_categories: int = MAX_CATEGORIES,
    seed: int = SEED,
) -> PipelineModel:
    """Label index, feature index, forest and label decode as one pipeline.

    A categorical feature value unseen in training goes to an extra category
    instead of failing the batch that brings it.
    """
    label_index = StringIndexer(inputCol="label", outputCol="indexedLabel").fit(data)
    feature_index = VectorIndexer(
        inputCol="features",
        outputCol="indexedFeatures",
        maxCategories=max_categories,
        handleInvalid="keep",
    )
    forest = RandomForestClassifier(
        labelCol="indexedLabel", featuresCol="indexedFeatures", numTrees=trees, seed=seed
    )
    decode = IndexToString(
        inputCol="prediction", outputCol="predictedLabel", labels=label_index.labels
    )
    return Pipeline(stages=[label_index, feature_index, forest, decode]).fit(data)
