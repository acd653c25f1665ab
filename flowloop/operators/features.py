"""Feature vectors."""

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame

from flowloop.schemas import FEATURES


def assemble(df: DataFrame, feature_cols: Sequence[str] = FEATURES) -> DataFrame:
    """Add the dense vector ``features``; a null input is an error, filter first."""
    return VectorAssembler(inputCols=list(feature_cols), outputCol="features").transform(df)
