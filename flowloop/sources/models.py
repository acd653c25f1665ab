"""Versioned model pairs on a shared file system.

Each publication is a new folder ``<root>/<name>/v=<number>`` holding the k-means
model and the forest pipeline. An empty ``_COMMITTED`` file, created last, makes
the pair visible, so a reader never sees half a pair or one being overwritten.
"""

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import SparkSession

# Versions that stay on disk unless a job says otherwise.
KEPT_VERSIONS = 12

USER = "user"
VALIDATED = "validated"

# The folder names of the two models of each pair.
MODEL_NAMES = {
    USER: ("kmeans_model", "rf_model"),
    VALIDATED: ("validated_kmeans_model", "validated_rf_model"),
}


@dataclass(frozen=True)
class ModelPair:
    kmeans: KMeansModel | None
    forest: PipelineModel
    version: int | None = None


class ModelStore:
    """``keep`` versions stay on disk; older ones are removed on publication."""

    def __init__(self, spark: SparkSession, root: str, keep: int = KEPT_VERSIONS):
        self.spark = spark
        self.root = root.rstrip("/")
        self.keep = keep
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = self._path(self.root).getFileSystem(conf)

    def _folder(self, name: str, version: int) -> str:
        return f"{self.root}/{name}/v={version:08d}"

    def _numbers(self, name: str) -> list[int]:
        folder = self._path(f"{self.root}/{name}")
        if not self._fs.exists(folder):
            return []
        names = [status.getPath().getName() for status in self._fs.listStatus(folder)]
        return sorted(int(n.removeprefix("v=")) for n in names if n.startswith("v="))

    def _committed(self, name: str) -> list[int]:
        return [
            version
            for version in self._numbers(name)
            if self._fs.exists(self._path(f"{self._folder(name, version)}/_COMMITTED"))
        ]

    def _claim(self, name: str) -> int:
        """A version number of our own: creating its claim file fails if it is taken."""
        version = max(self._numbers(name), default=0) + 1
        while not self._fs.createNewFile(self._path(f"{self._folder(name, version)}/_CLAIM")):
            version += 1
        return version

    def publish(self, name: str, pair: ModelPair) -> int:
        version = self._claim(name)
        folder = self._folder(name, version)
        kmeans_name, forest_name = MODEL_NAMES[name]
        pair.kmeans.write().overwrite().save(f"{folder}/{kmeans_name}")
        pair.forest.write().overwrite().save(f"{folder}/{forest_name}")
        self._fs.createNewFile(self._path(f"{folder}/_COMMITTED"))
        oldest = self._committed(name)[-self.keep :][0]
        for old in self._numbers(name):
            if old < oldest:
                self._fs.delete(self._path(self._folder(name, old)), True)
        return version

    def latest(self, name: str) -> int | None:
        return max(self._committed(name), default=None)

    def load(self, name: str, version: int | None = None) -> ModelPair | None:
        """The given or newest committed pair, or None if there is none."""
        version = self.latest(name) if version is None else version
        if version is None:
            return None
        folder = self._folder(name, version)
        kmeans_name, forest_name = MODEL_NAMES[name]
        return ModelPair(
            KMeansModel.load(f"{folder}/{kmeans_name}"),
            PipelineModel.load(f"{folder}/{forest_name}"),
            version,
        )
