"""Small files and folder listings through the cluster's own file system layer."""

import uuid

from pyspark.sql import SparkSession


class Files:
    """The file system that holds ``path``; all methods take full paths."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = self._path(path).getFileSystem(conf)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, folder: str) -> list[str]:
        """The names in a folder; none if there is no such folder."""
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder)))

    def matching(self, pattern: str) -> list[str]:
        found = self._fs.globStatus(self._path(pattern)) or []
        return sorted(status.getPath().toString() for status in found)

    def changed_at(self, path: str) -> float:
        """Seconds since 1970."""
        return self._fs.getFileStatus(self._path(path)).getModificationTime() / 1000

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def mark(self, path: str) -> bool:
        """Make an empty file; whether it was not there before."""
        if self.exists(path):
            return False
        return self._fs.createNewFile(self._path(path))

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> bool:
        """Write a file that appears whole or not at all; whether nobody else was first."""
        folder, name = path.rsplit("/", 1)
        draft = f"{folder}/_draft-{name}-{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(draft), False)
        try:
            stream.write(text.encode())
        finally:
            stream.close()
        # Some file systems rename onto a file that is there.
        won = not self.exists(path) and self._fs.rename(self._path(draft), self._path(path))
        if not won:
            self.delete(draft)
        return won
