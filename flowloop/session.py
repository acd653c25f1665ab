"""Session defaults and the shared work folder."""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # One mistyped field must not blank its neighbours.
    "spark.sql.json.enablePartialResults": "true",
    # A task that writes few partitions keeps their files open instead of sorting its
    # rows; beyond this number, which bounds the buffers, it sorts.
    "spark.sql.maxConcurrentOutputFileWriters": "8",
}

_local_folders: dict[str, str] = {}


def get_session(app_name: str = "flowloop", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for name, value in {**SETTINGS, **settings}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def _base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = context.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="flowloop-")
        atexit.register(shutil.rmtree, _local_folders[app], ignore_errors=True)
    return _local_folders[app]


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset, and only for a local session, whose driver and executors are one
    process, there is a temporary folder instead; it goes when the process ends.
    """
    app = spark.sparkContext.applicationId
    return f"{_base(spark)}/flowloop/{app}/{name}-{uuid.uuid4().hex}"


def clear_work(spark: SparkSession) -> None:
    """Remove what this application put below the shared folder."""
    as_path = spark._jvm.org.apache.hadoop.fs.Path
    folder = as_path(f"{_base(spark)}/flowloop/{spark.sparkContext.applicationId}")
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    folder.getFileSystem(conf).delete(folder, True)
