import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from flowloop.session import clear_work, get_session
from flowloop.sources import events as derived

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session(
        "tests",
        **{
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("work")),
            "spark.master": "local[4]",
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
            "spark.sql.maxMetadataStringLength": "10000",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clear_work(session)
    session.stop()


@pytest.fixture(scope="session")
def events(spark):
    return spark.read.parquet(f"{SF_DIR}/events.parquet")


@pytest.fixture(scope="session")
def messages(events):
    return derived.messages(events)


@pytest.fixture(scope="session")
def pair(spark, messages):
    """Both models, trained on every valid flow with the port rule as label."""
    from pyspark.sql import functions as F

    from flowloop.operators.decode import decode
    from flowloop.operators.features import assemble
    from flowloop.operators.normalize import normalize_flows
    from flowloop.plans.train import fit_pair

    flows = normalize_flows(decode(messages))
    labelled = flows.withColumn("label", (F.col("dest_port") == 53).cast("int"))
    return fit_pair(assemble(labelled).cache())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()
