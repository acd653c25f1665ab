"""Our plans against the plain way of doing the same, on one table of messages.

The plain way parses in every filter and write, converts addresses in a Python
function and writes once per model. Both sides run on the same Spark session.

    python benchmarks/compare.py [sf_dir] [copies] [cpus]

Every event's message is stored ``copies`` times, under a new work folder.
"""

import ipaddress
import json
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import functions as F

from flowloop import queries
from flowloop.operators.decode import decode
from flowloop.operators.features import assemble
from flowloop.operators.normalize import normalize_flows
from flowloop.operators.scoring import score_forest, score_kmeans
from flowloop.operators.training import fit_forest, fit_kmeans, training_set
from flowloop.plans.score import score_table
from flowloop.schemas import BEATS
from flowloop.session import get_session, work_path
from flowloop.sources import events as derived
from flowloop.sources.messages import table_messages
from flowloop.sources.models import USER, ModelPair, ModelStore
from flowloop.streaming.registry import ModelRegistry
from flowloop.streaming.scoring import file_sink, start_scoring


def plain_flows(messages):
    @F.udf("bigint")
    def number(text):
        try:
            return int(ipaddress.IPv4Address(text))
        except ValueError:
            return None

    parsed = messages.select("key", F.from_json("value", BEATS).alias("data"))
    ends = {
        f"{side}_{part}": F.col(f"data.{side}.{part}")
        for side in ("source", "dest")
        for part in ("ip", "port")
    }
    flows = parsed.select("*", *[column.alias(name) for name, column in ends.items()])
    for name in ends:
        flows = flows.filter(F.col(name).isNotNull())
    for name in ("source_ip", "dest_ip"):
        flows = flows.withColumn(name, number(name)).filter(F.col(name).isNotNull())
    return flows


def plain_messages(flows, pair):
    """One DataFrame per model, as separate writes."""
    flows = assemble(flows)
    value = F.to_json(F.struct("*")).alias("value")
    for scored, algo in (
        (score_kmeans(flows, pair.kmeans), "kmeans"),
        (score_forest(flows, pair.forest), "rf"),
    ):
        yield scored.withColumn("algo", F.lit(algo)).select("key", value)


def timed(action, runs: int = 3) -> float:
    best = None
    for _ in range(runs):
        start = time.perf_counter()
        action()
        spent = time.perf_counter() - start
        best = spent if best is None else min(best, spent)
    return round(best, 2)


def discard(*frames) -> None:
    for frame in frames:
        frame.write.format("noop").mode("overwrite").save()


def main(sf_dir: str = "/root/testdata/sf0.1", copies: str = "20", cpus: str = "4") -> None:
    spark = get_session(
        "compare",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    path = work_path(spark, "messages")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    copy = F.explode(F.sequence(F.lit(1), F.lit(int(copies)))).alias("copy")
    derived.messages(events).select("*", copy).drop("copy").repartition(16).write.parquet(path)
    messages = spark.read.parquet(path)
    results = {"messages": messages.count(), "cpus": int(cpus)}

    labels = queries._labels(spark, sf_dir, queries.PORT_LABEL)
    data = training_set(labels, lookback=None).persist()
    results["training_rows"] = data.count()
    results["fit_kmeans"] = timed(lambda: fit_kmeans(data))
    results["fit_forest"] = timed(lambda: fit_forest(data))
    pair = ModelPair(fit_kmeans(data), fit_forest(data))

    results["normalize"] = timed(lambda: discard(normalize_flows(decode(messages))))
    results["normalize_plain"] = timed(lambda: discard(plain_flows(messages)))
    results["score"] = timed(lambda: discard(score_table(messages, pair)))
    plain = list(plain_messages(plain_flows(messages), pair))
    results["score_plain"] = timed(lambda: discard(*plain))
    results["score_strong"] = timed(lambda: discard(score_table(messages, pair, pair)))
    results["score_strong_plain"] = timed(lambda: discard(*plain, *plain))

    store = ModelStore(spark, work_path(spark, "models"))
    store.publish(USER, pair)
    stream = table_messages(spark, path, messages.schema, streaming=True, files_per_trigger=1)
    query = start_scoring(
        stream,
        ModelRegistry(store),
        file_sink(work_path(spark, "scored"), hours=24 * 365),
        work_path(spark, "checkpoint"),
        trigger={"availableNow": True},
    )
    query.awaitTermination()
    batches = [p for p in query.recentProgress if p["numInputRows"]]
    durations = sorted(p["durationMs"]["triggerExecution"] for p in batches)
    results["micro_batch_rows"] = batches[0]["numInputRows"]
    results["micro_batch_median_ms"] = durations[len(durations) // 2]
    print(json.dumps(results))


if __name__ == "__main__":
    main(*sys.argv[1:])
