"""Time the headline queries; prints one JSON line.

Each query runs twice, training and streaming included, into a sink that
discards its rows. The first run warms the JVM up; the second is reported.
"""

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from flowloop.queries import QUERIES
from flowloop.session import clear_work, get_session

HEADLINE = [
    "beats_decode",
    "ip_to_long",
    "flow_normalize",
    "flow_rejects",
    "feature_vector",
    "live_candidates",
    "prediction_candidates",
    "user_labels",
    "validated_labels",
    "unknown_submissions",
    "candidate_parking",
    "training_set_user",
    "training_set_validated",
    "rf_score",
    "kmeans_score",
    "model_roundtrip",
    "score_envelope",
    "strong_envelope",
    "stream_score",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    work = tempfile.mkdtemp(prefix="flowloop-bench-")
    spark = get_session(
        "bench",
        **{
            "spark.checkpoint.dir": work,
            "spark.master": f"local[{cpus}]",
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        run(spark, name, sf_dir)
        seconds[name] = round(run(spark, name, sf_dir), 3)
        clear_work(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
