"""Tables that several writers share, candidate look-ups, and compaction under a running writer."""

import threading
import time
from collections import Counter
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloop.plans.label import park_candidates, parked_candidates
from flowloop.sources import candidates as store
from flowloop.sources import generations
from flowloop.sources.files import Files
from flowloop.sources.tables import (
    Batch,
    append_periods,
    compact,
    read_table,
    read_window,
    replace_batch,
    writer_of,
)

NOON = datetime(2024, 1, 30, 12, tzinfo=UTC)
HOUR = timedelta(hours=1)
ROW = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("algo", T.StringType()),
    ]
)


def rows(spark, *keys, at=NOON):
    found = [(key, at, algo) for key in keys for algo in ("kmeans", "rf")]
    return spark.createDataFrame(found, ROW)


def keys(df):
    return Counter(row.key for row in df.filter("algo = 'rf'").collect())


# -- writers and runs ------------------------------------------------------------


def test_writers_keep_each_others_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    replace_batch(rows(spark, "a"), path, "ts", Batch("one"))
    replace_batch(rows(spark, "b"), path, "ts", Batch("two"))
    assert keys(read_table(spark, path, ROW)) == {"a": 1, "b": 1}
    replace_batch(rows(spark, "c", at=NOON + HOUR), path, "ts", Batch("one"))
    assert keys(read_table(spark, path, ROW)) == {"b": 1, "c": 1}
    replace_batch(rows(spark, "d"), path, "ts", Batch("one", 1))
    replace_batch(rows(spark, "e"), path, "ts", Batch("one", 1))
    assert keys(read_table(spark, path, ROW)) == {"b": 1, "c": 1, "e": 1}


def test_a_checkpoint_keeps_its_writer(spark, tmp_path):
    first = writer_of(spark, str(tmp_path / "c"))
    assert writer_of(spark, str(tmp_path / "c")) == first != writer_of(spark, str(tmp_path / "d"))


def test_a_repeated_run_replaces_all_it_wrote(spark, tmp_path):
    path = str(tmp_path / "t")
    append_periods(rows(spark, "a"), path, "ts", run="r")
    append_periods(rows(spark, "b", at=NOON + HOUR), path, "ts", run="r")
    assert keys(read_table(spark, path, ROW)) == {"b": 1}
    append_periods(rows(spark), path, "ts", run="r")
    assert keys(read_table(spark, path, ROW)) == {}


# -- compaction ------------------------------------------------------------------


def _folders(tmp_path):
    period = next((tmp_path / "t").glob("period_1h=*"))
    return sorted(path.name for path in period.iterdir() if not path.name.startswith("."))


def test_compaction_folds_what_is_finished(spark, tmp_path):
    path = str(tmp_path / "t")
    for number in range(4):
        replace_batch(rows(spark, f"s{number}"), path, "ts", Batch("stream", number))
    replace_batch(rows(spark, "other"), path, "ts", Batch("table"))
    before = keys(read_table(spark, path, ROW))

    def fold(kept=HOUR):
        return compact(spark, path, ROW, NOON + 5 * HOUR, HOUR, kept=kept)

    assert len(before) == 5 and compact(spark, path, ROW, NOON + HOUR, HOUR) == []
    period = int(NOON.timestamp()) // 3600
    assert fold() == [period]
    # All are still there for readers that began before; new ones see each row once.
    assert keys(spark.read.parquet(path)) == before == keys(read_table(spark, path, ROW))
    window = read_window(spark, path, ROW, "ts", NOON + HOUR, HOUR)
    assert keys(window) == before
    assert fold() == []
    with pytest.raises(ValueError, match="compacted"):
        replace_batch(rows(spark, "again"), path, "ts", Batch("stream", 1))
    # The last batch can be repeated; then it is no longer the last, and is folded too.
    replace_batch(rows(spark, "repeated"), path, "ts", Batch("stream", 3))
    replace_batch(rows(spark, "late"), path, "ts", Batch("stream", 4))
    assert fold(timedelta(0)) == [period]
    want = {"s0": 1, "s1": 1, "s2": 1, "repeated": 1, "late": 1, "other": 1}
    assert keys(read_table(spark, path, ROW)) == want
    assert fold(timedelta(0)) == []
    assert keys(read_table(spark, path, ROW)) == want
    left = _folders(tmp_path)
    assert [name for name in left if name.startswith("_generation")] == ["_generation-2"]
    assert len([name for name in left if name.startswith("_rows")]) == 1
    with pytest.raises(ValueError, match="compacted"):
        replace_batch(rows(spark, "again"), path, "ts", Batch("stream", 1))


def test_of_two_compactions_one_wins(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    for number in range(3):
        replace_batch(rows(spark, f"s{number}"), path, "ts", Batch("stream", number))
    publish = Files.publish

    def late(self, marker, text):
        # Another job was faster.
        if "_generation" in marker and not self.exists(marker):
            monkeypatch.setattr(Files, "publish", publish)
            assert compact(spark, path, ROW, NOON + 5 * HOUR, HOUR)
        return publish(self, marker, text)

    monkeypatch.setattr(Files, "publish", late)
    assert compact(spark, path, ROW, NOON + 5 * HOUR, HOUR) == []
    assert keys(read_table(spark, path, ROW)) == {"s0": 1, "s1": 1, "s2": 1}
    assert len([name for name in _folders(tmp_path) if name.startswith("_rows")]) == 1


def test_readers_see_every_row_once_while_a_stream_writes(spark, tmp_path):
    path = str(tmp_path / "t")
    replace_batch(rows(spark, "k0"), path, "ts", Batch("stream", 0))
    written, wrong, done = [0], [], threading.Event()

    def write():
        for number in range(1, 12):
            replace_batch(rows(spark, f"k{number}"), path, "ts", Batch("stream", number))
            written[0] = number
        done.set()

    def read():
        while not done.is_set():
            least = written[0]
            seen = keys(read_table(spark, path, ROW))
            if set(seen.values()) != {1} or not {f"k{n}" for n in range(least + 1)} <= set(seen):
                wrong.append((least, seen))

    threads = [threading.Thread(target=job) for job in (write, read)]
    for thread in threads:
        thread.start()
    folded = 0
    while not done.is_set():
        folded += len(compact(spark, path, ROW, NOON + 5 * HOUR, HOUR, kept=timedelta(seconds=20)))
        time.sleep(0.2)
    for thread in threads:
        thread.join()
    compact(spark, path, ROW, NOON + 5 * HOUR, HOUR, kept=timedelta(0))
    compact(spark, path, ROW, NOON + 5 * HOUR, HOUR, kept=timedelta(0))
    assert folded and not wrong
    assert keys(read_table(spark, path, ROW)) == {f"k{n}": 1 for n in range(12)}
    shelf = str(next((tmp_path / "t").glob("period_1h=*")))
    files = Files(spark, path)
    # The last batch is left, and what was folded is gone.
    assert len(generations.units_of(files, shelf, 2)) <= 2


# -- candidates ------------------------------------------------------------------


def candidates(spark, n):
    return spark.range(n).select(
        F.lit("1.2.3.4").alias("source_ipv4"),
        F.lit(16909060).cast("bigint").alias("source_ip"),
        F.col("id").cast("int").alias("source_port"),
        F.lit("5.6.7.8").alias("dest_ipv4"),
        F.lit(84281096).cast("bigint").alias("dest_ip"),
        F.lit(53).cast("int").alias("dest_port"),
    )


def test_a_page_of_answers_lists_the_buckets_of_its_ids(spark, tmp_path):
    path = str(tmp_path / "c")
    park_candidates(candidates(spark, 3000), path, buckets=64)
    parked = parked_candidates(spark, path)
    pages = parked.groupBy("page").agg(F.count("*").alias("n"), F.countDistinct(F.col("id") % 64).alias("b"))
    assert [tuple(r) for r in pages.select(F.max("n"), F.max("b")).collect()] == [(10, 1)]
    ten = parked.orderBy("id").limit(10).select("id")
    ten = spark.createDataFrame(ten.collect(), "id bigint")
    found = parked_candidates(spark, path, wanted=ten)
    listed = {name.split("bucket=")[1].split("/")[0] for name in found.inputFiles()}
    assert listed == {str(r.id % 64) for r in ten.collect()} and len(listed) <= 10
    assert {r.id for r in found.join(ten, "id").collect()} == {r.id for r in ten.collect()}
    page = parked.first().page
    named = spark.createDataFrame([(None, page)], "id bigint, page string")
    only = parked_candidates(spark, path, wanted=named)
    assert len({name.split("bucket=")[1].split("/")[0] for name in only.inputFiles()}) == 1
    assert only.filter(F.col("page") == page).count() == 10
    nothing = spark.createDataFrame([], "id bigint")
    assert parked_candidates(spark, path, wanted=nothing).count() == 0


def test_a_parking_run_is_replaced(spark, tmp_path):
    path = str(tmp_path / "c")
    park_candidates(candidates(spark, 30), path, run="r")
    park_candidates(candidates(spark, 5), path, run="other")
    park_candidates(candidates(spark, 7), path, run="r", parked_at=NOON + 100 * HOUR)
    assert parked_candidates(spark, path).count() == 12
    park_candidates(candidates(spark, 0), path, run="r")
    assert parked_candidates(spark, path).count() == 5


def test_colliding_ids_are_drawn_anew(spark, tmp_path, monkeypatch):
    """Ids from a range hardly larger than the table collide within a run and with the table."""
    path = str(tmp_path / "c")
    draws = []

    def narrow():
        draws.append(1)
        return F.floor(F.rand(len(draws)) * 400).cast("bigint")

    monkeypatch.setattr(store, "random_id", narrow)
    for run in range(4):
        park_candidates(candidates(spark, 60), path, run=str(run), buckets=2, page_size=60)
    parked = parked_candidates(spark, path)
    ids = [r.id for r in parked.collect()]
    assert len(ids) == 240 == len(set(ids)) and set(ids) <= set(range(400))
    assert len(draws) > 4
    monkeypatch.setattr(store, "random_id", lambda: F.lit(8).cast("bigint"))
    with pytest.raises(RuntimeError, match="no free ids"):
        park_candidates(candidates(spark, 2), path, run="full", buckets=2)
    assert parked_candidates(spark, path).count() == 240


def test_the_layout_belongs_to_the_table(spark, tmp_path):
    path = str(tmp_path / "c")
    park_candidates(candidates(spark, 3), path, buckets=8)
    park_candidates(candidates(spark, 3), path, buckets=32)
    assert store.CandidateTable(spark, path).buckets() == 8
    with pytest.raises(FileNotFoundError):
        parked_candidates(spark, str(tmp_path / "none"), wanted=spark.range(1))
    with pytest.raises(ValueError, match="power of two"):
        park_candidates(candidates(spark, 3), path, buckets=10)
