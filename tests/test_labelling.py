import json
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from flowloop.operators import candidates as cand
from flowloop.operators import labelling
from flowloop.plans.label import park_candidates, parked_candidates, record_answers
from flowloop.plans.score import score_table
from flowloop.schemas import CANDIDATE, PREDICTION_CANDIDATE, label_record
from flowloop.sources.tables import append_periods, read_window
from tests.conftest import plan_of

AS_OF = datetime(2024, 1, 30)
DAY = timedelta(days=1)
FIELDS = [name for name in CANDIDATE.names if name != "id"]


def _candidates(spark, ids, parked_at="2024-01-30 00:00:00", port=53):
    return spark.createDataFrame([(i,) for i in ids], "id bigint").select(
        "id",
        F.lit("1.2.3.4").alias("source_ipv4"),
        F.lit(16909060).cast("bigint").alias("source_ip"),
        F.col("id").cast("int").alias("source_port"),
        F.lit("5.6.7.8").alias("dest_ipv4"),
        F.lit(84281096).cast("bigint").alias("dest_ip"),
        F.lit(port).cast("int").alias("dest_port"),
        F.lit(parked_at).cast("timestamp").alias("parked_at"),
    )


def _skewed(spark, n=3000):
    """A third of the answers are for id 1; a tenth are for ids nobody parked."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 1)
        .when(F.col("id") % 10 == 1, -F.col("id"))
        .otherwise(F.col("id") % 500)
        .alias("id"),
        F.when(F.col("id") % 2 == 0, "true").otherwise("false").alias("answer"),
    )


@pytest.mark.parametrize("chunk", [1, 7, 10_000])
def test_answers_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(labelling, "CHUNK", chunk)
    submissions, candidates = _skewed(spark), _candidates(spark, range(400))
    expected = Counter(
        (row.id, int(row.answer == "true")) for row in submissions.collect() if 0 <= row.id < 400
    )
    labels = labelling.resolve_answers(submissions, candidates, "label")
    assert labels.columns == label_record("label").names
    assert Counter((row.id, row.label) for row in labels.collect()) == expected
    unknown = Counter((row.id, row.answer) for row in submissions.collect() if not 0 <= row.id < 400)
    found = labelling.unknown_submissions(submissions, candidates)
    assert Counter((row.id, row.answer) for row in found.collect()) == unknown


def test_a_hot_id_is_spread_over_tasks(spark, monkeypatch):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {name: spark.conf.get(name) for name in settings}

    def largest_share(chunk):
        monkeypatch.setattr(labelling, "CHUNK", chunk)
        labels = labelling.resolve_answers(_skewed(spark), _candidates(spark, range(400)))
        sizes = [row["count"] for row in labels.groupBy(F.spark_partition_id()).count().collect()]
        return max(sizes) / sum(sizes)

    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        assert largest_share(10**6) > 1 / 5
        assert largest_share(10) < 1 / 8
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_a_page_of_answers_reads_the_candidates_without_a_shuffle(spark, tmp_path):
    """Ten ids are broadcast to the scan of a stored table; only what they meet goes on."""
    _candidates(spark, range(5000)).repartition(4).write.parquet(str(tmp_path / "candidates"))
    stored = spark.read.parquet(str(tmp_path / "candidates"))
    answers = spark.range(10).selectExpr("id * 7 AS id", "'true' AS answer")
    answers.write.json(str(tmp_path / "answers"))
    answers = spark.read.schema("id bigint, answer string").json(str(tmp_path / "answers"))
    labels = labelling.resolve_answers(answers, stored)
    assert sorted(row.id for row in labels.collect()) == [7 * i for i in range(10)]
    lines = plan_of(labels).split("\n")
    scan = next(i for i, line in enumerate(lines) if "FileScan parquet" in line)
    depth = lines[scan].index("+-") if "+-" in lines[scan] else lines[scan].index("*")
    above = []
    for line in reversed(lines[:scan]):
        at = len(line) - len(line.lstrip(" :+-*"))
        if at < depth:
            above.append(line)
            depth = at
    semi = next(i for i, line in enumerate(above) if "LeftSemi" in line)
    assert "BroadcastHashJoin" in above[semi]
    assert not any(word in line for line in above[:semi] for word in ("Exchange", "Sort", "Aggregate"))
    assert "Cartesian" not in plan_of(labels) and "NestedLoop" not in plan_of(labels)


def test_candidates_parked_at_once_have_a_defined_winner(spark):
    parked = _candidates(spark, [1], port=80).unionByName(_candidates(spark, [1], port=443))
    answers = spark.createDataFrame([(1, "true")], "id bigint, answer string")
    for rows in (parked, parked.orderBy("dest_port"), parked.orderBy(F.desc("dest_port"))):
        assert [r.dest_port for r in labelling.resolve_answers(answers, rows).collect()] == [443]


def test_the_candidate_parked_last_counts(spark):
    parked = _candidates(spark, [1, 2], "2024-01-01 00:00:00", port=80).unionByName(
        _candidates(spark, [1], "2024-01-02 00:00:00", port=443)
    )
    answers = spark.createDataFrame([(1, "true"), (2, "no")], "id bigint, answer string")
    labels = labelling.resolve_answers(answers, parked, "validated_label").collect()
    assert {(r.id, r.dest_port, r.validated_label) for r in labels} == {(1, 443, 1), (2, 80, 0)}


def test_unanswered_candidates_of_a_submitted_page_default_to_negative(spark):
    page = F.when(F.col("id") <= 3, "one").when(F.col("id") <= 6, "two").otherwise("three")
    shown = _candidates(spark, range(1, 10)).withColumn("page", page)
    answers = spark.createDataFrame(
        [(2, "true", None), (2, "false", None), (None, None, "three"), (-4, "true", "gone")],
        "id bigint, answer string, page string",
    )
    filled = labelling.with_default_answers(answers, shown)
    assert sorted(map(tuple, filled.collect())) == [
        (-4, "true"), (1, "false"), (2, "false"), (2, "true"), (3, "false"),
        (7, "false"), (8, "false"), (9, "false"),
    ]
    without_pages = labelling.with_default_answers(answers.drop("page"), shown, "true")
    assert sorted(map(tuple, without_pages.filter("id > 0").collect())) == [
        (1, "true"), (2, "false"), (2, "true"), (3, "true"),
    ]


@pytest.mark.parametrize("topic", [labelling.USER_TOPIC, labelling.VALIDATED_TOPIC])
def test_label_messages(spark, topic):
    label_col = labelling.LABEL_COLUMNS[topic]
    answers = spark.createDataFrame([(1, "true"), (2, "false")], "id bigint, answer string")
    parked = _candidates(spark, [1, 2]).withColumn("dest_port", F.lit(None).cast("int"))
    labels = labelling.resolve_answers(answers, parked, label_col)
    sent = labelling.label_messages(labels, topic)
    bodies = [json.loads(row.value) for row in sent.collect()]
    assert all(list(body) == label_record(label_col).names for body in bodies)
    assert {row.topic for row in sent.collect()} == {topic}
    back = labelling.labels_from_messages(sent.withColumn("ts", F.lit(AS_OF)), topic)
    assert back.columns[-1] == "labelled_at"
    assert sorted(back.drop("labelled_at").collect()) == sorted(labels.collect())


# -- candidates ----------------------------------------------------------------


def test_live_page_is_the_newest_ten(messages):
    page = cand.live_candidates(messages, AS_OF, DAY).collect()
    every = cand.live_candidates(messages, AS_OF, DAY, limit=None).collect()
    assert 10 == len(page) < len(every)
    newest = sorted(every, key=lambda row: (-row.ts.timestamp(), row.key))[:10]
    assert page == newest


def test_live_candidates_need_type_and_source_only(spark):
    flow = {"type": "flow", "source": {"ip": "1.2.3.4", "port": 5}}
    values = [
        flow,
        {**flow, "type": "dns"},
        {"type": "flow", "source": {"ip": "1.2.3.4"}},
        {"type": "flow", "source": {"port": 5}},
    ]
    rows = [(str(i), json.dumps(v), AS_OF - timedelta(seconds=1)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "key string, value string, ts timestamp")
    found = cand.live_candidates(df, AS_OF).collect()
    assert [(r.key, r.source_ip, r.dest_ipv4, r.dest_ip, r.dest_port) for r in found] == [
        ("0", 16909060, None, None, None)
    ]


def test_prediction_page(messages, pair):
    scored = score_table(messages, pair)
    page = cand.prediction_candidates(scored, AS_OF, DAY)
    rows = page.collect()
    assert len(rows) == 10
    assert all(r.predictedLabel == str(int(r.dest_port == 53)) for r in rows)
    assert rows == cand.prediction_candidates(scored.drop("algo"), AS_OF, DAY).collect()
    assert cand.with_ids(page).drop("ts").dtypes == [
        (f.name, f.dataType.simpleString()) for f in PREDICTION_CANDIDATE.fields
    ]


def test_pages_are_a_distributed_top_n(spark, messages, pair, tmp_path):
    path = str(tmp_path / "scored")
    score_table(messages, pair).write.parquet(path)
    stored = spark.read.parquet(path)
    for page, scanned in (
        (cand.live_candidates(messages, AS_OF, DAY), "LessThan(ts,2024-01-30"),
        (cand.prediction_candidates(stored, AS_OF, DAY), "LessThan(ts,2024-01-30T00:00), EqualTo(algo,rf)"),
    ):
        plan = plan_of(page)
        assert "TakeOrderedAndProject(limit=10" in plan and "Exchange" not in plan
        assert scanned in plan


def test_an_empty_window_gives_an_empty_page(messages):
    assert cand.live_candidates(messages, datetime(2030, 1, 1)).collect() == []


@pytest.mark.parametrize("predictions", [False, True])
def test_positional_list_round_trip(spark, predictions):
    rows = _candidates(spark, [1, 2**48 - 1]).drop("parked_at")
    rows = rows.withColumn("source_port", F.lit(7)).withColumn("dest_port", F.lit(None).cast("int"))
    if predictions:
        rows = rows.withColumn("predictedLabel", F.lit("1"))
    encoded = cand.encode_parked(rows)
    lists = {row.id: json.loads(row.value) for row in encoded.collect()}
    tail = ["1"] if predictions else []
    assert lists[1] == [1, "1.2.3.4", 16909060, 7, "5.6.7.8", 84281096, None, *tail]
    assert sorted(cand.decode_parked(encoded, predictions).collect()) == sorted(rows.collect())


def test_parked_ids_stay_the_same(spark, messages, tmp_path):
    path = str(tmp_path / "parked")
    rows = cand.live_candidates(messages, AS_OF, DAY, limit=None)
    park_candidates(rows, path)
    parked = parked_candidates(spark, path)
    assert parked.count() == rows.count() == parked.select("id").distinct().count()
    assert sorted(parked.collect()) == sorted(parked.collect())
    park_candidates(rows, path)
    parked = parked_candidates(spark, path)
    assert parked.select("id").distinct().count() == 2 * rows.count()


def test_the_loop_feeds_training(spark, messages, tmp_path):
    from flowloop.operators.training import training_set

    parked_path, label_path = str(tmp_path / "parked"), str(tmp_path / "labels")
    park_candidates(cand.live_candidates(messages, AS_OF, DAY), parked_path, parked_at=AS_OF)
    parked = parked_candidates(spark, parked_path)
    answers = labelling.with_default_answers(
        parked.limit(1).select("id", F.lit("true").alias("answer")), parked
    )
    record_answers(answers, parked, labelling.USER_TOPIC, label_path, labelled_at=AS_OF)
    schema = label_record("label").add("labelled_at", "timestamp")
    later = AS_OF + timedelta(minutes=59)
    labels = read_window(spark, label_path, schema, "labelled_at", later, timedelta(hours=1))
    assert labels.count() == 10
    whole = parked.filter("dest_port IS NOT NULL").count()
    assert training_set(labels, later).count() == whole


# -- period tables -------------------------------------------------------------


@pytest.mark.parametrize("backfill", [False, True])
def test_a_window_lists_only_its_folders(spark, messages, tmp_path, backfill):
    path = str(tmp_path / "t")
    append_periods(messages, path, "ts", hours=24, backfill=backfill)
    window = read_window(spark, path, messages.schema, "ts", AS_OF, timedelta(hours=30), hours=24)
    folders = {name.split("period_24h=")[1].split("/")[0] for name in window.inputFiles()}
    assert len(folders) == 2
    expected = messages.filter("ts >= '2024-01-28 18:00:00' AND ts < '2024-01-30'")
    assert window.exceptAll(expected).count() == 0 and expected.exceptAll(window).count() == 0
    nothing = read_window(spark, path, messages.schema, "ts", datetime(2030, 1, 1), DAY, hours=24)
    assert nothing.count() == 0
    with pytest.raises(ValueError, match="period_24h, not period_1h"):
        read_window(spark, path, messages.schema, "ts", AS_OF, DAY)
    with pytest.raises(FileNotFoundError):
        read_window(spark, f"{path}x", messages.schema, "ts", AS_OF, DAY)


def test_without_a_window_every_year_counts(spark, messages):
    old = messages.withColumn("ts", F.col("ts") - F.expr("INTERVAL 20 YEARS"))
    every = cand.live_candidates(messages, lookback=None, limit=None).count()
    assert cand.live_candidates(old, lookback=None, limit=None).count() == every > 0
