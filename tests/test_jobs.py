"""The command line jobs, end to end over tables; and the topic connector's options."""

import json
import subprocess
import sys
from datetime import UTC, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import DataFrameReader, DataFrameWriter
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from flowloop.__main__ import main
from flowloop.operators.decode import decode
from flowloop.operators.labelling import LABEL_COLUMNS, label_messages, resolve_answers
from flowloop.operators.normalize import normalize_flows
from flowloop.operators.scoring import score_messages
from flowloop.schemas import BEATS, label_record
from flowloop.sources.messages import kafka_messages, topic_window, write_kafka
from flowloop.sources.models import USER, VALIDATED, ModelStore
from flowloop.sources.tables import append_periods
from tests.conftest import SF_DIR

NOW = datetime(2024, 1, 30, 12, tzinfo=UTC)


@pytest.fixture
def paths(spark, messages, tmp_path):
    """Message files whose times end just before NOW, spread over its last minute."""
    at = F.timestamp_micros(F.lit(int(NOW.timestamp()) * 10**6 - 1) - F.col("key").cast("bigint") * 1000)
    recent = messages.withColumn("ts", at)
    recent.write.parquet(str(tmp_path / "messages"))
    append_periods(recent, str(tmp_path / "raw"), "ts")
    return {
        name: str(tmp_path / name)
        for name in ("messages", "raw", "models", "labels", "validated", "candidates", "scored",
                     "checkpoint", "answers", "stream")
    }


def _run(*argv, minute=0):
    moment = NOW + timedelta(minutes=minute)
    main([argv[0], "--as-of", moment.isoformat(), *argv[1:]])


def test_the_whole_loop(spark, paths):
    def answers(name):
        """Answer every parked candidate by the port rule, as one JSON file."""
        path = f"{paths['answers']}/{name}"
        parked = spark.read.parquet(paths["candidates"])
        parked.select(
            "id", F.when(F.col("dest_port") == 53, "true").otherwise("false").alias("answer")
        ).write.json(path)
        return path

    _run("park", "--table", paths["raw"], "--candidates", paths["candidates"], "--limit", "400")
    assert spark.read.parquet(paths["candidates"]).count() == 400
    _run("answer", "--submissions", answers("user"), "--candidates", paths["candidates"],
         "--labels", paths["labels"], "--kind", "user", minute=1)
    _run("train", "--user-labels", paths["labels"], "--models", paths["models"], minute=2)
    store = ModelStore(spark, paths["models"])
    assert store.latest(USER) == 1 and store.latest(VALIDATED) is None

    _run("score", "--messages", paths["messages"], "--models", paths["models"], "--out", paths["scored"])
    scored = spark.read.parquet(paths["scored"])
    rows = scored.count()
    _run("score", "--messages", paths["messages"], "--models", paths["models"], "--out", paths["scored"],
         "--backfill")
    again = spark.read.parquet(paths["scored"])
    assert again.count() == rows > 0
    parts = again.select("topic", "period_1h", "algo").distinct().count()
    assert len(again.inputFiles()) == parts

    paths["candidates"] += "_predicted"
    _run("park", "--table", paths["scored"], "--candidates", paths["candidates"],
         "--kind", "predictions", "--limit", "300")
    parked = spark.read.parquet(paths["candidates"])
    assert parked.count() == 300
    assert parked.filter("predictedLabel <> cast(cast(dest_port = 53 AS int) AS string)").count() == 0
    _run("answer", "--submissions", answers("validated"), "--candidates", paths["candidates"],
         "--labels", paths["validated"], "--kind", "validated", minute=1)
    _run("train", "--user-labels", paths["labels"], "--validated-labels", paths["validated"],
         "--models", paths["models"], minute=2)
    assert store.latest(USER) == 2 and store.latest(VALIDATED) == 1

    _run("stream", "--models", paths["models"], "--checkpoint", paths["checkpoint"],
         "--messages", paths["messages"], "--out", paths["stream"], "--available-now")
    topics = {r.topic: r["count"] for r in spark.read.parquet(paths["stream"]).groupBy("topic").count().collect()}
    assert topics == {"model_predictions": rows, "strong_predictions": rows}


def test_answers_for_unknown_candidates_are_reported(spark, paths, tmp_path, capsys):
    _run("park", "--table", paths["raw"], "--candidates", paths["candidates"])
    (tmp_path / "answers.json").write_text(json.dumps({"id": -1, "answer": "true"}))
    _run("answer", "--submissions", str(tmp_path / "answers.json"), "--candidates", paths["candidates"],
         "--labels", paths["labels"])
    assert "1 answers for unknown candidates" in capsys.readouterr().out


def test_a_repeated_answer_replaces_its_labels(spark, paths, tmp_path):
    _run("park", "--table", paths["raw"], "--candidates", paths["candidates"])
    _run("park", "--table", paths["raw"], "--candidates", paths["candidates"])
    assert spark.read.parquet(paths["candidates"]).count() == 10
    one = spark.read.parquet(paths["candidates"]).first().id
    rows = [{"id": one, "answer": "true"}, {"id": -1, "answer": "true"}]
    (tmp_path / "answers.json").write_text("\n".join(map(json.dumps, rows)))
    for _ in range(2):
        _run("answer", "--submissions", str(tmp_path / "answers.json"), "--candidates",
             paths["candidates"], "--labels", paths["labels"], "--rejects", str(tmp_path / "rejects"),
             "--default-answer", "false")
    labels = spark.read.parquet(paths["labels"]).collect()
    assert len(labels) == 10 and [row.id for row in labels if row.label] == [one]
    assert [row.id for row in spark.read.json(str(tmp_path / "rejects")).collect()] == [-1]


def test_default_answers_stay_on_their_page(spark, paths, tmp_path):
    """Of two parked pages one is answered; the other's candidates get no label. A retry, at
    another time, replaces the labels, also where it has fewer."""
    for run in ("one", "two"):
        _run("park", "--table", paths["raw"], "--candidates", paths["candidates"], "--run-id", run)
    parked = spark.read.parquet(paths["candidates"])
    pages = {r.page: r["count"] for r in parked.groupBy("page").count().collect()}
    assert sorted(pages.values()) == [10, 10]
    two = max(pages)
    one = parked.filter(F.col("page") == two).first().id
    answers = tmp_path / "answers.json"
    argv = ("answer", "--submissions", str(answers), "--candidates", paths["candidates"],
            "--labels", paths["labels"])
    for minute in (1, 200):
        answers.write_text(json.dumps({"id": one, "answer": "true"}))
        _run(*argv, "--default-answer", "false", minute=minute)
        labels = spark.read.parquet(paths["labels"]).collect()
        on_page = {r.id for r in parked.filter(F.col("page") == two).collect()}
        assert {r.id for r in labels} == on_page and len(labels) == 10
        assert [r.id for r in labels if r.label] == [one]
    answers.write_text("")
    _run(*argv, minute=400)
    assert spark.read.schema("id bigint").parquet(paths["labels"]).count() == 0


def test_two_inputs_share_a_table(spark, paths, pair, tmp_path):
    ModelStore(spark, paths["models"]).publish(USER, pair)
    other = str(tmp_path / "other")
    spark.read.parquet(paths["messages"]).filter("key < '5'").write.parquet(other)
    counts = []
    for source in (paths["messages"], other, paths["messages"], other):
        _run("score", "--messages", source, "--models", paths["models"], "--out", paths["scored"])
        counts.append(spark.read.parquet(paths["scored"]).count())
    assert counts[0] < counts[1] == counts[2] == counts[3]


def test_answers_as_a_stream(spark, paths, tmp_path):
    """Labels, unknown and late answers; a restart adds what is new and a page's defaults."""
    _run("park", "--table", paths["raw"], "--candidates", paths["candidates"], "--limit", "30",
         "--page-size", "10")
    parked = spark.read.parquet(paths["candidates"]).orderBy("page", "id").collect()
    assert len({r.page for r in parked}) == 3
    folder, rejects = tmp_path / "submissions", str(tmp_path / "rejects")
    folder.mkdir()

    def submit(name, *rows):
        (folder / name).write_text("\n".join(json.dumps(row) for row in rows))

    def label(**more):
        _run("answers", "--submissions", str(folder), "--candidates", paths["candidates"],
             "--labels", paths["labels"], "--checkpoint", paths["checkpoint"], "--available-now",
             "--rejects", rejects, "--late-hours", "24", "--default-answer", "false")

    soon, late = "2024-01-30T13:00:00Z", "2024-02-02T00:00:00Z"
    submit("a.json", {"id": parked[0].id, "answer": "true", "submitted_at": soon},
           {"id": -1, "answer": "true", "submitted_at": soon},
           {"id": parked[10].id, "answer": "true", "submitted_at": late})
    label()
    labels = spark.read.parquet(paths["labels"])
    # The defaults of a page have the time of the batch, which is years after parking.
    assert [(r.id, r.label) for r in labels.collect()] == [(parked[0].id, 1)]
    assert labels.first().labelled_at == datetime(2024, 1, 30, 13)
    told = spark.read.parquet(rejects).groupBy("reason").count().collect()
    assert {r.reason: r["count"] for r in told} == {"unknown": 1, "late": 1 + 9 + 9}
    label()
    submit("b.json", {"id": parked[1].id, "answer": "no", "submitted_at": soon})
    label()
    assert {r.id: r.label for r in spark.read.parquet(paths["labels"]).collect()} == {
        parked[0].id: 1, parked[1].id: 0
    }


def test_rejects_and_schema_of_a_stored_table(spark, paths, pair, tmp_path):
    ModelStore(spark, paths["models"]).publish(USER, pair)
    (tmp_path / "schema.json").write_text(BEATS.json())
    _run("score", "--messages", paths["messages"], "--models", paths["models"], "--out", paths["scored"],
         "--rejects", str(tmp_path / "rejects"), "--schema", str(tmp_path / "schema.json"))
    scored = spark.read.parquet(paths["scored"]).select("key").distinct().count()
    rejects = spark.read.parquet(str(tmp_path / "rejects"))
    assert scored + rejects.count() == spark.read.parquet(paths["messages"]).count()
    assert rejects.filter("reason IS NULL").count() == 0


def test_train_says_why_it_ends(spark, paths, tmp_path):
    train = ("train", "--models", paths["models"])
    for argv in (
        train,
        (*train, "--servers", "h", "--user-labels", paths["labels"]),
    ):
        with pytest.raises(SystemExit, match="train: give"):
            _run(*argv)
    with pytest.raises(FileNotFoundError):
        _run(*train, "--user-labels", paths["labels"])
    empty = spark.createDataFrame([], label_record("label").add("labelled_at", "timestamp"))
    empty.write.parquet(paths["labels"])
    with pytest.raises(SystemExit) as ended:
        _run(*train, "--user-labels", paths["labels"])
    assert ended.value.code == 1
    (tmp_path / "columns.json").write_text('{"columns": ["a"], "feature_columns": ["a"]}')
    with pytest.raises(SystemExit, match="scored by"):
        _run(*train, "--user-labels", paths["labels"], "--columns", str(tmp_path / "columns.json"))


def test_topic_source_options(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(DataStreamReader, "format", lambda self, name: seen.update(format=name) or self)
    monkeypatch.setattr(DataStreamReader, "option", lambda self, k, v: seen.update({k: v}) or self)
    monkeypatch.setattr(
        DataStreamReader,
        "load",
        lambda self: spark.sql("SELECT cast('k' AS binary) key, cast('v' AS binary) value,"
                               " 7 partition, timestamp'2024-01-01' timestamp"),
    )
    df = kafka_messages(spark, "host:9092")
    assert seen == {
        "format": "kafka",
        "kafka.bootstrap.servers": "host:9092",
        "kafkaConsumer.pollTimeoutMs": 10000,
        "subscribe": "beats",
    }
    assert df.dtypes == [("key", "string"), ("value", "string"), ("ts", "timestamp")]
    assert (df.first().key, df.first().value) == ("k", "v")


@pytest.fixture
def broker(spark, monkeypatch):
    """Batch reads of topics kept in memory, as the connector would return them."""
    topics, seen = {}, []

    class Reader:
        def __init__(self):
            self.settings = {}

        def option(self, name, value):
            self.settings[name] = value
            return self

        def options(self, **settings):
            self.settings.update(settings)
            return self

        def load(self):
            seen.append(self.settings)
            df = topics[self.settings["subscribe"]]
            return df.select(
                F.col("key").cast("binary"),
                F.col("value").cast("binary"),
                F.col("ts").alias("timestamp"),
                F.expr("cast(null AS array<struct<key: string, value: binary>>) AS headers"),
            )

    load = DataFrameReader.format
    monkeypatch.setattr(
        DataFrameReader, "format", lambda self, name: Reader() if name == "kafka" else load(self, name)
    )
    topics["seen"] = seen
    return topics


def test_a_topic_window_is_exact(spark, broker):
    broker["t"] = spark.sql(
        "SELECT 'k' key, cast(id AS string) value, timestamp_micros(1706616000000000 + id) ts"
        " FROM range(-60000001, 3)"
    ).filter("value IN ('-60000001', '-60000000', '-1', '0', '1')")
    rows = topic_window(spark, "host:9092", "t", NOW, timedelta(minutes=1)).collect()
    assert sorted(row.value for row in rows) == ["-1", "-60000000"]
    assert broker["seen"][0] == {
        "kafka.bootstrap.servers": "host:9092",
        "kafkaConsumer.pollTimeoutMs": 10000,
        "subscribe": "t",
        "startingTimestamp": "1706615940000",
        "startingOffsetsByTimestampStrategy": "latest",
    }


def test_the_loop_over_topics(spark, paths, pair, broker):
    messages = spark.read.parquet(paths["messages"])
    scored = score_messages(normalize_flows(decode(messages)), pair)
    broker["beats"] = messages
    # A batch that was published twice: the candidates are the same.
    broker["model_predictions"] = scored.unionByName(scored)
    for kind in ("live", "predictions"):
        _run("park", "--servers", "h", "--candidates", paths["candidates"], "--kind", kind, "--limit", "99")
    parked = spark.read.parquet(paths["candidates"])
    assert parked.count() == 198 and parked.filter("predictedLabel IS NULL").count() == 99
    answers = parked.select("id", F.lit("true").alias("answer"))
    for topic, label_col in LABEL_COLUMNS.items():
        sent = label_messages(resolve_answers(answers, parked, label_col), topic)
        broker[topic] = sent.withColumn("ts", F.lit(NOW))
    _run("train", "--servers", "h", "--models", paths["models"], minute=1)
    store = ModelStore(spark, paths["models"])
    assert store.latest(USER) == store.latest(VALIDATED) == 1


def test_topic_sink_columns(messages, pair, monkeypatch):
    seen = {}
    monkeypatch.setattr(DataFrameWriter, "format", lambda self, name: seen.update(format=name) or self)
    monkeypatch.setattr(DataFrameWriter, "option", lambda self, k, v: seen.update({k: v}) or self)
    monkeypatch.setattr(DataFrameWriter, "save", lambda self: seen.update(columns=self._df.columns))
    write_kafka(score_messages(normalize_flows(decode(messages)), pair), "host:9092")
    assert seen == {
        "format": "kafka",
        "kafka.bootstrap.servers": "host:9092",
        "columns": ["key", "value", "topic"],
    }


def test_the_comparison_benchmark_runs(spark, monkeypatch, capsys):
    from benchmarks import compare

    monkeypatch.setattr(compare, "timed", lambda action, runs=1: (action(), 0.0)[1])
    compare.main(SF_DIR, "1", "2")
    told = json.loads(capsys.readouterr().out.strip().split("\n")[-1])
    assert told["messages"] == 1000 and told["training_rows"] > 0 and told["micro_batch_rows"] > 0


def test_the_entry_survives_a_missing_library(tmp_path):
    """In a process where a text operator's library cannot be imported, the core queries are there."""
    code = (
        "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e;"
        " print(len(e.queries()), 'rf_score' in e.queries(), 'pipeline' in e.queries())"
    )
    root = str(Path(__file__).resolve().parent.parent)
    done = subprocess.run(
        [sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True
    )
    count, scored, piped = done.stdout.split()[-3:]
    assert int(count) >= 40 and scored == "True" and piped == "False"
