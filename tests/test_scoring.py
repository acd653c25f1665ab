import json

import pytest
from pyspark.sql import functions as F

from flowloop.operators.decode import decode
from flowloop.operators.normalize import normalize_flows
from flowloop.operators.scoring import score_messages
from flowloop.plans.score import score_table
from flowloop.sources.models import USER, VALIDATED, ModelPair, ModelStore
from flowloop.streaming.registry import ModelRegistry
from tests.conftest import plan_of

FLOW_FIELDS = ["key", "data", "source_ip", "dest_ip", "dest_port", "source_port", "features"]


def test_message_bodies(messages, pair):
    flows = normalize_flows(decode(messages)).cache()
    rows = score_messages(flows, pair).collect()
    assert len(rows) == 2 * flows.count()
    assert {(row.topic, row.algo) for row in rows} == {
        ("model_predictions", "kmeans"),
        ("model_predictions", "rf"),
    }
    for row in rows:
        body = json.loads(row.value)
        assert body["key"] == row.key and body["algo"] == row.algo
        assert body["data"]["source"]["port"] == body["source_port"]
        assert body["features"]["values"][0] == body["source_ip"]
        if row.algo == "kmeans":
            assert list(body) == [*FLOW_FIELDS, "prediction", "algo"]
            assert isinstance(body["prediction"], int)
        else:
            assert list(body) == [
                *FLOW_FIELDS,
                "indexedFeatures",
                "rawPrediction",
                "probability",
                "prediction",
                "predictedLabel",
                "algo",
            ]
            assert body["predictedLabel"] == str(int(body["dest_port"] == 53))


def test_message_text_is_what_to_json_writes(messages, pair):
    """The text equals one ``to_json`` over all columns of the scored row."""
    from flowloop.operators.features import assemble
    from flowloop.operators.scoring import score_forest, score_kmeans

    flows = normalize_flows(decode(messages)).drop("ts")
    features = assemble(flows)
    expected = score_kmeans(features, pair.kmeans).withColumn("algo", F.lit("kmeans")).select(
        F.to_json(F.struct("*")).alias("value")
    ).union(
        score_forest(features, pair.forest).withColumn("algo", F.lit("rf")).select(
            F.to_json(F.struct("*")).alias("value")
        )
    )
    scored = score_messages(flows, pair).select("value")
    assert scored.exceptAll(expected).count() == 0
    assert expected.exceptAll(scored).count() == 0


def test_awkward_text_survives(spark, pair):
    value = json.dumps(
        {
            "@timestamp": 'quote " backslash \\ brace } é',
            "source": {"ip": "1.2.3.4", "port": 1},
            "dest": {"ip": "5.6.7.8", "port": 53},
        }
    )
    df = spark.createDataFrame([('k"}', value), (None, value)], "key string, value string")
    for row in score_table(df, pair).collect():
        body = json.loads(row.value)
        assert body.get("key") == row.key
        assert body["data"]["@timestamp"] == json.loads(value)["@timestamp"]


def test_strong_messages_need_a_validated_pair(messages, pair):
    topics = lambda df: {r.topic: r["count"] for r in df.groupBy("topic").count().collect()}
    assert set(topics(score_table(messages, pair))) == {"model_predictions"}
    both = topics(score_table(messages, pair, pair))
    assert both["model_predictions"] == both["strong_predictions"] > 0


def test_strong_scorer(spark, messages, pair):
    """The validated pair scores strong messages, or the user pair on request."""
    flipped = pair.forest.copy()
    flipped.stages[3].setLabels(["b", "a"])
    validated = ModelPair(pair.kmeans, flipped)

    def labels(**options):
        scored = score_table(messages, pair, validated, **options)
        strong = scored.filter("topic = 'strong_predictions' AND algo = 'rf'")
        found = strong.select(F.get_json_object("value", "$.predictedLabel")).distinct()
        return {row[0] for row in found.collect()}

    assert labels() == {"a", "b"}
    assert labels(strong_scorer="user") == {"0", "1"}


def test_scoring_is_one_narrow_pass(messages, pair):
    plan = plan_of(score_table(messages, pair, pair))
    assert plan.count("from_json(") == 1
    assert plan.count("FileScan") == 1
    assert "Exchange" not in plan and "Python" not in plan


def test_models_keep_their_own_column_names(messages, pair):
    score_table(messages, pair, pair)
    assert pair.kmeans.getPredictionCol() == "prediction"
    assert pair.forest.stages[1].getOutputCol() == "indexedFeatures"


# -- store and registry --------------------------------------------------------


def test_saved_models_predict_the_same(spark, messages, pair, tmp_path):
    store = ModelStore(spark, str(tmp_path))
    loaded = store.load(USER, store.publish(USER, pair))
    before, after = score_table(messages, pair), score_table(messages, loaded)
    assert before.exceptAll(after).count() == 0 and after.exceptAll(before).count() == 0


def test_versions_are_kept_apart_and_pruned(spark, pair, tmp_path):
    store = ModelStore(spark, str(tmp_path), keep=2)
    assert store.latest(USER) is None and store.load(USER) is None
    assert [store.publish(USER, pair) for _ in range(3)] == [1, 2, 3]
    assert sorted(p.name for p in (tmp_path / USER).iterdir()) == ["v=00000002", "v=00000003"]
    assert store.latest(USER) == 3 and store.latest(VALIDATED) is None


def test_half_published_versions_are_invisible(spark, pair, tmp_path):
    store = ModelStore(spark, str(tmp_path))
    store.publish(USER, pair)
    (tmp_path / USER / "v=00000002" / "kmeans_model").mkdir(parents=True)
    assert store.latest(USER) == 1
    assert store.publish(USER, pair) == 3


class _FakeStore:
    root = "fake"

    def __init__(self):
        self.versions, self.broken, self.looks = {}, set(), 0

    def latest(self, name):
        self.looks += name == USER
        return self.versions.get(name)

    def load(self, name, version):
        if name in self.broken:
            raise OSError("unreadable")
        return ModelPair(f"kmeans {version}", f"forest {version}", version)


def test_models_refresh_on_batch_0_and_every_100th():
    store = _FakeStore()
    store.versions[USER] = 1
    registry = ModelRegistry(store)
    seen = []
    for batch_id in range(201):
        if batch_id == 50:
            store.versions[USER] = 2
        seen.append(registry.for_batch(batch_id)[0].version)
    assert seen[:100] == [1] * 100 and seen[100:] == [2] * 101
    assert store.looks == 3


def test_a_failed_load_keeps_the_pair():
    store = _FakeStore()
    store.versions = {USER: 1, VALIDATED: 1}
    registry = ModelRegistry(store, refresh_every=1)
    registry.for_batch(0)
    store.versions, store.broken = {USER: 2, VALIDATED: 2}, {USER}
    user, validated = registry.for_batch(1)
    assert (user.kmeans, user.forest, user.version) == ("kmeans 1", "forest 1", 1)
    assert validated.version == 2


def test_a_stream_without_models_fails_and_a_restart_looks_again():
    store = _FakeStore()
    registry = ModelRegistry(store)
    with pytest.raises(RuntimeError):
        registry.for_batch(0)
    store.versions[USER] = 1
    user, validated = registry.for_batch(57)
    assert user.version == 1 and validated is None


def test_generated_methods_stay_small_enough_to_compile(spark, messages, pair):
    """The JVM never compiles a method of more than 8000 bytes of bytecode."""
    package = spark._jvm.org.apache.spark.sql.execution.debug
    debug = getattr(getattr(package, "package$"), "MODULE$")
    frames = [normalize_flows(decode(messages)), score_table(messages, pair, pair)]
    for df in frames:
        stages = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
        for i in range(stages.size()):
            assert stages.apply(i)._3().maxMethodCodeSize() < 8000
