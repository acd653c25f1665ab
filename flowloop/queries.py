"""One query per operator, over the whole ``events`` table.

Each takes ``(spark, sf_dir)`` and returns a DataFrame. Queries whose operator
needs a table, a model store or a stream write them below the shared work folder.
"""

from collections.abc import Callable
from datetime import datetime, timedelta
from functools import partial

from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloop.functions import in_window, inet_aton_to_long, ip_to_long
from flowloop.operators import candidates as cand
from flowloop.operators import labelling
from flowloop.operators import training
from flowloop.operators.decode import decode
from flowloop.operators.features import assemble
from flowloop.operators.normalize import COALESCE, LAST_WINS, flow_rejects, normalize_flows
from flowloop.operators.scoring import (
    FOREST,
    PREDICTIONS_TOPIC,
    STRONG_TOPIC,
    score_forest,
    score_kmeans,
)
from flowloop.plans.label import park_candidates, parked_candidates, record_answers
from flowloop.plans.score import score_table
from flowloop.plans.train import fit_pair, train_all
from flowloop.schemas import (
    BEATS,
    CANDIDATE,
    FEATURES,
    PREDICTION_CANDIDATE,
    SCORED,
    SCORED_MESSAGE,
    label_record,
    load_schema,
)
from flowloop.session import work_path
from flowloop.sources import events as derived
from flowloop.sources.messages import MESSAGE_ID, distinct_messages, table_messages
from flowloop.sources.models import USER, VALIDATED, ModelPair, ModelStore
from flowloop.sources.tables import (
    Batch,
    append_periods,
    compact,
    read_table,
    read_window,
    replace_batch,
)
from flowloop.streaming.answers import start_answers, submission_files
from flowloop.streaming.registry import ModelRegistry
from flowloop.streaming.scoring import file_sink, start_scoring

# The data ends on 2024-01-30; a day's look-back keeps every window filled.
AS_OF = datetime(2024, 1, 30)
DAY = timedelta(days=1)


def _event_id() -> Column:
    return F.col("key").cast("bigint").alias("event_id")



def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.messages(_events(spark, sf_dir))


def _flows(spark: SparkSession, sf_dir: str, mode: str = LAST_WINS) -> DataFrame:
    return normalize_flows(decode(_messages(spark, sf_dir)), mode)


def _labels(spark: SparkSession, sf_dir: str, label: str, label_col: str = "label") -> DataFrame:
    """A label table: every valid flow with ``label``, an expression over the event."""
    messages = derived.messages(_events(spark, sf_dir), f"{label} AS {label_col}")
    return normalize_flows(decode(messages)).select(
        *FEATURES, label_col, F.col("ts").alias("labelled_at")
    )


# The forest reproduces the first rule without error; the second is noise.
PORT_LABEL = "cast(element_at(array(53, 80, 443, 8080), cast(1 + event_id % 4 AS int)) = 53 AS int)"
ERROR_LABEL = "cast(event_type = 'error' AS int)"


OTHER_LABEL = f"1 - {PORT_LABEL}"


def _training_data(spark: SparkSession, sf_dir: str, label: str = PORT_LABEL) -> DataFrame:
    return training.training_set(_labels(spark, sf_dir, label), lookback=None)


def _fitted(data: DataFrame, fit: Callable, kept: bool = False):
    """``fit(data)`` in a layout of its own, with the rows decoded once for all passes."""
    with training.in_fixed_order(data, kept=kept) as laid_out:
        return fit(laid_out)


def _pair(spark: SparkSession, sf_dir: str, label: str = PORT_LABEL) -> ModelPair:
    return _fitted(_training_data(spark, sf_dir, label), fit_pair)


def _fitted_each(spark: SparkSession, sf_dir: str, fits: dict[str, Callable]) -> list:
    """What each function fits to its label; the flows are decoded once for all of them."""
    names = {f"label_{i}": label for i, label in enumerate(fits)}
    messages = derived.messages(
        _events(spark, sf_dir), *[f"{label} AS {name}" for name, label in names.items()]
    )
    flows = normalize_flows(decode(messages)).select(
        *FEATURES, *names, F.col("ts").alias("labelled_at")
    )
    flows = flows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return [
            _fitted(training.training_set(flows, None, None, name), fits[label], kept=True)
            for name, label in names.items()
        ]
    finally:
        flows.unpersist()


def _forest(spark: SparkSession, sf_dir: str, label: str = PORT_LABEL) -> ModelPair:
    """A pair of which only the forest is used."""
    return ModelPair(None, _fitted(_training_data(spark, sf_dir, label), training.fit_forest))


def _bigints(*names: str) -> list[Column]:
    return [F.col(name).cast("bigint").alias(name) for name in names]


# -- decode and normalise ------------------------------------------------------


def beats_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode(_messages(spark, sf_dir)).select(
        _event_id(),
        F.col("data.source.ip").alias("source_ipv4"),
        F.col("data.source.port").alias("source_port"),
        F.col("data.dest.ip").alias("dest_ipv4"),
        F.col("data.dest.port").alias("dest_port"),
    )


def schema_file_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the record schema read from a file."""
    path = work_path(spark, "schema")
    text = spark.createDataFrame([(BEATS.json(),)], "value string")
    text.coalesce(1).write.text(path)
    return decode(_messages(spark, sf_dir), load_schema(spark, path)).select(
        _event_id(),
        F.col("data.source.ip").alias("source_ipv4"),
        F.col("data.source.port").alias("source_port"),
        F.col("data.dest.ip").alias("dest_ipv4"),
        F.col("data.dest.port").alias("dest_port"),
    )


def ip_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.addresses(_events(spark, sf_dir)).select(
        "event_id",
        ip_to_long(F.col("source_ipv4")).alias("source_ip"),
        ip_to_long(F.col("dest_ipv4")).alias("dest_ip"),
    )


def inet_aton_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.addresses(_events(spark, sf_dir)).select(
        "event_id",
        inet_aton_to_long(F.col("source_ipv4")).alias("source_ip"),
        inet_aton_to_long(F.col("dest_ipv4")).alias("dest_ip"),
    )


def flow_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flows(spark, sf_dir).select(_event_id(), *_bigints(*FEATURES))


def flow_normalize_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flows(spark, sf_dir, COALESCE).select(_event_id(), *_bigints(*FEATURES))


def rejected_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_rejects(decode(_messages(spark, sf_dir))).select(_event_id(), "reason")


def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = vector_to_array("features")
    return assemble(_flows(spark, sf_dir)).select(
        _event_id(), *[values[i].alias(f"f{i}") for i in range(len(FEATURES))]
    )


# -- labelling -----------------------------------------------------------------


def live_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cand.live_candidates(_messages(spark, sf_dir), AS_OF, DAY)
    return cand.with_ids(rows, F.col("key").cast("bigint")).select(*CANDIDATE.names)


def prediction_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = _forest(spark, sf_dir)
    # The forest's label decode blocks pushdown; over a stored table it is not needed.
    messages = _messages(spark, sf_dir)
    recent = messages.filter(in_window(messages, "ts", AS_OF, DAY))
    rows = cand.prediction_candidates(score_table(recent, forest, algos=[FOREST]), AS_OF, DAY)
    return cand.with_ids(rows, F.col("key").cast("bigint")).select(*PREDICTION_CANDIDATE.names)


def _parked_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every raw flow as a candidate under its event id."""
    rows = cand.live_candidates(_messages(spark, sf_dir), lookback=None, limit=None)
    return cand.with_ids(rows, F.col("key").cast("bigint")).withColumnRenamed("ts", "parked_at")


def _parked_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every forest prediction as a candidate under its event id."""
    scored = score_table(_messages(spark, sf_dir), _forest(spark, sf_dir), algos=[FOREST])
    rows = cand.prediction_candidates(scored, lookback=None, limit=None)
    return cand.with_ids(rows, F.col("key").cast("bigint")).withColumnRenamed("ts", "parked_at")


def user_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = derived.submissions(_events(spark, sf_dir))
    return labelling.resolve_answers(answers, _parked_flows(spark, sf_dir), "label")


def validated_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = derived.submissions(_events(spark, sf_dir))
    parked = _parked_predictions(spark, sf_dir)
    return labelling.resolve_answers(answers, parked, "validated_label")


def unknown_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = derived.submissions(_events(spark, sf_dir))
    return labelling.unknown_submissions(answers, _parked_flows(spark, sf_dir)).select("id")


# Ten events are a page. Of eight pages, six are answered, one is submitted without an answer and
# one is never submitted.
_PAGE = "event_id div 10"


def default_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    answers = derived.submissions(events.filter(f"{_PAGE} % 4 <> 3"))
    untouched = events.filter(f"{_PAGE} % 8 = 3").select(
        F.lit(None).cast("bigint").alias("id"),
        F.lit(None).cast("string").alias("answer"),
        F.expr(f"cast({_PAGE} AS string)").alias("page"),
    )
    submitted = answers.withColumn("page", F.lit(None).cast("string"))
    submitted = submitted.unionByName(untouched.distinct())
    shown = _parked_flows(spark, sf_dir).withColumn("page", F.expr("cast(id div 10 AS string)"))
    return labelling.with_default_answers(submitted, shown)


def candidate_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Park every raw flow, then label the flows of one port by look-ups in the parked table."""
    path = work_path(spark, "candidates")
    rows = cand.live_candidates(_messages(spark, sf_dir), lookback=None, limit=None)
    park_candidates(rows, path)
    answers = parked_candidates(spark, path).filter("dest_port = 53").select(
        "id", F.when(F.col("source_port") % 2 == 0, "true").otherwise("false").alias("answer")
    )
    found = parked_candidates(spark, path, wanted=answers)
    return labelling.resolve_answers(answers, found).drop("id")


def stream_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions as a stream of files over a parked table; all labels that it wrote."""
    parked, source = work_path(spark, "candidates"), work_path(spark, "submissions")
    park_candidates(cand.live_candidates(_messages(spark, sf_dir), lookback=None, limit=None), parked)
    answers = parked_candidates(spark, parked).select(
        "id", F.when(F.col("dest_port") == 53, "true").otherwise("false").alias("answer")
    )
    answers.repartition(FILES).write.json(source)
    labels = work_path(spark, "labels")
    query = start_answers(
        submission_files(spark, source, files_per_trigger=FILES // 2),
        parked,
        labelling.USER_TOPIC,
        labels,
        work_path(spark, "checkpoint"),
        trigger={"availableNow": True},
    )
    query.awaitTermination()
    return read_table(spark, labels, label_record("label")).drop("id")


def label_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = labelling.label_messages(user_labels(spark, sf_dir), labelling.USER_TOPIC)
    received = sent.withColumn("ts", F.lit(AS_OF))
    return labelling.labels_from_messages(received, labelling.USER_TOPIC).select("id", "label")


def validated_label_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = labelling.label_messages(validated_labels(spark, sf_dir), labelling.VALIDATED_TOPIC)
    received = sent.withColumn("ts", F.lit(AS_OF))
    return labelling.labels_from_messages(received, labelling.VALIDATED_TOPIC).select(
        "id", "validated_label"
    )


def candidate_parking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Park every raw flow under a random id and read the table back."""
    path = work_path(spark, "candidates")
    rows = cand.live_candidates(_messages(spark, sf_dir), lookback=None, limit=None)
    park_candidates(rows, path)
    parked = parked_candidates(spark, path)
    listed = cand.decode_parked(cand.encode_parked(parked))
    times = listed.groupBy("id").agg(F.count("*").alias("times"))
    fields = [name for name in CANDIDATE.names if name != "id"]
    return listed.join(times, "id").select(
        F.col("id").between(0, 2**48 - 1).alias("id_fits"),
        (F.col("times") == 1).alias("ids_differ"),
        *fields,
    )


# -- training ------------------------------------------------------------------


def training_set_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = f"CASE WHEN event_id % 3 <> 0 THEN {ERROR_LABEL} END"
    data = training.training_set(_labels(spark, sf_dir, label), AS_OF, DAY)
    return data.select(*FEATURES, "label")


def training_set_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stored label table, of which only the day's folder is read."""
    label = f"CASE WHEN event_id % 3 <> 1 THEN {ERROR_LABEL} END"
    labels = _labels(spark, sf_dir, label, "validated_label")
    path = work_path(spark, "validated_labels")
    append_periods(labels, path, "labelled_at", hours=24, backfill=True)
    window = read_window(spark, path, labels.schema, "labelled_at", AS_OF, DAY, hours=24)
    data = training.training_set(window, AS_OF, DAY, "validated_label")
    return data.select(*FEATURES, "label")


def label_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label order of the fitted pipeline; labels are 0 and 1, so this is two rows."""
    model = _fitted(_training_data(spark, sf_dir, ERROR_LABEL), training.fit_forest)
    rows = [(label, idx) for idx, label in enumerate(model.stages[0].labels)]
    return spark.createDataFrame(rows, "label string, idx bigint")


def feature_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The categories of the fitted pipeline: four values of four features at most."""
    model = _fitted(_training_data(spark, sf_dir), training.fit_forest)
    rows = [
        (FEATURES[feature], float(value), int(idx))
        for feature, values in model.stages[1].categoryMaps.items()
        for value, idx in values.items()
    ]
    return spark.createDataFrame(rows, "feature string, value double, idx bigint")


def rf_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = _fitted(_training_data(spark, sf_dir), training.fit_forest)
    scored = score_forest(assemble(_flows(spark, sf_dir)), forest)
    return scored.select(_event_id(), "predictedLabel")


def rf_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each flow's class probabilities add up and their largest was predicted."""
    forest = _fitted(_training_data(spark, sf_dir, ERROR_LABEL), training.fit_forest)
    scored = score_forest(assemble(_flows(spark, sf_dir)), forest)
    rows = scored.select(_event_id(), "prediction", vector_to_array("probability").alias("p"))
    total = F.aggregate("p", F.lit(0.0), lambda acc, x: acc + x)
    predicted = F.get("p", F.col("prediction").cast("int"))
    return rows.select(
        "event_id",
        (F.abs(total - 1) < 1e-9).alias("sums_to_one"),
        (predicted == F.array_max("p")).alias("is_largest"),
    )


def kmeans_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two clusters of flows that are moved far apart, each named by its smallest event id."""
    far = F.col("source_ip") + F.when(F.col("dest_port") == 53, 2**32).otherwise(0)
    flows = assemble(_flows(spark, sf_dir).withColumn("source_ip", far))
    model = _fitted(flows, partial(training.fit_kmeans, k=2))
    scored = score_kmeans(flows, model).select(_event_id(), "prediction")
    names = scored.groupBy("prediction").agg(F.min("event_id").alias("group_id"))
    # As many rows as there are clusters.
    return scored.join(F.broadcast(names), "prediction").select("event_id", "group_id")


def kmeans_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each flow got the centre that plain column arithmetic finds nearest."""
    model = _fitted(_training_data(spark, sf_dir), training.fit_kmeans)
    scored = score_kmeans(assemble(_flows(spark, sf_dir)), model)
    distances = F.array(
        *[
            sum((F.pow(F.col(name) - float(x), 2) for name, x in zip(FEATURES, c)), F.lit(0.0))
            for c in model.clusterCenters()
        ]
    )
    assigned = F.get(distances, F.col("prediction"))
    # The model compares distances in another order of arithmetic; allow rounding.
    nearest = assigned <= F.array_min(distances) * (1 + 1e-6) + 1e-3
    used = scored.agg(F.countDistinct("prediction")).first()[0]
    return scored.select(
        _event_id(), nearest.alias("is_nearest"), F.lit(used).cast("bigint").alias("centres_used")
    )


def model_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether models of two layouts of the same rows agree on every flow, with all ten clusters."""
    data = _training_data(spark, sf_dir, ERROR_LABEL)
    # As the table is read, and in parts of whole ports; neither has a fixed number of parts.
    keyed = data.repartition("source_port")
    first, second = (_fitted(rows, fit_pair) for rows in (data, keyed))
    flows = assemble(_flows(spark, sf_dir))
    scored = score_kmeans(score_kmeans(flows, first.kmeans, "a_"), second.kmeans, "b_")
    scored = score_forest(score_forest(scored, first.forest, "c_"), second.forest, "d_")
    return scored.select(
        _event_id(),
        (F.col("a_prediction") == F.col("b_prediction")).alias("same_cluster"),
        (vector_to_array("c_probability") == vector_to_array("d_probability")).alias("same_votes"),
    )


def model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = ModelStore(spark, work_path(spark, "models"))
    version = store.publish(USER, _pair(spark, sf_dir))
    pair = store.load(USER, version)
    scored = score_forest(assemble(_flows(spark, sf_dir)), pair.forest)
    return scored.select(_event_id(), "predictedLabel")


# -- scoring -------------------------------------------------------------------


def _envelope(scored: DataFrame, *also: str) -> DataFrame:
    fields = ", ".join(f"{name} string" for name in ("key", "algo", *also))
    body = F.explode(F.array(F.from_json("value", fields))).alias("body")
    read = scored.select("topic", "key", body)
    return read.select(
        F.col("body.key").cast("bigint").alias("event_id"),
        F.col("body.algo").alias("algo"),
        "topic",
        "key",
        *[f"body.{name}" for name in also],
    )


def score_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = _pair(spark, sf_dir)
    return _envelope(score_table(_messages(spark, sf_dir), pair))


def message_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of every scored message, read back from its text."""
    scored = score_table(_messages(spark, sf_dir), _pair(spark, sf_dir))
    vectors = ["features", "indexedFeatures", "rawPrediction", "probability"]
    values = T.StructType([T.StructField("values", T.ArrayType(T.DoubleType()))])
    body = T.StructType(
        [
            *SCORED.fields,
            T.StructField("prediction", T.DoubleType()),
            *[T.StructField(name, values) for name in vectors],
        ]
    )
    features = F.col("data.features.values")
    # Which cluster a flow is in depends on the partitions; that it is in one does not.
    forest = F.col("data.algo") == "rf"
    total = F.aggregate("data.probability.values", F.lit(0.0), lambda acc, x: acc + x)
    return decode(scored, body).filter(F.col("data.prediction").isNotNull()).select(
        _event_id(),
        "data.algo",
        F.col("data.data.source.ip").alias("source_ipv4"),
        F.col("data.data.dest.ip").alias("dest_ipv4"),
        *[F.col(f"data.{name}").cast("bigint").alias(name) for name in FEATURES],
        *[F.get(features, F.lit(i)).alias(f"f{i}") for i in range(len(FEATURES))],
        "data.predictedLabel",
        F.when(forest, F.col("data.prediction")).alias("prediction"),
        F.when(forest, F.size("data.indexedFeatures.values")).alias("indexed"),
        F.when(forest, F.size("data.rawPrediction.values")).alias("raw"),
        (F.abs(total - 1) < 1e-9).alias("sums_to_one"),
    )


def strong_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong messages are scored by the validated pair, which here learned the opposite labels."""
    forest, pair = _fitted_each(
        spark, sf_dir, {PORT_LABEL: training.fit_forest, OTHER_LABEL: fit_pair}
    )
    pairs = [ModelPair(None, forest), pair]
    strong = score_table(_messages(spark, sf_dir), *pairs, topics=[STRONG_TOPIC])
    return _envelope(strong, "predictedLabel")


# Files that a table is written to as the source of a stream.
FILES = 8


def _stream(
    spark: SparkSession, sf_dir: str, published: dict, sink: Callable | None = None, **options
) -> str:
    """All events as four micro-batches of many files; ``published`` names, by batch, a pair that
    becomes available just before it. Returns the path of the scored table.

    Each batch is one run of the stream, which resumes from its checkpoint.
    """
    store = ModelStore(spark, work_path(spark, "models"))
    source = work_path(spark, "messages")
    rows = _messages(spark, sf_dir)
    quarter = F.coalesce(F.pmod(F.col("key").cast("bigint"), F.lit(4)), F.lit(0))
    # By key, because Spark sorts all rows before it deals them in turn; every core gets files.
    files = max(FILES, 2 * spark.sparkContext.defaultParallelism)
    dealt = rows.withColumn("quarter", quarter).repartition(files, "key")
    dealt.write.partitionBy("quarter").parquet(source)

    class Registry(ModelRegistry):
        def for_batch(self, batch_id):
            if batch_id in published:
                self.store.publish(*published[batch_id])
            return super().for_batch(batch_id)

    out, checkpoint = work_path(spark, "scored"), work_path(spark, "checkpoint")
    registry = Registry(store, refresh_every=2)
    for last in range(4):
        query = start_scoring(
            table_messages(spark, f"{source}/quarter=[0-{last}]", rows.schema, streaming=True),
            registry,
            sink or file_sink(out, hours=24),
            checkpoint=checkpoint,
            trigger={"availableNow": True},
            **options,
        )
        query.awaitTermination()
    return out


def stream_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second version comes before batch 1 and is in use from batch 2, when the store is read."""
    pairs = _fitted_each(spark, sf_dir, {PORT_LABEL: fit_pair, OTHER_LABEL: fit_pair})
    scored = spark.read.parquet(_stream(spark, sf_dir, {0: (USER, pairs[0]), 1: (USER, pairs[1])}))
    body = _envelope(scored.filter(F.col("algo") == "rf"), "predictedLabel")
    return body.select("event_id", "predictedLabel")


def stream_strong(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validated pair comes before batch 1: the strong topic opens with batch 2."""
    pair = _pair(spark, sf_dir)
    scored = spark.read.parquet(_stream(spark, sf_dir, {0: (USER, pair), 1: (VALIDATED, pair)}))
    return scored.filter(F.col("topic") == STRONG_TOPIC).select(_event_id(), "algo")


def stream_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages that the stream could not use, from their own sink."""
    path = work_path(spark, "rejects")
    published = {0: (USER, _pair(spark, sf_dir))}
    _stream(spark, sf_dir, published, rejects=file_sink(path, hours=24))
    return spark.read.parquet(path).select(_event_id(), "reason")


def compacted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream's table whose closed periods were folded into one generation each, and whose
    replaced files were removed; the writer's last batch stays as it is."""
    path = _stream(spark, sf_dir, {0: (USER, _pair(spark, sf_dir))})
    under = f"topic={PREDICTIONS_TOPIC}"
    closed = AS_OF + timedelta(days=3650)
    settings = {"hours": 24, "under": under, "kept": timedelta(0)}
    for _ in range(2):
        compact(spark, path, SCORED_MESSAGE, closed, DAY, **settings)
    scored = read_table(spark, path, SCORED_MESSAGE, hours=24, under=under)
    return scored.select(_event_id(), "algo")


def shared_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two inputs scored into one table by writers of their own, one of them twice."""
    pair, path = _pair(spark, sf_dir), work_path(spark, "scored")
    odd = F.coalesce(F.pmod(F.col("key").cast("bigint"), F.lit(2)), F.lit(0)) == 1
    messages = _messages(spark, sf_dir)
    for writer, rows in (("odd", odd), ("even", ~odd), ("odd", odd)):
        scored = score_table(messages.filter(rows), pair)
        replace_batch(scored, path, "ts", Batch(writer), hours=24, backfill=True)
    under = f"topic={PREDICTIONS_TOPIC}"
    return read_table(spark, path, SCORED_MESSAGE, 24, under).select(_event_id(), "algo")


def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of a stream whose batches were all published twice, read back as a stream that
    drops repeats by their ids."""
    sent = work_path(spark, "sent")

    def sink(scored: DataFrame, batch: Batch) -> None:
        rows = scored.select("key", "value", "ts", "topic", "algo", MESSAGE_ID)
        # Scored once: the second publication sends what the first one sent.
        for number in range(2):
            published = f"{sent}/{batch.number}-{number}"
            rows.write.mode("overwrite").parquet(published)
            rows = spark.read.schema(rows.schema).parquet(published)

    sink.wants_ids = True
    _stream(spark, sf_dir, {0: (USER, _pair(spark, sf_dir))}, sink)
    schema = spark.read.parquet(f"{sent}/*").schema
    published = spark.readStream.schema(schema).parquet(f"{sent}/*")
    out = work_path(spark, "distinct")
    # The times of the table span a month, and its files are in no order of time.
    query = (
        distinct_messages(published, "60 days")
        .writeStream.format("parquet")
        .option("checkpointLocation", work_path(spark, "checkpoint"))
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return spark.read.parquet(out).select(_event_id(), "algo")


def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train, publish, run the stream until the source is exhausted, read its sink."""
    store = ModelStore(spark, work_path(spark, "models"))
    train_all(_labels(spark, sf_dir, PORT_LABEL), None, store, lookback=None)
    # As a glob, because a file stream takes a single file only through one.
    path = f"{sf_dir}/events.parque[t]"
    events = spark.readStream.schema(_events(spark, sf_dir).schema).parquet(path)
    out = work_path(spark, "scored")
    query = start_scoring(
        derived.messages(events),
        ModelRegistry(store),
        file_sink(out, hours=24),
        checkpoint=work_path(spark, "checkpoint"),
        trigger={"availableNow": True},
    )
    query.awaitTermination()
    scored = spark.read.parquet(out).filter(F.col("topic") == PREDICTIONS_TOPIC)
    return scored.select(_event_id(), "algo")


def active_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One turn of the loop through its tables: park, answer, train, score again.

    The answers follow the port rule, so the retrained forest predicts it.
    """
    parked_path, label_path = work_path(spark, "candidates"), work_path(spark, "labels")
    messages = _messages(spark, sf_dir)
    rows = cand.live_candidates(messages, lookback=None, limit=None)
    park_candidates(rows, parked_path, parked_at=AS_OF)
    parked = parked_candidates(spark, parked_path)
    answer = F.when(F.col("dest_port") == 53, "true").otherwise("false").alias("answer")
    record_answers(
        parked.select("id", answer), parked, labelling.USER_TOPIC, label_path, labelled_at=AS_OF
    )
    schema = label_record("label").add("labelled_at", "timestamp")
    later = AS_OF + timedelta(minutes=30)
    hour = timedelta(hours=1)
    labels = read_window(spark, label_path, schema, "labelled_at", later, hour)
    store = ModelStore(spark, work_path(spark, "models"))
    train_all(labels, None, store, later, hour)
    scored = score_forest(assemble(_flows(spark, sf_dir)), store.load(USER).forest)
    return scored.select(_event_id(), "predictedLabel")


QUERIES = {
    "beats_decode": beats_decode,
    "schema_file_decode": schema_file_decode,
    "ip_to_long": ip_numbers,
    "inet_aton_to_long": inet_aton_numbers,
    "flow_normalize": flow_normalize,
    "flow_normalize_coalesce": flow_normalize_coalesce,
    "flow_rejects": rejected_flows,
    "feature_vector": feature_vector,
    "live_candidates": live_candidates,
    "prediction_candidates": prediction_candidates,
    "user_labels": user_labels,
    "validated_labels": validated_labels,
    "unknown_submissions": unknown_submissions,
    "default_answers": default_answers,
    "candidate_lookup": candidate_lookup,
    "stream_answers": stream_answers,
    "label_messages": label_messages,
    "validated_label_messages": validated_label_messages,
    "candidate_parking": candidate_parking,
    "training_set_user": training_set_user,
    "training_set_validated": training_set_validated,
    "label_index": label_index,
    "feature_categories": feature_categories,
    "rf_score": rf_score,
    "rf_probability": rf_probability,
    "kmeans_score": kmeans_score,
    "kmeans_nearest": kmeans_nearest,
    "model_layouts": model_layouts,
    "model_roundtrip": model_roundtrip,
    "score_envelope": score_envelope,
    "message_body": message_body,
    "strong_envelope": strong_envelope,
    "stream_score": stream_score,
    "stream_refresh": stream_refresh,
    "stream_strong": stream_strong,
    "stream_rejects": stream_rejects,
    "stream_distinct": stream_distinct,
    "compacted_scores": compacted_scores,
    "shared_table": shared_table,
    "active_loop": active_loop,
}
