"""Command line jobs; run with ``spark-submit`` or ``python -m flowloop <job> ...``.

Tables are named by path; with ``--servers`` a job uses the topics instead.

``train``    fit both label sets of the last hour and publish the models
``stream``   score the message stream until stopped
``score``    score a stored table of messages once
``park``     choose labelling candidates and append them to the candidate table
``answer``   turn submitted answers into label rows, and label messages if asked
``answers``  the same as a stream over a folder of submissions
``compact``  fold the small files of a scored table's closed periods
"""

import argparse
import hashlib
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from flowloop.functions import ADDRESS_FORMS
from flowloop.operators import candidates as cand
from flowloop.operators import labelling
from flowloop.operators.decode import decode
from flowloop.operators.normalize import COALESCE, DOTTED_QUAD, LAST_WINS, flow_rejects
from flowloop.operators.scoring import PREDICTIONS_TOPIC
from flowloop.operators.training import LABEL_LOOKBACK
from flowloop.plans.label import park_candidates, parked_candidates, record_answers
from flowloop.plans.score import score_table
from flowloop.plans.train import train_all
from flowloop.schemas import (
    BEATS,
    FEATURES,
    MESSAGE,
    SCORED_MESSAGE,
    SUBMISSION,
    label_record,
    load_columns,
    load_schema,
)
from flowloop.session import get_session
from flowloop.sources import tables
from flowloop.sources.files import Files
from flowloop.sources.messages import (
    kafka_messages,
    table_messages,
    topic_window,
    write_kafka,
)
from flowloop.sources.models import KEPT_VERSIONS, USER, VALIDATED, ModelStore
from flowloop.sources.tables import WRITER, Batch, read_window, replace_batch
from flowloop.streaming.answers import start_answers, submission_files
from flowloop.streaming.drain import drained
from flowloop.streaming.registry import ModelRegistry
from flowloop.streaming.scoring import file_sink, kafka_sink, start_scoring

LABELLED_AT = T.StructField("labelled_at", T.TimestampType())


def train(spark: SparkSession, args: argparse.Namespace) -> None:
    """Ends with a status other than 0 when no user pair was published."""
    if not args.user_labels and not args.servers:
        raise SystemExit("train: give --user-labels or --servers")
    if args.servers and (args.user_labels or args.validated_labels):
        raise SystemExit("train: give label tables or --servers, not both")
    if args.columns:
        _, features = load_columns(spark, args.columns)
        if features != FEATURES:
            raise SystemExit(f"train: flows are scored by {FEATURES}, not by {features}")

    def labels(path: str | None, topic: str) -> DataFrame | None:
        if path:
            label = label_record(labelling.LABEL_COLUMNS[topic])
            schema = T.StructType([*label.fields, LABELLED_AT])
            return read_window(spark, path, schema, "labelled_at", args.as_of, LABEL_LOOKBACK)
        if args.servers:
            sent = topic_window(spark, args.servers, topic, args.as_of, LABEL_LOOKBACK)
            return labelling.labels_from_messages(sent, topic)
        return None

    results = train_all(
        labels(args.user_labels, labelling.USER_TOPIC),
        labels(args.validated_labels, labelling.VALIDATED_TOPIC),
        ModelStore(spark, args.models, args.keep_models),
        args.as_of,
    )
    for name, result in results.items():
        print(name, result.reason or f"version {result.version}")
    if results[USER].version is None:
        raise SystemExit(1)


def stream(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.servers:
        messages = kafka_messages(spark, args.servers, args.topic, **dict(args.source_option))
    else:
        messages = table_messages(spark, args.messages, streaming=True)
    if args.out:
        sink = file_sink(args.out)
    else:
        sink = kafka_sink(args.servers, **dict(args.sink_option))
    query = start_scoring(
        messages,
        ModelRegistry(ModelStore(spark, args.models)),
        sink,
        args.checkpoint,
        mode=args.addresses,
        strong_scorer=args.strong_scorer,
        form=args.address_form,
        trigger=_trigger(args),
        rejects=file_sink(args.rejects) if args.rejects else None,
        schema=_record_schema(spark, args),
        stop_marker=args.stop_marker,
    )
    _wait(query, args)


def _record_schema(spark: SparkSession, args: argparse.Namespace) -> T.StructType:
    return load_schema(spark, args.schema) if args.schema else BEATS


def score(spark: SparkSession, args: argparse.Namespace) -> None:
    """The input names the writer, so tables scored into one folder keep each other's rows."""
    store = ModelStore(spark, args.models)
    user, validated = store.load(USER), store.load(VALIDATED)
    if user is None:
        raise SystemExit(f"no user models under {args.models}")
    messages = table_messages(spark, args.messages)
    schema = _record_schema(spark, args)
    scored = score_table(
        messages, user, validated, args.addresses, args.strong_scorer, args.address_form, schema
    )
    batch = Batch(args.writer or _name(args.messages.rstrip("/")), args.batch)
    replace_batch(scored, args.out, "ts", batch, backfill=args.backfill)
    if args.rejects:
        rejected = flow_rejects(decode(messages, schema), args.addresses, args.address_form)
        replace_batch(rejected.select("key", "ts", "reason"), args.rejects, "ts", batch)


def compact(spark: SparkSession, args: argparse.Namespace) -> None:
    """Fold the batches of a scored table's closed periods; streams may write meanwhile."""
    files = Files(spark, args.table)
    topics = [name for name in files.names(args.table) if name.startswith("topic=")]
    for topic in topics:
        changed = tables.compact(
            spark,
            args.table,
            SCORED_MESSAGE,
            args.as_of,
            timedelta(hours=args.closed_hours),
            under=topic,
            kept=timedelta(minutes=args.keep_minutes),
        )
        print(topic, f"{len(changed)} periods compacted")


def park(spark: SparkSession, args: argparse.Namespace) -> None:
    live = args.kind == "live"
    lookback = cand.LIVE_LOOKBACK if live else cand.PREDICTION_LOOKBACK
    if args.servers:
        topic = args.topic if live else PREDICTIONS_TOPIC
        recent = topic_window(spark, args.servers, topic, args.as_of, lookback, distinct=not live)
    else:
        schema, under = (MESSAGE, "") if live else (SCORED_MESSAGE, f"topic={PREDICTIONS_TOPIC}")
        recent = read_window(spark, args.table, schema, "ts", args.as_of, lookback, under=under)
    if live:
        rows = cand.live_candidates(recent, args.as_of, lookback, args.limit, args.address_form)
    else:
        rows = cand.prediction_candidates(recent, args.as_of, lookback, args.limit)
    run = _run_id(args, args.kind)
    size = args.page_size or args.limit
    park_candidates(rows, args.candidates, args.as_of, run, size, bulk=args.limit > size)


def _run_id(args: argparse.Namespace, *parts: str) -> str:
    """The same for a repeated run, which then replaces its rows instead of doubling them.

    The time belongs to it only where it was given: a plain retry has another one.
    """
    if args.run_id:
        return args.run_id
    if args.run is answer:
        return _name(*parts)
    return _name(args.as_of.isoformat(), *parts)


def _name(*parts: str) -> str:
    return hashlib.sha256("|".join(parts).encode()).hexdigest()[:16]


def answer(spark: SparkSession, args: argparse.Namespace) -> None:
    """A set of submissions is labelled once: the input names the run, and a retry replaces it."""
    topic = labelling.USER_TOPIC if args.kind == "user" else labelling.VALIDATED_TOPIC
    submissions = spark.read.schema(SUBMISSION).json(args.submissions)
    parked = parked_candidates(spark, args.candidates, wanted=submissions)
    if args.default_answer:
        submissions = labelling.with_default_answers(submissions, parked, args.default_answer)
    run = _run_id(args, args.kind, args.submissions)
    unknown = record_answers(submissions, parked, topic, args.labels, args.as_of, run)
    if args.servers:
        label = label_record(labelling.LABEL_COLUMNS[topic])
        schema = T.StructType([*label.fields, LABELLED_AT, T.StructField(WRITER, T.StringType())])
        # The labels have this one time, and this reads up to the end of the moment.
        until = args.as_of + timedelta(microseconds=1)
        window = read_window(
            spark, args.labels, schema, "labelled_at", until, timedelta(microseconds=2)
        )
        sent = window.filter(F.col(WRITER) == run).select(*label.names)
        write_kafka(labelling.label_messages(sent, topic), args.servers)
    if args.rejects:
        unknown.write.mode("overwrite").json(f"{args.rejects}/run={run}")
    count = unknown.count()
    if count:
        print(f"{count} answers for unknown candidates")


def answers(spark: SparkSession, args: argparse.Namespace) -> None:
    """Label submissions as they come, until stopped."""
    query = start_answers(
        submission_files(spark, args.submissions),
        args.candidates,
        labelling.USER_TOPIC if args.kind == "user" else labelling.VALIDATED_TOPIC,
        args.labels,
        args.checkpoint,
        rejects=args.rejects,
        default_answer=args.default_answer,
        late_after=timedelta(hours=args.late_hours) if args.late_hours else None,
        servers=args.servers,
        trigger=_trigger(args),
        stop_marker=args.stop_marker,
    )
    _wait(query, args)


def _trigger(args: argparse.Namespace) -> dict:
    return {"availableNow": True} if args.available_now else {"processingTime": args.interval}


def _wait(query: StreamingQuery, args: argparse.Namespace) -> None:
    if args.stop_marker:
        drained(query, args.stop_marker)
    else:
        query.awaitTermination()


def _moment(text: str) -> datetime:
    moment = datetime.fromisoformat(text)
    return moment.replace(tzinfo=UTC) if moment.tzinfo is None else moment


def _option(text: str) -> tuple[str, str]:
    name, value = text.split("=", 1)
    return name, value


def parser() -> argparse.ArgumentParser:
    root = argparse.ArgumentParser(prog="flowloop")
    jobs = root.add_subparsers(required=True)

    def job(run, *required: str, **options):
        command = jobs.add_parser(run.__name__)
        command.set_defaults(run=run)
        command.add_argument("--as-of", type=_moment, default=datetime.now(UTC))
        for name in required:
            command.add_argument(f"--{name}", required=True)
        for name, settings in options.items():
            command.add_argument(f"--{name.replace('_', '-')}", **settings)

    form = {"choices": list(ADDRESS_FORMS), "default": DOTTED_QUAD}
    scoring = {
        "address_form": form,
        "addresses": {"choices": [LAST_WINS, COALESCE], "default": LAST_WINS},
        "strong_scorer": {"choices": ["validated", "user"], "default": "validated"},
    }
    streaming = {
        "available_now": {"action": "store_true"},
        "interval": {"default": "10 seconds"},
        "stop_marker": {"help": "path; once it exists, the stream ends with a whole batch"},
    }
    run_id = {"help": "name of this run; by default from its time and input"}
    job(
        train,
        "models",
        user_labels={},
        validated_labels={},
        servers={},
        columns={"help": "training-set description to check against"},
        keep_models={"type": int, "default": KEPT_VERSIONS},
    )
    job(
        stream,
        "models",
        "checkpoint",
        servers={},
        topic={"default": "beats"},
        messages={},
        out={},
        rejects={},
        schema={},
        source_option={"type": _option, "action": "append", "default": []},
        sink_option={"type": _option, "action": "append", "default": []},
        **streaming,
        **scoring,
    )
    job(
        score,
        "messages",
        "models",
        "out",
        writer={"help": "name of this input in the table; by default from its path"},
        batch={"type": int, "default": 0},
        backfill={"action": "store_true"},
        rejects={},
        schema={},
        **scoring,
    )
    job(
        park,
        "candidates",
        table={},
        servers={},
        topic={"default": "beats"},
        address_form=form,
        kind={"choices": ["live", "predictions"], "default": "live"},
        limit={"type": int, "default": cand.PAGE_SIZE},
        page_size={"type": int, "help": "candidates of one page; by default all of this run"},
        run_id=run_id,
    )
    job(
        answer,
        "submissions",
        "candidates",
        "labels",
        kind={"choices": ["user", "validated"], "default": "user"},
        servers={},
        default_answer={"choices": ["true", "false"]},
        rejects={},
        run_id=run_id,
    )
    job(
        answers,
        "submissions",
        "candidates",
        "labels",
        "checkpoint",
        kind={"choices": ["user", "validated"], "default": "user"},
        servers={},
        default_answer={"choices": ["true", "false"]},
        late_hours={"type": float, "help": "later answers are rejected; by default none"},
        rejects={},
        **streaming,
    )
    job(
        compact,
        "table",
        closed_hours={"type": float, "default": 2},
        keep_minutes={"type": float, "default": 60, "help": "longer than any read takes"},
    )
    return root


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(get_session(), args)


if __name__ == "__main__":
    main()
