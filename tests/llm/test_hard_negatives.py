import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloop.llm import hard_negatives as hard
from flowloop.llm.queries import op12_hard_negatives
from tests.conftest import SF_DIR

SCHEMA = "vec_id bigint, embedding array<float>, label int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def plain(rows, changed=True):
    """Every anchor against every row."""
    taking = []
    for vec_id, vector, label in rows:
        if label is None or vector is None:
            continue
        if any(x is None or not math.isfinite(x) for x in vector):
            continue
        if changed and vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        # As the table holds them, components are floats.
        whole = [math.floor(256 * float(np.float32(x))) for x in vector]
        taking.append((vec_id, whole, label))
    out = []
    for a, (anchor_id, va, la) in enumerate(taking):
        if anchor_id is None or anchor_id % 50:
            continue
        scored = [
            (-sum(x * y for x, y in zip(va, vb)), b is None, b or 0, b, lb)
            for i, (b, vb, lb) in enumerate(taking)
            if i != a
        ]
        scored.sort(key=lambda s: s[:3])
        for positive in [s for s in scored if s[4] == la][:5]:
            score = -positive[0]
            fits = [
                s for s in scored if s[4] != la and 50 * score <= -100 * s[0] <= 95 * score
            ]
            for rank, s in enumerate(fits[:3], 1):
                out.append((anchor_id, positive[3], rank, s[3], score, -s[0]))
    return sorted(out, key=str)


def mined(spark, rows, **options):
    table = spark.createDataFrame(rows, SCHEMA).withColumns(
        {name: F.lit("mine") for name in ("uid", "v", "block", "bucket", "squares", "rank")}
    )
    vectors = hard.vectors(table.repartition(3), changed=hard.changed_label())
    found = hard.hard_negatives(vectors, **options).select(*COLUMNS).collect()
    return sorted(map(tuple, found), key=str)


def clustered(rng, n, width=12, labels=4, spread=0.3):
    """Rows around one centre a label, of lengths from a half to two."""
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(labels)]
    out = []
    for i in range(n):
        label = rng.randrange(labels)
        v = [c + rng.gauss(0, spread) for c in centres[label]]
        length = math.sqrt(sum(x * x for x in v)) / rng.uniform(0.5, 2)
        out.append((i, [x / length for x in v], label))
    return out


def test_whole_table(spark):
    got = op12_hard_negatives(spark, "/root/testdata/sf0.1").select(*COLUMNS).collect()
    table = duckdb.read_parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = table.query("embeddings", hard.ORACLE).fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()
    got = op12_hard_negatives(spark, SF_DIR).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == plain([tuple(r) for r in rows])


@pytest.mark.parametrize("size", [16, 100, 4096])
def test_lengths_and_clusters(spark, size):
    rows = clustered(random.Random(size), 700)
    assert mined(spark, rows, bucket=size) == plain(rows)


def test_odd_rows(spark):
    rng = random.Random(3)
    rows = clustered(rng, 160, 6, 3)
    same = rows[50][1]
    rows += [(i, same, 1) for i in range(1000, 1400)]  # a vector with most of the rows
    rows += [(i, [0.0] * 6, 0) for i in (50, 2000, 2001)]  # an id again, zero vectors
    rows += [(100, rows[100][1], rows[100][2])] * 2  # repeated rows
    rows += [
        (None, same, 1),
        (None, rows[10][1], 2),
        (3000, None, 1),
        (3050, rows[1][1], None),
        (3100, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1),
        (3150, [float("nan")] * 6, 1),
        (3200, [float("inf")] * 6, 1),
        (3250, [], 1),
        (3300, [0.5, 0.25], 2),
        (3350, [-x for x in same], 77),
        (3400, [0.25] * 8, 2),
        (-50, [30000.0] * 6, 2),
        (-7, [-30000.0, 1.0, 1.0, 1.0, 1.0, 1.0], 0),
    ]
    assert mined(spark, rows, bucket=64) == plain(rows)
    assert mined(spark, [r for r in rows if r[0] is None or r[0] % 50]) == []
    assert mined(spark, []) == []
    assert mined(spark, [(50, [1.0], 1)]) == []


def test_large_components(spark):
    """Products that doubles would round."""
    rng = random.Random(4)
    rows = [(i, [rng.uniform(0.5, 1) * 4e6 for _ in range(4)], i % 2) for i in range(120)]
    assert mined(spark, rows, bucket=32) == plain(rows)


def test_candidates_hold_all_that_matters():
    """No row that reaches the least score is left out; where lengths and coordinates differ, most
    of the others are."""
    rng = np.random.default_rng(5)
    v = rng.normal(0, 1, (1000, 8)) * np.geomspace(4, 0.5, 8) * 100
    v = np.floor(v).astype(np.int64)
    n = np.arange(1000)
    members = hard.Members(n, n, np.ones(1000, dtype=bool), n % 3, v)
    directions, lengths = hard._directions(v)
    lists = np.argsort(directions, axis=0, kind="stable").T.astype("<u2")
    bucket = hard.Bucket(members, lists)
    seen = 0
    for a in range(100):
        scores = v @ v[a]
        for least in (int(np.sort(scores)[-5]), 0, 1, -50_000, int(scores.max()) + 1):
            places = bucket.candidates(directions[a], lengths[a], least)
            found = set(range(1000) if places is None else places.tolist())
            assert set(np.flatnonzero(scores >= least).tolist()) <= found
            if least == int(np.sort(scores)[-5]):
                seen += len(found)
    assert seen < 100 * 1000 / 2


def test_rows_pass_no_driver(spark, monkeypatch):
    """Blocks and buckets are never broadcast, whatever sizes Spark estimates: a broadcast is
    collected in the driver, and one of blocks beside every cell grew with both numbers."""
    sent, write = {}, hard.written

    def nodes(node):
        yield node
        if node.nodeName() == "AdaptiveSparkPlan":
            yield from nodes(node.initialPlan())
        for i in range(node.children().size()):
            yield from nodes(node.children().apply(i))

    def seen(df, name):
        plan = df._jdf.queryExecution().executedPlan()
        broadcasts = [n for n in nodes(plan) if n.nodeName() == "BroadcastExchange"]
        sent[name] = [n.output().mkString(",") for n in broadcasts]
        return write(df, name)

    monkeypatch.setattr(hard, "written", seen)
    rows = clustered(random.Random(6), 300)
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "1g")
    try:
        assert mined(spark, rows, bucket=16) == plain(rows)
    finally:
        spark.conf.set(name, before)
    columns = [c.split("#")[0] for outputs in sent.values() for o in outputs for c in o.split(",")]
    assert not {"v", "block_v", "lists", "told"} & set(columns), sent
    assert {"positives_found", "negatives_found"} <= set(sent)


@pytest.mark.parametrize("partitions", ["1", "3", "300"])
def test_any_number_of_cells(spark, partitions):
    rows = clustered(random.Random(7), 300)
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, partitions)
    try:
        assert mined(spark, rows, bucket=16) == plain(rows)
    finally:
        spark.conf.set(name, before)
