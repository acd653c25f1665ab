"""Toxicity and quality: gradients, held-out accuracy, and what a score may depend on."""

import math
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloop.llm import quality as q
from flowloop.llm import toxicity as tox
from flowloop.llm.labelled import labelled_sample
from tests.conftest import SF_DIR
from tests.llm.conftest import ODD, documents

LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture(scope="module")
def made(spark):
    """Toxic is an insult beside a group mention; poor is a text that repeats its words."""
    rng = random.Random(4)
    words = [f"{a}{b}{c}" for a in "bdfgkl" for b in "aeiou" for c in "mnrst"]
    rows, labels = [], []
    for i in range(900):
        body = rng.choices(words, k=rng.randrange(5, 60))
        insult, group, poor = rng.random() < 0.5, rng.random() < 0.5, rng.random() < 0.3
        if poor:
            body = [w for w in body for _ in range(6)]
        body += ["scoundrel"] * insult + ["islanders"] * group
        rows.append((i, " ".join(body)))
        labels.append((i, int(not poor), int(insult and group)))
    return documents(spark, rows), spark.createDataFrame(labels, LABELS)


def accuracy(scored, labels, label):
    rows = scored.join(labels, "doc_id").filter("held_out")
    return rows.agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0]


def test_interactions_are_learned(made):
    docs, labels = made
    machine = tox.fit_toxicity(docs, labels)
    assert accuracy(tox.toxicity(docs, machine), labels, "toxic") > 0.97


def test_quality_is_learned(made):
    docs, labels = made
    assert accuracy(q.quality(docs, q.fit_quality(docs, labels)), labels, "quality") > 0.97


def test_machine_scores_alike_in_bulk_and_alone():
    rng = np.random.default_rng(2)
    m = tox.FactorizationMachine(np.arange(9), 0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    x = (rng.random((20, 9)) < 0.5).astype(float)
    bulk = 1 / (1 + np.exp(-m.logits(x)))
    alone = [m.score(np.flatnonzero(row).tolist()) for row in x]
    assert np.allclose(bulk, alone)
    pairs = [
        m.bias + m.weights[row > 0].sum()
        + sum(m.factors[i] @ m.factors[j] for i in np.flatnonzero(row) for j in np.flatnonzero(row) if i < j)
        for row in x
    ]
    assert np.allclose(m.logits(x), pairs)


def test_attention_gradients():
    rng = np.random.default_rng(3)
    model = q.AttentionModel([rng.normal(0, 0.3, s) for s in q.AttentionModel.shapes()])
    x, starts, y = rng.random((11, q.WIDTH)), np.array([0, 4, 5]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = model.forward(x, starts)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for param, grad in zip(model.params, model.gradients(x, starts, y)):
        for _ in range(5):
            at = tuple(rng.integers(0, n) for n in param.shape)
            kept = param[at]
            param[at] = kept + 1e-5
            high = loss()
            param[at] = kept - 1e-5
            low = loss()
            param[at] = kept
            assert abs((high - low) / 2e-5 - grad[at]) < 1e-6


def plain_quality(text, model):
    """A text's score, passage by passage."""
    enc, tan, gate, att, top, bias = model.params
    words = text.split()
    rows = []
    count = max(1, len(words) // q.PASSAGE)
    for i in range(count):
        start = i * q.PASSAGE
        own = words[start : start + q.PASSAGE] if i < count - 1 else words[start:]
        row = np.zeros(q.WIDTH)
        if own:
            for word in own:
                row[zlib.crc32(q.shape(word).encode()) % q.SHAPES] += 1 / len(own)
            chars = "".join(own)
            before = [None, *words][start : start + len(own)]
            row[q.SHAPES :] = [
                len(set(own)) / len(own),
                sum(a == b for a, b in zip(own, before)) / len(own),
                len(chars) / len(own) / 10,
                sum(map(str.isupper, chars)) / len(chars),
                sum(map(str.isalpha, chars)) / len(chars),
                sum(map(str.isdigit, chars)) / len(chars),
                math.log(1 + len(own)) / 5,
                1,
            ]
        rows.append(row)
    hidden = [np.tanh(row @ enc) for row in rows]
    strength = [(np.tanh(h @ tan) / (1 + np.exp(-(h @ gate)))) @ att for h in hidden]
    weights = np.exp(np.array(strength) - max(strength))
    z = sum(w * h for w, h in zip(weights / weights.sum(), hidden))
    return 1 / (1 + math.exp(-float(z @ top + bias[0])))


def test_quality_of_a_whole_table(spark, sample):
    model = q.fit_quality(sample, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    want = {r.doc_id: plain_quality(r.text or "", model) for r in sample.collect()}
    rows = q.quality(sample, model).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert abs(r.score - want[r.doc_id]) < 1e-3
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == (r.score >= 0.3)


def test_toxicity_of_a_whole_table(spark, sample):
    """Every pair of a text's terms, one by one."""
    machine = tox.fit_toxicity(sample, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    place = {int(t): i for i, t in enumerate(machine.terms)}
    scores = {r.doc_id: r.score for r in tox.toxicity(sample, machine).collect()}
    for r in sample.collect():
        found = set()
        for word in re.findall(r"[^\W\d_]+", (r.text or "").lower()):
            keys = ["w" + word] + ["p" + word[:k] for k in (4, 5, 6) if len(word) >= k]
            found |= {zlib.crc32(key.encode()) % tox.BUCKETS for key in keys}
        own = sorted(place[t] for t in found if t in place)
        logit = machine.bias + sum(machine.weights[i] for i in own)
        logit += sum(machine.factors[i] @ machine.factors[j] for i, j in combinations(own, 2))
        assert abs(scores[r.doc_id] - 1 / (1 + math.exp(-max(-40, min(40, logit))))) < 1e-9


def test_the_sample_is_bounded_in_characters(spark):
    docs = documents(spark, [(i, "word " * (i % 40)) for i in range(400)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)], LABELS)
    whole = labelled_sample(docs, labels, "quality", 1000).collect()
    some = labelled_sample(docs, labels, "quality", 1000, 6400).collect()
    assert 0 < len(some) < len(whole) and sum(len(r.text) for r in some) <= 6400
    assert max(len(r.text) for r in some) <= 100
    assert len(labelled_sample(docs, labels, "quality", 3, 6400).collect()) <= 3


def test_held_out_labels_change_nothing(made):
    docs, labels = made
    flipped = labels.withColumn(
        "toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))
    )
    a, b = (tox.fit_toxicity(docs, x) for x in (labels, flipped))
    assert np.array_equal(a.terms, b.terms) and np.array_equal(a.weights, b.weights)


@pytest.mark.parametrize("labelled", [True, False])
def test_odd_rows(spark, odd, none, labelled):
    rows = [(1, 1, 0), (2, 0, 1), (3, None, None), (4, 1, 1), (None, 1, 1), (9, 0, 1), (-5, 1, 0)]
    labels = spark.createDataFrame(rows if labelled else [], LABELS)
    for scored in (
        tox.toxicity(odd, tox.fit_toxicity(odd, labels)),
        q.quality(odd, q.fit_quality(odd, labels)),
    ):
        got = scored.collect()
        assert sorted((r.doc_id for r in got), key=str) == sorted((i for i, _ in ODD), key=str)
        assert all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (3, 4)}) == 1
    assert tox.toxicity(none, tox.fit_toxicity(none, labels)).collect() == []
    assert q.quality(none, q.fit_quality(none, labels)).collect() == []


def test_good_rows_keep_their_columns(spark, odd, made):
    docs, labels = made
    model = q.fit_quality(docs, labels)
    kept = q.good_rows(odd, model)
    assert kept.columns == odd.columns
    want = [r.doc_id for r in q.quality(odd, model).collect() if r.predicted]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(want, key=str)
