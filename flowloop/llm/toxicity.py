"""Toxicity by a factorization machine over hashed terms.

A text is the set of its hashed terms: its words and the beginnings of its words. The machine scores
it by a weight for each term and, for each pair of terms, the product of two factor vectors; an
insult beside a group mention thus counts more than both alone. It is fitted to the terms that tell
the two classes apart best on a bounded sample of labelled texts.
"""

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloop.llm.common import held_out, rows_of, texts, written
from flowloop.llm.labelled import labelled_sample

BUCKETS = 1 << 20
PREFIXES = (4, 5, 6)
# At most so many labelled texts are fitted to.
SAMPLE = 20_000
# At most so many terms enter the machine, each with this log-likelihood ratio at least.
TERMS = 1024
LEAST_G2 = 20.0
FACTORS = 8
STEPS = 1500
BATCH = 512
# Words whose terms a worker remembers; it starts anew beyond them.
REMEMBERED = 200_000

_WORD = re.compile(r"[^\W\d_]+")


def terms_of(word: str) -> list[int]:
    """The hashed terms of one lower-case word."""
    keys = [f"w{word}"] + [f"p{word[:k]}" for k in PREFIXES if len(word) >= k]
    return [zlib.crc32(key.encode()) % BUCKETS for key in keys]


def text_terms(text: str, memo: dict[str, tuple], keep: dict[int, int] | None = None) -> set[int]:
    """The distinct terms of a text; with ``keep``, their numbers in it, others left out."""
    if len(memo) > REMEMBERED:
        memo.clear()
    out: set[int] = set()
    for word in set(_WORD.findall(text.lower())):
        found = memo.get(word)
        if found is None:
            found = terms_of(word)
            if keep is not None:
                found = [keep[t] for t in found if t in keep]
            memo[word] = found = tuple(found)
        if found:
            out.update(found)
    return out


@dataclass
class FactorizationMachine:
    """``bias + sum w_i + sum_{i<j} <v_i, v_j>`` over the terms of a text, through a sigmoid."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        sums = x @ self.factors
        own = x @ (self.factors**2).sum(axis=1)
        return self.bias + x @ self.weights + 0.5 * ((sums**2).sum(axis=1) - own)

    def score(self, present: list[int]) -> float:
        chosen = self.factors[present]
        pairs = 0.5 * ((chosen.sum(axis=0) ** 2).sum() - (chosen**2).sum())
        z = self.bias + self.weights[present].sum() + pairs
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit(terms: np.ndarray, x: np.ndarray, y: np.ndarray) -> FactorizationMachine:
    """Fit to rows of 0/1 ``x`` by Adam on the logistic loss with a little decay."""
    rng = np.random.default_rng(1)
    n, d = x.shape
    share = y.sum() / (n + 1)
    bias = float(np.log((share + 1e-4) / (1 - share + 1e-4)))
    machine = FactorizationMachine(terms, bias, np.zeros(d), np.zeros((d, FACTORS)))
    if not n or not d:
        return machine
    params = [np.array([machine.bias]), np.zeros(d), rng.normal(0, 0.05, (d, FACTORS))]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, STEPS + 1):
        rows = rng.integers(0, n, BATCH)
        xb, yb = x[rows].astype(np.float64), y[rows]
        machine.bias, machine.weights, machine.factors = float(params[0][0]), params[1], params[2]
        g = (1 / (1 + np.exp(-np.clip(machine.logits(xb), -40, 40))) - yb) / BATCH
        sums = xb @ params[2]
        once = xb.T @ g
        grads = [
            np.array([g.sum()]),
            once + 1e-4 * params[1],
            xb.T @ (g[:, None] * sums) - once[:, None] * params[2] + 1e-3 * params[2],
        ]
        rate = 0.05 * min(1, 2 * (1 - step / (STEPS + 1)))
        for p, grad, (m, v) in zip(params, grads, moments):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad**2 - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    machine.bias, machine.weights, machine.factors = float(params[0][0]), params[1], params[2]
    return machine


def _g2(pos: str, neg: str, all_pos: int, all_neg: int):
    """Log-likelihood ratio of a term's counts in the two classes."""
    cells = []
    n, here = float(all_pos + all_neg), F.col(pos) + F.col(neg)
    for count, total in ((F.col(pos), all_pos), (F.col(neg), all_neg)):
        for seen, margin in ((count, here), (F.lit(total) - count, F.lit(n) - here)):
            ratio = seen * F.lit(n) / (margin * F.lit(float(total)))
            cells.append(F.when(seen > 0, seen * F.log(ratio)).otherwise(0.0))
    return 2 * sum(cells, F.lit(0.0))


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> FactorizationMachine:
    """Learn from at most ``SAMPLE`` labelled texts; without two classes, the smoothed share."""
    sample = labelled_sample(docs, labels, "toxic", SAMPLE)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple] = {}
        for batch in batches:
            found = [list(text_terms(t, memo)) for (t,) in rows_of(iter([batch]), "text")]
            columns = [batch.column("label"), pa.array(found, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["label", "terms"])

    rows = written(sample.mapInArrow(hashed, "label int, terms array<int>"), "toxic_terms")
    counts = dict(rows.groupBy("label").count().collect())
    pos, neg = counts.get(1, 0), counts.get(0, 0)
    none = np.zeros(0, dtype=np.int64)
    if not pos or not neg:
        return fit(none, np.zeros((pos + neg, 0)), np.repeat([1.0, 0.0], [pos, neg]))
    terms = rows.select("label", F.explode("terms").alias("term"))
    seen = terms.groupBy("term").agg(
        F.sum("label").cast("double").alias("pos"),
        F.sum(1 - F.col("label")).cast("double").alias("neg"),
    )
    g2 = seen.withColumn("g2", _g2("pos", "neg", pos, neg)).filter(F.col("g2") >= LEAST_G2)
    best = [r.term for r in g2.orderBy(F.desc("g2"), "term").limit(TERMS).collect()]
    chosen = {term: i for i, term in enumerate(best)}
    if not chosen:
        return fit(none, np.zeros((pos + neg, 0)), np.repeat([1.0, 0.0], [pos, neg]))

    wanted = F.array_intersect("terms", F.array(*map(F.lit, best)))
    examples = rows.select("label", wanted.alias("terms")).collect()
    x = np.zeros((len(examples), len(best)), dtype=np.uint8)
    for i, example in enumerate(examples):
        x[i, [chosen[t] for t in example.terms]] = 1
    y = np.array([e.label for e in examples], dtype=np.float64)
    return fit(np.array(best), x, y)


def toxicity(docs: DataFrame, machine: FactorizationMachine) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row, from its text alone.

    Null and empty texts have no terms and get the machine's bias. Rows with a null id count as
    held out. Repeated rows get equal scores; an empty table gives no rows.
    """
    keep = {int(t): i for i, t in enumerate(machine.terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple] = {}
        for batch in batches:
            scores = [
                machine.score(sorted(text_terms(text, memo, keep)))
                for (text,) in rows_of(iter([batch]), "text")
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"]
            )

    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())]
    )
    rows = texts(docs).withColumn("doc_id", F.col("doc_id").cast("bigint")).mapInArrow(run, schema)
    return rows.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
