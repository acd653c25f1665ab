"""Text quality by attention-based multiple-instance learning.

A text is a bag of passages. Each passage is encoded from the shapes of its words and a few ratios;
gated attention, learned from labels of whole texts, weighs the encoded passages, and the weighted
sum is scored. One bad passage can thus decide a long text.
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

from flowloop.llm.common import held_out, rows_of, short_batches, texts
from flowloop.llm.labelled import labelled_sample

PASSAGE = 64  # words
SHAPES = 64  # hashed shapes of words
RATIOS = 8
WIDTH = SHAPES + RATIOS
HIDDEN = 16
GATES = 8
THRESHOLD = 0.3
# At most so many labelled texts are fitted to, and of so many characters together.
SAMPLE = 6_000
SAMPLE_CHARS = 64 << 20
STEPS = 800
BATCH = 64
REMEMBERED = 200_000

_CLASSES = [
    (re.compile("[A-ZÀ-ÖØ-Þ]+"), "A"),
    (re.compile(r"[^\W\d_A]+"), "a"),
    (re.compile(r"\d+"), "0"),
]


def shape(word: str) -> str:
    """Runs of capitals, other letters and digits as one sign each; others stay, twice at most."""
    for pattern, sign in _CLASSES:
        word = pattern.sub(sign, word)
    return re.sub(r"(.)\1+", r"\1\1", word)[:8]


class WordTable:
    """Numbers for words, with a row of figures for each; it starts anew when it is full."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.rows: list[tuple] = []
        self.figures = np.zeros((0, 5), dtype=np.float32)

    def lookup(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.numbers) > REMEMBERED:
            self.__init__()
        numbers = self.numbers
        for word in set(words).difference(numbers):
            numbers[word] = len(self.rows)
            letters = sum(map(str.isalpha, word))
            self.rows.append(
                (
                    zlib.crc32(shape(word).encode()) % SHAPES,
                    len(word),
                    sum(map(str.isupper, word)),
                    letters,
                    sum(map(str.isdigit, word)),
                )
            )
        if len(self.rows) > len(self.figures):
            fresh = np.array(self.rows[len(self.figures) :], dtype=np.float32)
            self.figures = np.concatenate([self.figures, fresh])
        return np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)), self.figures


def passages(text: str, table: WordTable) -> np.ndarray:
    """One row of figures for each passage of a text; a text without words is one empty passage."""
    words = text.split()
    if not words:
        return np.zeros((1, WIDTH), dtype=np.float32)
    ids, figures = table.lookup(words)
    n = len(ids)
    # The last passage takes a short rest with it.
    count = max(1, n // PASSAGE)
    at = np.minimum(np.arange(n) // PASSAGE, count - 1)
    sizes = np.bincount(at, minlength=count).astype(np.float32)
    mine = figures[ids]
    out = np.zeros((count, WIDTH), dtype=np.float32)
    cells = at * SHAPES + mine[:, 0].astype(np.int64)
    shapes = np.bincount(cells, minlength=count * SHAPES).reshape(count, SHAPES)
    out[:, :SHAPES] = shapes / sizes[:, None]
    sums = np.stack([np.bincount(at, mine[:, k], count) for k in range(1, 5)], axis=1)
    chars = np.maximum(sums[:, 0], 1)
    distinct = np.unique(at * (len(figures) + 1) + ids) // (len(figures) + 1)
    repeats = np.zeros(n, dtype=np.float32)
    repeats[1:] = ids[1:] == ids[:-1]
    out[:, SHAPES:] = np.stack(
        [
            np.bincount(distinct, minlength=count) / sizes,
            np.bincount(at, repeats, count) / sizes,
            sums[:, 0] / sizes / 10,
            sums[:, 1] / chars,
            sums[:, 2] / chars,
            sums[:, 3] / chars,
            np.log1p(sizes) / 5,
            np.ones(count),
        ],
        axis=1,
    )
    return out


@dataclass
class AttentionModel:
    """Encoder, gated attention and the scoring layer, in this order."""

    params: list[np.ndarray]

    @staticmethod
    def shapes() -> list[tuple]:
        return [(WIDTH, HIDDEN), (HIDDEN, GATES), (HIDDEN, GATES), (GATES,), (HIDDEN,), (1,)]

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict:
        """Scores of bags; ``starts`` are the first rows of the bags in ``x``."""
        enc, tan, gate, att, top, bias = self.params
        sizes = np.diff(np.append(starts, len(x)))
        h = np.tanh(x @ enc)
        t, s = np.tanh(h @ tan), 1 / (1 + np.exp(-(h @ gate)))
        e = (t * s) @ att
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        p = 1 / (1 + np.exp(-np.clip(z @ top + bias[0], -40, 40)))
        return {"sizes": sizes, "h": h, "t": t, "s": s, "a": a, "z": z, "p": p}

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        enc, tan, gate, att, top, bias = self.params
        f = self.forward(x, starts)
        g = (f["p"] - y) / len(y)
        h, t, s, a = f["h"], f["t"], f["s"], f["a"]
        dz = np.repeat(g[:, None] * top, f["sizes"], axis=0)
        da = (dz * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, starts), f["sizes"]))
        dt = de[:, None] * att * s * (1 - t**2)
        ds = de[:, None] * att * t * s * (1 - s)
        dh = (dz * a[:, None] + dt @ tan.T + ds @ gate.T) * (1 - h**2)
        return [x.T @ dh, h.T @ dt, h.T @ ds, (t * s).T @ de, f["z"].T @ g, np.array([g.sum()])]


def fit(bags: list[np.ndarray], y: np.ndarray) -> AttentionModel:
    """Fit by Adam; without two classes, the model gives the smoothed share of label 1."""
    rng = np.random.default_rng(1)
    n = len(bags)
    share = y.sum() / (n + 1)
    params = [rng.normal(0, 1 / np.sqrt(s[0]), s) for s in AttentionModel.shapes()]
    params[-1][:] = np.log((share + 1e-4) / (1 - share + 1e-4))
    model = AttentionModel(params)
    if not 0 < y.sum() < n:
        params[-2][:] = 0
        return model
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    # Both classes weigh alike in a batch, and the bias is put back to their shares at the end.
    sides = [np.flatnonzero(y == v) for v in (0, 1)]
    params[-1][:] = 0
    for step in range(1, STEPS + 1):
        rows = np.concatenate([rng.choice(side, BATCH // 2) for side in sides])
        starts = np.cumsum([0] + [len(bags[i]) for i in rows[:-1]])
        grads = model.gradients(np.concatenate([bags[i] for i in rows]), starts, y[rows])
        rate = 0.01 * min(1, 2 * (1 - step / (STEPS + 1)))
        for p, grad, (m, v) in zip(params, grads, moments):
            grad = grad + 1e-4 * p
            m += 0.1 * (grad - m)
            v += 0.01 * (grad**2 - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    params[-1] += np.log(len(sides[1]) / len(sides[0]))
    return model


def _pack(bag: np.ndarray) -> bytes:
    return bag.astype(np.float32).tobytes()


def fit_quality(docs: DataFrame, labels: DataFrame) -> AttentionModel:
    """Learn from at most ``SAMPLE`` labelled texts of at most ``SAMPLE_CHARS`` characters."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable()
        for batch in batches:
            bags = [_pack(passages(text, table)) for (text,) in rows_of(iter([batch]), "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array(bags, pa.binary())], names=["label", "bag"]
            )

    sample = labelled_sample(docs, labels, "quality", SAMPLE, SAMPLE_CHARS)
    rows = sample.mapInArrow(encode, "label int, bag binary").collect()
    rows.sort(key=lambda r: bytes(r.bag))
    bags = [np.frombuffer(r.bag, dtype=np.float32).reshape(-1, WIDTH) for r in rows]
    return fit(bags, np.array([r.label for r in rows], dtype=np.float64))


def quality(docs: DataFrame, model: AttentionModel, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row, from its whole text alone.

    Null and empty texts are one empty passage. Rows with a null id count as held out. Repeated
    rows get equal scores; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable()
        for batch in batches:
            bags = [passages(text, table) for (text,) in rows_of(iter([batch]), "text")]
            scores = [model.forward(bag, np.array([0]))["p"][0] for bag in bags]
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
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def good_rows(docs: DataFrame, model: AttentionModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose texts score ``threshold`` at least."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable()
        for batch in batches:
            bags = [passages(text or "", table) for (text,) in rows_of(iter([batch]), "text")]
            good = [bool(model.forward(bag, np.array([0]))["p"][0] >= threshold) for bag in bags]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
