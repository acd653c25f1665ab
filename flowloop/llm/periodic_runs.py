"""Runs of periodic words, caught online by catchers over completed power-of-two blocks.

Words are appended one after the other, or many at a time. Two equal stretches of ``p`` words side
by side are a square. Any ``p >= 2b - 1`` words in a row hold a whole aligned block of ``b`` words,
so on level ``b`` every completed aligned block is a catcher for the squares of ``2b - 1`` to
``4b - 2`` words' period: when the last ``b`` words are the block again, that far behind it, a
pursuit begins. It compares words with those ``p`` before, backwards at once and forwards with every
word that is appended. At any time, the last ``b`` words are watched by two catchers alone. Short
periods need no catcher: there every word is compared with the word ``p`` before.

A pursuit that finds ``p`` equal words has caught a square, and all squares of one pursuit are one
run: the longest stretch of that period. It is reported when a word ends it. The same stretch with a
multiple of its smallest period is the same run, and is reported with the smallest alone.

Blocks are compared by prefix hashes, which can only suggest a pursuit; words decide.
"""

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloop.llm.common import rows_of, texts

LEAST_WORDS = 24
LEAST_EXPONENT = 3
# Periods up to this need no catcher; blocks of catchers have (SHORT + 2) / 2 words at least.
SHORT = 14
# Output batches hold about this many bytes of text.
OUTPUT_BYTES = 8 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


class Run(NamedTuple):
    """Words ``start`` to ``end``, not included, each like the word ``period`` before."""

    start: int
    end: int
    period: int


def _mixed(ids: np.ndarray) -> np.ndarray:
    """A fixed 64-bit value for every word id."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


class _Growing:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self.data = np.zeros(64, dtype=dtype)
        self.size = 0

    def extend(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.data):
            grown = np.zeros(max(need, 2 * len(self.data)), dtype=self.data.dtype)
            grown[: self.size] = self.data[: self.size]
            self.data = grown
        self.data[self.size : need] = values
        self.size = need


class SquareCatcher:
    """The runs of a sequence of word ids that is appended piece by piece.

    ``append`` takes any number of ids and returns the runs they ended; ``close`` those that reach
    the end. How the sequence is cut into appended pieces changes no run.
    """

    def __init__(self, least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT):
        if least_exponent < 2:
            raise ValueError("a run holds a square")
        self.least_words, self.least_exponent = least_words, least_exponent
        self.size = 0
        self._words = _Growing(np.int64)
        self._sums = _Growing(np.uint64)
        self._powers = _Growing(np.uint64)
        self._sums.extend(np.zeros(1, dtype=np.uint64))
        self._powers.extend(np.ones(1, dtype=np.uint64))
        # By period: the first word of the stretch that is equal to the words before up to now.
        self._equal_since = [0] * (SHORT + 1)
        # By period: where the latest stretch of equal words starts and ends, and whether it may grow.
        self._pursuits: dict[int, list] = {}
        self._growing: set[int] = set()
        # Ended squares that catchers of longer blocks may still meet.
        self._known: list[Run] = []

    def append(self, ids: np.ndarray) -> list[Run]:
        if not len(ids):
            return []
        before = self.size
        self._add(np.asarray(ids, dtype=np.int64))
        squares = self._short_periods(before)
        squares += self._advance()
        self._known += squares
        block = (SHORT + 2) // 2
        # The first block can come again one least period of the level behind its start.
        while 3 * block - 1 <= self.size:
            squares += self._catch(block, before)
            block *= 2
        self._forget(block)
        return self._runs(squares)

    def close(self) -> list[Run]:
        squares = [
            Run(since - p, self.size, p)
            for p, since in enumerate(self._equal_since)
            if p and self.size - since >= p
        ]
        for p in self._growing:
            start, end, _ = self._pursuits[p]
            if end - start >= p:
                squares.append(Run(start - p, end, p))
        self._growing.clear()
        return self._runs(squares)

    def _add(self, ids: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            need = self.size + len(ids) + 1
            while self._powers.size < need:
                last = self._powers.data[: self._powers.size]
                self._powers.extend(last * (last[-1] * _BASE))
            terms = _mixed(ids) * self._powers.data[self.size : self.size + len(ids)]
            sums = np.cumsum(terms, dtype=np.uint64) + self._sums.data[self.size]
        self._sums.extend(sums)
        self._words.extend(ids)
        self.size += len(ids)

    def _short_periods(self, before: int) -> list[Run]:
        """Squares of short periods that the new words ended."""
        words, ended = self._words.data, []
        for p in range(1, SHORT + 1):
            first = max(before, p)
            if before < p:
                self._equal_since[p] = p
            if first >= self.size:
                continue
            breaks = first + np.flatnonzero(
                words[first : self.size] != words[first - p : self.size - p]
            )
            if not len(breaks):
                continue
            since = np.r_[self._equal_since[p], breaks[:-1] + 1]
            for k in np.flatnonzero(breaks - since >= p).tolist():
                ended.append(Run(int(since[k]) - p, int(breaks[k]), p))
            self._equal_since[p] = int(breaks[-1]) + 1
        return ended

    def _advance(self) -> list[Run]:
        """Compare the new words in every pursuit that goes on; the squares that ended."""
        ended = []
        for p in sorted(self._growing):
            pursuit = self._pursuits[p]
            pursuit[1] = self._forward(pursuit[1], p)
            if pursuit[1] < self.size:
                self._growing.discard(p)
                if pursuit[1] - pursuit[0] >= p:
                    ended.append(Run(pursuit[0] - p, pursuit[1], p))
        return ended

    def _forward(self, at: int, p: int) -> int:
        """The first word from ``at`` on that is unlike the word ``p`` before."""
        words, step = self._words.data, 32
        while at < self.size:
            stop = min(at + step, self.size)
            unlike = words[at:stop] != words[at - p : stop - p]
            if unlike.any():
                return at + int(unlike.argmax())
            at, step = stop, 2 * step
        return at

    def _backward(self, at: int, p: int) -> int:
        """The first word of the stretch up to ``at`` in which each is like the word ``p`` before."""
        words, step = self._words.data, 32
        while at > p:
            start = max(at - step, p)
            unlike = words[start:at] != words[start - p : at - p]
            if unlike.any():
                return at - int(unlike[::-1].argmax())
            at, step = start, 2 * step
        return at

    def _catch(self, block: int, before: int) -> list[Run]:
        """Let the catchers of one level look at the suffixes that end in the new words."""
        ended = []
        for a, i in self._hits(block, before):
            p = i - a
            pursuit = self._pursuits.get(p)
            if pursuit is not None and pursuit[0] <= i < pursuit[1]:
                continue  # the same stretch
            end = self._forward(i, p)
            if end < i + block:
                continue  # equal hashes of unequal words
            self._pursuits[p] = [self._backward(i, p), end, block]
            if end == self.size:
                self._growing.add(p)
            elif end - self._pursuits[p][0] >= p:
                ended.append(Run(self._pursuits[p][0] - p, end, p))
        self._known += ended
        return ended

    def _hits(self, block: int, before: int) -> list[tuple[int, int]]:
        """``(a, i)``: block ``a`` came again at ``i``, which the new words completed."""
        least = 2 * block - 1
        first, stop = max(least, before - block + 1), self.size - block + 1
        if first >= stop:
            return []
        # Row r holds the places that block r is the nearer and block r - 1 the farther catcher of.
        row, last = (first - least) // block, (stop - 1 - least) // block
        low = least + row * block
        far = row > 0
        sums, powers = self._sums.data, self._powers.data
        with np.errstate(over="ignore"):
            suffixes = np.zeros((last - row + 1) * block, dtype=np.uint64)
            suffixes[: stop - low] = sums[low + block : stop + block] - sums[low:stop]
            starts = np.arange(row - far, last + 1) * block
            blocks = sums[starts + block] - sums[starts]
            suffixes = suffixes.reshape(-1, block)
            near = suffixes == blocks[far:, None] * powers[None, least : least + block]
            farther = suffixes[1 - far :] == (
                blocks[: last - row + far, None] * powers[None, least + block : least + 2 * block]
            )
        found = []
        for equal, back, skipped in ((near, 0, 0), (farther, 1, 1 - far)):
            r, c = np.nonzero(equal)
            r = r + row + skipped
            i = least + r * block + c
            a = (r - back) * block
            ok = (i >= first) & (i < stop) & (i - a <= 4 * block - 2)
            found.append(np.stack([a[ok], i[ok]], axis=1))
        hits = np.concatenate(found)
        if len(hits):
            hits = hits[np.argsort(hits[:, 1], kind="stable")]
            hits = hits[self._worth(hits[:, 0], hits[:, 1], block)]
        return [tuple(hit) for hit in hits.tolist()]

    def _worth(self, a: np.ndarray, i: np.ndarray, block: int) -> np.ndarray:
        """Leaves out hits within runs of short periods that begin no new run.

        A block within a run of at most half its length as period comes again at every period. If
        both places are in one run, the distance is a multiple of its period. If they are in two
        runs, equal words go on beyond an end of a run only where both runs end alike; elsewhere
        the runs' ends show how many words are equal.
        """
        runs = [r for r in self._current() if r.period <= block // 2]
        low = int(a.min())
        home = np.full(int(i.max()) - low + 1, -1, dtype=np.int64)
        for k, run in enumerate(runs):
            stop = run.end - block + 1 - low
            if stop > 0:
                home[max(run.start - low, 0) : stop] = k
        here, there = home[a - low], home[i - low]
        both = (here >= 0) & (there >= 0)
        if not both.any():
            return np.ones(len(a), dtype=bool)
        starts = np.array([r.start for r in runs])
        ends = np.array([r.end for r in runs])
        after, after_there = ends[here] - (a + block), ends[there] - (i + block)
        ahead, ahead_there = a - starts[here], i - starts[there]
        open_end = (after == after_there) | (ahead == ahead_there)
        # The end of a run that goes on is not known yet.
        open_end |= (ends[here] == self.size) | (ends[there] == self.size)
        equal = np.minimum(after, after_there) + np.minimum(ahead, ahead_there) + block
        return ~both | ((here != there) & (open_end | (equal >= i - a)))

    def _current(self) -> list[Run]:
        """All squares that are known, those that go on with the words they have by now."""
        short = [
            Run(since - p, self.size, p)
            for p, since in enumerate(self._equal_since)
            if p and self.size - since >= p
        ]
        long = [Run(self._pursuits[p][0] - p, self._pursuits[p][1], p) for p in self._growing]
        return self._known + short + [r for r in long if r.end - r.start >= 2 * r.period]

    def _forget(self, block: int) -> None:
        """Drop what no catcher can meet any more."""
        reach = self.size - 6 * block
        self._known = [r for r in self._known if r.end > reach]
        gone = [p for p, (_, end, b) in self._pursuits.items() if end <= self.size - 6 * b]
        for p in gone:
            del self._pursuits[p]

    def _runs(self, squares: list[Run]) -> list[Run]:
        """The ended runs that are long enough, each with its smallest period."""
        least: dict[tuple[int, int], int] = {}
        for start, end, p in squares:
            least[start, end] = min(p, least.get((start, end), p))
        return sorted(
            Run(start, end, p)
            for (start, end), p in least.items()
            if end - start >= max(self.least_words, self.least_exponent * p)
        )


def runs_of(
    ids: np.ndarray,
    least_words: int = LEAST_WORDS,
    least_exponent: int = LEAST_EXPONENT,
    piece: int = 1 << 16,
) -> list[Run]:
    """All runs of a sequence, by start and period, appended in pieces."""
    catcher = SquareCatcher(least_words, least_exponent)
    runs = []
    for at in range(0, len(ids), piece):
        runs += catcher.append(ids[at : at + piece])
    return sorted(runs + catcher.close())


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """``words`` joined by a space, each run with its first period alone."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), dtype=bool)
    for start, end, period in runs:
        keep[start + period : end] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def word_ids(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words of this list alone."""
    table: dict[bytes, int] = {}
    number = table.setdefault
    return np.fromiter((number(w, len(table)) for w in words), dtype=np.int64, count=len(words))


def periodic_runs(
    docs: DataFrame,
    prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
    least_words: int = LEAST_WORDS,
    least_exponent: int = LEAST_EXPONENT,
) -> DataFrame:
    """``(doc_id, runs, collapsed)`` for every row: its runs and its text without their repetitions.

    Words are what stands between ASCII white space, in UTF-8. ``prepare`` may change a document's
    words first. Runs are ordered by start, then period, and have ``least_words`` words and
    ``least_exponent`` periods at least. A null text is an empty one: no runs, and an empty text.
    Repeated rows and null ids each give a row; an empty table gives none. A text of any length is
    one sequence; a task holds one text's words at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            words = text.encode().split()
            if prepare is not None:
                words = prepare(doc_id, words)
            found = []
            if len(words) >= least_words:
                found = runs_of(word_ids(words), least_words, least_exponent)
            rest = collapsed(words, found)
            told = [{"start": s, "length": e - s, "period": p} for s, e, p in found]
            out.append((doc_id, told, rest))
            size += len(rest)
            if size >= OUTPUT_BYTES or len(out) >= 4096:
                yield _batch(out)
                out, size = [], 0
        if out:
            yield _batch(out)

    docs = texts(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return docs.mapInArrow(run, f"doc_id bigint, runs {RUNS}, collapsed string")


_TYPES = [
    pa.int64(),
    pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])),
    pa.string(),
]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, runs, rest = zip(*rows)
    columns = [pa.array(ids, _TYPES[0]), pa.array(runs, _TYPES[1])]
    columns.append(pa.array(rest, pa.binary()).cast(pa.string()))
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "runs", "collapsed"])


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's edit: one document in ten gets a tail that repeats. A null id gets none."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def run_digests(found: DataFrame) -> DataFrame:
    """The contract's columns from ``(doc_id, runs, collapsed)``: the run of greatest exponent, of
    equal ones the first by start and period, and digests of all runs and of the text that is left.
    """

    def greater(best: Column, run: Column) -> Column:
        more = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | more, run).otherwise(best)

    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    best = F.aggregate("runs", none, greater)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "")
    rows = found.select("*", best.alias("best"))
    milli = F.expr("(1000 * best.length) div best.period")
    return rows.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        milli.alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
