import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from flowloop.llm import periodic_runs as runs
from flowloop.llm.queries import op13_periodic_runs
from tests.conftest import SF_DIR
from tests.llm.conftest import ODD, documents


def plain_runs(ids, least_words=24, least_exponent=3):
    """Every period against the whole sequence."""
    ids, found = np.asarray(ids), {}
    for p in range(1, len(ids) // 2 + 1):
        equal = np.r_[False, ids[p:] == ids[:-p], False].astype(np.int8)
        starts, ends = np.flatnonzero(np.diff(equal) == 1), np.flatnonzero(np.diff(equal) == -1)
        for start, end in zip(starts.tolist(), (ends + p).tolist()):
            if end - start >= max(2 * p, least_words, least_exponent * p):
                found.setdefault((start, end), p)
    return sorted((s, e, p) for (s, e), p in found.items())


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


SEQUENCES = {
    "none": [],
    "one": [5],
    "equal": [0] * 300,
    "fibonacci": fibonacci(400),
    "thue_morse": [bin(i).count("1") & 1 for i in range(512)],
    "rows of dashes": ([0] * 50 + [1]) * 8,
    "two runs of one period": [0] * 60 + [2] + [0] * 61 + [3] + [0] * 60,
    "touching runs": [1, 0, 0] * 20 + [0] + [0, 0, 1] * 20,
    "long period": list(range(130)) * 4,
    "first square of a level": list(range(127)) * 2,
    "nested": (list(range(20)) * 3 + [99]) * 5,
}


@pytest.mark.parametrize("piece", [1, 7, 1 << 16])
@pytest.mark.parametrize("name", SEQUENCES)
def test_known_sequences(name, piece):
    """All squares' runs, however the sequence is cut."""
    ids = SEQUENCES[name]
    for least in ((1, 2), (24, 3)):
        got = runs.runs_of(np.array(ids, dtype=np.int64), *least, piece)
        assert [tuple(r) for r in got] == plain_runs(ids, *least)


def test_random_sequences():
    rng = random.Random(13)
    for _ in range(400):
        kinds = rng.choice([1, 2, 3, 8, 40])
        ids = [rng.randrange(kinds) for _ in range(rng.randrange(0, 90))]
        for _ in range(rng.randrange(0, 4)):
            a, p = rng.randrange(len(ids) + 1), rng.randrange(1, 40)
            unit = ids[a : a + p] or [0]
            ids[a:a] = [unit[j % len(unit)] for j in range(rng.randrange(0, 120))]
        least = rng.choice([(1, 2), (8, 2), (24, 3)])
        piece = rng.choice([1, 5, 64, 1 << 16])
        got = runs.runs_of(np.array(ids, dtype=np.int64), *least, piece)
        assert [tuple(r) for r in got] == plain_runs(ids, *least), (ids, least, piece)


def test_equal_hashes_of_unequal_words(monkeypatch):
    """Words decide, not hashes: with all hashes equal, the runs are the same."""
    monkeypatch.setattr(runs, "_mixed", lambda ids: np.zeros(len(ids), dtype=np.uint64))
    for ids in SEQUENCES.values():
        got = runs.runs_of(np.array(ids, dtype=np.int64), 1, 2)
        assert [tuple(r) for r in got] == plain_runs(ids, 1, 2)


def test_long_sequences_take_no_square_of_their_length():
    assert runs.runs_of(np.zeros(300_000, dtype=np.int64)) == [(0, 300_000, 1)]
    rows = np.array(([0] * 300 + [1, 2, 3]) * 300)
    assert len(runs.runs_of(rows)) == 301


def digest(text):
    return hashlib.sha256(text).hexdigest()


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    table = {}
    found = plain_runs([table.setdefault(w, len(table)) for w in words])
    best = min(found, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=None)
    dropped = {i for s, e, p in found for i in range(s + p, e)}
    told = "".join(f"{s},{e - s},{p}\n" for s, e, p in found)
    shown = [None] * 4
    if best:
        s, e, p = best
        shown = [s, e - s, p, 1000 * (e - s) // p]
    rest = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(found), *shown, digest(told.encode()), digest(rest))


COLUMNS = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()


def rows_of(found):
    return sorted((tuple(r) for r in found.select(*COLUMNS).collect()), key=str)


def test_whole_table(spark, sample):
    got = rows_of(op13_periodic_runs(spark, SF_DIR))
    want = sorted((plain_row(r.doc_id, r.text) for r in sample.collect()), key=str)
    assert got == want
    assert sum(r[1] for r in want) > 3


def test_odd_rows(spark, odd, none):
    got = rows_of(runs.run_digests(runs.periodic_runs(odd, runs.repeated_tail)))
    assert got == sorted((plain_row(i, t) for i, t in ODD), key=str)
    assert runs.periodic_runs(none).collect() == []


def test_ties_and_texts(spark):
    """Of two runs of one exponent the first counts; a text keeps each run's first period."""
    text = "a b c " * 10 + "x " + "d e f " * 10 + "y"
    found = runs.periodic_runs(documents(spark, [(1, text)]))
    (row,) = found.collect()
    assert [tuple(r) for r in row.runs] == [(0, 30, 3), (31, 30, 3)]
    assert row.collapsed == "a b c x d e f y"
    (told,) = runs.run_digests(found).collect()
    assert (told.start, told.length, told.period, told.exponent_milli) == (0, 30, 3, 10_000)
    assert runs.periodic_runs(documents(spark, [(1, text)]), None, 24, 11).first().runs == []
