import hashlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from flowloop.llm.fingerprints import (
    PrefixHashes,
    common_extension,
    fingerprint,
    fingerprints,
    likeness,
    spans_equal,
)
from tests.llm.conftest import ODD, documents

SMALL = st.text(alphabet="ab", max_size=40)


@settings(max_examples=200, deadline=None)
@given(SMALL, SMALL, st.data())
def test_spans_and_extensions(a, b, data):
    left, right = PrefixHashes(a), PrefixHashes(b)
    i = data.draw(st.integers(0, len(a)))
    j = data.draw(st.integers(0, len(b)))
    n = data.draw(st.integers(0, 45))
    equal = i + n <= len(a) and j + n <= len(b) and a[i : i + n] == b[j : j + n]
    assert spans_equal(left, i, right, j, n) == equal
    length = 0
    while i + length < len(a) and j + length < len(b) and a[i + length] == b[j + length]:
        length += 1
    assert common_extension(left, i, right, j) == length


def test_windows_are_spans():
    prefix = PrefixHashes("abracadabra abracadabra")
    windows = prefix.windows(5)
    assert [prefix.span(i, 5) for i in range(len(windows))] == windows.tolist()
    assert windows[0] == windows[12] != windows[7]
    text = "abracadabra abracadabra"
    assert len(np.unique(windows)) == len({text[i : i + 5] for i in range(19)})


def test_likeness():
    def mark(text):
        return fingerprint(PrefixHashes(text))

    a = " ".join(map(str, range(2000)))
    b = " ".join(map(str, range(5000, 7000)))
    assert likeness(mark(a), mark(a)) == 1
    assert likeness(mark(""), mark("")) == 1
    assert likeness(mark(""), mark(a)) == 0
    assert likeness(mark(a), mark(b)) < 0.1
    assert 0.35 < likeness(mark(a), mark(a[: len(a) // 2] + b[: len(a) // 2])) < 0.65
    assert likeness(mark(a), mark("an insertion " + a)) > 0.9


def test_likeness_of_short_texts():
    """Short texts are alike by what they share, as long ones are."""

    def near(a, b):
        return likeness(*(fingerprint(PrefixHashes(t)) for t in (a, b)))

    assert near("Hello my dear world.", "Hello my dear worlds") > 0.8
    assert 0.5 < near("the quick brown fox jumps over the dog", "the quick brown cat jumps over the dog") < 0.95
    assert near("the quick brown fox", "zwölf Boxkämpfer jagen") < 0.1
    half = "an opening of some words, "
    assert 0.3 < near(half + "then this end of it", half + "and quite another") < 0.8
    assert near("ab", "ab") == 1 and near("ab", "cd") == 0 and near("", "ab") == 0
    # Across the limit, the longer spans count for both.
    text = " ".join(map(str, range(100)))
    assert len(text) > 256 and near(text, text[:255]) > 0.8


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for (doc_id, text), (_, following) in zip(order, order[1:] + order[:1]):
        text, following = text or "", following or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        marks = [fingerprint(PrefixHashes(t)) for t in (text, edited, following)]
        sha = hashlib.sha256(edited.encode()).hexdigest()
        out.append((doc_id, len(text), sha, *marks[:2], likeness(*marks[:2]), likeness(marks[0], marks[2])))
    return Counter(out)


def actual(docs):
    return Counter(tuple(r)[:7] for r in fingerprints(docs).collect())


def test_odd_rows(odd):
    assert actual(odd) == expected(ODD)


def test_every_number_of_rows(spark, none):
    assert fingerprints(none).collect() == []
    for n in (1, 2, 3, 40):
        rows = [(i * 7 % 41, f"text {i} " * (i % 5)) for i in range(n)]
        assert actual(documents(spark, rows)) == expected(rows)
    nulls = [(None, "b"), (None, "a"), (None, None)]
    assert actual(documents(spark, nulls)) == expected(nulls)


def test_whole_table(sample):
    assert actual(sample) == expected([(r.doc_id, r.text) for r in sample.collect()])
