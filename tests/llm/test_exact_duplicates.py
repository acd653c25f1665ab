import hashlib
import re

import pytest

from flowloop.llm import exact_duplicates as exact
from tests.llm.conftest import ODD, documents


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def check(rows, docs, stretch=20_000):
    got = exact.exact_duplicates(docs, stretch).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    want = []
    for i, t in rows:
        ids = groups[normal(t)]
        keep = min((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), hashlib.sha256(normal(t).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == sorted(
        want, key=str
    )
    kept = [r for r in got if r.kept]
    assert all(r.doc_id == r.keep_id for r in kept)
    assert sorted(r.text_sha256 for r in kept) == sorted(
        hashlib.sha256(body.encode()).hexdigest() for body in groups
    )


@pytest.mark.parametrize("stretch", [20_000, 2])
def test_odd_rows(odd, none, stretch):
    """Also with stretches of two rows, so that every step has something to combine."""
    check(ODD, odd, stretch)
    assert exact.exact_duplicates(none).collect() == []


def test_a_third_in_one_group(spark):
    rows = [(i, "the hot text" if i % 3 == 0 else f"text {i // 2}") for i in range(900)]
    check(rows, documents(spark, rows).repartition(8), 7)


def test_normalised_agrees_with_the_pattern():
    for text in ["", " ", " a", "a ", "\x0b\x0c a\r\n\tb \x1c\x85\xa0 c", "ab"]:
        assert exact.normalised(text).decode() == normal(text)
