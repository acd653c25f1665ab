import random
import re
from itertools import combinations

import pytest
import xxhash

from flowloop.llm import near_duplicates as near
from flowloop.llm.components import connected_components
from tests.llm.conftest import ODD, documents


def plain_simhash(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> bit & 1 for h in hashes) > len(hashes)) << bit for bit in range(64))


def plain_components(nodes, linked):
    home = {n: n for n in nodes}

    def find(n):
        while home[n] != n:
            n = home[n]
        return n

    for a, b in combinations(sorted(nodes), 2):
        if linked(a, b):
            a, b = sorted((find(a), find(b)))
            home[b] = a
    return {n: find(n) for n in nodes}


def expected(rows):
    prints = [(i, plain_simhash(t or "")) for i, t in rows]
    home = plain_components({p for _, p in prints}, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for i, p in prints:
        known = least.get(home[p])
        least[home[p]] = i if known is None else known if i is None else min(i, known)
    return sorted(((i, f"{p:016x}", least[home[p]]) for i, p in prints), key=str)


def actual(docs):
    return sorted((tuple(r) for r in near.near_duplicates(docs).collect()), key=str)


def test_odd_rows(odd, none):
    assert actual(odd) == expected(ODD)
    assert near.near_duplicates(none).collect() == []


def test_whole_table(sample):
    assert actual(sample) == expected([(r.doc_id, r.text) for r in sample.collect()])


def test_representatives(spark, odd):
    rows = expected(ODD)
    got = near.representatives(odd).collect()
    assert len(got) == len({(c, p) for i, p, c in rows if i == c})


@pytest.mark.parametrize("bucket", [32, 1])
def test_links_connect_what_is_close(spark, monkeypatch, bucket):
    """Clusters around random centres, paired and by flips: the components of brute force."""
    monkeypatch.setattr(near, "BUCKET", bucket)
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(30)}
    for fp in list(fps):
        for _ in range(25):
            fp ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                fp ^= 1 << rng.randrange(64)
            fps.add(fp)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = near.close_links(spark.createDataFrame(signed, "fp bigint"))
    pairs = {(r.u & (1 << 64) - 1, r.v & (1 << 64) - 1) for r in links.collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in pairs)
    both = pairs | {(b, a) for a, b in pairs}
    want = plain_components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    got = plain_components(fps, lambda a, b: (a, b) in both)
    assert got == want


def test_components(spark):
    rng = random.Random(6)
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(1, i) for i in range(2, 40)]
    loose = [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    edges = path + star + loose + [(7, 7), (500, 499)]
    got = connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    nodes = {n for a, b in edges for n in (a, b) if a != b}
    known = {frozenset(e) for e in edges}
    want = plain_components(nodes, lambda a, b: frozenset((a, b)) in known)
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []
