import hashlib
import math
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowloop.llm import personal_data as pii
from tests.llm.conftest import ODD, documents

# The definition, as it is written: leftmost non-overlapping matches of each kind.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.findall("[0-9]", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="a1.@+-_ 0()", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


@pytest.mark.parametrize(
    "text",
    [
        "a@b.com_x@y.org a@@b.c.d a@b c@d.e",
        "4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111234",
        "1.2.3.4.5.6 256.1.1.1 0001.2.3.0255 " + "9" * 4000 + ".1.1.1",
        "+1 (980) 555-6268 +1 2 ++12345678) +12345678901234567",
        "a" * 20_000 + "@" + "b" * 20_000,
    ],
)
def test_base_spans_of_hard_texts(text):
    assert pii.base_spans(text) == plain_spans(text)


def words(text):
    for _, a, b in pii.base_spans(text):
        text = text[:a] + " " * (b - a) + text[b:]
    return [(m.group().lower(), *m.span()) for m in re.finditer(r"\w{3,}", text)]


def plain_terms(texts):
    """Disclosure by the definition, from plain counts."""
    n = len(texts)
    beside, different, owners = defaultdict(set), defaultdict(set), defaultdict(set)
    frequency = defaultdict(int)
    for doc, text in enumerate(texts):
        spaced = words(text)
        for w in {w for w, _, _ in spaced}:
            frequency[w] += 1
        for kind, a, b in pii.base_spans(text):
            e = pii.entity(kind, text[a:b])
            owners[e].add(doc)
            at = sum(start < a for _, start, _ in spaced)
            window = [w for w, _, _ in spaced[max(0, at - pii.WINDOW) : at + pii.WINDOW]]
            for w in window:
                beside[e, w].add(doc)
                different[e, w].add(" ".join(window))
    out = {}
    for (e, w), docs in beside.items():
        if len(different[e, w]) >= pii.CONTEXTS and len(owners[e]) < n:
            pmi = math.log2(len(docs) * n / (len(owners[e]) * frequency[w]))
            value = pmi / math.log2(n / len(owners[e]))
            if value >= pii.GENERALISE:
                out[w] = max(value, out.get(w, 0))
    return out


def expected(rows):
    texts = [t or "" for _, t in rows]
    terms = plain_terms(texts)
    out = []
    for (i, _), text in zip(rows, texts):
        spans = plain_spans(text)
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        more = [f"term:{a}:{b}" for w, a, b in words(text) if w in terms]
        counts = [sum(s[0] == kind for s in spans) for kind in pii.KINDS]
        out.append((i, *counts, hashlib.sha256(base.encode()).hexdigest(), ",".join([base] * bool(base) + more)))
    return sorted(out, key=str)


def actual(docs):
    return sorted((tuple(r) for r in pii.personal_data(docs).collect()), key=str)


REVEALING = [
    (1, "please ask doctor Zebulon about it, mail zeb@clinic.example.com today"),
    (2, "yesterday our Zebulon wrote from zeb@clinic.example.com again"),
    (3, "zeb@clinic.example.com belongs to Zebulon as everyone knows"),
    (4, "Zebulon was here without any address at all"),
    *[(i, f"please ask about item {i} today, everyone knows it") for i in range(10, 60)],
    *[(i, f"please write to user{i}@mail.example.com about it today") for i in range(60, 70)],
]


def test_revealing_terms(spark):
    docs = documents(spark, REVEALING)
    got = actual(docs)
    assert got == expected(REVEALING)
    spans = {r[0]: r[-1] for r in got}
    assert spans[4] == "term:0:7" and spans[10] == ""
    clear = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clear[4] == " was here without any address at all" or clear[4].startswith("[TERM]")
    assert "zeb@" not in clear[1] and "[EMAIL]" in clear[1] and "Zebulon" not in clear[1]
    assert clear[10] == dict(REVEALING)[10]


def test_odd_rows(odd, none):
    assert actual(odd) == expected(ODD)
    assert actual(none) == []
    assert pii.sanitise(none).collect() == []
    clean = pii.sanitise(odd)
    assert clean.columns == odd.columns and clean.count() == len(ODD)
    assert [r.text for r in clean.filter("doc_id = 3").collect()] == [None]
    assert all("@" not in r.text for r in clean.filter("doc_id is null").collect())


def test_whole_table(sample):
    assert actual(sample) == expected([(r.doc_id, r.text) for r in sample.collect()])
