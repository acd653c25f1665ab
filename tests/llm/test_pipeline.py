"""Each stage against a plain version on its own input."""

import hashlib
import re
from collections import Counter

import corpus_pipeline as pipeline
from flowloop.llm import quality as q
from flowloop.llm.personal_data import base_spans
from tests.conftest import SF_DIR
from tests.llm.conftest import ODD
from tests.llm.test_near_duplicates import expected as components
from tests.llm.test_tokens import check_packing


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_stages_in_order(spark, sample):
    docs = sample
    for name, stage in pipeline.STAGES[:-1]:
        done = stage(spark, docs, SF_DIR)
        assert done.columns == sample.columns, name
        before, after = rows_of(docs), rows_of(done)
        if name == "quality":
            model = q.fit_quality(docs, pipeline.labels(spark, SF_DIR))
            want = {r.doc_id for r in q.quality(docs, model).collect() if r.predicted}
            assert {i for i, _ in after} == want and len(after) == len(want)
        elif name == "exact_dedup":
            least = {}
            for i, t in sorted(before):
                least.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
            assert sorted(after) == sorted((i, t) for i, t in before if i in least.values())
        elif name == "near_dedup":
            want = {i for i, _, c in components(before) if i == c}
            assert sorted(after) == sorted((i, t) for i, t in before if i in want)
        else:
            assert {i for i, _ in after} == {i for i, _ in before}
            assert not any(base_spans(t) for _, t in after)
            assert all(r.n_chars == len(r.text) for r in done.collect())
        docs = done
    check_packing(rows_of(docs), pipeline.pack(spark, docs, SF_DIR))


def test_odd_rows(spark, odd, none):
    copies = pipeline.drop_copies(spark, odd, SF_DIR)
    assert copies.columns == odd.columns
    bodies = Counter(re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows_of(copies))
    want = {re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in ODD}
    assert bodies == Counter(want)
    near = pipeline.drop_near_copies(spark, odd, SF_DIR)
    assert near.columns == odd.columns
    assert near.count() == len({(c, p) for i, p, c in components(ODD) if i == c})
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, SF_DIR).collect() == []


def test_run(spark):
    a, b = (
        hashlib.sha256(str(sorted(tuple(r)[:5] for r in pipeline.run(spark, SF_DIR).collect())).encode())
        for _ in range(2)
    )
    assert a.hexdigest() == b.hexdigest()
