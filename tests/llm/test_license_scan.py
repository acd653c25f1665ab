import math
import re

from flowloop.llm.license_scan import CONTAINMENT, TEMPLATES, WORDS, scan_licenses
from tests.llm.conftest import ODD, documents


def shingles(text):
    words = re.findall("[a-z0-9]+", (text or "").lower())
    return [tuple(words[i : i + WORDS]) for i in range(len(words) - WORDS + 1)]


def apart(name):
    """What each sibling of a template lacks of it."""
    own = set(shingles(TEMPLATES[name]))
    for sibling, body in TEMPLATES.items():
        other = set(shingles(body))
        if sibling != name and 2 * len(own & other) >= len(own) and own - other:
            yield own - other


def expected(rows):
    out = []
    marks = {name: list(apart(name)) for name in TEMPLATES}
    for i, text in rows:
        own = shingles(text)
        for name, body in TEMPLATES.items():
            template = set(shingles(body))
            step = 2 ** math.ceil(math.log2(len(template)))
            places = []
            for start in range(0, len(own), step):
                held = set(own[start : start + 2 * step])
                share = len(template & held) / len(template)
                told = all(len(part & held) >= CONTAINMENT * len(part) for part in marks[name])
                if share >= CONTAINMENT and told:
                    places.append((share, start))
            if places:
                out.append((i, name, max(places)[0], len(places), min(s for _, s in places)))
    return sorted(out, key=str)


def actual(docs):
    return sorted((tuple(r) for r in scan_licenses(docs).collect()), key=str)


def test_odd_rows(odd, none):
    assert actual(odd) == expected(ODD)
    assert actual(none) == []


def test_templates_in_texts(spark):
    filler = " ".join(f"filler{i}" for i in range(100))
    rows = []
    for i, body in enumerate(TEMPLATES.values()):
        words = body.split()
        rows.append((10 * i, f"{filler} {body.upper()} {filler} {body}"))
        rows.append((10 * i + 1, filler[: 13 * i] + " " + " ".join(words[: -len(words) // 8 or None])))
        rows.append((10 * i + 2, " ".join(w for w in words for _ in range(2))))
    got = actual(documents(spark, rows))
    assert got == expected(rows)
    assert {r[1] for r in got} == set(TEMPLATES)


def test_siblings_are_told_apart(spark):
    """Every template is found under its own name, and under no other that it does not contain."""
    rows = list(enumerate(TEMPLATES.values()))
    names = list(TEMPLATES)
    found = {(names[r.doc_id], r.license) for r in scan_licenses(documents(spark, rows)).collect()}
    assert {(name, name) for name in names} <= found
    for name, other in found:
        if name != other:
            own, part = (set(shingles(TEMPLATES[n])) for n in (name, other))
            assert part <= own, (name, other)
    texts = [
        "This work is licensed under the GNU General Public License, version 2.",
        "This work is licensed under the GNU General Public License, version 4.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 2.0 Generic License.",
        TEMPLATES["GPL-3.0 notice"].replace("version 3", "version 2"),
        TEMPLATES["GPL-3.0 notice"].replace("General", "Affero General"),
        "This program " + TEMPLATES["LGPL-2.1 notice"],
    ]
    got = {}
    for r in scan_licenses(documents(spark, list(enumerate(texts)))).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert got == {
        0: {"GPL-2.0 line"},
        3: {"GPL-2.0 notice"},
        4: {"AGPL-3.0 notice"},
        5: {"LGPL-2.1 notice"},
    }


def test_whole_table(sample):
    assert actual(sample) == expected([(r.doc_id, r.text) for r in sample.collect()])


def test_no_python_in_the_plan(odd):
    plan = scan_licenses(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
