"""License scans by MinHash bands over overlapping text windows, with DataFrame functions only.

A template of ``m`` shingles belongs to the class of the least ``2**k >= m``. Windows of a class are
``2 * 2**k`` shingles long and begin every ``2**k``, so wherever a template stands, one window holds
all of it, and their Jaccard similarity is above 1/4 (1/5 with a fifth of the template missing).
With ``BANDS`` bands of one MinHash each, such a window shares a band with its template with a
probability above ``1 - 0.8**64 > 0.999999``. What the bands retrieve is verified by the exact
share of the template's shingles that stand in the window.

Versions and variants of a license share most of their words. A template's siblings are the others
that have half of its shingles at least. Of the shingles that it has and a sibling has not, the same
share must stand in the window, for every sibling: a notice of version 2 is not one of version 3,
however much of it stands there.

A MinHash shared by a window and a template is that of a shingle they share. Windows without any
shingle of a template thus cannot be retrieved, and are not hashed.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = 5
CONTAINMENT = 0.8
BANDS = 64

# Notices as licences ask for them, and lines that name a license. Those of the Lesser
# GPL begin behind "This library" or "This program".
TEMPLATES = {
    "AGPL-3.0 line": """This work is licensed under the GNU Affero General Public License,
        version 3.""",
    "AGPL-3.0 notice": """This program is free software: you can redistribute it and/or modify it
        under the terms of the GNU Affero General Public License as published by the Free Software
        Foundation, either version 3 of the License, or (at your option) any later version.""",
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may
        not use this file except in compliance with the License. You may obtain a copy of the
        License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
        agreed to in writing, software distributed under the License is distributed on an "AS IS"
        BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the
        License for the specific language governing permissions and limitations under the
        License.""",
    "BSD-2-Clause conditions": """Redistribution and use in source and binary forms, with or without
        modification, are permitted provided that the following conditions are met: 1.
        Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce
        the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution.""",
    "BSD-3-Clause conditions": """Redistribution and use in source and binary forms, with or without
        modification, are permitted provided that the following conditions are met: 1.
        Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce
        the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. 3. Neither the name of
        the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission.""",
    "CC-BY-4.0 line": """This work is licensed under a Creative Commons Attribution 4.0
        International License.""",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0 long line": """This work is licensed under a Creative Commons
        Attribution-NonCommercial 4.0 International License.""",
    "CC-BY-NC-ND-4.0 line": """This work is licensed under a Creative Commons
        Attribution-NonCommercial-NoDerivatives 4.0 International License.""",
    "CC-BY-NC-SA-4.0 line": """This work is licensed under a Creative Commons
        Attribution-NonCommercial-ShareAlike 4.0 International License.""",
    "CC-BY-ND-4.0 line": """This work is licensed under a Creative Commons
        Attribution-NoDerivatives 4.0 International License.""",
    "CC-BY-SA-3.0 line": """This work is licensed under a Creative Commons Attribution-ShareAlike 3.0
        Unported License.""",
    "CC-BY-SA-4.0 line": """This work is licensed under a Creative Commons Attribution-ShareAlike 4.0
        International License.""",
    "CC0-1.0 line": "This work is dedicated to the public domain under CC0 1.0 Universal.",
    "EPL-2.0 notice": """This program and the accompanying materials are made available under the
        terms of the Eclipse Public License 2.0 which is available at
        https://www.eclipse.org/legal/epl-2.0""",
    "GPL-2.0 line": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0 notice": """This program is free software; you can redistribute it and/or modify it
        under the terms of the GNU General Public License as published by the Free Software
        Foundation; either version 2 of the License, or (at your option) any later version.""",
    "GPL-2.0-only notice": """This program is free software; you can redistribute it and/or modify it
        under the terms of the GNU General Public License version 2 as published by the Free
        Software Foundation.""",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 notice": """This program is free software: you can redistribute it and/or modify it
        under the terms of the GNU General Public License as published by the Free Software
        Foundation, either version 3 of the License, or (at your option) any later version.""",
    "ISC permission": """Permission to use, copy, modify, and/or distribute this software for any
        purpose with or without fee is hereby granted, provided that the above copyright notice and
        this permission notice appear in all copies.""",
    "LGPL-2.1 notice": """is free software; you can redistribute it and/or modify it
        under the terms of the GNU Lesser General Public License as published by the Free Software
        Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    "LGPL-3.0 notice": """is free software: you can redistribute it and/or modify it
        under the terms of the GNU Lesser General Public License as published by the Free Software
        Foundation, either version 3 of the License, or (at your option) any later version.""",
    "MIT line": "Released under the MIT License.",
    "MIT permission": """Permission is hereby granted, free of charge, to any person obtaining a copy
        of this software and associated documentation files (the "Software"), to deal in the
        Software without restriction, including without limitation the rights to use, copy, modify,
        merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software.""",
    "MPL-1.1 notice": """The contents of this file are subject to the Mozilla Public License Version
        1.1 (the "License"); you may not use this file except in compliance with the License.""",
    "MPL-2.0 notice": """This Source Code Form is subject to the terms of the Mozilla Public License,
        v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
        https://mozilla.org/MPL/2.0/.""",
    "SPDX AGPL-3.0-or-later": "SPDX-License-Identifier: AGPL-3.0-or-later",
    "SPDX Apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "SPDX BSD-2-Clause": "SPDX-License-Identifier: BSD-2-Clause",
    "SPDX BSD-3-Clause": "SPDX-License-Identifier: BSD-3-Clause",
    "SPDX GPL-2.0-only": "SPDX-License-Identifier: GPL-2.0-only",
    "SPDX GPL-2.0-or-later": "SPDX-License-Identifier: GPL-2.0-or-later",
    "SPDX GPL-3.0-only": "SPDX-License-Identifier: GPL-3.0-only",
    "SPDX GPL-3.0-or-later": "SPDX-License-Identifier: GPL-3.0-or-later",
    "SPDX LGPL-2.1-only": "SPDX-License-Identifier: LGPL-2.1-only",
    "SPDX LGPL-2.1-or-later": "SPDX-License-Identifier: LGPL-2.1-or-later",
    "SPDX LGPL-3.0-only": "SPDX-License-Identifier: LGPL-3.0-only",
    "SPDX LGPL-3.0-or-later": "SPDX-License-Identifier: LGPL-3.0-or-later",
    "SPDX MPL-2.0": "SPDX-License-Identifier: MPL-2.0",
    "Unlicense notice": """This is free and unencumbered software released into the public domain.
        Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,
        either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means.""",
    "zlib permission": """Permission is granted to anyone to use this software for any purpose,
        including commercial applications, and to alter it and redistribute it freely, subject to
        the following restrictions: 1. The origin of this software must not be misrepresented; you
        must not claim that you wrote the original software.""",
}


def _with_shingles(rows: DataFrame, text: Column) -> DataFrame:
    """``rows`` with ``words``, runs of ASCII letters and digits in lower case, and ``shingles``,
    the hashes of all runs of ``WORDS`` words.

    Words are a column of their own: inside the lambda they would be found again for every shingle.
    """
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    rows = rows.withColumn("words", found)
    # A sequence that ends before it begins would count down.
    starts = F.when(F.size("words") >= WORDS, F.sequence(F.lit(1), F.size("words") - (WORDS - 1)))
    starts = F.coalesce(starts, F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, WORDS)))
    return rows.withColumn("shingles", hashes)


def _min_hash(shingles: Column, band: int) -> Column:
    return F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, F.lit(band))))


def _min_hashes(shingles: Column) -> Column:
    """``BANDS`` bands of one MinHash each."""
    return F.array(*[_min_hash(shingles, band) for band in range(BANDS)])


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """``(license, shingles, class)``; a template needs ``WORDS`` words at least.

    It has one row a template and is the same size for every table that is scanned.
    """
    pairs = [
        F.struct(F.lit(name).alias("license"), F.lit(text).alias("text"))
        for name, text in templates.items()
    ]
    rows = _with_shingles(spark.range(1).select(F.inline(F.array(*pairs))), F.col("text"))
    rows = rows.select("license", F.array_distinct("shingles").alias("shingles"))
    power = F.ceil(F.log2(F.size("shingles").cast("double")))
    return rows.select("license", "shingles", F.pow(F.lit(2), power).cast("int").alias("class"))


def telling(known: list) -> Column:
    """For each license in ``license``, what it has and a sibling has not, an array for each sibling."""
    sets = {row.license: set(row.shingles) for row in known}
    marks = []
    for name, own in sets.items():
        apart = [
            sorted(own - other)
            for sibling, other in sets.items()
            if sibling != name and 2 * len(own & other) >= len(own) and own - other
        ]
        if apart:
            marks += [F.lit(name), F.array(*[F.array(*map(F.lit, part)) for part in apart])]
    none = F.array().cast("array<array<bigint>>")
    return F.coalesce(F.create_map(*marks)[F.col("license")], none) if marks else none


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """``(doc_id, license, containment, n_places, first_word)`` for each license of a row.

    ``containment`` is the largest share of the template's shingles in one window, ``n_places`` the
    number of windows that hold enough of it and ``first_word`` the number of the first word of
    the first such window. Null and empty texts and those of fewer than ``WORDS`` words have no
    license; rows without one are left out. Rows that repeat an id are each scanned and give rows
    of their own. Words are runs of ASCII letters and digits.
    """
    spark = docs.sparkSession
    # The table is small and fixed; its values are needed in expressions.
    known = template_table(spark, templates or TEMPLATES).collect()
    wanted = sorted({s for row in known for s in row.shingles})
    classes = sorted({row["class"] for row in known})

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    # Each shingle that any template has, with its place.
    hits = F.filter(
        F.transform("shingles", lambda s, i: F.struct(i.alias("at"), s.alias("shingle"))),
        lambda x: x.shingle.isin(wanted),
    )
    # The row numbers keep the filter above the shingles; below, it would find them once more.
    rows = _with_shingles(rows, F.col("text")).select(
        "doc_id", "shingles", hits.alias("hits"), F.monotonically_increasing_id().alias("row")
    )
    rows = rows.filter(F.size("hits") > 0)

    # The windows of each class that hold a hit: every place is in two, the first ones in one.
    windows = rows.select(
        "doc_id", "row", "shingles", "hits", F.explode(F.array(*map(F.lit, classes))).alias("class")
    )
    at_window = F.transform("hits", lambda h: F.floor(h.at / F.col("class")).cast("int"))
    before = F.filter(F.transform(at_window, lambda w: w - 1), lambda w: w >= 0)
    window = F.explode(F.array_union(at_window, before)).alias("window")
    windows = windows.select("doc_id", "row", "shingles", "class", window)
    held = F.slice("shingles", F.col("window") * F.col("class") + 1, 2 * F.col("class"))
    windows = windows.select("doc_id", "row", "class", "window", F.array_distinct(held).alias("held"))
    bands = F.posexplode(_min_hashes(F.col("held"))).alias("band", "value")
    keyed = windows.select("*", bands)

    table = template_table(spark, templates or TEMPLATES)
    bands = F.posexplode(_min_hashes(F.col("shingles"))).alias("band", "value")
    marks = table.select("license", "class", bands)
    found = keyed.join(F.broadcast(marks), ["class", "band", "value"])
    same = found.groupBy("doc_id", "row", "license", "class", "window")
    found = same.agg(F.first("held").alias("held"))
    shared = F.size(F.array_intersect("held", "shingles")) / F.size("shingles")
    checked = found.join(F.broadcast(table.select("license", "shingles")), "license")
    checked = checked.withColumn("share", shared).filter(F.col("share") >= CONTAINMENT)

    def enough(part: Column) -> Column:
        return F.size(F.array_intersect("held", part)) >= CONTAINMENT * F.size(part)

    checked = checked.withColumn("telling", telling(known)).filter(F.forall("telling", enough))
    return checked.groupBy("doc_id", "row", "license").agg(
        F.max("share").alias("containment"),
        F.count("*").alias("n_places"),
        F.min(F.col("window").cast("bigint") * F.col("class")).alias("first_word"),
    ).drop("row")


def oracle(templates: dict[str, str] = TEMPLATES) -> str:
    """DuckDB's answer over ``documents``: every window is held against every template."""
    quoted = [[x.replace("'", "''") for x in pair] for pair in templates.items()]
    values = ", ".join("('{}', '{}')".format(*pair) for pair in quoted)
    return f"""
        WITH template(license, body) AS (VALUES {values}),
        split AS (
            SELECT license, regexp_extract_all(lower(body), '[a-z0-9]+') AS words FROM template
        ), pieces AS (
            SELECT DISTINCT license, unnest([array_to_string(words[i:i + {WORDS - 1}], ' ')
                for i in range(1, len(words) - {WORDS - 2})]) AS shingle
            FROM split
        ), sized AS (
            SELECT license, count(*) AS m, CAST(pow(2, ceil(log2(count(*)))) AS BIGINT) AS step
            FROM pieces GROUP BY license
        ), siblings AS (
            SELECT a.license, b.license AS sibling
            FROM pieces a JOIN pieces b ON a.shingle = b.shingle AND a.license <> b.license
            JOIN sized s ON s.license = a.license
            GROUP BY a.license, b.license HAVING 2 * count(*) >= any_value(s.m)
        ), telling AS (
            SELECT p.license, q.sibling, p.shingle
            FROM pieces p JOIN siblings q ON p.license = q.license
            WHERE NOT EXISTS (
                SELECT 1 FROM pieces o WHERE o.license = q.sibling AND o.shingle = p.shingle
            )
        ), needed AS (
            SELECT license, sibling, count(*) AS n FROM telling GROUP BY license, sibling
        ), docs AS (
            SELECT doc_id, row_number() OVER () AS r,
                   regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS words
            FROM documents
        ), placed AS (
            SELECT doc_id, r, words, unnest(range(0, len(words) - {WORDS - 1})) AS spot FROM docs
        ), met AS (
            SELECT d.doc_id, d.r, p.license, p.shingle, d.spot, s.m, s.step
            FROM placed d
            JOIN pieces p ON p.shingle = array_to_string(d.words[d.spot + 1:d.spot + {WORDS}], ' ')
            JOIN sized s ON s.license = p.license
        ), windows AS (
            SELECT *, spot // step AS win FROM met
            UNION ALL SELECT *, spot // step - 1 FROM met WHERE spot >= step
        ), shares AS (
            SELECT doc_id, r, license, win, any_value(step) AS step,
                   count(DISTINCT shingle) / any_value(m) AS share
            FROM windows GROUP BY doc_id, r, license, win
        ), seen AS (
            SELECT w.r, w.license, w.win, t.sibling, count(DISTINCT w.shingle) AS n
            FROM windows w JOIN telling t ON t.license = w.license AND t.shingle = w.shingle
            GROUP BY w.r, w.license, w.win, t.sibling
        ), confused AS (
            SELECT s.r, s.license, s.win
            FROM shares s JOIN needed n ON n.license = s.license
            LEFT JOIN seen e ON e.r = s.r AND e.license = s.license AND e.win = s.win
                AND e.sibling = n.sibling
            WHERE coalesce(e.n, 0) < {CONTAINMENT} * n.n
        )
        SELECT doc_id, license, max(share) AS containment, count(*) AS n_places,
               min(win * step) AS first_word
        FROM shares s WHERE share >= {CONTAINMENT} AND NOT EXISTS (
            SELECT 1 FROM confused c WHERE c.r = s.r AND c.license = s.license AND c.win = s.win
        )
        GROUP BY doc_id, r, license
    """
