"""License scans against a direct implementation."""

from __future__ import annotations

import math
import random
import re
import textwrap
from collections import Counter

import pytest
from pyspark.sql import functions as F

from geolattice.llm.license_texts import long_templates
from geolattice.llm.licenses import LICENSE_NAME, TEMPLATES, THRESHOLD, scan_licenses, template_words


def slow_own(text):
    counts = {name: Counter(template_words(t)) for name, t in TEMPLATES}
    m = len(counts)
    idf = lambda w: math.log((1 + m) / (1 + sum(w in c for c in counts.values()))) + 1
    norm = lambda c: math.sqrt(sum((n * idf(w)) ** 2 for w, n in c.items()))
    best, matched = None, 0
    for unit in re.split(r"[\r\n]+|(?<=[.!?])[ \t\n\x0b\f\r]+", text or ""):
        c = Counter(template_words(unit))
        if not c:
            continue
        top = max((round(sum(n * t[w] * idf(w) ** 2 for w, n in c.items()) / (norm(c) * norm(t)), 9), name) for name, t in counts.items())
        if top[0] >= THRESHOLD:
            best, matched = max(best or top, top), matched + sum(c.values())
    return best, matched / max(1, len(template_words(text or "")))


def slow_scan(rows):
    own = [slow_own(t) for _, _, t in rows]
    is_file = [bool(b) and (share >= 0.5 or bool(re.search(LICENSE_NAME, p or ""))) for (_, p, _), (b, share) in zip(rows, own, strict=True)]
    parent = lambda p: re.sub("/?[^/]*$", "", p, count=1)
    given = {}
    for (_, p, _), (b, _), f in zip(rows, own, is_file, strict=True):
        if f and p is not None:
            given[parent(p)] = min(given.get(parent(p), (0, "", "")), (-b[0], p, b[1]))
    out = []
    for (i, p, _), (b, _), f in zip(rows, own, is_file, strict=True):
        d, found = parent(p) if p is not None else None, None
        while d is not None and found is None:
            found = given.get(d, (None,) * 3)[2]
            d = None if d == "" else parent(d)
        out.append((i, p, b and b[1], f, b[1] if b else found, "own" if b else "inherited" if found else None))
    return out


def test_scan_against_brute_force(spark):
    rng = random.Random(4)
    words = ["alpha", "the", "work", "license", "public", "Ünder", "4", "rights"]
    rows = []
    for i in range(250):
        parts = [" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(rng.randint(0, 4))]
        if rng.random() < 0.4:
            notice = rng.choice(TEMPLATES)[1]
            parts.append(rng.choice([notice, notice.upper(), notice.replace("License", "licence"), "# " + notice + " alpha"]))
        rng.shuffle(parts)
        rows.append((i, f"{rng.choice(['a', 'a/b', 'a/b/c', 'd', ''])}/f{i}.txt".lstrip("/"), rng.choice(["\n", ". ", " "]).join(parts)))
    rows += [(900, "a/b/LICENSE", "alpha " * 90 + "\n" + TEMPLATES[9][1]), (901, "a/b/c/d/e/x", "nothing"), (902, None, TEMPLATES[0][1]), (903, "z/q", None), (904, "z/r", ""), (904, "z/r", "")]
    rows += [(905, "k/l", ("the work is public under license " * 5000) + "\n" + TEMPLATES[4][1])]
    docs = spark.createDataFrame(rows, "doc_id long, p string, text string").selectExpr("*", "1 AS _own", "'x' AS license", "2 AS path")
    for limit in (200_000, 0):
        got = [(r.doc_id, r.path, r.own_license, r.is_license_file, r.license, r.via) for r in scan_licenses(docs, "doc_id", F.col("p"), broadcast_rows=limit).collect()]
        key = lambda r: tuple(str(x) for x in r)
        assert sorted(got, key=key) == sorted(slow_scan(rows), key=key)
    vias = Counter(r[5] for r in got)
    assert vias["own"] > 20 and vias["inherited"] > 20


@pytest.mark.parametrize(("name", "text"), TEMPLATES)
def test_each_template_finds_itself(spark, name, text):
    assert slow_own(text)[0][1] == name


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert scan_licenses(docs, "doc_id", F.lit("a/b")).collect() == []


def test_headers_and_whole_texts_find_themselves_line_by_line(spark):
    rows = [(-1, "x/x", "the use of this software is free and the copy of it works")]
    for i, (_, text) in enumerate(long_templates()):
        rows += [(2 * i, f"{i}/LICENSE", text), (2 * i + 1, f"{i}/b/x.c", "\n".join("// " + line for line in textwrap.wrap(text, 60)) + "\n//\nint main() { return 0; }\n")]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, p string, text string"), "doc_id", F.col("p")).collect()}
    assert got[-1].license is None
    for i, (name, _) in enumerate(long_templates()):
        assert (got[2 * i].own_license, got[2 * i].is_license_file, got[2 * i + 1].own_license) == (name, True, name)


def test_spdx_tags_and_inheritance_from_a_whole_text(spark):
    mit = dict(long_templates())["MIT"].replace("<year> <copyright holders>", "2020 Some One")
    rows = [(1, "m/LICENSE", mit), (2, "m/src/x", "nothing"), (3, "s/x", "// SPDX-License-Identifier: Apache-2.0\nint x;"), (4, "s/y", "# SPDX-License-Identifier: GPL-2.0-or-later OR MIT\n"), (5, "s/z", "an SPDX-License-Identifier without one")]
    docs = spark.createDataFrame(rows, "doc_id long, p string, text string")
    got = {r.doc_id: (r.license, r.via) for r in scan_licenses(docs, "doc_id", F.col("p")).collect()}
    assert got == {1: ("MIT", "own"), 2: ("MIT", "inherited"), 3: ("Apache-2.0", "own"), 4: ("GPL-2.0 OR MIT", "own"), 5: (None, None)}
