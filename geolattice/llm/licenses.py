"""License scans: sparse TF-IDF cosine to templates, then inheritance along paths. DataFrame functions only.

Texts are cut into units (lines and sentences). A unit is scored against every template by
the cosine of their TF-IDF vectors over words of a-z and 0-9; idf comes from the template
collection, words it lacks have the largest. The best unit gives a file its own license.
Files that are mostly license text, or are named like license files, are license files of
their directory; files without a license of their own take that of the nearest ancestor.

Whole texts and paragraphs are scored besides, against whole license texts and the headers of
source files, by the same cosine over words that are long or hold a digit. An SPDX tag names
its license by itself.

Scoring is row by row. Texts are first held against terms without one of which no unit can
reach the threshold (by Cauchy-Schwarz), which loses nothing. For inheritance, directories,
not files, are expanded into ancestors, and each directory has one license file at most.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolattice.llm.common import materialize
from geolattice.llm.license_texts import long_templates

#: License notices by SPDX-like name.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, Version 2.0."),
    ("proprietary", "Copyright. All rights reserved."),
)
THRESHOLD = 0.7
UNIT = r"[\r\n]+|(?<=[.!?])\s+"
LICENSE_NAME = r"(?i)(^|/)(licen[sc]e|copying|notice)([._-][^/]*)?$"
BIG_BROADCAST_ROWS = 200_000
#: Words of long templates: those of five letters or more, and those with a digit.
LONG_WORD = "[a-z]*[0-9][a-z0-9]*|[a-z]{5,}"
#: Lines without a word of a-z and 0-9 part paragraphs, also behind the marks of comments.
PARAGRAPH = r"(?:\r\n|\r|\n)(?:[^a-z0-9\r\n]*(?:\r\n|\r|\n))+"
SPDX = r"(?i)spdx-license-identifier:[ \t]*(\(?[a-z0-9.+-]+\)?(?:[ \t]+(?:or|and|with)[ \t]+\(?[a-z0-9.+-]+\)?)*)"


def template_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.translate({c: c + 32 for c in range(65, 91)}))


class TemplateIndex:
    """Weights of the templates: idf by word, products by template, and the words to look for first."""

    def __init__(self, templates, threshold: float) -> None:
        counts = [(name, Counter(template_words(text))) for name, text in templates]
        frequency = Counter(w for _, c in counts for w in c)
        m = len(counts)
        self.other = math.log(1 + m) + 1
        self.idf = {w: math.log((1 + m) / (1 + n)) + 1 for w, n in sorted(frequency.items())}
        self.products, self.needed = {}, set()
        for name, c in counts:
            weights = {w: n * self.idf[w] for w, n in c.items()}
            norm = math.sqrt(sum(x * x for x in weights.values()))
            self.products[name] = {w: self.idf[w] * x / norm for w, x in sorted(weights.items())}
            left = norm * norm
            for w in sorted(weights, key=lambda w: (-len(w), w)):
                if math.sqrt(max(0.0, left)) < (threshold - 1e-9) * norm:
                    break
                self.needed.add(w)
                left -= weights[w] ** 2

    def finder(self) -> str:
        """Pattern that every unit at or over the threshold matches, in lower case."""
        return r"(?<![a-z0-9])(?:" + "|".join(sorted(self.needed)) + r")(?![a-z0-9])"


class LongIndex(TemplateIndex):
    """Weights of whole texts and headers, by number, as several may have one name.

    A text must hold one of ``needles`` to reach the threshold with any template.
    """

    def __init__(self, templates, threshold: float) -> None:
        reduced = [(str(i), " ".join(w for w in template_words(text) if re.fullmatch(LONG_WORD, w))) for i, (_, text) in enumerate(templates)]
        super().__init__(reduced, threshold)
        self.names = {str(i): name for i, (name, _) in enumerate(templates)}
        shares = {i: {w: (x / self.idf[w]) ** 2 for w, x in p.items()} for i, p in self.products.items()}  # each sums to 1
        self.needles, left = [], dict.fromkeys(shares, 1.0)
        while open_ := [i for i, x in left.items() if x >= threshold**2 - 1e-9]:
            gain = Counter()
            for i in open_:
                for w, x in shares[i].items():
                    if w not in self.needles:
                        gain[w] += min(x, left[i] - threshold**2 + 2e-9)
            best = min(gain, key=lambda w: (-gain[w], w))
            self.needles.append(best)
            left = {i: x - shares[i].get(best, 0.0) for i, x in left.items()}


def _map(values: dict[str, float]) -> Column:
    """A literal map; many values are told as one text, which takes one call instead of thousands."""
    if len(values) > 100:
        return F.expr("cast(str_to_map('" + ",".join(f"{w}:{x!r}" for w, x in values.items()) + "', ',', ':') as map<string,double>)")
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _words(text: Column) -> Column:
    """Words of a-z and 0-9 of a text that is lower-cased in A-Z."""
    return F.array_remove(F.split(text, "[^a-z0-9]+"), "")


def _norm(words: Column, index: TemplateIndex) -> Column:
    """Length of the TF-IDF vector, from runs of equal words in sorted order."""
    idf = _map(index.idf)
    square = lambda word, n: F.pow(n * F.coalesce(F.try_element_at(idf, word), F.lit(index.other)), F.lit(2.0))
    start = F.struct(F.lit("").alias("word"), F.lit(0.0).alias("n"), F.lit(0.0).alias("sum"))

    def step(acc: Column, w: Column) -> Column:
        same = acc["word"] == w
        return F.struct(w.alias("word"), F.when(same, acc["n"] + 1).otherwise(1.0).alias("n"), F.when(same | (acc["n"] == 0), acc["sum"]).otherwise(acc["sum"] + square(acc["word"], acc["n"])).alias("sum"))

    return F.aggregate(F.array_sort(words), start, step, lambda acc: F.sqrt(acc["sum"] + square(acc["word"], acc["n"])))


def _product(words: Column, products: dict[str, float]) -> Column:
    by_word = _map(products)
    return F.aggregate(words, F.lit(0.0), lambda acc, w: acc + F.coalesce(F.try_element_at(by_word, w), F.lit(0.0)))


def _best(unit: Column, index: TemplateIndex) -> Column:
    """(score, name, words) of the best template for a unit; of equal scores the last name."""

    def scored(words: Column) -> Column:
        def against(norm: Column) -> Column:
            pairs = [
                F.struct(F.round(_product(words, products) / norm, 9).alias("score"), F.lit(name).alias("name"))
                for name, products in index.products.items()
            ]
            return F.array_max(F.array(*pairs))

        top = F.get(F.transform(F.array(_norm(words, index)), against), 0)
        return F.struct(top.alias("top"), F.size(words).alias("words"))

    return F.get(F.transform(F.array(_words(unit)), scored), 0)


def _long_hits(low: Column, index: LongIndex, threshold: float) -> Column:
    """Array of struct(top, words): the whole text and its paragraphs where they reach the threshold; NULL without a needle.

    The length of the part of a text in words of the templates bounds its cosine to any of
    them, so a text is scored only if that part is long enough beside the other words.
    """
    vocabulary = sorted(index.idf)
    let = lambda value, body: F.get(F.transform(F.array(value), body), 0)

    def parted(text: Column) -> Column:
        words = F.regexp_extract_all(text, F.lit(LONG_WORD), F.lit(0))
        known = lambda all_: F.struct(text.alias("text"), all_.alias("all"), F.filter(all_, lambda w: w.isin(vocabulary)).alias("known"))
        return let(words, known)

    def possible(t: Column) -> Column:
        others = (F.size(t["all"]) - F.size(t["known"])) * index.other**2
        return (F.size(t["known"]) > 0) & let(_norm(t["known"], index), lambda k: k * k >= (threshold**2 - 1e-6) * (k * k + others))

    def scored(t: Column) -> Column:
        pairs = lambda norm: F.array_max(F.array(*[F.struct(F.round(_product(t["known"], p) / norm, 9).alias("score"), F.lit(index.names[i]).alias("name")) for i, p in index.products.items()]))
        return F.struct(let(_norm(t["all"], index), pairs).alias("top"), F.size(_words(t["text"])).alias("words"))

    texts = F.filter(F.transform(F.concat(F.array(low), F.split(low, PARAGRAPH)), parted), possible)
    hits = F.filter(F.transform(texts, scored), lambda b: b["top"]["score"] >= threshold)
    return F.when(reduce(or_, [F.contains(low, F.lit(word)) for word in index.needles]), hits)


def _tagged(text: Column) -> Column:
    """The license expression of the first SPDX tag, without what says "only" or "or later"; NULL without a tag."""
    tag = F.nullif(F.regexp_extract(text, SPDX, 1), F.lit(""))
    return F.when(F.contains(text, F.lit(":")), F.regexp_replace(tag, r"(?i)-only|-or-later|\+", ""))


def match_licenses(files: DataFrame, text_col: str, index: TemplateIndex, threshold: float) -> DataFrame:
    """Adds _own struct(score, name) of the best unit at or over ``threshold``, or NULL, and _share of words in such units."""
    # non-ASCII letters part words, so lower-casing A-Z alone is enough and plain lower() would merge others in
    low = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    finder = index.finder()
    loose = F.coalesce(F.col(text_col), F.lit("")).rlike("(?i)" + finder)

    def judge(text: Column) -> Column:
        units = F.filter(F.split(text, UNIT), lambda u: u.rlike(finder))
        hits = F.filter(F.transform(units, lambda u: _best(u, index)), lambda b: b["top"]["score"] >= threshold)
        total = F.size(_words(text))
        return F.get(
            F.transform(
                F.array(hits),
                lambda h: F.struct(
                    F.array_max(F.transform(h, lambda b: b["top"])).alias("own"),
                    F.when(F.size(h) > 0, F.aggregate(h, F.lit(0), lambda acc, b: acc + b["words"]) / total).otherwise(0.0).alias("share"),
                ),
            ),
            0,
        )

    judged = F.when(loose, F.get(F.transform(F.array(low), judge), 0))
    wide = LongIndex(long_templates(), threshold)
    tag = F.when(F.col("_tag").isNotNull(), F.struct(F.lit(1.0).alias("score"), F.col("_tag").alias("name")))
    long_own = F.array_max(F.transform("_long", lambda b: b["top"]))
    # the whole text, if it is among them, has all words
    long_share = F.when(F.size("_long") > 0, F.least(F.lit(1.0), F.aggregate("_long", F.lit(0), lambda acc, b: acc + b["words"]) / F.size(_words(low))))
    rows = files.withColumns({"_judged": judged, "_long": F.get(F.transform(F.array(low), lambda t: _long_hits(t, wide, threshold)), 0), "_tag": _tagged(F.col(text_col))})
    return rows.withColumns({"_own": F.greatest("_judged.own", long_own, tag), "_share": F.greatest(F.coalesce("_judged.share", F.lit(0.0)), F.coalesce(long_share, F.lit(0.0)))}).drop("_judged", "_long", "_tag")


def scan_licenses(files: DataFrame, id_col: str, path: Column, text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD, file_share: float = 0.5, broadcast_rows: int = BIG_BROADCAST_ROWS) -> DataFrame:
    """Finds each file's license.

    Returns one row per input row: ``id_col``, path, own_license and own_score (NULL where no
    unit, paragraph or whole text reaches ``threshold`` and no SPDX tag stands),
    is_license_file (with a license of its own, and named like one or at least ``file_share``
    of its words in what matches), license and via: "own", "inherited" from the license
    file of the nearest directory up the path (of several in one directory the best score,
    then the smallest path), or NULL.

    NULL texts count as empty; a NULL path inherits nothing. Repeated and NULL ids come back
    as they are; an empty table gives no rows. Other columns are ignored, whatever their names.
    """
    index = TemplateIndex(templates, threshold)
    rows = files.select(F.col(f"`{id_col}`").alias("_id"), path.alias("_path"), F.col(f"`{text_col}`").alias("_text"))
    found = match_licenses(rows, "_text", index, threshold).withColumn("_file", F.col("_own").isNotNull() & (F.coalesce(F.col("_path").rlike(LICENSE_NAME), F.lit(False)) | (F.col("_share") >= file_share)))
    table = materialize(found.select("_id", "_path", F.regexp_replace("_path", "/?[^/]*$", "").alias("_dir"), "_own", "_file"), "license-files")
    rank = F.struct((-F.col("_own.score")).alias("s"), F.col("_path").alias("p"), F.col("_own.name").alias("n"))
    licensed = materialize(table.filter("_file AND _dir IS NOT NULL").groupBy("_dir").agg(F.min(rank).alias("best")).select(F.col("_dir").alias("_from"), F.col("best.n").alias("_given")), "license-dirs")
    small = lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df
    folders = table.filter("_dir IS NOT NULL").select("_dir").distinct()
    parts = F.split("_dir", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("up")))
    climbed = folders.select("_dir", F.explode(ups).alias("u")).select("_dir", "u.depth", F.col("u.up").alias("_from"))
    nearest = climbed.join(small(licensed), "_from").groupBy("_dir").agg(F.max_by("_given", "depth").alias("_inherited"))
    joined = table.join(small(materialize(nearest, "inherited")), "_dir", "left")
    own = F.col("_own.name")
    return joined.select(
        F.col("_id").alias(id_col),
        F.col("_path").alias("path"),
        own.alias("own_license"),
        F.round("_own.score", 6).alias("own_score"),
        F.col("_file").alias("is_license_file"),
        F.coalesce(own, F.col("_inherited")).alias("license"),
        F.when(own.isNotNull(), "own").when(F.col("_inherited").isNotNull(), "inherited").alias("via"),
    )
