"""The pipeline's stages on a small corpus with planted cases, against plain Python."""

from __future__ import annotations

import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")

from tests.llm.test_decontaminate import slow  # noqa: E402
from tests.llm.test_simhash import slow_components, slow_fingerprint  # noqa: E402


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    syllables = {"aa": ["ka", "mi", "to", "ru"], "bb": ["sch", "öl", "ung", "eit"]}
    make = lambda lang, n: " ".join("".join(rng.choices(syllables[lang], k=rng.randint(1, 4))) for _ in range(n))
    rows = [(i, make(lang := rng.choice(["aa", "bb"]), rng.randint(20, 90)), lang, f"s{i % 3}") for i in range(150)]
    items = [(i, make("aa", 25)) for i in range(5)]
    rows += [(200 + i, rows[i][1].upper().replace("Ö", "ö"), rows[i][2], "copy") for i in range(10)]
    rows += [(300 + i, rows[20 + i][1] + " x", rows[20 + i][2], "near") for i in range(10)]
    rows += [(400 + i, make("aa", 9) + " " + items[i][1] + " " + make("aa", 9), "aa", "leak") for i in range(5)]
    rows += [(500, "12 34", None, "junk"), (501, None, None, "junk")]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as long) n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def test_every_stage_against_plain_python(spark, corpus):
    folder, rows, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r[0]: r[1] for r in rows}
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.collect()}
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns and after.schema.simpleString() == docs.schema.simpleString()
        got = sorted(r.doc_id for r in after.collect())
        kept[name] = set(got)
        assert len(got) == len(kept[name]) and kept[name] <= before
        if name == "language_id":
            assert {500, 501}.isdisjoint(got) and len(got) >= len(rows) - 4
        if name == "exact_dedup":
            least = {}
            for i in before:
                key = texts[i].encode().lower()
                least[key] = max(i, least.get(key, i))
            assert kept[name] == set(least.values())
        if name == "simhash_near_dedup":
            ids = sorted(before)
            groups = slow_components([slow_fingerprint(texts[i]) for i in ids])
            assert kept[name] == {ids[g] for g in groups}
        if name == "decontaminate":
            assert kept[name] == {s[0] for s in slow([(i, texts[i]) for i in before], items, 10) if not s[2]}
        docs = spark.createDataFrame(after.collect(), after.schema)
    assert not kept["decontaminate"] & set(range(400, 405))
    pieces = pipeline.run(spark, folder).collect()
    assert {p.doc_id for p in pieces} == kept["decontaminate"]


def test_stages_take_an_empty_table(spark, corpus):
    folder = corpus[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, folder).collect() == []


def test_near_copies_keep_one_of_repeated_and_unnamed_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (1, text), (1, text.upper()), (None, text), (None, "other words entirely here"), (None, "other words entirely here")], "doc_id long, text string")
    kept = sorted((r.doc_id or 0) for r in pipeline.drop_near_copies(spark, docs, "").collect())
    assert kept == [0, 1]
