"""The pipeline's stages against brute force on the smallest documents."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from test_operators import brute_components, shingles

DATA = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "sentencepiece"]
    # language ID keeps all that has letters
    first = corpus_pipeline.language_id(spark, docs, DATA)
    assert first.columns == docs.columns and first.count() == docs.count()
    # line dedup
    rows = first.collect()
    pages = {(r.source, r.text) for r in rows}
    hosts = Counter(h for h, _ in pages)
    seen = Counter((h, x) for h, t in pages for x in {y.strip(" \t\n\x0b\x0c\r") for y in t.split("\n")} if x)
    texts = {}
    for r in rows:
        n = {x: seen[r.source, x.strip(" \t\n\x0b\x0c\r")] for x in r.text.split("\n")}
        left = "\n".join(x for x in r.text.split("\n") if n[x] < 3 or n[x] <= 0.01 * hosts[r.source])
        texts[r.doc_id] = left if left.strip() else r.text
    second = corpus_pipeline.line_dedup(spark, first, DATA)
    assert second.columns == docs.columns and {r.doc_id: r.text for r in second.collect()} == texts
    assert all(r.n_chars == len(r.text) for r in second.collect())
    # near-dedup
    kept = {i for i, (_, label) in brute_components(texts, 80).items() if i == label}
    third = corpus_pipeline.near_dedup(spark, second, DATA)
    assert third.columns == docs.columns and {r.doc_id for r in third.collect()} == kept
    # decontamination
    items = [shingles(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = {i for i in kept if not any(len(s & shingles(texts[i])) >= 0.8 * len(s) for s in items)}
    fourth = corpus_pipeline.decontaminate(spark, third, DATA)
    assert fourth.columns == docs.columns and {r.doc_id for r in fourth.collect()} == clean
    # encoding
    last = corpus_pipeline.encode(spark, fourth, DATA).collect()
    assert {r.doc_id: r.text for r in last} == {i: texts[i] for i in clean} and all(r.n_tokens == len(r.ids) for r in last)


def test_run_applies_all_stages(spark):
    assert corpus_pipeline.run(spark, DATA).columns == ["doc_id", "ids", "n_tokens", "text"]


def test_stages_on_odd_rows(spark):
    """Nulls, empty texts, repeated rows, clashing columns and empty tables pass through every stage but the last as they are."""
    fox = "the quick brown fox jumps over the lazy dog and runs away from it all day"
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, fox, "en", None, len(fox)), (3, fox, "en", None, len(fox)), (None, fox, None, "s", len(fox)), (4, " \n ", "en", "s", 3), (3, "another text of the same document, which is nobody's copy at all", "en", "s", 64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for extra in ("before", "host_of", "often", "hits", "text_hash", "node", "kept"):
        docs = docs.withColumn(extra, F.lit(1))
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and out.exceptAll(docs).count() == 0 and out.count() == len(rows), name
    identified = corpus_pipeline.language_id(spark, docs, DATA)
    assert identified.columns == docs.columns and identified.where("text is null or trim(text) = ''").count() == 0
    last = corpus_pipeline.encode(spark, docs, DATA).collect()
    assert len(last) == len(rows) and sorted(r.text for r in last) == sorted(r[1] or "" for r in rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0
