"""Groups of copies through the pipeline's dedup stages."""

from __future__ import annotations

import random

import corpus_pipeline


def lines_of(draw, n):
    return [" ".join(f"w{draw.randrange(10**6)}" for _ in range(30)) for _ in range(n)]


def test_a_large_group_of_copies_keeps_one_whole_document(spark):
    draw = random.Random(3)
    top = "top of every page"
    alone = [[top, *lines_of(draw, 6)] for _ in range(40)]
    group = lines_of(draw, 6)
    near = lines_of(draw, 24)
    texts = {i: x for i, x in enumerate(alone)}
    texts |= {100 + i: group for i in range(30)}  # exact copies, a third of the host
    texts |= {200 + i: near[:i] + near[i + 1 :] for i in range(24)}  # near copies: each lacks one line of the others
    rows = [(i, "h", "\n".join(x), 0) for i, x in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, n_chars long")
    second = corpus_pipeline.line_dedup(spark, docs, "")
    rows = second.collect()
    assert {r.doc_id: r.text for r in rows} == {i: "\n".join(y for y in x if y != top) for i, x in texts.items()}
    third = {r.doc_id for r in corpus_pipeline.near_dedup(spark, second, "").collect()}
    assert third == {*range(40), 100, 200}


def test_line_dedup_of_odd_rows(spark):
    rows = [(i, "h", t, 7) for i, t in enumerate([None, "", " \n\t"] + ["same\nline"] * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, n_chars long")
    assert corpus_pipeline.line_dedup(spark, docs, "").exceptAll(docs).count() == 0
    assert corpus_pipeline.line_dedup(spark, docs, "").count() == docs.count()
