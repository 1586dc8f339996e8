"""Language-model scores against loops over words, and on rows that hold nothing known."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import DATA, ODD, lower, split

from weekloom.llm import neurallm
from weekloom.llm import wordbytes as wb


def tokens_of(text):
    return [*split(lower(text)), "\0"]


def test_base_counts_equal_brute_force(spark):
    documents = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(i + 5000, t) for i, t in dict(ODD).items() if i is not None], "doc_id long, text string")
    rows = documents.union(odd)
    got = {r.doc_id: r for r in neurallm.lm_scores(rows).collect()}
    tokens = {i: tokens_of(t) for i, t in map(tuple, rows.collect())}
    out = {i for i in tokens if zlib.crc32(str(i).encode()) % 7 == 2}
    c = Counter(w for i, t in tokens.items() if i not in out for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in out, len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), abs=1e-6)


def test_scores_equal_brute_force(spark, monkeypatch):
    for name, value in (("UNIT_WORDS", 6), ("HELD_WORDS", 9)):
        monkeypatch.setattr(neurallm, name, value)
    draw = random.Random(8)
    texts = [" ".join(draw.choices([f"w{k}" for k in range(14)], weights=range(1, 15), k=draw.randrange(12))) for _ in range(40)] + ["new w1 NEW", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = {}
    train = neurallm.train_model

    def keep(rows, v, **settings):
        seen["v"], seen["model"] = v, train(rows, v, **settings)
        return seen["model"]

    monkeypatch.setattr(neurallm, "train_model", keep)
    got = {r.doc_id: r for r in neurallm.lm_scores(docs).collect()}
    v, m = seen["v"], seen["model"]
    count = Counter(w for r in got.values() if not r.held_out for w in tokens_of(texts[r.doc_id]))
    units = {wb.signed(np.array([wb.word_hash(f"w{k}")], np.uint64))[0]: f"w{k}" for k in range(14)}
    words = {units[h]: int(u) for h, u in zip(v.word, v.word_unit, strict=True)}
    tails = [w for w in count if w not in words and w != "\0"]
    assert v.units == 6 + 1 + 1 and len(tails) > 3
    rows = [m.context.astype(float), m.unit.astype(float), m.group.astype(float), m.places.astype(float)]

    def probability(before, unit):
        guess = sum((rows[0][b, :-1] @ rows[3][k * 16 : (k + 1) * 16, :-1] for k, b in enumerate(before)), np.zeros(16))
        classes = [math.exp(g[:-1] @ guess + g[-1]) for g in rows[2]]
        c = m.class_of[unit]
        inside = {u: math.exp(rows[1][u, :-1] @ guess + rows[1][u, -1]) for u in range(v.units) if m.class_of[u] == c}
        return classes[c] / sum(classes) * inside[unit] / sum(inside.values())

    for i, r in got.items():
        t, total = tokens_of(texts[i]), 0.0
        number = [words.get(w, v.units - 1 if w == "\0" else 6) for w in t]
        for k, w in enumerate(t):
            before = [number[k - j] if k >= j else v.units for j in (1, 2, 3)]
            p = probability(before, number[k])
            if number[k] == 6:
                p *= (count[w] + 1) / (sum(count[x] for x in tails) + len(tails) + 1)
            total += math.log10(p)
        assert r.score == pytest.approx(total, abs=1e-3)
    for before in ([v.units] * 3, [0, 1, 2], [6, 7, 0]):
        assert sum(probability(before, u) for u in range(v.units)) == pytest.approx(1)


def test_held_out_documents_score_above_the_base(spark):
    rows = neurallm.lm_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out")
    r = rows.agg(F.sum(F.col("score") - F.col("base_score")).alias("gain"), F.sum("n_tokens").alias("n")).first()
    assert r.gain / r.n > 0.25


def test_slices_without_known_words(spark):
    assert neurallm.lm_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    nulls = spark.createDataFrame([(i, None) for i in range(50)], "doc_id long, text string")
    got = neurallm.lm_scores(nulls).collect()
    assert len(got) == 50 and all(r.n_tokens == 1 and r.score == pytest.approx(0, abs=0.02) for r in got)  # the tail unit has add-one smoothed counts
    mixed = nulls.union(spark.createDataFrame([(100 + i, "some words here") for i in range(50)], "doc_id long, text string")).coalesce(1)
    assert neurallm.lm_scores(mixed).count() == 100
    unknown = spark.createDataFrame([(i, "only held out" if zlib.crc32(str(i).encode()) % 7 == 2 else "") for i in range(60)], "doc_id long, text string")
    assert all(r.n_known == 1 for r in neurallm.lm_scores(unknown).where("held_out").collect())


def test_odd_rows_as_they_are(spark):
    odd = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"row": F.lit("x"), "units": F.lit(1), "held_out": F.lit(2), "score": F.lit("s")})
    got = neurallm.lm_scores(odd).collect()
    assert len(got) == len(ODD) and sum(r.doc_id is None for r in got) == 1
    assert len({(r.n_tokens, round(r.score, 6)) for r in got if r.doc_id == 4}) == 1


def test_scores_follow_the_rows_and_not_their_layout(spark, monkeypatch):
    """The same rows in other partitions and order give the same scores, with one shard and with several."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.union(docs.where("doc_id < 5"))
    for tokens in (2_000_000, 10_000):
        monkeypatch.setattr(neurallm, "SHARD_TOKENS", tokens)
        one, other = ({(r.doc_id, round(r.base_score, 6)): r.score for r in neurallm.lm_scores(x).collect()} for x in (docs.coalesce(1), docs.repartition(7).orderBy(F.rand(3))))
        assert one.keys() == other.keys()
        assert max(abs(a - other[k]) / max(1.0, abs(a)) for k, a in one.items()) < 1e-6
