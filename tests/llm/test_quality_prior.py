"""Quality scores with the corpus as the target's prior."""

from __future__ import annotations

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weekloom.llm import quality
from weekloom.llm.queries import op1_quality_rules

DATA = "/root/testdata/sf0.01"


def test_scores_with_a_prior_equal_brute_force(spark):
    docs = spark.createDataFrame([(1, "a b a"), (1, "a b"), (2, "a c"), (3, "z z z z"), (4, None), (5, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 0), (5, 1), (None, 1)], "doc_id long, quality int")
    got = quality.quality_rules(docs, labels, buckets=1 << 16, prior=10).collect()
    grams = {(1, 3): ["a", "b", "a", "ab", "ba"], (1, 2): ["a", "b", "ab"], (2, 2): ["a", "c", "ac"], (3, 4): ["z"] * 4 + ["zz"] * 3}
    raw, target, n = Counter(sum(grams.values(), [])), Counter(grams[1, 3] + grams[1, 2]), 1 << 16
    for r in got:
        g = grams.get((r.doc_id, r.n_words), [])
        own = Counter(g) if r.doc_id == 1 else Counter()
        share = {x: (raw[x] + 1) / (18 + n) for x in g}
        s = sum(math.log((target[x] - own[x] + 10 * share[x]) / (8 - own.total() + 10)) - math.log(share[x]) for x in g) / max(len(g), 1)
        assert r.score == pytest.approx(s, abs=1e-8)


def test_clean_documents_of_rare_languages_stay(spark):
    rows = op1_quality_rules(spark, DATA).where("not base_failed").join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = rows.join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id", "left")
    low = {r.lang: r.low for r in rows.where("quality is null").groupBy("lang").agg(F.avg((~F.col("kept")).cast("int")).alias("low")).collect()}
    assert max(low.values()) < 0.15 and {"de", "es", "fr"} <= set(low)
    assert rows.where("quality = 0 and kept").count() == 0
    assert rows.where("quality = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0] > 0.95
