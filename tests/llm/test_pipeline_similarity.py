"""The pipeline's near-dedup against brute force at a similarity of 0.8."""

from __future__ import annotations

import random

import corpus_pipeline
from test_operators import shingles


def test_near_dedup_links_from_four_fifths_on(spark):
    draw = random.Random(4)
    texts = {}
    for k in range(60):  # pairs around the threshold: the second text has other words at its end
        base = [f"w{draw.randrange(10**6)}" for _ in range(204)]
        texts[2 * k] = " ".join(base)
        texts[2 * k + 1] = " ".join(base[: 204 - k] + [f"e{draw.randrange(10**6)}" for _ in range(k)])
    sets = {i: shingles(t) for i, t in texts.items()}
    similar = {i: len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in texts if i % 2 == 0}
    assert sum(0.8 <= x < 0.85 for x in similar.values()) >= 5 and sum(0.75 < x < 0.8 for x in similar.values()) >= 5
    gone = {i + 1 for i in similar if 100 * len(sets[i] & sets[i + 1]) >= 80 * len(sets[i] | sets[i + 1])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == set(texts) - gone
