"""Sequence queries use whole sequences."""

from __future__ import annotations

from weekloom.plans import registry


def test_warping_uses_the_whole_sequence(spark, tmp_path):
    tails = [0.0, 5.0, 9.0, 0.1, 5.2, 5.1, 9.3]
    rows = [(i, [0.5] * 16 + [t] * 48) for i, t in enumerate(tails)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.queries()["clu_dtw_assign"](spark, str(tmp_path)).collect()
    assert {r["cluster"]: r["n"] for r in got} == {0: 2, 1: 3, 2: 2}
