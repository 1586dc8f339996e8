"""Dropping near-duplicates by their places in the source files equals the plain decision of each row."""

import pytest
from pyspark.sql import functions as F

from weekloom.llm import minhash, places

BODY = " ".join(f"w{k}" for k in range(40))


@pytest.mark.parametrize("plain", [False, True])
def test_drop_follows_kept(spark, tmp_path, plain):
    texts = [f"{BODY} {n % 7} group {n % 7} " + " ".join(f"g{n % 7}x{k}" for k in range(60)) for n in range(60)]
    rows = [(n, t, n, "a", None) for n, t in enumerate(texts)]
    rows += [(3, texts[3], 900, "b", 1), (9, "another text of this id with more than five words", 901, "c", 2), (9, None, 902, "d", 3), (None, texts[0], 903, "e", 4), (70, "", 904, "f", 5), (71, None, 905, "g", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, file long, row string, _metadata long").repartition(3)
    if plain:
        docs.write.parquet(f"{tmp_path}/docs")
        docs = spark.read.parquet(f"{tmp_path}/docs")
        assert places.places(docs)[0] is docs
    out = minhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    want = {(n, t, p, b, m) for n, t, p, b, m in rows if n is None or n < 7 or not t or t.startswith("another")}
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want


def test_rows_at_places_go_without_a_shuffle(spark, tmp_path):
    """Several files of several bitmaps each; half of all rows go, some places repeat, some have nulls, one file has none."""
    spark.range(400_000).repartition(3).write.parquet(f"{tmp_path}/ids")
    spark.range(400_000, 400_100).coalesce(1).write.mode("append").parquet(f"{tmp_path}/ids")
    docs, file, row = places.places(spark.read.parquet(f"{tmp_path}/ids"))
    goes = (F.pmod(F.xxhash64("id"), F.lit(2)) == 0) & (F.col("id") < 400_000)
    gone = docs.where(goes).select(file.alias("file"), row.alias("row"))
    gone = gone.union(gone.limit(1000)).union(spark.createDataFrame([(None, 1), (5, None), (5, 7)], "file long, row long"))
    left = places.without(docs, file, row, gone)
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Broadcast" not in plan and "Join" not in plan
    assert left.exceptAll(docs.where(~goes)).count() == 0 and left.count() == docs.where(~goes).count()
    assert places.without(docs, file, row, gone.limit(0)).count() == 400_100


def test_anything_but_a_plain_read_is_written_first(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/ids")
    spark.range(10).write.csv(f"{tmp_path}/csv")
    for df in (spark.read.parquet(f"{tmp_path}/ids").withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))), spark.read.schema("id long").csv(f"{tmp_path}/csv"), spark.range(3)):
        docs, file, row = places.places(df)
        assert docs.select(file, row).distinct().count() == df.count()


def test_drop_on_an_empty_table(spark):
    assert minhash.drop_near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
