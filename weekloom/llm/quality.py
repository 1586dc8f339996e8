"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus. DataFrame functions only."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.llm.tables import materialize

_SPACES = "\t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
#: Up to so many repeated windows of a text are looked up in a list, more by sorting; the result is the same.
_FEW = 64


def text_words(text: Column) -> Column:
    """Words of a text; none for null."""
    for c in _SPACES:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), " "), "")


def _pairs(a: Column, b: Column, n: Column, f) -> Column:
    """f over neighbours of two arrays, the second one place ahead."""
    size = F.greatest(n - 1, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), size), F.slice(b, F.lit(2), size), f)


def parsed(docs: DataFrame, buckets: int) -> DataFrame:
    """Base counts of each row, and the buckets of its words and of its pairs of neighbouring words."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = out.withColumn("words", text_words(F.col("text")))
    out = out.withColumn("word_hash", F.transform("words", lambda w: F.xxhash64(w)))
    out = out.withColumn("pair_hash", _pairs(F.col("word_hash"), F.col("word_hash"), F.size("word_hash"), lambda a, b: F.xxhash64(a, b)))
    n = F.size("words")
    third = F.greatest(n - 2, F.lit(0))
    out = out.withColumn("triple", F.zip_with(F.slice("pair_hash", F.lit(1), third), F.slice("word_hash", F.lit(3), third), lambda a, b: F.xxhash64(a, b)))
    # Only texts with a repeated window need its positions.
    out = out.withColumn("sorted", F.when(F.size("triple") > F.size(F.array_distinct("triple")), F.sort_array("triple")))
    out = out.withColumn("twice", F.array_distinct(F.filter("sorted", lambda x, i: F.get(F.col("sorted"), i + 1) == x)))
    few = F.filter(F.transform("triple", lambda h, i: F.when(F.array_contains("twice", h), i)), lambda x: x.isNotNull())
    out = out.withColumn("ordered", F.when(F.size("twice") > _FEW, F.sort_array(F.transform("triple", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    far = F.col("ordered")
    many = F.sort_array(F.transform(F.filter(far, lambda x, i: (F.get(far, i - 1)["h"] == x["h"]) | (F.get(far, i + 1)["h"] == x["h"])), lambda x: x["i"]))
    out = out.withColumn("at", F.when(F.size("twice") > _FEW, many).when(F.col("twice").isNotNull(), few))
    at, m = F.col("at"), F.size("at")
    covered = F.aggregate(_pairs(at, at, m, lambda a, b: F.least(b - a, F.lit(3))), F.lit(0), lambda s, x: s + x) + 3
    out = out.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(" " + _SPACES))) > 0))
    bare = F.col("text")
    for c in _SYMBOLS:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    return out.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.octet_length("text") - F.octet_length(bare)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.coalesce(m, F.lit(-1)) > 0, covered).otherwise(0).cast("long").alias("n_repeat_words"),
        *(F.transform(h, lambda x: F.pmod(x, F.lit(buckets)).cast("int")).alias(name) for h, name in (("word_hash", "word_bucket"), ("pair_hash", "pair_bucket"))),
    )


def bucket_counts(rows: DataFrame, target_ids: DataFrame, *, buckets: int) -> tuple[list[int], list[int]]:
    """How often each n-gram bucket is in the corpus, and in the target.

    Every row of the corpus counts; only ``buckets`` rows of counts reach the driver.
    """
    # target_ids is a sample of bounded size, hence the broadcast
    marked = rows.join(F.broadcast(target_ids.withColumn("target", F.lit(1))), "doc_id", "left").select(F.coalesce("target", F.lit(0)).alias("target"), "word_bucket", "pair_bucket")
    grams = marked.select("target", F.explode("word_bucket").alias("bucket")).union(marked.select("target", F.explode("pair_bucket")))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = [0] * buckets, [0] * buckets
    for r in counts:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    return raw, target


def _table(values: list[float]) -> Column:
    return F.split(F.lit(",".join(repr(v) for v in values)), ",").cast("array<double>")


def quality_rules(docs: DataFrame, labels: DataFrame, *, buckets: int = 32_768, target_rows: int = 50_000, threshold: float = -0.1, min_words: int = 50, max_repeat_percent: int = 50, prior: int | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept for every row of ``docs`` (doc_id, text).

    score is the log-likelihood ratio between the trusted target's and the
    corpus's multinomials of hashed words and word pairs, divided by their
    number. kept: base_failed is false and score >= ``threshold``, for every
    document alike. base_failed: n_words < ``min_words`` or
    100 * n_repeat_words > ``max_repeat_percent`` * n_words.

    Without ``prior`` both are add-one smoothed, and over few documents
    unlabelled clean ones score lower, as the target knows few of their n-grams.
    With it, the target's counts are smoothed by ``prior`` n-grams dealt as in
    the corpus, so that what a small target doesn't know counts little, and a
    target document is scored without its own counts in the target.

    The target is fitted on a bounded sample: the documents with quality 1 in
    ``labels`` (doc_id, quality), at most ``target_rows`` ids, the first by hash.
    The corpus statistics cover every row. Null and empty texts have no words,
    score 0 and fail the base rule. Rows of a null doc_id are no targets.
    Repeated rows are kept. Without labels all scores come from smoothing alone.
    Other columns are ignored; empty tables give an empty result.
    """
    trusted = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    trusted = materialize(trusted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_rows), "trusted")
    rows = materialize(parsed(docs, buckets), "parsed")
    raw, target = bucket_counts(rows, trusted, buckets=buckets)
    n_raw, n_target = sum(raw) + buckets, sum(target)
    share = [(c + 1) / n_raw for c in raw]
    smoothed = [t + 1 if prior is None else t + prior * p for t, p in zip(target, share, strict=True)]
    total = n_target + (buckets if prior is None else prior)
    table = _table([log(t / total) - log(p) for t, p in zip(smoothed, share, strict=True)])

    def ratio(name: str) -> Column:
        return F.aggregate(name, F.lit(0.0), lambda s, b: s + F.get(table, b))

    grams = F.size("word_bucket") + F.size("pair_bucket")
    out, own = rows, F.lit(0.0)
    if prior is not None:
        out = rows.join(F.broadcast(trusted.withColumn("target", F.lit(True))), "doc_id", "left")
        out = out.withColumn("sorted", F.when(F.col("target"), F.sort_array(F.concat("word_bucket", "pair_bucket"))))
        ends = F.filter(F.transform("sorted", lambda b, i: F.when(F.coalesce(F.get(F.col("sorted"), i + 1) != b, F.lit(True)), i)), lambda x: x.isNotNull())
        out = out.withColumn("ends", ends)
        runs = F.transform("ends", lambda e, k: F.struct(F.get(F.col("sorted"), e).alias("b"), (e - F.coalesce(F.get(F.col("ends"), k - 1), F.lit(-1))).alias("n")))
        counts = _table(smoothed)
        without = F.aggregate(runs, F.lit(0.0), lambda s, r: s + r["n"] * F.log(1 - r["n"] / F.get(counts, r["b"])))
        own = F.when(F.col("target"), without + grams * F.log(total / (total - grams))).otherwise(0.0)
    out = out.withColumn("score", F.when(grams > 0, (ratio("word_bucket") + ratio("pair_bucket") + own) / grams).otherwise(0.0))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    scored = out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.round("score", 9).alias("score"), (~failed & (F.col("score") >= threshold)).alias("kept"))
    # Written with a prior, as a filter on the score that is moved before the sorted arrays would sort them once for each n-gram.
    return scored if prior is None else materialize(scored, "scored")
