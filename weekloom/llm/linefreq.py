"""Line dedup by site-relative frequency: a line on too large a share of its host's pages is boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.llm.tables import discard, materialize, unused

_TRIM = " \t\n\x0b\x0c\r"


def is_blank(text: str) -> Column:
    """Whether a text has nothing but white space; null for null."""
    return F.btrim(F.col(text), F.lit(_TRIM)) == ""


def boilerplate_lines(docs: DataFrame, *, host: str = "source", max_ratio: float = 0.01, min_pages: int = 3) -> DataFrame:
    """host and lines (array of line hashes) of the hosts that have lines on more than ``max_ratio`` of their pages, and on ``min_pages`` or more.

    Lines are compared without white space at either end; blank ones don't
    count. Pages of one host with the same text are one page, and a page counts
    once for a line. The rule is the same for hosts of every size. Null is a
    host of its own. A host's array has at most (mean lines of a page) /
    max_ratio entries.
    """
    pages = docs.select(F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    lines = F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(_TRIM))))
    # Copies meet by the hash of their text, with the hashes of their lines only.
    hashed = F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.xxhash64(x))
    pages = materialize(pages.select("host", F.xxhash64("text").alias("page"), hashed.alias("lines")).dropDuplicates(["host", "page"]), "pages")
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    counts = pages.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    often = counts.alias("c").join(totals.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host"))).where(F.col("c.n") > max_ratio * F.col("t.pages"))
    found = often.groupBy(F.col("c.host").alias("host")).agg(F.sort_array(F.collect_list("c.line")).alias("lines"))
    return discard(materialize(found, "boilerplate"), pages)


def drop_boilerplate(docs: DataFrame, *, host: str = "source", max_ratio: float = 0.01, min_pages: int = 3, broadcast_lines: int = 500_000) -> DataFrame:
    """``docs``, all columns as they are, but for the text without its host's boilerplate lines (see ``boilerplate_lines``).

    Remaining lines keep their order and form; a text of which no line stays
    becomes empty, a null text stays null, and a text without boilerplate stays
    as it is, byte for byte. Rows are never dropped. Empty tables give an empty
    result. The hosts' lines are broadcast up to ``broadcast_lines`` of them and
    joined by shuffle beyond.
    """
    found = boilerplate_lines(docs, host=host, max_ratio=max_ratio, min_pages=min_pages)
    total = found.agg(F.sum(F.size("lines"))).first()[0] or 0
    host_of, often, hits = (unused(docs, name) for name in ("host_of", "often", "hits"))
    found = found.select(F.col("host").alias(host_of), F.col("lines").alias(often))
    key = F.col(host).cast("string")
    joined = docs.join(F.broadcast(found) if total <= broadcast_lines else found, key.eqNullSafe(F.col(host_of)), "left")
    text = F.col("text").cast("string")

    def line_hash(x):
        return F.xxhash64(F.btrim(x, F.lit(_TRIM)))

    joined = joined.withColumn(hits, F.when(F.col(often).isNotNull(), F.array_intersect(F.transform(F.split(text, "\n"), line_hash), often)))
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(hits, line_hash(x))), "\n")
    return joined.withColumn("text", F.when(F.coalesce(F.size(hits), F.lit(0)) > 0, kept).otherwise(text)).drop(host_of, often, hits)
