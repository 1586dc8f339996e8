"""Near-duplicate documents: MinHash with tensored banding, links confirmed on full shingle sets.

Two collections of ``half_tables`` small hashes (each of ``half_width``
minhashes) are drawn per document. Table (i, j) is keyed by the pair of the
i-th hash of the first and the j-th of the second collection, so
``2 * half_tables * half_width`` minhashes serve ``half_tables ** 2`` tables.

Within a table bucket every document is compared with one central document.
Documents of a bucket that are then in different components are compared with
each other, except where a bound computed from full sets proves that they
can't reach the threshold. No bucket, partner list or candidate list is capped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm import wordbytes as wb
from weekloom.llm.components import connected_components
from weekloom.llm.places import places, without
from weekloom.llm.tables import arrow_map, discard, materialize

SKETCH = "n_shingles long, node long, left_half array<long>, right_half array<long>"
SETS = "node long, shingles array<long>"
#: Comparisons with one central document that meet in one task's key at most, about.
HUB_PAIRS = 64


def _nodes(value: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set of shingles: a hash of two sums over its members."""
    spread = wb.mix(value)
    other = np.add.reduceat(wb.mix(spread + np.uint64(0xD6E8FEB86659FD93)), start)
    return wb.signed(wb.mix(np.add.reduceat(spread, start) + wb.mix(other)))


def _sketches(half_tables: int, half_width: int, width: int, seed: int):
    a, b = wb.multipliers(seed, 2 * half_tables * half_width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wb.slices(batch.column(2)):
                rows = part.last - part.first
                doc, value = wb.shingle_keys(wb.words(part), rows, width)
                size = np.bincount(doc, minlength=rows)
                full = np.flatnonzero(size)
                start = (np.cumsum(size) - size)[full]
                node = np.zeros(rows, np.int64)
                halves = np.zeros((rows, 2 * half_tables), np.uint64)
                if len(full):
                    node[full] = _nodes(value, start)
                    hashed = np.empty_like(value)
                    for t in range(2 * half_tables):
                        half = np.full(len(full), (t + 1) * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
                        for k in range(t * half_width, (t + 1) * half_width):
                            np.multiply(value, a[k], out=hashed)
                            hashed += b[k]
                            half = wb.mix(half + np.minimum.reduceat(hashed, start))
                        halves[full, t] = half
                left, right = (wb.list_array(wb.signed(np.ascontiguousarray(x[full]).ravel()), np.where(size > 0, half_tables, 0)) for x in (halves[:, :half_tables], halves[:, half_tables:]))
                carried = {name: batch.column(name).slice(part.first, rows) for name in batch.schema.names if name != "text"}
                yield pa.RecordBatch.from_pydict(carried | {"n_shingles": pa.array(size.astype(np.int64)), "node": pa.array(node), "left_half": left, "right_half": right})

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wb.slices(batch.column(2)):
                rows = part.last - part.first
                doc, value = wb.shingle_keys(wb.words(part), rows, width)
                size = np.bincount(doc, minlength=rows)
                size = size[size > 0]
                if len(size):
                    yield pa.RecordBatch.from_arrays([pa.array(_nodes(value, np.cumsum(size) - size)), wb.list_array(wb.signed(value), size)], ["node", "shingles"])

    return run


def near_duplicates(docs: DataFrame, *, threshold: int = 85, half_tables: int = 10, half_width: int = 3, width: int = 5, seed: int = 11, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, text_hash, n_shingles, class_id, component_id and kept for every row of ``docs`` (doc_id, text).

    Words are lower-cased in A-Z. Texts are linked if
    ``100 * intersection >= threshold * union`` of their ``width``-word shingle
    sets. class_id is the smallest doc_id with the same set, component_id the
    smallest doc_id reachable over links, and kept says whether that is the
    row's own. text_hash is Spark's xxhash64 of the text.

    Null or empty texts have no shingles, link with nothing and are kept. A
    null doc_id has a null component, links with nothing and is kept. Rows that
    repeat a doc_id and its text share one result. Unlike texts of one doc_id
    are texts of their own, each with its own component. Columns named in
    ``carry``, whole numbers under names that the result has not, come back as
    they are; others are ignored, whatever their names. An empty table gives an
    empty result.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"), *(F.col(c).cast("long").alias(c) for c in carry))
    made: list[DataFrame] = []

    def save(df: DataFrame, name: str) -> DataFrame:
        made.append(materialize(df, name))
        return made[-1]

    sketches = save(arrow_map(source, _sketches(half_tables, half_width, width, seed), "".join(f"{c} long, " for c in ("doc_id", "text_hash", *carry)) + SKETCH), "sketches")
    # One node for each set; its first document stands for it.
    classes = save(sketches.where("n_shingles > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("class_id")), "classes")
    reps = sketches.where("n_shingles > 0").join(classes, (sketches.node == classes.node) & (F.col("doc_id") == F.col("class_id")), "left_semi").dropDuplicates(["node"])

    # Halves that two classes share; a pair needs one on either side.
    halves = save(reps.select("node", "doc_id", F.explode("left_half").alias("half"), F.lit(True).alias("is_left")).union(reps.select("node", "doc_id", F.explode("right_half"), F.lit(False))), "halves")
    shared = save(halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    both = halves.join(shared, "half").groupBy("node", "doc_id").agg(F.expr("collect_list(half) filter (where is_left)").alias("l"), F.expr("collect_list(half) filter (where not is_left)").alias("r"), F.sum("n").alias("weight"))
    near = save(both.where("size(l) > 0 and size(r) > 0"), "near")
    keys = save(near.select("node", "doc_id", "weight", F.explode("l").alias("l"), "r").select("node", "doc_id", "weight", "l", F.explode("r").alias("r")).select("node", "doc_id", "weight", F.xxhash64("l", "r").alias("key")), "keys")
    # The first of those that share most: in a group of edited copies often the one they were made from.
    hubs = save(keys.groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("weight", (-F.col("doc_id")).alias("minus"), "node")).alias("best")).where("n > 1").select("key", F.col("best.node").alias("hub")), "hubs")
    members = save(keys.join(hubs, "key").select("key", "hub", "node"), "members")
    stars = save(members.where("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "stars")

    wanted = save(stars.select(F.col("a").alias("node")).union(stars.select("b")).distinct(), "wanted")
    wanted_docs = save(classes.join(wanted, "node").select(F.col("class_id").alias("doc_id")).distinct(), "wanted_docs")
    found_sets = arrow_map(source.select("doc_id", "text_hash", "text").join(wanted_docs, "doc_id", "left_semi"), _sets(width), SETS)
    found_sets = found_sets.join(wanted, "node", "left_semi")
    # Only rows that repeat a doc_id and its text make a set twice; without them no set need move.
    twice = sketches.join(wanted, "node", "left_semi").join(classes.withColumnsRenamed({"node": "of", "class_id": "first"}), (F.col("node") == F.col("of")) & (F.col("doc_id") == F.col("first")), "left_semi").groupBy("node").count().where("count > 1")
    sets = save(found_sets.dropDuplicates(["node"]) if twice.limit(1).count() else found_sets, "sets")
    close = F.expr(f"100 * common >= {int(threshold)} * (size_a + size_b - common)")

    def parts_of(pairs: DataFrame) -> DataFrame:
        """(a, parts): how many parts the pairs of each first side are dealt over."""
        return save(pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_PAIRS).cast("long").alias("parts")), "parts")

    def each_part(df: DataFrame, *columns) -> DataFrame:
        return df.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), *columns)

    def compared(pairs: DataFrame, parts: DataFrame) -> DataFrame:
        """Sets of both sides of the pairs; a side with many partners is dealt over parts, each with a copy of its set."""
        b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_of_b"))
        hot = parts.where("parts > 1")
        dealt = pairs.join(hot, "a", "left").withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1).cast("long"))))
        a = each_part(sets.join(parts, sets.node == parts.a), F.col("shingles").alias("set_of_a"))
        met = dealt.join(b, "b").join(a, ["a", "part"]).select("a", "b", "part", "set_of_a", "set_of_b", F.size(F.array_intersect("set_of_a", "set_of_b")).alias("common"))
        return met.withColumns({"size_a": F.size("set_of_a"), "size_b": F.size("set_of_b")})

    parts = parts_of(stars)
    met = save(compared(stars, parts).select("a", "b", "part", "common", "size_a", "size_b", F.array_except("set_of_b", "set_of_a").alias("extra")), "met")
    links = met.where(close).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    labels = connected_components(links).withColumnRenamed("node", "at")

    # Buckets that still hold several components: what a member can share with
    # one of another component is its part of the hub and the extras that members
    # of other components have. What only one component shares, links nothing.
    named = save(members.join(labels, members.node == F.col("at"), "left").select("key", "hub", "node", F.coalesce("label", "node").alias("label")), "named")
    open_keys = save(named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key"), "open")
    live = save(named.join(open_keys, "key", "left_semi").where("hub <> node"), "live")
    sides = live.select(F.col("hub").alias("a"), F.col("node").alias("b"), "label").distinct()
    # Holders of an extra are listed by part, so that a row stands for all of a part's.
    extras = met.join(sides, ["a", "b"]).select("a", "part", "b", "label", F.explode("extra").alias("token"))
    holders = save(extras.groupBy("a", "part", "token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.collect_list("b").alias("held_by")), "holders")
    common = save(holders.groupBy("a", "token").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("a", "token"), "common_extras")
    shares = holders.select("a", "token", "held_by").join(common, ["a", "token"]).select("a", F.explode("held_by").alias("b")).groupBy("a", "b").agg(F.count("*").alias("shared"))
    reach = met.select("a", "b", "common", "size_b").join(shares, ["a", "b"], "left").select(F.col("a").alias("hub"), F.col("b").alias("node"), F.col("size_b").alias("size"), "common", F.coalesce("shared", F.lit(0)).alias("shared"))
    reach = save(reach.where(f"100 * (common + shared) >= {int(threshold)} * size"), "reach")
    able = save(live.join(reach, ["hub", "node"]).select("key", "node", "label", "size", "common", "shared"), "able")
    # A pair meets in the smallest of the keys that it shares, and only there.
    able = save(able.join(able.groupBy("node").agg(F.collect_set("key").alias("keys")), "node"), "able_keys")
    x, y = able.alias("x"), able.alias("y")
    most = "(least(x.common, y.common) + least(x.shared, y.shared))"
    rest = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label")) & F.expr(f"100 * {most} >= {int(threshold)} * (x.size + y.size - {most})") & F.expr("x.key = array_min(array_intersect(x.keys, y.keys))"))
    rest = save(rest.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), "rest")
    more = compared(rest, parts_of(rest)).where(close).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    links = save(links.union(more).distinct(), "links")
    labels = connected_components(links).withColumnRenamed("node", "at")
    # The smallest doc_id of each component names it.
    named = classes.join(labels, classes.node == F.col("at"), "left").select("node", "class_id", F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("class_id").alias("least"))
    found = save(named.join(least, "label").select("node", "class_id", "least"), "found")
    out = sketches.select("doc_id", "text_hash", "n_shingles", *carry, F.expr("if(n_shingles > 0 and doc_id is not null, node, null)").alias("node")).join(found, "node", "left")
    component = F.coalesce("least", "doc_id")
    out = out.select("doc_id", "text_hash", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), *carry)
    return discard(materialize(out, "near_duplicates"), *made)


def drop_near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that ``near_duplicates`` keeps; its ``settings`` are passed on.

    A row goes by its doc_id and its text, so that another text of the same
    doc_id stays. Where the rows that go stand in the source files is carried
    with their sketches (see ``places``), so no text moves. A table that isn't a
    plain read of Parquet files is written first.
    """
    docs, file, row = places(docs)
    found = near_duplicates(docs.select("doc_id", "text", file.alias("file"), row.alias("row")), **settings, carry=("file", "row"))
    return without(docs, file, row, found.where("not kept"))
