"""Ranked lexical search over bit-sliced Bloom signatures.

Every document has a Bloom signature of its terms and of the levels that their
counts reach. Signatures of documents of about one size are stored by bit: a
slice is a bitmap over the documents of a block. The slices of a term, joined by
"and", say which documents may hold it, never missing one that does. Sums of the
items' weights over these bitmaps, level by level, bound every document's score
from above. The best bounds are scored exactly, which gives each item a score
that its results reach at least; all documents whose bound reaches it are scored
exactly from their whole texts, and the best are the result.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekloom.llm import wordbytes as wb
from weekloom.llm.tables import arrow_map, discard, materialize

INDEX = "doc_ids array<long>, text_hashes array<long>, sizes array<long>, bits long, slices binary, terms array<long>, counts array<long>"
#: Counts from which a term has a further key, and the largest count that a term without the next key has.
LEVELS, CAPS = (1, 2, 3, 5, 9), (1, 2, 4, 8)
#: Bits of a signature for each of its keys, at least (up to twice as many), and slices that a key sets.
KEY_BITS, KEY_SLICES = 8, 3
#: Documents of a block and bits of a block, at most (but 8 documents at least).
BLOCK_ROWS, BLOCK_BITS = 1024, 1 << 22
#: Items and bytes of their texts that are searched for in one go.
ITEM_ROWS, ITEM_BYTES = 1000, 1 << 22

#: A term is a run of bytes other than these: ASCII that is no letter or digit.
APART = np.zeros(256, dtype=bool)
APART[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def _positions(terms: np.ndarray, level: int, bits: int) -> list[np.ndarray]:
    """The slices that a term sets at a level, in signatures of ``bits`` bits (a power of two)."""
    key = wb.mix(terms + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64))
    return [(wb.mix(key + np.uint64(k)) & np.uint64(bits - 1)).astype(np.int64) for k in range(KEY_SLICES)]


def _block(docs: list[tuple], bits: int) -> pa.RecordBatch:
    """One row of the index; ``docs`` are (doc_id, text hash, size, terms, counts)."""
    terms, counts = (np.concatenate([d[k] for d in docs]) for k in (3, 4))
    row = np.repeat(np.arange(len(docs)), [len(d[3]) for d in docs])
    marks = np.zeros((bits, -(-len(docs) // 8) * 8), bool)
    for level, least in enumerate(LEVELS):
        often = counts >= least
        for at in _positions(terms[often], level, bits):
            marks[at, row[often]] = True
    seen, df = np.unique(terms, return_counts=True)
    lists = [[d[0] for d in docs], [d[1] for d in docs], [d[2] for d in docs]]
    columns = [pa.array([x], pa.list_(pa.int64())) for x in lists]
    columns += [pa.array([bits]), pa.array([np.packbits(marks, axis=1).tobytes()]), *(wb.list_array(x, np.array([len(seen)])) for x in (wb.signed(seen), df.astype(np.int64)))]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in INDEX.split(", ")])


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: dict[int, list[tuple]] = defaultdict(list)
    for batch in batches:
        ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for part in wb.slices(batch.column(2)):
            w = wb.words(part, apart=APART)
            rows, terms, counts = _counted(w)
            first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]][: len(rows)])
            size = np.bincount(w.doc, minlength=part.last - part.first)
            for a, b in zip(first, np.r_[first[1:], len(rows)][: len(first)], strict=True):
                keys = sum(int((counts[a:b] >= least).sum()) for least in LEVELS)
                bits = max(64, 1 << (KEY_BITS * keys - 1).bit_length())
                k = int(rows[a])
                waiting[bits].append((ids[part.first + k], hashes[part.first + k], int(size[k]), terms[a:b].copy(), counts[a:b].copy()))
                if len(waiting[bits]) >= max(8, min(BLOCK_ROWS, BLOCK_BITS // bits)):
                    yield _block(waiting.pop(bits), bits)
    for bits in sorted(waiting):
        yield _block(waiting[bits], bits)


def _counted(w: wb.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of each term of each row, sorted by row."""
    order = np.lexsort((w.hash, w.doc))
    doc, term = w.doc[order], w.hash[order]
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])][: len(doc)])
    return doc[first], term[first], np.diff(np.r_[first, len(doc)])


def build_index(docs: DataFrame) -> DataFrame:
    """The index table of ``docs`` (doc_id, text): a row for each block of documents, written in the shared folder.

    Every document with a term is in it, whatever its doc_id; ``terms`` and
    ``counts`` say how many documents of the block hold each term. It serves any items.
    """
    return materialize(arrow_map(_source(docs), _index_rows, INDEX), "signatures")


def _source(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


class Query(NamedTuple):
    """Items to search for: sorted term hashes, each item's terms and weights (times their repeats), one item after another."""

    item_ids: list[int]
    terms: np.ndarray
    first: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    documents: int
    words: int

    def parts(self, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """What one unit of weight scores for a term with these counts in documents of these sizes."""
        m = 25 + 75 * sizes * self.documents // self.words
        return 1_000_000_000 * counts // np.maximum(1000 * counts + 8 * m, 1)


def _query(index: DataFrame, items: list[tuple[int, str]], documents: int, words: int) -> Query | None:
    w = wb.words(wb.Slice(0, len(items), *wb.text_buffers(pa.array([x[1] for x in items], pa.large_string()))), apart=APART)
    item, term, repeats = _counted(w)
    terms = np.unique(term)
    if not len(terms):
        return None
    spark = index.sparkSession
    wanted = spark.createDataFrame([(int(t),) for t in wb.signed(terms)], "term long")
    held = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.counts").alias("n"))
    df = {r.term: r.df for r in held.join(F.broadcast(wanted), "term").groupBy("term").agg(F.sum("n").alias("df")).collect()}  # terms of one block of items
    weights = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for t, n in df.items()}
    weight = np.array([weights.get(int(t), 0) for t in wb.signed(term)], np.int64) * repeats
    known = weight > 0
    item, term, weight = item[known], term[known], weight[known]
    if not len(item):
        return None
    first = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
    terms = np.unique(term)
    return Query([items[i][0] for i in item[first]], terms, first, np.searchsorted(terms, term), weight, documents, words)


def _bounds(query: Query, row: dict) -> np.ndarray:
    """Upper bounds of the scores of a block's documents, item by document. No document's score is above its bound."""
    sizes, bits = np.array(row["sizes"], np.int64), row["bits"]
    slices = np.frombuffer(row["slices"], np.uint8).reshape(bits, -1)
    caps = [query.parts(np.minimum(c, sizes), sizes) for c in CAPS] + [query.parts(sizes, sizes)]
    total = np.zeros((len(query.item_ids), len(sizes)), np.int64)
    ends = np.r_[query.first[1:], len(query.term)]
    for level, cap in enumerate(caps):
        at = _positions(query.terms, level, bits)
        maybe = slices[at[0]]
        for more in at[1:]:
            maybe = maybe & slices[more]
        if not maybe.any():
            continue
        maybe = np.unpackbits(maybe, axis=1)[:, : len(sizes)]
        gain = cap - caps[level - 1] if level else cap
        for i, (a, b) in enumerate(zip(query.first, ends, strict=True)):
            # Sums of whole weights, exact in doubles.
            total[i] += (query.weight[a:b].astype(float) @ maybe[query.term[a:b]]).astype(np.int64) * gain
    return total


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(name)[k].as_py() for name in batch.schema.names}


def _best_bounds(query: Query, top: int):
    """Of each task the ``top`` highest bounds of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: np.ndarray | None = None
        for row in _rows(batches):
            ids = np.array([0 if x is None else x for x in row["doc_ids"]], np.int64)
            bound = _bounds(query, row)
            bound[:, [x is None for x in row["doc_ids"]]] = 0
            new = np.stack(np.broadcast_arrays(bound, ids, np.array(row["text_hashes"], np.int64)))
            kept = new if kept is None else np.concatenate([kept, new], axis=2)
            if kept.shape[2] > top:
                best = np.argpartition(-kept[0], top - 1, axis=1)[:, :top]
                kept = np.stack([np.take_along_axis(x, best, axis=1) for x in kept])
        if kept is not None:
            item, place = np.nonzero(kept[0] > 0)
            yield pa.RecordBatch.from_arrays([pa.array(item), *(pa.array(x[item, place]) for x in kept)], ["item", "bound", "doc_id", "text_hash"])

    return run


def _reaching(query: Query, least: np.ndarray):
    """The documents whose bound reaches the least score of some item, with these items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            doc, item = np.nonzero((_bounds(query, row) >= least[:, None]).T)
            named = np.array([x is not None for x in row["doc_ids"]])[doc]
            doc, item = doc[named], item[named]
            if len(doc):
                at, size = np.unique(doc, return_counts=True)
                columns = [pa.array([row[name][k] for k in at], pa.int64()) for name in ("doc_ids", "text_hashes")]
                yield pa.RecordBatch.from_arrays([*columns, wb.list_array(item.astype(np.int32), size)], ["doc_id", "text_hash", "items"])

    return run


def _scorer(query: Query, least: np.ndarray):
    """Exact scores of documents for the items that they may reach, from their whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wb.slices(batch.column(1)):
                w = wb.words(part, apart=APART)
                size = np.bincount(w.doc, minlength=part.last - part.first)
                at = np.minimum(np.searchsorted(query.terms, w.hash), len(query.terms) - 1)
                hit = query.terms[at] == w.hash
                rows, terms, counts = _counted(wb.Words(w.doc[hit], w.start[hit], w.end[hit], at[hit]))
                found: list[tuple[np.ndarray, ...]] = []
                first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]][: len(rows)])
                for a, b in zip(first, np.r_[first[1:], len(rows)][: len(first)], strict=True):
                    each = np.zeros(len(query.terms), np.int64)
                    each[terms[a:b]] = query.parts(counts[a:b], size[rows[a]])
                    score = np.add.reduceat(query.weight * each[query.term], query.first)
                    item = np.array(batch.column(2)[part.first + int(rows[a])].as_py(), np.int64)
                    item = item[score[item] >= least[item]]
                    found.append((item, np.full(len(item), part.first + rows[a]), score[item]))
                if found:
                    item, row, score = map(np.concatenate, zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(item), batch.column(0).take(pa.array(row)), pa.array(score)], ["item", "doc_id", "score"])

    return run


def _score(docs: DataFrame, wanted: DataFrame, query: Query, least: np.ndarray) -> DataFrame:
    """(item, doc_id, score) of the wanted (doc_id, text_hash, items); Spark broadcasts ``wanted`` if its table is small and shuffles otherwise."""
    met = _source(docs).join(wanted, ["doc_id", "text_hash"]).select("doc_id", "text", "items")
    return arrow_map(met, _scorer(query, least), "item long, doc_id long, score long")


def _first(df: DataFrame, by: str, top: int) -> DataFrame:
    """The ``top`` rows of each item; Spark keeps no more of each task before it shuffles."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc(by), "doc_id"))).where(F.col("rank") <= top)


def _search(docs: DataFrame, index: DataFrame, query: Query, top: int) -> DataFrame:
    bounds = index.select("doc_ids", "text_hashes", "sizes", "bits", "slices")
    best = _first(arrow_map(bounds, _best_bounds(query, top), "item long, bound long, doc_id long, text_hash long"), "bound", top)
    seeds = materialize(best.groupBy("doc_id", "text_hash").agg(F.collect_set(F.col("item").cast("int")).alias("items")), "seeds")
    least = np.ones(len(query.item_ids), np.int64)
    ranked = _first(_score(docs, F.broadcast(seeds), query, least), "score", top)  # ``top`` for each item of a block
    for item, score in ranked.where(F.col("rank") == top).select("item", "score").collect():
        least[item] = score
    reaching = arrow_map(bounds, _reaching(query, least), "doc_id long, text_hash long, items array<int>")
    wanted = materialize(reaching.dropDuplicates(["doc_id", "text_hash"]), "reaching")
    names = docs.sparkSession.createDataFrame([(k, i) for k, i in enumerate(query.item_ids)], "item long, item_id long")
    out = _first(_score(docs, wanted, query, least), "score", top).join(F.broadcast(names), "item")
    return discard(materialize(out.select("item_id", "rank", "doc_id", "score"), "ranked"), seeds, wanted)


def lexical_search(docs: DataFrame, items: DataFrame, *, top: int = 10) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` best documents of each item (item_id, text).

    Terms are runs of letters, digits and non-ASCII characters, lower-cased in
    A-Z, compared by 64-bit hashes. A term's score in a document grows with its
    count and falls with the document's share of all terms and with the number
    of documents that hold it; an item's score sums over its terms, repeats
    included, all in whole numbers. Documents with a score of 0 aren't
    returned; equal scores go by ascending doc_id.

    Null and empty texts have no terms: they aren't counted as documents, and as
    items they have no results. Repeated rows of ``docs`` are documents of their
    own. A row with a null doc_id counts in all statistics but can't be
    returned. Repeated items count once; unlike texts of one item_id are ranked
    apart under that id; a null item_id stays null. Other columns are ignored,
    whatever their names. Empty tables give an empty result.

    The items are a stated query set, searched in blocks of about ``ITEM_ROWS``.
    """
    spark = docs.sparkSession
    index = build_index(docs)
    documents, words = index.agg(F.coalesce(F.sum(F.size("sizes")), F.lit(0)), F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b)), F.lit(0))).first()
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    total, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-total // ITEM_ROWS), -(-size // ITEM_BYTES)) if documents else 0
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for k in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()  # a bounded block of the query set
        query = _query(index, block, documents, words) if block else None
        if query is not None:
            out = out.union(_search(docs, index, query, top))
    return discard(out, index)
