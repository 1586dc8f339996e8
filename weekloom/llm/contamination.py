"""Benchmark items inside documents: size-partitioned MinHash containment search, then exact shingle containment."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm import files
from weekloom.llm import wordbytes as wb
from weekloom.llm.tables import arrow_map, materialize, new_path, release_memory, ship


class ItemBlock(NamedTuple):
    """A block of test items: their shingles, and sorted MinHash keys for each partition by size."""

    item_id: list[int]
    width: np.ndarray
    shingles: list[np.ndarray]
    #: (words in a shingle, power of the partition) -> for each hash function sorted values and their items
    tables: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]]
    factors: tuple[np.ndarray, np.ndarray]


def item_block(ids: list[int], texts: list[str], hashes: int, seed: int) -> ItemBlock:
    factors = wb.multipliers(seed, hashes)
    item_id, width, shingles, parts = [], [], [], {}
    for i, text in zip(ids, texts, strict=True):
        part = next(wb.slices(pa.array([text])))
        w = wb.words(part)
        if not len(w.hash):
            continue
        k = min(5, len(w.hash))
        _, value = wb.distinct(*wb.ngrams(w, 1, k))
        parts.setdefault((k, int(len(w.hash) - k + 1).bit_length() - 1), []).append(len(item_id))
        item_id.append(i)
        width.append(k)
        shingles.append(value)
    tables = {}
    for key, members in parts.items():
        rows = []
        for a, b in zip(*factors, strict=True):
            low = np.array([(shingles[m] * a + b).min() for m in members])
            order = np.argsort(low, kind="stable")
            rows.append((low[order], np.array(members)[order]))
        tables[key] = rows
    return ItemBlock(item_id, np.array(width), shingles, tables, factors)


def write_blocks(items: DataFrame, *, hashes: int = 48, block: int = 5000, seed: int = 23) -> list[str]:
    """Write the items (item_id, text) in blocks of about ``block`` to files in the shared folder; returns their names.

    Tasks make the blocks, and readers hold one at a time. Items with a null id
    or text, or without a word, are left out.
    """
    rows = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    n = max(1, ceil(rows.count() / block))
    folder = new_path(items.sparkSession, "items")
    dealt = rows.repartition(n, F.xxhash64("item_id", "text")).sortWithinPartitions("item_id", "text")
    return [r["uri"] for r in materialize(arrow_map(dealt, _block_writer(folder, hashes, seed), "uri string"), "blocks").collect()]


def _block_writer(folder: str, hashes: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            texts += batch.column(1).to_pylist()
        made = item_block(ids, texts, hashes, seed)
        if made.item_id:
            uri, out = files.create(folder, "items.block")
            out.write(pickle.dumps(made))
            out.close()
            yield pa.RecordBatch.from_pydict({"uri": [uri]})

    return run


#: Bytes of blocks that a worker keeps between batches; further blocks are read for each batch.
HELD_BYTES = 256 << 20
_held: dict[str, tuple[ItemBlock, int]] = {}


def _read_block(uri: str) -> ItemBlock:
    if uri in _held:
        return _held[uri][0]
    if any(x.rpartition("/")[0] != uri.rpartition("/")[0] for x in _held):  # another query's
        _held.clear()
    with files.open_range(uri) as f:
        raw = f.read()
    block = pickle.loads(raw)
    if sum(size for _, size in _held.values()) + len(raw) <= HELD_BYTES:
        _held[uri] = block, len(raw)
    return block


def find_items(block: ItemBlock, part: wb.Slice, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, item index, shingles shared) of every hit in a slice.

    Items of 2**p up to 2**(p+1) - 1 shingles are searched in windows of
    2**(p+2) shingles that start every 2**(p+1): an item lies whole in some
    window, of which it is a quarter or more, however long the document is.
    """
    rows = part.last - part.first
    w = wb.words(part)
    hits: list[np.ndarray] = []
    sets: dict[int, np.ndarray] = {}
    for width in sorted({k for k, _ in block.tables}):
        doc, value = wb.ngrams(w, rows, width, whole_short=False)
        if not len(value):
            continue
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        size = np.diff(np.r_[first, len(doc)])
        hashed = np.empty_like(value)
        plans = {}
        for power in sorted(p for k, p in block.tables if k == width):
            stride = 2 << power
            n = -(-size // stride)
            start = np.repeat(first, n) + stride * wb.spread(np.zeros(len(n), np.int64), n)
            owner = np.repeat(np.arange(len(n)), n)
            plans[power] = (start, owner, np.r_[owner[1:] == owner[:-1], False])
        for h, (a, b) in enumerate(zip(*block.factors, strict=True)):
            np.multiply(value, a, out=hashed)
            hashed += b
            for power, (start, owner, more) in plans.items():
                low = np.minimum.reduceat(hashed, start)
                low[more] = np.minimum(low[more], np.r_[low[1:], low[:1]][more])
                keys, members = block.tables[width, power][h]
                left, right = np.searchsorted(keys, low, "left"), np.searchsorted(keys, low, "right")
                found = np.flatnonzero(right > left)
                if len(found):
                    count = (right - left)[found]
                    row = np.repeat(doc[first[owner[found]]], count)
                    hits.append(np.unique(row * len(block.item_id) + members[wb.spread(left[found], count)]))
        if hits:
            own, its = wb.distinct(doc, value)
            sets[width] = own.astype(np.uint64) << np.uint64(wb.SHINGLE_BITS) | its
    if not hits:
        return (np.zeros(0, np.int64),) * 3
    row, item = np.divmod(np.unique(np.concatenate(hits)), len(block.item_id))
    shared = np.zeros(len(row), np.int64)
    for k in range(len(row)):
        all_keys = sets.get(int(block.width[item[k]]))
        if all_keys is None:
            continue
        key = np.uint64(row[k]) << np.uint64(wb.SHINGLE_BITS) | block.shingles[item[k]]
        place = np.minimum(np.searchsorted(all_keys, key), len(all_keys) - 1)
        shared[k] = (all_keys[place] == key).sum()
    enough = shared >= threshold * np.array([len(block.shingles[i]) for i in item])
    return row[enough], item[enough], shared[enough]


def contained_items(docs: DataFrame, items: DataFrame, *, threshold: float = 0.8, hashes: int = 48) -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_shared and containment of every item found in a document.

    containment is the share of the item's distinct 5-word shingles that the
    document has, ``threshold`` or more; words are lower-cased in A-Z. An item
    with fewer than five words is one shingle of its own length. All items are
    the query set, searched in blocks against every whole document. Null and
    empty texts hold nothing; an item without words is in nothing. Other columns
    are ignored, a repeated row gives repeated results, and empty tables give an
    empty result.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = arrow_map(source, _searcher(write_blocks(items, hashes=hashes), threshold), "doc_id long, item_id long, n_item_shingles long, n_shared long")
    return out.withColumn("containment", F.col("n_shared") / F.col("n_item_shingles"))


def _searcher(uris: list[str], threshold: float):
    """One scan of the documents: each batch of rows meets one block after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in uris:
                block = _read_block(uri)
                ids = np.array(block.item_id, np.int64)
                sizes = np.array([len(x) for x in block.shingles], np.int64)
                for part in wb.slices(batch.column(1)):
                    row, item, shared = find_items(block, part, threshold)
                    if len(row):
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + part.first)), pa.array(ids[item]), pa.array(sizes[item]), pa.array(shared)], ["doc_id", "item_id", "n_item_shingles", "n_shared"])

    return run


def drop_contaminated(docs: DataFrame, items: DataFrame, *, threshold: float = 0.8, hashes: int = 48) -> DataFrame:
    """The rows of ``docs``, all columns as they are, in which no item is found (see ``contained_items``)."""
    ship(docs.sparkSession)
    holds = F.arrow_udf(_holder(write_blocks(items, hashes=hashes), threshold), "boolean")
    return docs.where(~holds(F.col("text").cast("string")))


def _holder(uris: list[str], threshold: float):
    def run(texts: pa.Array) -> pa.Array:
        held = np.zeros(len(texts), bool)
        for uri in uris:
            block = _read_block(uri)
            for part in wb.slices(texts):
                held[part.first + find_items(block, part, threshold)[0]] = True
        release_memory()
        return pa.array(held)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return run
