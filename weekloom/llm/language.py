"""Language identification by rank-order profiles and out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekloom.llm import wordbytes as wb
from weekloom.llm.tables import arrow_map, ship

#: Letter n-grams of 1 to this many characters, with one mark on either side of a word.
LONGEST = 3
_MARK = 1
#: A slice's n-grams take some two hundred bytes for each of its bytes.
SLICE_BYTES = 1 << 18


class Profiles(NamedTuple):
    """Ranks of the known n-grams: grams sorted, one column of ranks for each language; ``depth`` where absent."""

    langs: list[str]
    grams: np.ndarray
    ranks: np.ndarray
    depth: int


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower-case form if it is a letter, else the word mark."""
    table = np.full(0x110000, _MARK, np.uint32)
    for c in range(0x110000):
        if (ch := chr(c)).isalpha():
            table[c] = ord(ch.lower()[0])
    return table


def ranked_grams(part: wb.Slice, depth: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, n-gram hash, count, rank) by row and falling count, and the letters of each row; equal counts go by hash. ``depth`` limits ranks."""
    rows = part.last - part.first
    point = np.frombuffer(part.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.flatnonzero((part.data & 0xC0) != 0x80)
    at = np.searchsorted(heads, part.offsets)
    if len(heads) != len(point):  # bytes that aren't UTF-8
        at = np.array([len(part.data[:k].tobytes().decode("utf-8", "replace")) for k in part.offsets])
    code = _letters()[point]
    letter = code != _MARK
    row = np.repeat(np.arange(rows), np.diff(at))
    n_letters = np.bincount(row[letter], minlength=rows)
    # One mark before and after each run of letters: keep letters, the first mark after a run, and a mark at each row's start.
    keep = letter.copy()
    keep[1:] |= letter[:-1] & (row[1:] == row[:-1])
    full = np.concatenate([np.arange(rows), row[keep], np.arange(rows)])
    code = np.concatenate([np.full(rows, _MARK, np.uint32), code[keep], np.full(rows, _MARK, np.uint32)]).astype(np.uint64)
    order = np.argsort(full, kind="stable")
    full, code = full[order].astype(np.uint64), code[order]
    mark = code == _MARK
    keys = []
    gram = np.zeros(len(code), np.uint64)
    for n in range(1, LONGEST + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        gram = (gram[:m] << np.uint64(21)) | code[n - 1 :]
        good = full[:m] == full[n - 1 :]
        for k in range(1, n - 1):
            good &= ~mark[k : k + m]  # no n-gram reaches over a word's end
        good &= ~mark[:m] if n == 1 else ~(mark[:m] & mark[n - 1 :]) if n == 2 else True
        keys.append(full[:m][good] << np.uint64(wb.SHINGLE_BITS) | wb.mix(gram[good] + np.uint64(n)) >> np.uint64(64 - wb.SHINGLE_BITS))
    key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    key.sort()
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, len(key)])
    key = key[first]
    owner = (key >> np.uint64(wb.SHINGLE_BITS)).astype(np.int64)
    order = np.argsort((owner << 32) - count, kind="stable")
    owner, key, count = owner[order], key[order], count[order]
    size = np.bincount(owner, minlength=rows)
    rank = np.arange(len(owner)) - (np.cumsum(size) - size)[owner]
    if depth is not None:
        top = rank < depth
        owner, key, count, rank = owner[top], key[top], count[top], rank[top]
    return owner, wb.signed(key & np.uint64((1 << wb.SHINGLE_BITS) - 1)), count, rank, n_letters


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), dtype=object)
        for part in wb.slices(batch.column(0), SLICE_BYTES):
            owner, gram, count, _, _ = ranked_grams(part, None)
            names, which = np.unique(langs[part.first : part.last].astype(str), return_inverse=True)
            for k, name in enumerate(names):
                mine = which[owner] == k
                values, inverse = np.unique(gram[mine], return_inverse=True)
                if len(values):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(values)), pa.array(values), pa.array(np.bincount(inverse, weights=count[mine]).astype(np.int64))], ["lang", "gram", "n"])


def fit_profiles(labelled: DataFrame, *, depth: int = 400, rows_per_lang: int = 5000) -> Profiles:
    """Profiles of the ``depth`` most frequent n-grams of each language of ``labelled`` (doc_id, text, lang).

    The classifier is fitted on a bounded sample: of a language with more than
    ``rows_per_lang`` rows, those whose hashed doc_id falls under the rate that
    gives about ``rows_per_lang`` rows. Rows whose text or lang is null teach
    nothing. Equal counts rank by n-gram hash. Only depth rows a language reach the driver.
    """
    rows = labelled.where("text is not null and lang is not null").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Profiles([], np.zeros(0, np.int64), np.zeros((0, 0), np.int32), depth)
    rate = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, rows_per_lang / n))])
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < rate[F.col("lang")] * 1_000_003).select("text", "lang")
    counts = arrow_map(sample, _gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("rank", rank).where(f"rank <= {int(depth)}").select("lang", "gram", "rank").toArrow().to_pydict()
    langs = sorted(sizes)
    grams = np.unique(np.array(top["gram"], dtype=np.int64))
    ranks = np.full((len(grams), len(langs)), depth, np.int32)
    ranks[np.searchsorted(grams, top["gram"]), np.searchsorted(np.array(langs), np.array(top["lang"], dtype=str))] = np.array(top["rank"], dtype=np.int32) - 1
    return Profiles(langs, grams, ranks, depth)


def out_of_place(profiles: Profiles, part: wb.Slice) -> tuple[list[str], np.ndarray]:
    """Predicted language and score of each row of a slice."""
    rows = part.last - part.first
    owner, gram, _, rank, n_letters = ranked_grams(part, profiles.depth)
    pred, score = ["und"] * rows, np.zeros(rows)
    if not profiles.langs:
        return pred, score
    place = np.minimum(np.searchsorted(profiles.grams, gram), max(len(profiles.grams) - 1, 0))
    known = profiles.grams[place] == gram if len(profiles.grams) else np.zeros(len(gram), bool)
    size = np.bincount(owner, minlength=rows)
    total = np.empty((rows, len(profiles.langs)))
    for k in range(len(profiles.langs)):
        its = profiles.ranks[place, k] if len(profiles.grams) else np.full(len(gram), profiles.depth)
        apart = np.where(known & (its < profiles.depth), np.minimum(np.abs(rank - its), profiles.depth), profiles.depth)
        total[:, k] = np.bincount(owner, weights=apart, minlength=rows)
    best = total.argmin(axis=1)
    ok = n_letters > 0
    score[ok] = 1 - total[ok, best[ok]] / (profiles.depth * np.maximum(size[ok], 1))
    for r in np.flatnonzero(ok):
        pred[r] = profiles.langs[best[r]]
    return pred, np.clip(score, 0, 1)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred and score for every row of ``docs`` (doc_id, text), from the whole text alone.

    Null texts, texts without a letter, and all texts when no language was
    learned give ``und`` with score 0. Where no n-gram was learned, a text with
    letters is at the largest distance from all languages. Equal distances go to the language whose
    name sorts first. The score is 1 less the out-of-place distance as a share
    of the largest possible one. Other columns are ignored, repeated rows are
    kept, and an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wb.slices(batch.column(1), SLICE_BYTES):
                pred, score = out_of_place(profiles, part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, part.last - part.first), pa.array(pred), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, profiles: Profiles, *, min_score: float = 0.1) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text has a recognised language with at least ``min_score``."""
    ship(docs.sparkSession)
    marked = F.arrow_udf(_recogniser(profiles, min_score), "boolean")
    return docs.where(marked(F.col("text").cast("string")))


def _recogniser(profiles: Profiles, min_score: float):
    def run(texts: pa.Array) -> pa.Array:
        out = [np.zeros(0, bool)]
        for part in wb.slices(texts, SLICE_BYTES):
            pred, score = out_of_place(profiles, part)
            out.append((np.array(pred, dtype=object) != "und") & (score >= min_score))
        return pa.array(np.concatenate(out))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return run
