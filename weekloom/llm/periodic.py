"""Periodic runs of words: seeds from minimizers at many scales, direct scans for short periods.

A run is a stretch of words with smallest period q and at least ``max(6, 4 * q)``
words that no neighbouring word extends. At scale K (16, 32, ...), which serves
the periods from K / 2 + 1 to K, every window of K / 2 positions picks its
smallest hash of K words. Inside a run the windows at a distance of q hold the
same hashes, so both pick their minimum at a distance of q; and as K >= q, equal
hashes of K words lie at multiples of q only. So two picked positions with one
hash that follow each other at a distance of q seed every run. Seeds of one lag
that overlap are joined and extended word by word. Periods up to ``SCANNED`` are
found by comparing the words with those a lag later.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.llm import wordbytes as wb
from weekloom.llm.tables import arrow_map

RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
#: Periods up to this are scanned for; the first scale is twice as long.
SCANNED = 8
LEAST_WORDS, LEAST_PERIODS = 6, 4

Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def _enough(start: np.ndarray, end: np.ndarray, lag: np.ndarray) -> Found:
    """(start, length, period) of the stretches of equal words a lag apart that are long enough."""
    length = end - start + lag
    keep = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * lag)
    return start[keep], length[keep], lag[keep]


def _scan(x: np.ndarray, lag: int) -> Found:
    edge = np.diff(np.r_[False, x[lag:] == x[:-lag], False].astype(np.int8))
    start = np.flatnonzero(edge == 1)
    return _enough(start, np.flatnonzero(edge == -1), np.full(len(start), lag))


def _windowed(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` of every ``width`` values, a power of two, by doubling."""
    step = 1
    while step < width:
        values = best(values[:-step], values[step:])
        step *= 2
    return values


def _equal_for(x: np.ndarray, at: np.ndarray, lag: np.ndarray, way: int, chunk: int) -> np.ndarray:
    """How many words from ``at`` on, forwards or backwards, equal those a lag later."""
    count, live = np.zeros(len(at), np.int64), np.arange(len(at))
    while len(live):
        i = at[live, None] + way * (count[live, None] + np.arange(chunk))
        j = i + lag[live, None]
        inside = (i >= 0) & (j < len(x))
        same = inside & (x[np.where(inside, i, 0)] == x[np.where(inside, j, 0)])
        more = np.where(same.all(1), chunk, same.argmin(1))
        count[live] += more
        live = live[more == chunk]
    return count


def _seeded(x: np.ndarray, gram: np.ndarray, size: int) -> Found:
    """Stretches with periods from size / 2 + 1 to ``size``; ``gram`` are the hashes of ``size`` words."""
    half = size // 2
    lows = np.pad(_windowed(gram, half, np.minimum), half - 1)
    picked = np.flatnonzero(_windowed(lows, half, np.maximum) == gram)
    picked = picked[np.argsort(gram[picked], kind="stable")]
    lag = np.diff(picked)
    seed = (gram[picked[1:]] == gram[picked[:-1]]) & (lag > half) & (lag <= size)
    at, lag = picked[:-1][seed], lag[seed]
    if not len(at):
        return at, at, at
    order = np.lexsort((at, lag))
    at, lag = at[order], lag[order]
    first = np.flatnonzero(np.r_[True, (lag[1:] != lag[:-1]) | (at[1:] > at[:-1] + size)])
    start, end, lag = at[first], at[np.r_[first[1:], len(at)] - 1] + size, lag[first]
    start = start - _equal_for(x, start - 1, lag, -1, size)
    return _enough(start, end + _equal_for(x, end, lag, 1, size), lag)


def word_runs(x: np.ndarray, of: np.ndarray, counts: np.ndarray) -> Found:
    """(start, length, period) of all runs of word hashes, by start and period.

    ``x`` holds each row's words and then an end of its own that no other word
    equals, so that no stretch reaches into another row; ``of`` is each
    position's row, ``counts`` the rows' words.
    """
    found = [_scan(x, q) for q in range(1, SCANNED + 1)]
    place, words, gram, size = np.arange(len(x)), x, x, 1
    while True:
        if size > SCANNED:
            # A run of this scale has more than two hashed stretches of words.
            long = counts[of[place]] >= 2 * size + LEAST_PERIODS
            if not long.any():
                break
            place, words, gram = place[long], words[long], gram[long[: len(gram)]]
            start, length, period = _seeded(words, gram, size)
            found.append((place[start], length, period))
        if len(gram) <= size:
            break
        gram, size = wb.mix(gram[:-size] * np.uint64(0x9E3779B97F4A7C15) + gram[size:]), 2 * size
    start, length, period = map(np.concatenate, zip(*found, strict=True))
    # A stretch that a multiple of its period found has the period itself too.
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    least = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])][: len(start)]
    start, length, period = start[least], length[least], period[least]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _joined(data: np.ndarray, w: wb.Words, kept: np.ndarray, rows: int) -> pa.Array:
    """Each row's kept words joined by one space."""
    start, size, doc = w.start[kept], (w.end - w.start)[kept], w.doc[kept]
    last = np.r_[doc[1:] != doc[:-1], True][: len(doc)]
    room = size + ~last
    offsets = np.zeros(rows + 1, np.int64)
    np.cumsum(np.bincount(doc, weights=room, minlength=rows).astype(np.int64), out=offsets[1:])
    out = np.full(int(offsets[-1]), 0x20, np.uint8)
    out[wb.spread(np.cumsum(room) - room, size)] = data[wb.spread(start, size)]
    return pa.StringArray.from_buffers(rows, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out))


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in wb.slices(batch.column(1)):
            rows = part.last - part.first
            w = wb.words(part, lower=False)
            counts = np.bincount(w.doc, minlength=rows)
            first = np.cumsum(counts) - counts + np.arange(rows)
            x = np.empty(len(w.hash) + rows, np.uint64)
            x[np.arange(len(w.hash)) + w.doc] = w.hash
            x[first + counts] = wb.mix(np.arange(1, rows + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            start, length, period = word_runs(x, np.repeat(np.arange(rows), counts + 1), counts)
            # Words after a run's first period are repeats.
            edge = np.zeros(len(x) + 1, np.int64)
            np.add.at(edge, start + period, 1)
            np.add.at(edge, start + length, -1)
            kept = np.flatnonzero((np.cumsum(edge)[:-1] == 0)[np.arange(len(w.hash)) + w.doc])
            doc = np.searchsorted(first, start, "right") - 1
            runs = pa.StructArray.from_arrays([pa.array(start - first[doc]), pa.array(length), pa.array(period)], ["start", "length", "period"])
            offsets = np.r_[0, np.cumsum(np.bincount(doc, minlength=rows))].astype(np.int32)
            columns = [batch.column(0).slice(part.first, rows), pa.array(counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), runs), _joined(part.data, w, kept, rows)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs and collapsed for every row of ``docs`` (doc_id, text).

    Words are the stretches without white space (0x20, 0x09 to 0x0D) of the
    whole text, case kept, compared by 64-bit hashes. ``runs`` lists every run
    (start, length, period in words, from 0) by start and period; ``collapsed``
    is the text of the words that no run holds after its first period, joined
    by one space.

    A null or empty text has no words, no runs and an empty collapsed text.
    Repeated rows give repeated results; a null doc_id stays null. Other columns
    are ignored, whatever their names. An empty table gives an empty result. A
    text is worked on whole in one task; memory follows its words, not its runs.
    """
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), _run_rows, RUNS)


def strongest(runs: str) -> Column:
    """The run with the most periods, compared as exact fractions; the first by start and period wins ties. Null without runs."""
    more = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, run: F.when(more(best, run), run).otherwise(best))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the rows, by hash of doc_id, repeat some of their words to the end.

    For h = crc32 of the decimal doc_id, g = h div 10 and n words, rows with
    h % 10 = 0 and words repeat the words from a = g % n on with a period of
    1 + (n - a) div (3 + g % 8), their words joined by one space; others stay.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), F.expr("crc32(cast(cast(doc_id as string) as binary)) div 10").alias("g"))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.expr("if(n > 0, cast(g % n as int), null)")).withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    again = F.expr("array_join(concat(slice(words, 1, a), flatten(array_repeat(slice(words, a + 1, p), cast((n - a) div p as int))), slice(words, a + 1, (n - a) % p)), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))
