"""Encoding of texts run by run, where each distinct run of bytes is encoded once."""

from __future__ import annotations

import numpy as np

from weekloom.llm import wordbytes as wb


class RunEncoder:
    """Base of encoders whose ids for a text are those of its runs, one after another.

    Runs of earlier batches are remembered by hash, up to ``remembered`` of at most 64 bytes; the result doesn't depend on it.
    """

    def __init__(self, remembered: int = 600_000):
        self.remembered = remembered
        #: Sorted hashes, number of ids, where they start, ids.
        self.known = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))

    def encode_runs(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the runs in the order given, and how many each has."""
        raise NotImplementedError

    def encode_all(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after another, and how many each row has."""
        key, first, which = np.unique(wb.span_hashes(data, start, end, lower=False), return_index=True, return_inverse=True)
        start, size = start[first], (end - start)[first]
        keys, sizes, places, ids = self.known
        place = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
        old = keys[place] == key if len(keys) else np.zeros(len(key), bool)
        new = np.flatnonzero(~old)
        fresh, fresh_counts = self.encode_runs(data, start[new], size[new])
        counts = np.zeros(len(key), np.int64)
        counts[new] = fresh_counts
        counts[old] = sizes[place[old]]
        at = np.cumsum(counts) - counts
        flat = np.zeros(int(counts.sum()), np.int32)
        flat[wb.spread(at[new], fresh_counts)] = fresh
        flat[wb.spread(at[old], counts[old])] = ids[wb.spread(places[place[old]], counts[old])]
        if len(keys) + len(new) <= self.remembered:
            short = new[size[new] <= 64]
            added = counts[short]
            joined = np.r_[keys, key[short]]
            order = np.argsort(joined)
            self.known = (joined[order], np.r_[sizes, added][order], np.r_[places, len(ids) + np.cumsum(added) - added][order], np.r_[ids, flat[wb.spread(at[short], added)]])
        per_run = counts[which]
        return flat[wb.spread(at[which], per_run)], np.bincount(doc, weights=per_run, minlength=rows).astype(np.int64)
