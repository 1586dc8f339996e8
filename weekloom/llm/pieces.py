"""SentencePiece encoding and decoding by batched numpy Viterbi.

The piece table of a public ``.model`` file is read (never trained). A text is
a dummy prefix and its characters, spaces written as U+2581. As no piece holds
a space mark after another character, runs "marks, then other characters" can
be segmented alone; distinct runs of a batch are encoded once. All runs of one
length class (equal after padding) advance together: substring hashes probe the
sorted piece keys, and vectorised maxima store the backpointers.

The public models are merged byte pairs, not unigrams. A prefix of a text has
one last piece, so a candidate counts only if merging leaves it apart from the
piece before it; the best of these is the model's own encoding.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm import wordbytes as wb
from weekloom.llm.tables import arrow_map
from weekloom.llm.runs import RunEncoder

MARK = "▁".encode()


class PieceTable(RunEncoder):
    """Pieces of a SentencePiece model with byte fallback: sorted hashes, ids, scores, and the bytes of each id."""

    def __init__(self, model_file: str):
        import sentencepiece

        super().__init__()
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        self.fallback = np.zeros(256, np.int64)
        raw, ids, scores, surface = [], [], [], []
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.fallback[int(piece[3:5], 16)] = i
                surface.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                surface.append(b"")
            else:
                raw.append(piece.encode())
                ids.append(i)
                scores.append(model.get_score(i))
                surface.append(piece.encode())
        if not self.fallback.any():
            raise ValueError("the model has no byte fallback pieces")
        if any(MARK in _unmarked(x) or (b"\n" in x and x != b"\n") for x in raw):
            raise ValueError("a piece reaches over a space mark or a line end")
        self._learn_merges([x.decode() for x in raw], np.array(scores))
        # Pieces that merging can't make never appear.
        made = np.flatnonzero(self.made)
        self.longest = max(len(raw[k]) for k in made)
        key = np.array([_hash_all(raw[k]) for k in made], np.uint64)
        order = np.argsort(key)
        self.keys, self.places = key[order], made[order]
        self.ids, self.scores = np.array(ids), np.array(scores, np.float64)
        self.sizes = {len(raw[k]) for k in made}
        #: Rules out most substrings before the sorted keys are probed.
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.keys & np.uint64(len(self.maybe) - 1)] = True
        #: What a character outside the pieces costs, as in the library.
        self.unknown = min(scores) - 10.0
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_at = np.r_[0, np.cumsum([len(x) for x in surface])]

    def _learn_merges(self, pieces: list[str], scores: np.ndarray) -> None:
        """Which pieces merging makes, from which two, and which piece two neighbours make."""
        number = {p: k for k, p in enumerate(pieces)}
        turn = np.empty(len(pieces), np.int64)
        turn[np.argsort(-scores, kind="stable")] = np.arange(len(pieces))
        self.made = np.zeros(len(pieces), bool)
        self.left, self.right = np.full(len(pieces), -1), np.full(len(pieces), -1)
        #: Turn at which a piece is merged; single characters come before all.
        self.turn = np.array([-1 if len(p) == 1 else t for p, t in zip(pieces, turn, strict=True)])
        for k, piece in enumerate(pieces):
            parts, last = list(piece), (-1, -1)
            while len(parts) > 1:
                t, at = min((turn[number[a + b]], i) if a + b in number else (len(pieces), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if t == len(pieces):
                    break
                last = number.get(parts[at], -1), number.get(parts[at + 1], -1)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.made[k] = len(parts) == 1 and (len(piece) == 1 or min(last) >= 0)
            self.left[k], self.right[k] = last
        pairs = [(number[p[:i]] << 32 | number[p[i:]], self.turn[k]) for k, p in enumerate(pieces) for i in range(1, len(p)) if p[:i] in number and p[i:] in number]
        pair = np.array([x for x, _ in pairs], np.int64)
        order = np.argsort(pair)
        self.pairs, self.pair_turn = pair[order], np.array([t for _, t in pairs])[order]
        self.maybe_pair = np.zeros(1 << 20, bool)
        self.maybe_pair[_fold(self.pairs)] = True

    def _merge_turn(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Turn at which two neighbours are merged; beyond all turns if never."""
        out = np.full(len(a), len(self.turn))
        key = a << 32 | b
        at = np.flatnonzero(self.maybe_pair[_fold(key)])
        place = np.minimum(np.searchsorted(self.pairs, key[at]), len(self.pairs) - 1)
        hit = self.pairs[place] == key[at]
        out[at[hit]] = self.pair_turn[place[hit]]
        return out

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves two neighbouring pieces as they are; a character outside the pieces (-1) never merges.

        Undo the merges of both from the last on; the ends that then meet must not have had an earlier turn.
        """
        out = np.ones(len(a), bool)
        live = np.flatnonzero((a >= 0) & (b >= 0))
        a, b = a[live], b[live]
        limit = np.full(len(live), len(self.turn))
        while len(live):
            bad = self._merge_turn(a, b) < limit
            out[live[bad]] = False
            turn_a, turn_b = self.turn[a], self.turn[b]
            go = ~bad & ((turn_a >= 0) | (turn_b >= 0))
            live, a, b, turn_a, turn_b = live[go], a[go], b[go], turn_a[go], turn_b[go]
            first = turn_a > turn_b
            # of two merges with the same turn the left one comes first
            limit = np.where(first, turn_a, turn_b + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return out

    def segment(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, length: int, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """Ids and number of ids of spans, padded to one length; they advance together, ``block`` positions at a time."""
        n = len(start)
        inside = np.arange(length) < size[:, None]
        grid = np.where(inside, data[np.minimum(start[:, None] + np.arange(length), len(data) - 1)], 0)
        head = np.ones((n, length + 1), bool)
        head[:, :length] = (grid & 0xC0) != 0x80
        # prefix sums of the polynomial hash, so that each substring's hash is one subtraction
        power, inverse = wb._power_tables(length + 1)
        sums = np.zeros((n, length + 1), np.uint64)
        np.cumsum(wb._BYTE[grid] * power[:length], axis=1, out=sums[:, 1:])
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((n, length + 1), np.int32)
        piece = np.full((n, length + 1), -1, np.int32)
        for low in range(0, length, block):
            high = min(low + block, length)
            found = []
            for width in range(1, min(self.longest, length) + 1):
                m = min(high, length - width + 1) - low
                if m <= 0:
                    break
                if width > 4 and width not in self.sizes:
                    continue
                good = head[:, low : low + m] & head[:, low + width : low + width + m] & (np.arange(low + width, low + width + m) <= size[:, None])
                if width <= 4:  # a character alone, if it is no piece
                    alone = good.copy()
                    for k in range(1, width):
                        alone &= ~head[:, low + k : low + k + m]
                if width in self.sizes:
                    key = wb.mix((sums[:, low + width : low + width + m] - sums[:, low : low + m]) * inverse[low : low + m] + np.uint64(width * 0x9E3779B97F4A7C15 % 2**64))
                    good &= self.maybe[key & np.uint64(len(self.maybe) - 1)]
                    at = np.flatnonzero(good)
                    key = key.ravel()[at]
                    place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                    hit = self.keys[place] == key
                    row, col = np.divmod(at[hit], m)
                    found.append((row, col, np.full(len(row), width), self.places[place[hit]]))
                    if width <= 4:
                        alone[row, col] = False
                if width <= 4:
                    row, col = np.nonzero(alone)
                    found.append((row, col, np.full(len(row), width), np.full(len(row), -1)))
            row, col, width, which = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(col, kind="stable")
            edge = np.searchsorted(col[order], np.arange(high - low + 1))
            for at in range(low, high):
                mine = order[edge[at - low] : edge[at - low + 1]]
                mine = mine[best[row[mine], at] > -np.inf]
                mine = mine[self.apart(piece[row[mine], at].astype(np.int64), which[mine])]
                r, end, p = row[mine], at + width[mine], which[mine]
                total = best[r, at] + np.where(p >= 0, self.scores[p], self.unknown)
                more = total > best[r, end]
                r, end, p, total = r[more], end[more], p[more], total[more]
                best[r, end], back[r, end], piece[r, end] = total, at, p
        return self._trace(grid, back, piece, size)

    def _trace(self, grid: np.ndarray, back: np.ndarray, piece: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, length = grid.shape
        out = np.full((n, length), -1, np.int64)  # at most one id a byte; filled at the position where it starts
        at = size.copy()
        while True:
            rows = np.flatnonzero(at > 0)
            if not len(rows):
                break
            end, start = at[rows], back[rows, at[rows]]
            known = piece[rows, end] >= 0
            out[rows[known], start[known]] = self.ids[piece[rows[known], end[known]]]
            for k in range(4):  # the bytes of a character
                more = ~known & (start + k < end)
                out[rows[more], start[more] + k] = self.fallback[grid[rows[more], start[more] + k]]
            at[rows] = start
        used = out >= 0
        return out[used], used.sum(axis=1)

    def encode_runs(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = np.zeros(len(start), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        # powers of two from 8 on, and those times 1.5
        padded = 1 << np.ceil(np.log2(np.maximum(size, 8))).astype(np.int64)
        padded = np.where((size <= padded * 3 // 4) & (padded > 8), padded * 3 // 4, padded)
        for length in np.unique(padded).tolist():
            members = np.flatnonzero(padded == length)
            step = max(1, 1_000_000 // (min(length, 2048) * 8))
            for a in range(0, len(members), step):
                group = members[a : a + step]
                ids, n = self.segment(data, start[group], size[group], length)
                counts[group] = n
                found.append((group, ids))
        flat = np.zeros(int(counts.sum()), np.int32)
        at = np.cumsum(counts) - counts
        for group, ids in found:
            flat[wb.spread(at[group], counts[group])] = ids
        return flat, counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the number of ids of each; null and empty texts have none."""
        data, offsets = _marked(texts)
        return self.encode_all(data, *_runs(data, offsets), len(texts))

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes and offsets of the texts with these ids: the inverse of ``encode``."""
        size = np.diff(self.surface_at)[ids]
        data = self.surface[wb.spread(self.surface_at[ids], size)]
        ends = np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(counts)]]
        mark = np.flatnonzero((data[:-2] == MARK[0]) & (data[1:-1] == MARK[1]) & (data[2:] == MARK[2])) if len(data) > 2 else np.zeros(0, np.int64)
        keep = np.ones(len(data), bool)
        keep[mark + 1] = keep[mark + 2] = False
        data = data.copy()
        data[mark] = 0x20
        keep[ends[:-1][np.diff(ends) > 0]] = False  # the dummy prefix
        kept = np.r_[0, np.cumsum(keep)]
        return data[keep], kept[ends]


def _unmarked(piece: bytes) -> bytes:
    while piece.startswith(MARK):
        piece = piece[len(MARK) :]
    return piece


def _fold(pair: np.ndarray) -> np.ndarray:
    return (wb.mix(pair.view(np.uint64)) >> np.uint64(44)).view(np.int64)


def _hash_all(raw: bytes) -> int:
    x = np.frombuffer(raw, np.uint8)
    return wb.span_hashes(x, np.zeros(1, np.int64), np.array([len(x)]), False)[0]


def _marked(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts with spaces as marks and a mark before each text that isn't empty."""
    raw, at = wb.text_buffers(texts)
    raw = raw[at[0] : at[-1]]
    at = at - at[0]
    room = np.where(raw == 0x20, 3, 1)
    full = np.diff(at) > 0
    lead = at[:-1][full]
    extra = np.zeros(len(raw) + 1, np.int64)
    extra[lead] = 3
    place = np.cumsum(room) - room + np.cumsum(extra)[: len(raw)]
    total = int(room.sum() + 3 * full.sum())
    data = np.zeros(total, np.uint8)
    data[place] = raw
    ends = np.r_[0, np.cumsum(room)][at] + 3 * np.r_[0, np.cumsum(full)]
    for where in (place[raw == 0x20], ends[:-1][full]):
        for k in range(3):
            data[where + k] = MARK[k]
    return data, ends


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the runs "marks, then other characters"."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    mark = np.zeros(n + 3, bool)
    at = np.flatnonzero((data[: n - 2] == MARK[0]) & (data[1 : n - 1] == MARK[1]) & (data[2:] == MARK[2]))
    mark[at] = True
    inside = mark.copy()
    inside[at + 1] = inside[at + 2] = True
    begin = np.zeros(n, bool)
    begin[at[(at == 0) | ~inside[np.maximum(at - 1, 0)]]] = True
    # line ends are in no piece with other characters: they end a run, so that runs stay short
    line = data == 0x0A
    begin |= line
    begin[1:] |= line[:-1]
    begin[offsets[:-1][np.diff(offsets) > 0]] = True
    start = np.flatnonzero(begin)
    return start, np.r_[start[1:], n], np.searchsorted(offsets, start, "right") - 1


@lru_cache(maxsize=2)
def piece_table(model_file: str) -> PieceTable:
    return PieceTable(model_file)


def _encoder(model_file: str, limit: int = 1 << 19):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(model_file)
        for batch in batches:
            for part in wb.slices(batch.column(1), limit):
                texts = batch.column(1).slice(part.first, part.last - part.first)
                ids, counts = table.encode(texts)
                data, ends = table.decode(ids, counts)
                back = pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, part.last - part.first), wb.list_array(ids.astype(np.int32), counts), back], ["doc_id", "ids", "decoded"])

    return run


def encode_pieces(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, ids (array<int>) and decoded (the text made from the ids) for every row of ``docs`` (doc_id, text).

    The ids are those of the library for the same model, but that special and
    user-defined symbols are plain text. Characters outside the
    pieces become byte pieces, so that ids decode to the exact text. Null and
    empty texts give no ids and an empty text; a text of U+2581 marks decodes to
    spaces, as in the library. Other columns are ignored, repeated rows are
    kept, and an empty table gives an empty result. ``model_file`` must lie at
    the same path on every executor.
    """
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), _encoder(model_file), "doc_id long, ids array<int>, decoded string")
