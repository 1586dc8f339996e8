"""Language-model scores: a log-bilinear model trained with noise-contrastive estimation, and an add-one unigram base.

The model's units are the frequent words, the end, and tail units: every other
word belongs to the tail unit of its last bytes, which it shares by add-one
smoothed counts. Units form classes of equal size, and a unit's probability is
that of its class times that inside its class, each a softmax over whole rows
of a matrix product. So the probabilities of all words after a context sum to
one, without a sum over all units.

Word counts, tail counts and training cover every training token. Rows are dealt
over shards by hash of their doc_id and text; the number of shards follows the
training tokens alone. Each round of training, a copy of the model is trained on
each shard's rows of the round, in the order of their hash, every row in one
round; the changes are averaged, row by row, by how often a shard met the row.
So the model depends on the rows, not on the files and tasks that hold them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm import wordbytes as wb
from weekloom.llm.tables import arrow_map, crc_remainder, discard, materialize

#: Bounds of the model's size: words that are units of their own, tail units, and words whose counts every task holds.
UNIT_WORDS = 8_192
TAIL_UNITS = 1_000
HELD_WORDS = 65_536
#: Words before a token that the model sees.
PLACES = 3
#: Rows are dealt over rounds by these shares of eight.
ROUNDS = (1, 2, 5)
#: There are (training tokens / SHARD_TOKENS) ** SHARD_POWER shards, at least one: shards grow with the corpus, and so does their number.
SHARD_TOKENS, SHARD_POWER = 2_000_000, 0.75
#: Rows of the model in one message of a shard.
_BLOCK = 256


class Vocabulary(NamedTuple):
    """What the scores need of the training tokens; unit words are sorted by hash, held words too."""

    tokens: int
    types: int
    ends: int
    held: np.ndarray
    held_count: np.ndarray
    word: np.ndarray
    word_unit: np.ndarray
    #: log10 of tokens + types + 1 of each tail unit.
    tail_log: np.ndarray
    #: Training tokens of each unit: words by falling frequency, tails, the end.
    unit_tokens: np.ndarray

    @property
    def units(self) -> int:
        return len(self.unit_tokens)

    @property
    def words(self) -> int:
        return len(self.word)


class LogBilinear(NamedTuple):
    """Rows (vector, bias) of contexts, units and classes, the matrix of the places before, and the units of each class."""

    context: np.ndarray
    unit: np.ndarray
    group: np.ndarray
    places: np.ndarray
    #: Class of each unit, and each class's units (padded with the number of units).
    class_of: np.ndarray
    members: np.ndarray

    def log_probabilities(self, before: np.ndarray, units: np.ndarray, block: int = 1 << 15) -> np.ndarray:
        """log10 of the probability of each unit after the units ``before`` it (nearest first), by matrix products for each class."""
        out = np.zeros(len(units))
        padded = np.vstack([self.unit, np.r_[np.zeros(self.unit.shape[1] - 1), -1e30].astype(np.float32)])
        vectors, places = (np.ascontiguousarray(x[:, :-1]) for x in (self.context, self.places))
        group = np.ascontiguousarray(self.group.T)
        for low in range(0, len(units), block):
            mine = units[low : low + block]
            # A last column of ones meets the biases.
            guess = np.ones((len(mine), self.unit.shape[1]), self.unit.dtype)
            guess[:, :-1] = vectors.take(before[low : low + block], axis=0).reshape(len(mine), -1) @ places
            kind = self.class_of[mine].astype(np.uint16)  # which numpy sorts by radix
            total = np.empty(len(mine))
            for a in range(0, len(mine), 1024):  # as many as a core's cache holds
                here = slice(a, a + 1024)
                score = guess[here] @ group
                total[here] = score[np.arange(len(score)), kind[here]]
                total[here] -= _log_sum(score)
            order = np.argsort(kind, kind="stable")
            edge = np.searchsorted(kind[order], np.arange(len(self.group) + 1))
            for c in np.flatnonzero(np.diff(edge)):
                at = order[edge[c] : edge[c + 1]]
                score = guess.take(at, axis=0) @ padded[self.members[c]].T
                place = np.searchsorted(self.members[c], mine[at])
                total[at] += score[np.arange(len(at)), place]
                total[at] -= _log_sum(score)
            out[low : low + block] = total / np.log(10)
        return out


def _log_sum(score: np.ndarray) -> np.ndarray:
    """Logs of the sums of exponentials of rows; overwrites the scores. Only rows that might leave the range of floats are shifted by their largest score."""
    some = score[:, :8].max(axis=1)
    if score.max() < 60 and some.min() > -60:
        np.exp(score, out=score)
        return np.log(score @ np.ones(score.shape[1], score.dtype))
    top = score.max(axis=1)
    top[(top < 60) & (some > -60)] = 0
    score -= top[:, None]
    np.exp(score, out=score)
    return np.log(score @ np.ones(score.shape[1], score.dtype)) + top


def _tails(part: wb.Slice, w: wb.Words) -> np.ndarray:
    """A number under ``TAIL_UNITS`` for each word, the same for equal last three bytes, lower-cased."""
    out = np.zeros(len(w.end), np.int64)
    for k in range(1, 4):
        at = w.end - k
        byte = part.data[np.maximum(at, 0)].astype(np.int64)
        byte += 32 * ((byte >= ord("A")) & (byte <= ord("Z")))
        out = out << 8 | np.where(at >= w.start, byte, 0)
    return (wb.mix(out.astype(np.uint64)) % np.uint64(TAIL_UNITS)).astype(np.int64)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in wb.slices(batch.column(0), 1 << 20):
            w = wb.words(part)
            key, at, n = np.unique(w.hash, return_index=True, return_counts=True)
            if len(key):
                yield pa.RecordBatch.from_arrays([pa.array(wb.signed(key)), pa.array(_tails(part, w)[at]), pa.array(n)], ["word", "tail", "n"])


def count_words(train: DataFrame) -> tuple[DataFrame, Vocabulary]:
    """(word, n) of all words of ``train`` (text), words as 64-bit hashes, and the vocabulary; null is an empty text.

    The number of units grows with the distinct words up to ``UNIT_WORDS`` and
    ``TAIL_UNITS``; what lies beyond is told apart by its counts, exactly.
    """
    table = arrow_map(train.select("text"), _word_counts, "word long, tail long, n long").groupBy("word").agg(F.sum("n").alias("n"), F.min("tail").alias("tail"))
    table = materialize(table, "word_counts")
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("types")).first()
    ends = train.count()
    # A histogram of a few hundred steps finds the count from which on at most HELD_WORDS words lie.
    step = F.floor(F.log2("n") * 8).cast("int")
    steps = {r["step"]: r["words"] for r in table.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()}
    held, low = 0, max(steps, default=0) + 1
    for s in sorted(steps, reverse=True):
        if held + steps[s] > HELD_WORDS:
            break
        held, low = held + steps[s], s
    top = table.where(step >= low).toArrow()
    word, n, tail = (top[c].to_numpy() for c in ("word", "n", "tail"))
    first = np.lexsort((word, -n))[:UNIT_WORDS]
    n_tails = max(1, min(TAIL_UNITS, total["types"] // 64))
    tail_tokens, tail_types = np.zeros(n_tails, np.int64), np.zeros(n_tails, np.int64)
    for r in table.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect():
        tail_tokens[r["tail"] % n_tails] += r["n"]
        tail_types[r["tail"] % n_tails] += r["types"]
    tail_tokens -= np.bincount(tail[first] % n_tails, weights=n[first], minlength=n_tails).astype(np.int64)
    tail_types -= np.bincount(tail[first] % n_tails, minlength=n_tails)
    by_word, by_first = np.argsort(word), np.argsort(word[first])
    return table, Vocabulary(total["n"] + ends, total["types"] + (ends > 0), ends, word[by_word], n[by_word], word[first][by_first], by_first, np.log10(tail_tokens + tail_types + 1.0), np.r_[n[first], tail_tokens, ends].astype(np.float64))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted key in sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return place, keys[place] == wanted


def _sums(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    # bincount of nothing gives whole numbers even with weights
    return np.bincount(row, weights=value, minlength=rows).astype(np.float64)


ENCODED = "doc_id long, held_out boolean, row long, key long, n_tokens long, n_known long, held_log double, other_log double, tail_log double, units binary, rest array<long>, rest_n array<int>"


def _encoder(v: Vocabulary):
    """Sums over the words that a task knows, the units of each row, and the words that must meet their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_log = np.log10(v.held_count + 1.0)
        n_tails = len(v.tail_log)
        for batch in batches:
            for part in wb.slices(batch.column(1)):
                rows = part.last - part.first
                w = wb.words(part)
                h = wb.signed(w.hash)
                place, is_word = _find(v.word, h)
                tail = _tails(part, w) % n_tails
                unit = np.where(is_word, v.word_unit[place] if v.words else 0, v.words + tail)
                size = np.bincount(w.doc, minlength=rows)
                last = np.cumsum(size + 1) - 1
                tokens = np.full(len(h) + rows, v.units - 1, np.uint16)
                inner = np.ones(len(tokens), bool)
                inner[last] = False
                tokens[inner] = unit
                place, known = _find(v.held, h)
                logs = held_log[place[known]]
                other = known & ~is_word
                rest_doc, rest = w.doc[~known], h[~known]
                order = np.lexsort((rest, rest_doc))
                rest_doc, rest = rest_doc[order], rest[order]
                first = np.flatnonzero(np.r_[True, (rest[1:] != rest[:-1]) | (rest_doc[1:] != rest_doc[:-1])]) if len(rest) else np.zeros(0, np.int64)
                n_rest = np.bincount(rest_doc[first], minlength=rows)
                ends = np.zeros(rows + 1, np.int32)
                ends[1:] = 2 * (last + 1)
                units = pa.BinaryArray.from_buffers(pa.binary(), rows, [None, pa.py_buffer(ends), pa.py_buffer(tokens)])
                sums = [_sums(w.doc[known], logs, rows), _sums(w.doc[other], held_log[place[other]], rows), _sums(w.doc[~is_word], v.tail_log[tail[~is_word]], rows)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k).slice(part.first, rows) for k in (0, 2, 3, 4)] + [pa.array(size + 1), pa.array(np.bincount(w.doc[known], minlength=rows)), *map(pa.array, sums), units, wb.list_array(rest[first], n_rest), wb.list_array(np.diff(np.r_[first, len(rest)]).astype(np.int32), n_rest)],
                    ["doc_id", "held_out", "row", "key", "n_tokens", "n_known", "held_log", "other_log", "tail_log", "units", "rest", "rest_n"],
                )

    return run


def _with_places(column: pa.Array, units: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens of rows, the ``PLACES`` units before each (nearest first; ``units`` is the start), and their rows."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] // 2
    tokens = np.frombuffer(data, np.uint16)[at[0] : at[-1]]
    sizes, first = np.diff(at), at[:-1] - at[0]
    row = np.repeat(np.arange(len(sizes)), sizes)
    before = np.full((len(tokens), PLACES), units, np.uint16)
    for k in range(PLACES):
        before[k + 1 :, k] = tokens[: -k - 1]
    for k in range(PLACES):  # the first tokens of a row have none before it; every row has an end
        early = (first + k)[sizes > k]
        before[early, k:] = units
    return tokens, before, row


def _portions(column: pa.Array, limit: int) -> Iterator[pa.Array]:
    """Runs of rows of about ``limit`` bytes; a longer row is a run of its own."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    first = 0
    while first < len(column):
        last = min(max(int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1, first + 1), len(column))
        yield column.slice(first, last - first)
        first = last


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.Array]]]:
    """(shard, its units) of batches (shard, units) that come sorted by shard."""

    def pieces() -> Iterator[tuple[int, pa.Array]]:
        for batch in batches:
            shard = batch.column(0).to_numpy()
            first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]][: len(shard)])
            for a, b in zip(first, np.r_[first[1:], len(shard)][: len(first)], strict=True):
                yield int(shard[a]), batch.column(1).slice(a, b - a)

    for shard, group in groupby(pieces(), key=lambda x: x[0]):
        yield shard, (units for _, units in group)


def _steady_portions(columns: Iterator[pa.Array], limit: int) -> Iterator[pa.Array]:
    """``_portions`` of the rows of all columns in order, wherever the columns begin and end."""
    waiting = None
    for column in columns:
        *whole, waiting = _portions(column if waiting is None else pa.concat_arrays([waiting, column]), limit)
        yield from whole
    if waiting is not None:
        yield waiting


class _Step:
    """Adaptive steps on rows of a table, each row with its own pace."""

    def __init__(self, table: np.ndarray, rate: float):
        self.table, self.rate = table, rate
        self.seen = np.ones(len(table), np.float32)
        self.met = np.zeros(len(table), np.float32)

    def rows(self, row: np.ndarray, grad: np.ndarray, weight: float = 1.0) -> None:
        """Add the gradients of rows that may repeat; without a column for the bias, it stays."""
        order = np.argsort(row, kind="stable")
        ordered = row[order]
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        at, total = ordered[first], np.add.reduceat(grad.take(order, axis=0), first, axis=0)
        self.seen[at] += np.einsum("rd,rd->r", total, total) / total.shape[1]
        total *= (self.rate / np.sqrt(self.seen[at]))[:, None]
        self.table[at, : total.shape[1]] += total
        self.met[at] += weight * np.diff(np.r_[first, len(row)])


def _trainer(model: LogBilinear, share: np.ndarray, with_classes: bool, *, noise: int, batch: int, rate: float, seed: int):
    """Train a copy of the model on each shard of a task's rows (shard, units); yields its changes in blocks of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, columns in _by_shard(batches):
            yield from trained_on(shard, columns)

    def trained_on(shard: int, columns: Iterator[pa.Array]) -> Iterator[pa.RecordBatch]:
        draw = np.random.default_rng((seed, shard))
        units = len(share)
        local = LogBilinear(*(p.copy() for p in model[:4]), *model[4:])
        steps = [_Step(p, rate) for p in local[:4]]
        group_share = np.bincount(local.class_of, weights=share, minlength=len(local.group))
        log_share, log_group = (np.log(p).astype(np.float32) for p in (share, group_share))
        stairs = np.cumsum(group_share)
        dims = local.unit.shape[1] - 1

        def errors(step: _Step, log_share: np.ndarray, guess: np.ndarray, true: np.ndarray, false: np.ndarray) -> np.ndarray:
            """One contrastive step of groups (group, token) against each group's noise; returns the guesses' gradient."""
            up, down = (step.table.take(x, axis=0) for x in (true, false))
            np.negative(down, out=down)
            log_noise = log_share + np.float32(np.log(false.shape[1]))
            with np.errstate(over="ignore"):  # the inverse of infinity is the zero it should be
                good = np.einsum("gbd,gbd->gb", guess, up[..., :-1]) + up[..., -1] - log_noise[true]
                good = 1 / (1 + np.exp(good))
                bad = guess @ down[..., :-1].transpose(0, 2, 1)
                bad += (down[..., -1] + log_noise[false])[:, None, :]
                np.exp(bad, out=bad)
                bad += 1
                np.divide(-1, bad, out=bad)
            d_guess = good[..., None] * up[..., :-1] - bad @ down[..., :-1]
            d_up, d_down = np.empty_like(up), np.empty_like(down)
            np.multiply(good[..., None], guess, out=d_up[..., :-1])
            d_up[..., -1] = good
            d_down[..., :-1] = bad.transpose(0, 2, 1) @ guess
            bad.sum(axis=1, out=d_down[..., -1])
            if false.shape == true.shape:  # the noise is the tokens themselves, rolled: their gradients meet before the sort
                d_up += np.roll(d_down, (-1, -1), (0, 1))
                step.rows(true.ravel(), d_up.reshape(-1, dims + 1))
            else:
                step.rows(np.r_[true.ravel(), false.ravel()], np.vstack([d_up.reshape(-1, dims + 1), d_down.reshape(-1, dims + 1)]))
            return d_guess

        trained = False
        for portion in _steady_portions(columns, 1 << 19):
            tokens, before, _ = _with_places(portion, units)
            order = draw.permutation(len(tokens))
            for low in range(0, len(tokens), batch):
                at = order[low : low + batch]
                true, near = tokens[at], before.take(at, axis=0)
                seen = local.context.take(near, axis=0)[..., :-1].reshape(len(at), -1)
                guess = seen @ local.places[:, :-1]
                d_guess = np.zeros_like(guess)
                whole = len(at) // noise * noise
                for part, shape in ((slice(0, whole), (-1, noise)), (slice(whole, len(at)), (1, -1))):
                    if len(true[part]):
                        mine = true[part].reshape(shape)
                        # the tokens of the next group are the noise: draws by their frequency
                        d_guess[part] = errors(steps[1], log_share, guess[part].reshape(*mine.shape, dims), mine, np.roll(mine, (1, 1), (0, 1))).reshape(-1, dims)
                if with_classes:
                    false = np.minimum(np.searchsorted(stairs, draw.random(noise) * stairs[-1]), len(stairs) - 1).astype(np.uint16)
                    d_guess += errors(steps[2], log_group, guess[None], local.class_of[true].astype(np.uint16)[None], false[None])[0]
                d_seen = (d_guess @ local.places[:, :-1].T).reshape(-1, dims)
                steps[0].rows(near.ravel(), d_seen)
                steps[3].rows(np.arange(len(local.places)), seen.T @ d_guess, len(at))
                trained = trained or len(at) > 0
        if trained:
            change = np.vstack([new - old for new, old in zip(local[:4], model[:4], strict=True)])
            met = np.concatenate([s.met for s in steps]) + np.float32(1e-3)
            for k in range(0, len(change), _BLOCK):
                yield _message(k // _BLOCK, shard, change[k : k + _BLOCK] * met[k : k + _BLOCK, None], met[k : k + _BLOCK])

    return run


_MESSAGE = "block int, shard int, change binary, met binary"


def _message(block: int, shard: int, change: np.ndarray, met: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([shard], pa.int32()), pa.array([change.astype(np.float32).tobytes()], pa.binary()), pa.array([met.astype(np.float32).tobytes()], pa.binary())], ["block", "shard", "change", "met"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of messages that come sorted by block and shard, one block at a time."""
    block, change, met = None, np.zeros(0, np.float32), np.zeros(0, np.float32)
    for batch in batches:
        for b, _, c, m in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if b != block:
                if block is not None:
                    yield _message(block, 0, change, met)
                block, change, met = b, np.frombuffer(c, np.float32).copy(), np.frombuffer(m, np.float32).copy()
            else:
                change += np.frombuffer(c, np.float32)
                met += np.frombuffer(m, np.float32)
    if block is not None:
        yield _message(block, 0, change, met)


def _classes(unit: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of equal size: units are halved again and again along the main direction of their vectors.

    Returns each unit's class, each class's units in order, and class rows: at a
    guess of zero a class's score and slope are those of the log-sum of its units.
    """
    depth = max(0, round(np.log2(max(len(unit), 1)) / 2))
    parts = [np.arange(len(unit))]
    for _ in range(depth):
        halves = []
        for at in parts:
            centred = unit[at, :-1] - unit[at, :-1].mean(axis=0)
            axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
            order = at[np.argsort(centred @ axis, kind="stable")]
            halves += [order[: len(at) // 2], order[len(at) // 2 :]]
        parts = halves
    members = np.full((len(parts), max(map(len, parts))), len(unit))
    class_of = np.zeros(len(unit), np.int64)
    group = np.zeros((len(parts), unit.shape[1]), np.float32)
    for c, at in enumerate(parts):
        members[c, : len(at)] = np.sort(at)
        class_of[at] = c
        weight = share[at] / share[at].sum()
        group[c, :-1] = weight @ unit[at, :-1]
        group[c, -1] = np.log(share[at].sum())
    return class_of, members, group


def train_model(rows: DataFrame, v: Vocabulary, *, size: int = 16, noise: int = 64, batch: int = 2048, rate: float = 0.2, passes: int = 1, seed: int = 5) -> LogBilinear:
    """Fit the log-bilinear model to ``rows`` (key, units) with noise-contrastive estimation.

    Every row is trained on once in each pass. Messages of the shards have the
    model's size, which is bounded; they are summed in Spark by blocks of rows.
    """
    share = v.unit_tokens + 1.0
    share = share / share.sum()
    draw = np.random.default_rng(seed)
    n = v.units

    def table(vectors: np.ndarray, bias: np.ndarray) -> np.ndarray:
        return np.c_[vectors, bias].astype(np.float32)

    unit = table(draw.normal(0, 0.1, (n, size)), np.log(share))
    places = np.vstack([np.eye(size) * 0.5] * PLACES)
    class_of, members, group = _classes(unit, share)
    model = LogBilinear(table(draw.normal(0, 0.1, (n + 1, size)), np.zeros(n + 1)), unit, group, table(places, np.zeros(len(places))), class_of, members)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, int(np.ceil((v.tokens / SHARD_TOKENS) ** SHARD_POWER)))
    turn = F.pmod(F.xxhash64("key"), F.lit(sum(ROUNDS)))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(shards)).cast("int"))
    for k in range(passes * len(ROUNDS)):
        low = sum(ROUNDS[: k % len(ROUNDS)])
        if k == 1:  # the vectors of the first round tell which units go together
            class_of, members, group = _classes(model.unit, share)
            model = model._replace(class_of=class_of, members=members, group=group)
        mine = dealt.where((turn >= low) & (turn < low + ROUNDS[k % len(ROUNDS)])).repartition(4 * shards, "shard").sortWithinPartitions("shard", "key").select("shard", "units")
        messages = arrow_map(mine, _trainer(model, share, k > 0, noise=noise, batch=batch, rate=rate / (1 + k), seed=seed + k), _MESSAGE)
        total = arrow_map(messages.repartition(tasks, "block").sortWithinPartitions("block", "shard"), _summed, _MESSAGE).collect()
        flat = np.vstack(model[:4])
        for r in total:
            met = np.frombuffer(r["met"], np.float32)
            flat[r["block"] * _BLOCK : r["block"] * _BLOCK + len(met)] += np.frombuffer(r["change"], np.float32).reshape(len(met), -1) / met[:, None]
        parts = np.split(flat, np.cumsum([len(p) for p in model[:3]]))
        model = LogBilinear(*parts, *model[4:])
    return model


def _scorer(model: LogBilinear, units: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for portion in _portions(batch.column(1), 1 << 19):
                tokens, before, row = _with_places(portion, units)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(portion)), pa.array(_sums(row, model.log_probabilities(before, tokens), len(portion)))], ["row", "model_log"])
                first += len(portion)

    return run


def lm_scores(docs: DataFrame, *, held_out_of: int = 7, held_out_is: int = 2, **training) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of ``docs`` (doc_id, text).

    Tokens are the words, lower-cased in A-Z, and one end for each text; null
    is an empty text. Rows whose crc32(doc_id as text) modulo ``held_out_of`` is
    ``held_out_is`` are held out; all others, null ids among them, are learned
    from. n_known counts tokens seen in training. base_score sums
    log10((c + 1) / (N + V + 1)); score is the model's log10 probability of the
    text. The counts of the words most often seen, at most ``HELD_WORDS``, are
    held by every task; all other words meet their counts by shuffle. Other
    columns are ignored, repeated rows are scored each, and an empty table gives
    an empty result. With nothing to learn from, all words are unknown.
    ``training`` goes to ``train_model``.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held_out = F.coalesce(crc_remainder("doc_id", held_out_of) == held_out_is, F.lit(False))
    table, v = count_words(source.where(~held_out))
    numbered = source.select("doc_id", "text", held_out.alias("held_out"), F.monotonically_increasing_id().alias("row"), F.xxhash64("doc_id", "text").alias("key"))
    encoded = materialize(arrow_map(numbered, _encoder(v), ENCODED), "encoded")
    model = train_model(encoded.where("not held_out").select("key", "units"), v, **training)
    rest = encoded.select("row", F.explode(F.arrays_zip("rest", "rest_n")).alias("x")).select("row", F.col("x.rest").alias("word"), F.col("x.rest_n").alias("times"))
    seen = rest.join(table, "word").groupBy("row").agg(F.sum("times").alias("rest_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rest_log"))
    modelled = arrow_map(encoded.select("row", "units"), _scorer(model, v.units), "row long, model_log double")
    out = encoded.drop("key", "units", "rest", "rest_n").join(modelled, "row").join(seen, "row", "left").fillna(0, ["rest_known", "rest_log"])
    n_end = F.lit(1 if v.ends else 0)
    base = F.col("held_log") + F.col("rest_log") + float(np.log10(v.ends + 1)) - F.col("n_tokens") * float(np.log10(v.tokens + v.types + 1))
    # A tail unit's probability is split by add-one smoothed counts of its words.
    score = F.col("model_log") + F.col("other_log") + F.col("rest_log") - F.col("tail_log")
    out = out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("rest_known") + n_end).cast("long").alias("n_known"), F.lit(int(v.tokens)).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))
    return discard(materialize(out, "scores"), encoded, table)
