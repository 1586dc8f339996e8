"""Token ids as binary files: one concatenated id array, document boundaries in Elias-Fano form."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm import files
from weekloom.llm import wordbytes as wb
from weekloom.llm.runs import RunEncoder
from weekloom.llm.tables import arrow_map, materialize, new_path

MAGIC = b"WLTOKEN1"
#: A select sample is kept for every this many values.
SAMPLE = 256


class EliasFano:
    """A sorted sequence of non-negative integers below ``universe``, 2**64 at most; ``select`` returns values by position.

    The low bits are packed; the high bits are a unary bit vector. Samples are
    32-bit positions in the high bits, one for ``SAMPLE`` values; a file holds fewer than 2**31 documents.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        n, values = len(values), values.astype(np.uint64)
        low_bits = max(0, int(max(universe, 1) // max(n, 1)).bit_length() - 1)
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        bits[at] = 1
        low = np.zeros(n * low_bits, np.uint8)
        for k in range(low_bits):
            low[k::low_bits] = (values >> np.uint64(k)) & np.uint64(1)
        return cls(n, low_bits, np.packbits(low, bitorder="little"), np.packbits(bits, bitorder="little"), at[::SAMPLE].astype(np.uint32))

    def select(self, first: int, last: int) -> np.ndarray:
        """Values at positions first .. last - 1, unsigned."""
        if last <= first:
            return np.zeros(0, np.uint64)
        base = first - first % SAMPLE
        begin = int(self.samples[base // SAMPLE])
        stop = int(self.samples[-(-last // SAMPLE)]) if -(-last // SAMPLE) < len(self.samples) else 8 * len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[begin >> 3 : (stop >> 3) + 1], bitorder="little")) + (begin & ~7)
        ones = ones[np.searchsorted(ones, begin) :]
        upper = ones[first - base : last - base] - np.arange(first, last)
        low = np.zeros(last - first, np.uint64)
        for k in range(self.low_bits):
            at = np.arange(first, last) * self.low_bits + k
            low |= ((self.low[at >> 3] >> (at & 7)) & 1).astype(np.uint64) << np.uint64(k)
        return upper.astype(np.uint64) << np.uint64(self.low_bits) | low

    def dump(self) -> bytes:
        return struct.pack("<QBQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)) + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def load(cls, raw: bytes) -> EliasFano:
        n, low_bits, a, b, c = struct.unpack_from("<QBQQQ", raw)
        at = struct.calcsize("<QBQQQ")
        return cls(n, low_bits, np.frombuffer(raw, np.uint8, a, at), np.frombuffer(raw, np.uint8, b, at + a), np.frombuffer(raw, "<u4", c, at + a + b))


class ByteBpe(RunEncoder):
    """Ids of the tokenizers library's byte-level BPE.

    Its splitting pattern starts a new token at every space before a visible
    character, so that the text's stretches between such spaces are encoded alone.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        super().__init__()
        if json.loads(open(vocabulary, encoding="utf-8").read())["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("a vocabulary with a prefix space is not one for runs")
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)

    def encode_runs(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        texts = [raw[a:b].decode("utf-8") for a, b in zip(start.tolist(), (start + size).tolist(), strict=True)]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in ids for i in x], np.int32), np.array([len(x) for x in ids], np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, at = wb.text_buffers(texts)
        data, at = data[at[0] : at[-1]], at - at[0]
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        begin = np.zeros(len(data), bool)
        begin[:-1] = (data[:-1] == 0x20) & _VISIBLE[data[1:]]
        begin[at[:-1][np.diff(at) > 0]] = True
        start = np.flatnonzero(begin)
        return self.encode_all(data, start, np.r_[start[1:], len(data)], np.searchsorted(at, start, "right") - 1, len(texts))


#: First bytes that are never those of a white-space character.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_VISIBLE[0xC3:0xE1] = True
_VISIBLE[0xE4:0xF5] = True


@lru_cache(maxsize=2)
def byte_bpe(vocabulary: str) -> ByteBpe:
    return ByteBpe(vocabulary)


def _writer(vocabulary: str, folder: str, end_id: int, limit: int = 4 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(vocabulary)
        width = np.dtype("<u2" if max(encoder.size, end_id + 1) <= 1 << 16 else "<u4")
        uri, out = None, None
        doc_ids, sizes = [], []
        for batch in batches:
            for part in wb.slices(batch.column(1), limit):
                if out is None:
                    uri, out = files.create(folder, "tokens.bin")
                    out.write(MAGIC)
                ids, counts = encoder.encode(batch.column(1).slice(part.first, part.last - part.first))
                ends = np.cumsum(counts + 1)
                whole = np.full(int(ends[-1]), end_id, width)
                whole[wb.spread(ends - counts - 1, counts)] = ids
                out.write(whole.tobytes())
                doc_ids.append(batch.column(0).slice(part.first, part.last - part.first))
                sizes.append(counts + 1)
        if out is None:
            return
        column = pa.concat_arrays(doc_ids)
        nulls = column.null_count
        known = column.drop_null().to_numpy().astype(np.int64)
        low = int(known[0]) if len(known) else 0
        size = np.concatenate(sizes)
        total = int(size.sum())
        bounds = EliasFano.build(np.r_[0, np.cumsum(size)], total + 1).dump()
        # Differences of signed ids as unsigned ones, which may take all 64 bits.
        names = EliasFano.build(known.view(np.uint64) - np.uint64(low % 2**64), int(known[-1]) - low + 1 if len(known) else 1).dump()
        out.write(bounds)
        out.write(names)
        head = {"ids": total, "docs": len(size), "bytes_per_id": width.itemsize, "null_ids": nulls, "first_id": low, "bounds": len(bounds), "names": len(names)}
        tail = json.dumps(head).encode()
        out.write(tail + struct.pack("<I", len(tail)) + MAGIC)
        out.close()
        yield pa.RecordBatch.from_pydict({"path": [uri], "first_doc": [None if nulls else low], "n_docs": [len(size)], "n_ids": [total]}, pa.schema([("path", pa.string()), ("first_doc", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return run


class TokenFile:
    """A file of token ids: ``offsets`` by select, ``ids`` by range read."""

    def __init__(self, uri: str):
        self.file = files.open_range(uri)
        size = self.file.size()
        (length,) = struct.unpack("<I", self.file.read_at(4, size - 12))
        self.head = json.loads(self.file.read_at(length, size - 12 - length))
        if self.file.read_at(8, size - 8) != MAGIC:
            raise ValueError(f"{uri} is no token file")
        self.width = np.dtype(f"<u{self.head['bytes_per_id']}")
        at = len(MAGIC) + self.head["ids"] * self.width.itemsize
        self.bounds = EliasFano.load(self.file.read_at(self.head["bounds"], at))
        self.names = EliasFano.load(self.file.read_at(self.head["names"], at + self.head["bounds"]))

    def doc_ids(self, first: int, last: int) -> list[int | None]:
        nulls = self.head["null_ids"]
        known = self.names.select(max(first - nulls, 0), max(last - nulls, 0)) + np.uint64(self.head["first_id"] % 2**64)
        return [None] * (last - first - len(known)) + known.view(np.int64).tolist()

    def offsets(self, first: int, last: int) -> np.ndarray:
        """Where documents first .. last - 1 start, and where the last of them ends."""
        return self.bounds.select(first, last + 1).view(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        raw = self.file.read_at((stop - start) * self.width.itemsize, len(MAGIC) + start * self.width.itemsize)
        return np.frombuffer(raw, self.width)


def write_tokens(docs: DataFrame, vocabulary: str, *, end_id: int = 2, folder: str | None = None, partitions: int | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into token files; returns their manifest: path, first_doc, n_docs, n_ids, base.

    Files hold the documents in ascending doc_id order (null ids first, equal
    ids by text), each text's ids and then ``end_id``. base is the number of ids
    in all files before. Null and empty texts are the end id alone. Other
    columns are ignored. An empty table writes no file. The only rows that
    reach the driver are one for each file.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = source.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    written = materialize(arrow_map(ordered, _writer(vocabulary, folder, end_id), "path string, first_doc long, n_docs long, n_ids long"), "manifest")
    rows, base = [], 0
    for r in sorted(written.collect(), key=lambda r: (r.first_doc is not None, r.first_doc or 0)):
        rows.append((r.path, r.first_doc, r.n_docs, r.n_ids, base))
        base += r.n_ids
    return spark.createDataFrame(rows, "path string, first_doc long, n_docs long, n_ids long, base long")


def read_tokens(manifest: DataFrame, *, docs_per_read: int = 2000) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the token files of ``manifest``.

    start counts the ids of all documents before; ids_crc32 is the unsigned
    crc32 of the document's ids as little-endian unsigned 32-bit integers. Null
    and empty texts have one id; a null doc_id stays null, repeated rows give
    repeated results, and an empty manifest gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, TokenFile] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["path"] not in opened:
                    opened = {r["path"]: TokenFile(r["path"])}
                tokens = opened[r["path"]]
                last = min(r["first"] + docs_per_read, r["n_docs"])
                at = tokens.offsets(r["first"], last)
                raw = tokens.ids(int(at[0]), int(at[-1])).astype("<u4").tobytes()
                edge = ((at - at[0]) * 4).tolist()
                crc = [zlib.crc32(memoryview(raw)[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(tokens.doc_ids(r["first"], last), pa.int64()), pa.array(at[:-1] + r["base"]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    pieces = manifest.select("path", "n_docs", "base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.lit(docs_per_read).cast("long"))).alias("first"))
    return arrow_map(pieces.repartition("path", "first"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")
