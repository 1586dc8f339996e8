"""Rows of Parquet files by place: which rows of a table go is kept as one bitmap for each 32,768 rows of a source file."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.llm import files
from weekloom.llm.tables import materialize, ship

#: Rows of one bitmap (the size of Spark's bitmaps) as a power of two, and folders that the bitmaps of all files are dealt over.
BITMAP_POWER, SLOTS = 15, 4_096


def places(docs: DataFrame) -> tuple[DataFrame, Column, Column]:
    """(docs, file, row): a table with the same rows, the hash of each row's source file, and its number there.

    A plain read of Parquet files is returned as it is. Anything else is
    written first, so that a row has one place, which every later scan repeats.
    """
    plain = docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    try:
        at = docs.metadataColumn("_metadata")
        docs.select(at["row_index"])
    except AnalysisException:  # no file, or not of Parquet
        plain = False
    if not plain:
        docs = materialize(docs, "placed")
        at = docs.metadataColumn("_metadata")
    return docs, F.xxhash64(at["file_path"]), at["row_index"]


def without(docs: DataFrame, file: Column, row: Column, gone: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, but those at the places (file, row) of ``gone``.

    ``docs``, ``file`` and ``row`` are those of ``places``. The places become
    bitmaps in the shared folder, and a task loads those of the files that it
    scans: no row moves, and nothing is sent to all tasks, whatever the share of
    rows that go. Places that repeat, or have a null, change nothing; with no
    places every row stays.
    """
    slot = F.pmod("file", F.lit(SLOTS)).cast("int").alias("slot")
    part = F.shiftright("row", BITMAP_POWER).alias("part")
    bits = F.bitmap_construct_agg(F.col("row").bitwiseAND((1 << BITMAP_POWER) - 1)).alias("bits")
    marks = gone.where("file is not null and row is not null").groupBy("file", part).agg(bits).select("file", "part", "bits", slot)
    folder = materialize(marks.repartition("slot").sortWithinPartitions("slot", "file", "part"), "marks", by="slot")._weekloom_path
    ship(docs.sparkSession)
    return docs.where(~F.arrow_udf(_is_gone(folder), "boolean")(file, row))


@lru_cache(maxsize=8)
def _bitmaps(folder: str, file: int) -> dict[int, np.ndarray]:
    """The bitmaps of one source file by part; a task's scan has few files, one after the other."""
    found = {}
    for uri in files.listed(f"{folder}/slot={file % SLOTS}"):
        with files.open_range(uri) as f:
            table = pq.read_table(f, columns=["part", "bits"], filters=[("file", "=", file)], partitioning=None)
        for part, bits in zip(table["part"].to_pylist(), table["bits"].to_pylist(), strict=True):
            found[part] = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool)
    return found


def _is_gone(folder: str):
    def run(file: pa.Array, row: pa.Array) -> pa.Array:
        of, at = file.to_numpy(zero_copy_only=False), row.to_numpy(zero_copy_only=False)
        gone = np.zeros(len(of), bool)
        for one in np.unique(of):
            marks = _bitmaps(folder, int(one))
            here = np.flatnonzero(of == one)
            part = at[here] >> BITMAP_POWER
            for k in np.unique(part):
                if int(k) in marks:
                    some = here[part == k]
                    gone[some] = marks[int(k)][at[some] & ((1 << BITMAP_POWER) - 1)]
        return pa.array(gone)

    run.__annotations__ = {"file": pa.Array, "row": pa.Array, "return": pa.Array}
    return run
