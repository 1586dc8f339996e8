"""CSV members of zip archives, read and written in tasks."""

from __future__ import annotations

import codecs
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import csv, fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a member that are decoded at once.
PIECE = 1 << 20


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith(("/", "file:")):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _encoding_of(archive: zipfile.ZipFile, name: str, encodings: list[str]) -> str:
    """The first encoding that a whole member has, strictly; checked piece by piece."""
    for encoding in encodings:
        decoder = codecs.getincrementaldecoder(encoding)()
        try:
            with archive.open(name) as member:
                while piece := member.read(PIECE):
                    decoder.decode(piece)
            decoder.decode(b"", final=True)
            return encoding
        except UnicodeDecodeError:
            continue
    raise ValueError(f"none of {', '.join(encodings)}")


def _member_rows(archive: zipfile.ZipFile, name: str, encoding: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The chosen columns of a member as text, in batches."""
    text = {x: pa.string() for x in columns}
    with archive.open(name) as member:
        reader = csv.open_csv(
            member, csv.ReadOptions(block_size=PIECE, encoding=encoding), csv.ParseOptions(newlines_in_values=True),
            csv.ConvertOptions(include_columns=columns, column_types=text, strings_can_be_null=True, quoted_strings_can_be_null=False, null_values=[""]),
        )
        yield from reader


def read_zipped_csv(spark: SparkSession, paths: str | list[str], schema: str | T.StructType, *, encodings: tuple[str, ...] = ("cp949", "utf-8"), suffix: str = ".csv", source: str | None = None) -> DataFrame:
    """The columns of ``schema`` from all CSV members (with a header) of the zip archives under ``paths``.

    Spark lists the archives without reading them and deals them over tasks; a
    task streams each member, so neither an archive nor a member is held whole.
    A member has the first of ``encodings`` in which all its bytes are valid. An
    empty unquoted field, and a value that isn't of its column's type, become
    null. Members without ``suffix`` are passed over. ``source`` names a column
    for "archive!member". An archive or member that can't be read, or lacks a
    column, is an error that names it. An archive is read by one task.
    """
    wanted = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    columns, coders, ending = wanted.fieldNames(), list(encodings), suffix.lower()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                at = uri
                try:
                    system, path = _opened(uri)
                    with system.open_input_file(path) as stream, zipfile.ZipFile(stream) as archive:
                        for name in archive.namelist():
                            if name.lower().endswith(ending):
                                at = f"{uri}!{name}"
                                for rows in _member_rows(archive, name, _encoding_of(archive, name, coders), columns):
                                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([at] * rows.num_rows, pa.string())], [*columns, "_source"])
                except (OSError, ValueError, KeyError, EOFError, zipfile.BadZipFile, pa.ArrowException) as error:
                    raise ValueError(f"can't read {at}: {error}") from error

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path")
    files = files.repartition(max(1, min(files.count(), 10_000)), "path")
    kind = T.StructType([T.StructField(x, T.StringType()) for x in [*columns, "_source"]])
    rows = files.mapInArrow(run, kind)
    typed = [F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in wanted]
    return rows.select(*typed, *([F.col("_source").alias(source)] if source else []))


def write_zipped_csv(df: DataFrame, folder: str, *, encoding: str = "utf-8", member: str = "part.csv") -> list[str]:
    """Each partition of ``df`` as a zip archive with one CSV member; the archives' paths.

    A task writes a file of its own name, and only those of finished tasks are
    listed, so that a task can run again. An empty partition leaves no file.
    Characters that the encoding doesn't have are an error.
    """
    columns = df.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = (f for f in frames if len(f))
        head = next(frames, None)
        if head is None:
            return
        system, path = _opened(folder)
        system.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.zip"
        with system.open_output_stream(f"{path}/{name}", compression=None) as stream, zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED) as archive, archive.open(member, "w", force_zip64=True) as out:
            out.write(head.to_csv(index=False, columns=columns).encode(encoding))
            for frame in frames:
                out.write(frame.to_csv(index=False, header=False, columns=columns).encode(encoding))
        yield pd.DataFrame({"path": [f"{folder}/{name}"]})

    return [r[0] for r in df.mapInPandas(run, "path string").collect()]  # a row for each partition
