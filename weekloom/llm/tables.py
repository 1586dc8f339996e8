"""Where intermediate tables live: the shared folder that the session names."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a temporary folder of this process, on a local master only.

    On a cluster, executors don't share the driver's folders, so an unset setting is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="weekloom-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return "file://" + _own["dir"]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/weekloom-{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str, *, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder, in a folder for each value of ``by`` if given, and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, partitionBy=by)
    table = spark.read.schema(df.schema).parquet(path)
    table._weekloom_path = path
    return table


def discard(kept: DataFrame, *tables: DataFrame) -> DataFrame:
    """Delete tables of ``materialize`` after their last reader; returns ``kept``, which must not read them."""
    spark = kept.sparkSession
    for table in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(table._weekloom_path).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return kept


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def arrow_map(df: DataFrame, function, schema: str) -> DataFrame:
    """``df.mapInArrow`` for functions of this package, which executors need not have installed."""
    ship(df.sparkSession)

    def run(batches):
        try:
            yield from function(batches)
        finally:
            release_memory()

    return df.mapInArrow(run, schema)


def release_memory() -> None:
    """Give freed memory back to the system: Spark keeps Python workers for later tasks of any stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no such call outside glibc
        pass


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark application."""
    application = spark.sparkContext.applicationId
    if _own.get("shipped") == application:
        return
    root = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="weekloom-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = f"{folder}/weekloom_code.zip"
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(name)
    _own["shipped"] = application


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_remainder(column: str, n: int):
    """crc32 of the column's text form modulo n; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n
