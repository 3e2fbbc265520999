"""Tables in the folder that the whole cluster shares: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from plumbline.errors import EngineError

_written: dict[str, SparkSession] = {}
_local: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster names in ``spark.checkpoint.dir``.

    Where the session names none, a master within this process gets a temporary folder of its own; a cluster is told to name one,
    as its executors would not see a folder of the driver.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise EngineError("shared_folder", f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="plumbline-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        top = f"file://{_local[0]}"
    return f"{top.rstrip('/')}/{re.sub(r'[^\w.-]', '_', name)}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The frame written as a table in the shared folder and read again; ``by`` is a column by whose values the files are parted.

    The table goes with ``discard``, or when the application ends. The shuffles behind it are garbage once it is written; the driver's
    JVM is asked to collect it, upon which Spark's cleaner deletes their files on the executors.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    if not _written:
        atexit.register(_clear)
    _written[path] = spark
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes the tables behind frames that ``stored`` has made, once nothing reads them any more."""
    for frame in frames:
        if (path := getattr(frame, "stored_at", None)) in _written:
            _delete(_written.pop(path), path)


def discard_part(frame: DataFrame, part: str) -> None:
    """Deletes the files of one value (as ``kind=1``) of a table that ``stored`` has parted, once nothing reads them any more."""
    if (path := getattr(frame, "stored_at", None)) in _written:
        _delete(_written[path], f"{path}/{part}")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clear() -> None:
    for path, spark in list(_written.items()):
        with contextlib.suppress(Exception):  # the session may have gone before
            _delete(spark, path)
