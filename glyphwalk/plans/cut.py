"""Lineage cuts: write a DataFrame to the folder that the whole cluster shares and read it back.

Iterative and multi-pass operators need a stable intermediate result. A Parquet table in
``spark.checkpoint.dir`` survives lost executors, is columnar, and gives the optimizer a size.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a temporary folder if driver and executors are one machine, else an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isDefined():
            return jsc.getCheckpointDir().get()
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="glyphwalk-"))
        found = jsc.getCheckpointDir().get()
    return found


#: Folders of the cuts that were not removed yet.
_MADE: set[str] = set()
_COLLECTING: list[list[str]] = []


@contextmanager
def collecting(paths: list[str]) -> Iterator[None]:
    """Notes the folders of all cuts made meanwhile, for ``remove`` once no plan reads them."""
    _COLLECTING.append(paths)
    try:
        yield
    finally:
        _COLLECTING.remove(paths)


def remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        _MADE.discard(path)


def release(spark: SparkSession) -> None:
    """Removes all cuts of this process. For when no result is read any more: results of queries are plans over cuts."""
    remove(spark, sorted(_MADE))


@atexit.register
def _at_exit() -> None:
    with suppress(Exception):  # the session may be gone
        spark = SparkSession.getActiveSession()
        if spark and _MADE:
            release(spark)


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; ``release`` removes what is there."""
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    for paths in _COLLECTING:
        paths.append(path)
    _MADE.add(path)
    return path


def cut(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder; returns a scan of what was written."""
    spark = df.sparkSession
    path = scratch(spark)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._cut_path = path
    return back


def drop_cut(df: DataFrame) -> None:
    """Removes the files of a cut that no later plan reads."""
    path = getattr(df, "_cut_path", None)
    if path:
        remove(df.sparkSession, [path])
