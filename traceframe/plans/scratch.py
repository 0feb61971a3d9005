"""Intermediate tables in the folder that driver and executors share.

A step whose result is read more than once is written as a Parquet table below
``spark.checkpoint.dir`` and read back.  That cuts lineage, survives the loss of
executors, and lets later scans prune columns.

All tables of one application lie below one folder, which is deleted when the driver
ends.  What is only needed for a table that has been written is deleted earlier, by
``with scratch_scope(spark): ...`` around the making of it.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}
_open = threading.local()


def scratch_root(spark: SparkSession) -> str:
    """This application's folder; a temporary one only where the session names none (local mode)."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _roots[app] = f"{shared.rstrip('/')}/traceframe-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="traceframe-")
        atexit.register(_at_exit, spark, _roots[app])
    return _roots[app]


def _at_exit(spark: SparkSession, path: str) -> None:
    """A session that was stopped before cannot delete anything any more, which is no reason to fail."""
    try:
        delete(spark, path)
    except Exception:  # noqa: BLE001
        return


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever store it lies."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the tables written inside when the block is left; nothing may read them afterwards."""
    outer, _open.paths = getattr(_open, "paths", None), []
    try:
        yield
    finally:
        inner, _open.paths = _open.paths, outer
        for path in inner:
            delete(spark, path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path that nothing else uses."""
    own = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    if getattr(_open, "paths", None) is not None:
        _open.paths.append(own)
    return f"{own}/{name}"


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder (to ``path``, if given) and return the written table."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
