"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths written inside each open scope, the innermost last.
_SCOPES: list[list[tuple[SparkSession, str]]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir.

    Where it is unset a session on one machine gets a new temporary folder; on
    a cluster that is an error, as executors could not see each other's files.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _folder(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def reserved(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes with the open scope, or else when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    target, files = _folder(spark, path)
    files.deleteOnExit(target)
    if _SCOPES:
        _SCOPES[-1].append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df and reads it back: this cuts its lineage, and no lost executor takes its rows away."""
    path = reserved(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._tessera_path = path
    return back


def _delete(spark: SparkSession, path: str) -> None:
    target, files = _folder(spark, path)
    files.delete(target, True)


def forget(df: DataFrame) -> None:
    """Deletes what written() wrote, once nothing reads it any more."""
    path = getattr(df, "_tessera_path", None)
    if path:
        _delete(df.sparkSession, path)


@contextmanager
def scope(*kept: str) -> Iterator[list[str]]:
    """Tables written inside are deleted on leaving, but those whose paths are put into the list that it gives.

    DataFrames are lazy: what is made inside must have been written or counted
    before the scope ends.
    """
    keep = list(kept)
    _SCOPES.append([])
    try:
        yield keep
    finally:
        for spark, path in _SCOPES.pop():
            if path not in keep:
                _delete(spark, path)
            elif _SCOPES:
                _SCOPES[-1].append((spark, path))
