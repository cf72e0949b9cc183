"""Reliable checkpoints, and the package for executors that lack it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def _forget(context: SparkContext, folder: str) -> None:
    """Removes the checkpoints of this application."""
    try:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended: a local folder can still be removed
        shutil.rmtree(folder.removeprefix("file:"), ignore_errors=True)


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below the checkpoint folder; it is removed when the application ends.

    The checkpoint folder is the one that ``spark.checkpoint.dir`` names; only where neither that
    nor a checkpoint folder is set, as in local tests, is a temporary one made.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
        atexit.register(_forget, context, context._jsc.sc().getCheckpointDir().get())
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df written once, here and now, to the shared folder, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, for clusters on which it is not installed."""
    root = Path(__file__).resolve().parents[1]
    packed = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="package-")) / root.name), "zip", root.parent, root.name)
    spark.sparkContext.addPyFile(packed)
