"""Cutting lineage through the shared folder of the cluster."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The folder in ``spark.checkpoint.dir`` holds; a temporary one serves only a local session without it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if shared is None:
            shared = tempfile.mkdtemp(prefix="folioscope-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        context.setCheckpointDir(shared)


def cut(frame: DataFrame) -> DataFrame:
    """``frame`` written once to the reliable checkpoint folder and read from there by every consumer."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


#: Estimated bytes of input for each core under which a frame is spread over all cores.
SMALL = 64 * 1024 * 1024


def spread(frame: DataFrame) -> DataFrame:
    """A small frame dealt over all cores, so that one file of one row group does not leave the work to one task.

    Larger inputs have splits enough and are left alone: a corpus is never shuffled for this.
    """
    context = frame.sparkSession.sparkContext
    size = int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return frame.repartition(2 * context.defaultParallelism) if size < SMALL * context.defaultParallelism else frame
