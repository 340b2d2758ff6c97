"""Cutting lineage where a loop or a numbering needs it, and joins that stay off the driver."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's folder below spark.checkpoint.dir, which all executors share. Where that is unset, a temporary folder will
    do on one machine; on a cluster it is an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession) -> str:
    """A folder of its own below the shared one, for files that one plan writes and another reads."""
    return f"{shared_folder(spark)}/files-{uuid.uuid4()}"


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def sorted_side(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input. Spark takes a few columns of a file, exploded or in a loop, for smaller than they are and
    would broadcast them through the driver; the join is a sort-merge join instead, whose hot keys AQE can split."""
    return df.hint("merge")
