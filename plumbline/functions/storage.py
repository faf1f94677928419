"""Where lineage is cut: the reliable checkpoint folder of the session."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def _checkpoint_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return context.getCheckpointDir()
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder, so that a lost executor cannot
    cause them to be laid out differently on recomputation."""
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _session_folder(spark: SparkSession) -> str:
    """One folder for all that a session writes, so that it can be released at once."""
    return f"{_checkpoint_folder(spark)}/tables-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, ending: str) -> str:
    """A new path in the session's folder next to the checkpoints."""
    return f"{_session_folder(spark)}/table-{uuid4().hex}{ending}"


def release(spark: SparkSession) -> bool:
    """Remove the tables that this session has stored; results that still read them cannot be computed again. False if there were none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_session_folder(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """Write the rows as a Parquet table next to the checkpoints and read it back.

    Unlike a checkpoint the table stays columnar: later scans read only the
    columns they need.
    """
    path = scratch_path(df.sparkSession, ".parquet")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
