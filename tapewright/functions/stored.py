"""Tables that are computed once and written to the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only where neither the context nor the session names one (a local test session) a temporary folder is made.
    """
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known:
        return known
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return context.getCheckpointDir()


def cut_table(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: computed once, with no lineage to redo, and read by
    column."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
