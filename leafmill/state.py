"""Cutting lineage: a checkpoint in the folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame


def materialized(df: DataFrame) -> DataFrame:
    """`df`, computed once and written to spark.checkpoint.dir, so that later stages survive lost executors.

    The folder must be one that all executors share. A session that names none is refused, unless it runs in one process
    (tests, a laptop), where a temporary one does. Spark removes the files of what is no longer referred to if
    spark.cleaner.referenceTracking.cleanCheckpoints is set, which belongs where the session is made.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not folder:
            import tempfile

            folder = tempfile.mkdtemp()
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
