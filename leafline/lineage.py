"""Cutting the lineage of iterative plans in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to ``spark.checkpoint.dir`` and read back.

    Where the setting is missing, a temporary folder takes its place if driver
    and executors are one process; on a cluster that is an error.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="leafline-"))
    return df.checkpoint(eager=True)
