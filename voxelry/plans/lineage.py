"""Cutting lineage between the rounds of a loop."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written to the shared folder of ``spark.checkpoint.dir``.

    Where no folder is set and Spark runs in one process (tests), a temporary one is used;
    on a cluster it must be set, as executors don't see each other's disks.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or f"file://{tempfile.mkdtemp(prefix='voxelry-')}")
    return df.checkpoint()
