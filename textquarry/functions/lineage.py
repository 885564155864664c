"""Cutting lineage: checkpoints in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written once and read from there on, with its partitions and their order as they are. Only a local session without
    spark.checkpoint.dir gets a temporary folder, deleted with the driver; a cluster without it is refused."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        path = sc.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            path = tempfile.mkdtemp(prefix="textquarry-checkpoint-")
            atexit.register(shutil.rmtree, path, True)
        sc.setCheckpointDir(path)
    return df.checkpoint()
