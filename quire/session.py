"""What a session needs before the engine's Python functions can run on executors."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Puts the package's folder on the Python path of workers that start from now on. Where executors can't see that folder, submit it with --py-files."""
    top, held = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = held.get("PYTHONPATH", "").split(os.pathsep)
    if top not in paths:
        held["PYTHONPATH"] = os.pathsep.join(filter(None, [top, *paths]))
    return spark


#: Bytes of an Arrow batch that goes to a Python function of texts.
BATCH = "2m"


def bounded(spark: SparkSession) -> SparkSession:
    """Batches of BATCH bytes at most, unless the session says otherwise: 10,000 rows, Spark's own measure, may be any number of bytes, and a worker
    holds a batch's texts, what is made of them and both as Arrow at once."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    return spark


def settled(df: DataFrame) -> DataFrame:
    """df, worked out once and kept in spark.checkpoint.dir. In local mode a folder of this machine will do where none is set; a cluster has to name one."""
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and context.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(found or "file://" + os.path.join(tempfile.gettempdir(), "quire-checkpoints"))
    return df.checkpoint()
