"""Makes this package importable in Python workers, wherever the driver was started."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession | None = None) -> None:
    """Adds the package to what workers import, once a session; without a session (a column that is only built) nothing happens."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or getattr(spark.sparkContext, "_dealgraph_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="dealgraph-"), "dealgraph_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("dealgraph", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    spark.sparkContext._dealgraph_shipped = True


def cut(df: DataFrame) -> DataFrame:
    """df computed once, its lineage cut in the session's checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="dealgraph-checkpoint-"))
    return df.checkpoint(eager=True)
