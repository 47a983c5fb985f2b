"""What every query needs of its session: worker code on the executors, and rows on all cores."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED = "gleanmill.library.shipped"


def ship(spark: SparkSession) -> None:
    """Once per application; nothing is done when this code already runs from an archive."""
    sc = spark.sparkContext
    if sc.getLocalProperty(_SHIPPED) == sc.applicationId:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(root):
        path = os.path.join(tempfile.mkdtemp(prefix="gleanmill-"), "gleanmill_library.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, files in os.walk(root):
                for name in (f for f in files if f.endswith(".py")):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
        sc.addPyFile(path)
    sc.setLocalProperty(_SHIPPED, sc.applicationId)


#: Tables up to this size are dealt out when they come in fewer files than there are cores.
SMALL_TABLE = 32 << 20


def dealt(df: DataFrame) -> DataFrame:
    """A small table of one or a few files would be scanned by as few tasks: its rows are dealt to all cores. Others stay."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > SMALL_TABLE or len(df.inputFiles()) * 2 > cores:
        return df  # the files of large tables are not listed here
    return df.repartition(cores)
