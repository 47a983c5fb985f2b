"""Session services shared by the operators: shipping code, cutting lineage, reading tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..shared import cut, drop, hits, shared_dir, shared_path
from ..shipping import dealt, ship

__all__ = ["batch_limits", "cut", "drop", "hits", "shared_dir", "shared_path", "ship", "table"]

#: Rows that reach a Python worker at once; operators slice further by bytes.
ARROW_ROWS = 2000
#: Rows that a Parquet reader holds at once: texts of some KB each must not need buffers of tens of MB.
READER_ROWS = 512


def batch_limits(spark: SparkSession) -> None:
    """Smaller Arrow and Parquet batches for this session: a batch of long texts must not fill a worker's or an executor's memory.

    The registered queries and the pipeline call this; operators leave their caller's session as it is.
    """
    for key, default, rows in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", ARROW_ROWS), ("spark.sql.parquet.columnarReaderBatchSize", "4096", READER_ROWS)):
        if int(spark.conf.get(key, default)) != rows:
            spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    batch_limits(spark)
    return dealt(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
