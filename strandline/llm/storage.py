"""Settings of Python workers; written tables are those of ``strandline.tables``."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..tables import Workspace, shared_dir

__all__ = ["Workspace", "lean_memory", "shared_dir", "small_batches"]


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Spark hands rows to Python in batches of ``size`` bytes at most, so that long texts do not fill a worker's memory.

    Spark reads this bound when a job starts, so it is a setting of the session; one that the user has lowered stays.  One row is
    the least batch.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().getConfString(key)
    to_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if not 0 < to_bytes(now) <= to_bytes(size):
        spark.conf.set(key, size)


def lean_memory() -> None:
    """For Python workers, which stay between tasks: Arrow then gives memory back instead of keeping it for later."""
    import pyarrow as pa

    pa.set_memory_pool(pa.system_memory_pool())
