"""Intermediate tables in the folder that all machines of the cluster share.

``spark.checkpoint.dir`` names that folder. Tables written here cut lineage, and
survive the loss of any executor, because no machine's own disk holds them.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; in local mode without one, a temporary one is set.

    Raises ValueError on a cluster that names no shared folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="corvanta-")
    spark.conf.set("spark.checkpoint.dir", made)
    atexit.register(_remove_local, made.removeprefix("file://"))
    return made


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def small_enough(df: DataFrame, rows: int = 500_000) -> bool:
    """Whether a table has at most so many rows, by counting no further."""
    return df.limit(rows + 1).count() <= rows


#: Bytes of the Arrow batches that Python workers get. Long texts fill Spark's default of
#: 64 MB, of which a worker and its executor hold several at once.
BATCH_BYTES = "16777216b"
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


_MADE: list[str] = []


def release(spark: SparkSession) -> None:
    """Delete the tables of all workspaces that this driver has made. Results that read them must be written before."""
    while _MADE:
        _delete(spark, _MADE.pop())


def is_kept(path: str | None) -> bool:
    """Whether the tables under a workspace's path have not been released."""
    return path is not None and path in _MADE


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Workspace:
    """A folder of Parquet tables for one run of one operator."""

    def __init__(self, spark: SparkSession, name: str):
        if spark.conf.get(BATCH_SETTING, "67108864b") == "67108864b":
            spark.conf.set(BATCH_SETTING, BATCH_BYTES)
        self.spark = spark
        self.path = f"{shared_dir(spark)}/corvanta/{name}-{uuid.uuid4().hex[:12]}"
        _MADE.append(self.path)

    def save(self, df: DataFrame, table: str) -> DataFrame:
        """Write ``df`` as a table and return the table, with the same schema."""
        path = f"{self.path}/{table}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: str) -> None:
        """Delete tables that no later step reads."""
        for table in tables:
            _delete(self.spark, f"{self.path}/{table}")
