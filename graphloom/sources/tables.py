"""Tables that a plan writes and reads again, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
PARTS = 2  # parts a core of rows that are costly


def shared(spark: SparkSession) -> str:
    """The shared folder; in local mode a temporary one does where the session names none."""
    where = spark.conf.get(CHECKPOINT_DIR, None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share")
        where = getattr(shared, "own", None) or "file://" + tempfile.mkdtemp()
        shared.own = where
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None, tag: str = "table", **options) -> DataFrame:
    """``df`` written as a table, to ``path`` or a folder of its own, and read back: plans on it start there.  ``options`` are the writer's."""
    path = path or scratch(df.sparkSession, tag)
    df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> bool:
    """Remove a folder; false if there was none."""
    gone = spark._jvm.org.apache.hadoop.fs.Path(path)
    return gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores: a small table of fewer parts than there are is dealt out, a larger one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame) -> DataFrame:
    """``df`` dealt out in several parts a core, for work that costs far more a row than moving it.

    A table's parts say nothing of its rows: a row group goes to one of them whole, and the others are empty.
    """
    return df.repartition(max(df.rdd.getNumPartitions(), PARTS * df.sparkSession.sparkContext.defaultParallelism))
