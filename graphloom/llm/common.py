"""What the operators of this subpackage share: tables, stored intermediates, tokens."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
_OPEN: list[list[DataFrame]] = []  # the scratch blocks that are open, each with its tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see.  In local mode a temporary one does where the session names none."""
    where = spark.conf.get(CHECKPOINT_DIR, None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share")
        where = getattr(shared_dir, "own", None) or "file://" + tempfile.mkdtemp(prefix="graphloom-")
        shared_dir.own = where
    return where.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_path = path
    if _OPEN:
        _OPEN[-1].append(back)
    return back


def drop_stored(df: DataFrame) -> None:
    """Delete a table made by ``stored`` that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch():
    """Tables stored inside go when the block ends, but for those passed to the function it gives.

    A kept table belongs to the block around, if there is one, and goes with that.
    """
    _OPEN.append([])
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        for df in _OPEN.pop():
            if not any(df is k for k in kept):
                drop_stored(df)
        if _OPEN:
            _OPEN[-1].extend(kept)


HOT = 1000  # a key is hot that holds more than one in so many rows, so that there are at most so many


def hot_join(many: DataFrame, one: DataFrame, key: str, rows: str) -> DataFrame:
    """``many``, a stored table, with the row of ``one`` that has its ``key``; ``one`` counts in ``rows`` the key's rows in ``many``.

    Hot keys, at most ``HOT`` of them, are joined where their rows are, by a broadcast of that size;
    the others by a shuffle, in which no key is hot.
    """
    one = stored(one, "hot-join")
    limit = max(HOT, many.count() // HOT)
    hot = one.filter(F.col(rows) > limit)
    if hot.isEmpty():
        return many.join(one.drop(rows), key)
    cold = many.join(F.broadcast(hot.select(key)), key, "left_anti").join(one.filter(F.col(rows) <= limit), key)
    return many.join(F.broadcast(hot), key).unionByName(cold).drop(rows)


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, mod ``n``; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(n))


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, as UTF-8; bytes.split() knows just those blanks."""
    return text.encode("utf-8", "replace").lower().split() if text else []
