"""A stored vector index: created, refreshed, read and dropped under a name, as a graph's index is.

Unit vectors are kept as bytes beside how far each is from its bytes, so a scan of a quarter of the
data gives every cosine within a known error.  Whatever may be among the best by that error is scored
again from the vectors themselves: results are those of brute force.  A version is a folder; the
pointer to the current one is replaced last, so readers see whole versions only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.sources import tables

HELD_VALUES = 20_000_000  # numbers of questions' vectors that tasks hold at a time; more come in rounds
SPARE = 64  # candidates of a task beyond which those that cannot be among the best are left out
HELD_PAIRS = 1_000_000  # of questions and candidates that a broadcast may hold; beyond, a shuffle join
ROUNDED = 1e-6  # scores are rounded to six places
_CODES = pa.schema([("scale", pa.float32()), ("off", pa.float32()), ("code", pa.binary())])


class NoIndex(LookupError):
    """There is no index of that name."""


def unit(vectors) -> np.ndarray:
    """Rows of unit length; zero vectors stay zero."""
    x = np.asarray(vectors, np.float64)
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of unit vectors, their scales, and an upper bound of each one's distance from its bytes."""
    scale = (np.abs(x).max(1) / 127).astype(np.float32)
    safe = np.where(scale > 0, scale, 1).astype(np.float64)
    code = np.clip(np.rint(x / safe[:, None]), -127, 127).astype(np.int8)
    off = np.sqrt(((x - code * scale.astype(np.float64)[:, None]) ** 2).sum(1))
    return code, scale, np.nextafter(off.astype(np.float32), np.float32(np.inf))


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _encode_part(batches):
    for batch in batches:
        if batch.num_rows:
            code, scale, off = encode(unit(_matrix(batch.column(1))))
            codes = pa.RecordBatch.from_arrays([pa.array(scale), pa.array(off), pa.array([c.tobytes() for c in code], pa.binary())], schema=_CODES)
            yield pa.RecordBatch.from_arrays([*batch.columns, *codes.columns], names=[*batch.schema.names, *_CODES.names])


def _lookup(held, k: int):
    """Of a batch's codes the ids that may be among the ``k`` best of each held question."""

    def run(batches):
        qids, q = held.value
        best = [(np.array([], np.float64), np.array([], np.float64), []) for _ in qids]  # least, most, ids

        def kept(low, high, ids):
            if len(low) <= k:
                return low, high, ids
            stay = np.flatnonzero(high >= np.partition(low, -k)[-k])
            return low[stay], high[stay], [ids[i] for i in stay]

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids = batch.column(0).to_pylist()
            code = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int8).reshape(n, -1).astype(np.float32)
            scale, off = batch.column(1).to_numpy().astype(np.float64), batch.column(2).to_numpy().astype(np.float64)
            for at in range(0, len(qids), 256):
                error = ROUNDED + 2**-23 * q.shape[1]  # of float sums of numbers that are at most 1 together
                near = (q[at : at + 256].astype(np.float32) @ code.T).astype(np.float64) * scale
                for i, row in enumerate(near, at):
                    low, high = row - off - error, row + off + error
                    some = np.arange(n) if n <= k else np.flatnonzero(high >= np.partition(low, -k)[-k])
                    old = best[i]
                    best[i] = np.concatenate([old[0], low[some]]), np.concatenate([old[1], high[some]]), [*old[2], *(ids[j] for j in some)]
                    if len(best[i][0]) > SPARE + k:
                        best[i] = kept(*best[i])
        for qid, mine in zip(qids, best, strict=True):
            low, high, ids = kept(*mine)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array([qid] * len(ids), held_type), pa.array(ids, id_type), pa.array(low), pa.array(high)], names=["qid", "id", "low", "high"])

    from pyspark.sql.pandas.types import to_arrow_type

    held_type, id_type = (to_arrow_type(t) for t in held.types)
    return run


class _Held:
    """Questions' ids and unit vectors, sent to tasks once."""

    def __init__(self, context, rows, types):
        self.sent = context.broadcast(([r["qid"] for r in rows], unit([r["vector"] for r in rows])))
        self.types = types

    @property
    def value(self):
        return self.sent.value


def _pointer(path: str) -> str:
    return f"{path}/current"


def versions(spark: SparkSession, path: str) -> int | None:
    """The current version of the index, null where there is none."""
    if not tables.exists(spark, _pointer(path)):
        return None
    return spark.read.schema("version int").json(_pointer(path)).first()["version"]


def _write(vectors: DataFrame, path: str, version: int) -> None:
    rows = vectors.filter(F.col("vector").isNotNull()).select("id", F.col("vector").cast("array<double>").alias("vector"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, vector array<double>, scale float, off float, code binary"
    rows.mapInArrow(_encode_part, schema).write.mode("overwrite").parquet(f"{path}/v={version}")


def _point(spark: SparkSession, path: str, version: int) -> None:
    spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("overwrite").json(_pointer(path))


def create(vectors: DataFrame, path: str) -> int:
    """The index of ``vectors`` (id, vector, any others) under ``path``: version 0, or that which is there."""
    spark = vectors.sparkSession
    there = versions(spark, path)
    if there is not None:
        return there
    _write(vectors, path, 0)
    _point(spark, path, 0)
    return 0


def refresh(vectors: DataFrame, path: str, gone: DataFrame | None = None) -> int:
    """A new version: ``vectors`` replace those of their ids, and the ids of ``gone`` (id) leave.

    What is not touched is taken as it is, without being encoded again.  The version before stays for
    those who read it, the one before that goes.
    """
    spark = vectors.sparkSession
    now = versions(spark, path)
    if now is None:
        return create(vectors, path)
    touched = vectors.select("id") if gone is None else vectors.select("id").union(gone.select("id"))
    _write(vectors, path, now + 1)
    kept = spark.read.parquet(f"{path}/v={now}").join(touched.distinct(), "id", "left_anti")
    kept.write.mode("append").parquet(f"{path}/v={now + 1}")
    _point(spark, path, now + 1)
    tables.delete(spark, f"{path}/v={now - 1}")
    return now + 1


def drop(spark: SparkSession, path: str) -> bool:
    """Remove the index with all its versions; false if there was none."""
    return tables.delete(spark, path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id, vector, scale, off, code) of the current version."""
    version = versions(spark, path)
    if version is None:
        raise NoIndex(f"no vector index at {path}")
    return spark.read.parquet(f"{path}/v={version}")


def search(questions: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank): each question's ``k`` nearest of an index by cosine to six places, ties by id.

    ``questions`` (qid, vector) of ``HELD_VALUES`` at a time are held by every task, in rounds if there
    are more; null vectors find nothing.  All vectors are of one length.  Codes stream past them, and of each task only what may be
    among the best moves; their vectors are then read for the exact scores.
    """
    from graphloom.operators.retrieval import cosine

    spark = questions.sparkSession
    asked = questions.filter(F.col("vector").isNotNull()).select("qid", F.col("vector").cast("array<double>").alias("vector"))
    types = (asked.schema["qid"].dataType, index.schema["id"].dataType)
    values = asked.agg(F.sum(F.size("vector"))).first()[0] or 0
    rounds, found = max(1, -(-values // HELD_VALUES)), None
    schema = f"qid {types[0].simpleString()}, id {types[1].simpleString()}, low double, high double"
    for b in range(rounds):
        rows = (asked if rounds == 1 else asked.filter(F.pmod(F.xxhash64("qid"), F.lit(rounds)) == b)).collect()
        if rows:
            part = index.select("id", "scale", "off", "code").mapInArrow(_lookup(_Held(spark.sparkContext, rows, types), k), schema)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"qid {types[0].simpleString()}, id {types[1].simpleString()}, score double, rank int")
    # over all tasks the k-th least bound leaves few
    sure = Window.partitionBy("qid").orderBy(F.desc("low"), "id")
    floor = found.withColumn("n", F.row_number().over(sure)).withColumn("floor", F.max(F.when(F.col("n") == k, F.col("low"))).over(Window.partitionBy("qid")))
    close = tables.written(floor.filter(F.col("floor").isNull() | (F.col("high") >= F.col("floor"))).select("qid", "id"), tag="close")
    few = F.broadcast(close) if close.count() <= HELD_PAIRS else close  # else the vectors are shuffled
    pairs = index.select("id", "vector").join(few, "id").join(asked.withColumnRenamed("vector", "asked"), "qid")
    exact = pairs.select("qid", "id", F.round(F.coalesce(cosine(F.col("asked"), F.col("vector")), F.lit(0.0)), 6).alias("score"))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return exact.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


# What an item says if the search fails.
FAILED = "VectorRetriever 检索失败："


def items(questions: DataFrame, path: str, k: int) -> DataFrame:
    """(qid, id, score, rank, error): the nearest of the index at ``path``; where it cannot be read one row a question says why."""
    spark = questions.sparkSession
    try:
        return search(questions, read(spark, path), k).withColumn("error", F.lit(None).cast("string"))
    except Exception as e:  # noqa: BLE001 - answers go on without chunks
        none = lambda kind: F.lit(None).cast(kind)
        return questions.select("qid", none("long").alias("id"), none("double").alias("score"), none("int").alias("rank"), F.lit(f"{FAILED}{str(e).splitlines()[0]}").alias("error"))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of ``exact`` (qid, id) that ``found`` has."""
    n = exact.count()
    return exact.join(found.select("qid", "id"), ["qid", "id"], "left_semi").count() / n if n else 1.0
