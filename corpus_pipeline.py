"""The corpus pipeline: documents in, packed sequences out.  Each stage's result is written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import mixing, near_dedup, packing, pii, toxicity
from graphloom.llm.common import scratch, shared_dir, stored, table

PERCENT = 80  # the near-dedup stage's least similarity; op3_near_dedup has its own

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, list(COLUMNS)).filter("score < 0.5").select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (Jaccard of ``PERCENT`` or more) stays, the one of the smallest doc_id.

    Rows of one doc_id are one document, of which each text stays once.  Rows without doc_id belong
    to no group; of equal texts among them one stays.
    """
    groups = near_dedup.near_dedup(docs, PERCENT)
    gone = groups.filter(~F.col("kept")).select("doc_id").distinct()
    stay = docs.select(*COLUMNS).join(_held(gone), "doc_id", "left_anti").select(*COLUMNS)
    # rows that share their doc_id, or have none, are few if any: only they are compared by text
    shared = stored(groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1 or doc_id is null").select(F.col("doc_id").alias("its"), F.lit(True).alias("shared")), "pipe-shared")
    if shared.isEmpty():
        return stay
    marked = stay.join(_held(shared), F.col("doc_id").eqNullSafe(F.col("its")), "left").drop("its")
    alike = marked.filter("shared").drop("shared")
    others = [c for c in COLUMNS if c not in ("doc_id", "text")]
    one = alike.groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("r")).select("doc_id", "text", *(F.col(f"r.{c}") for c in others))
    return marked.filter("shared is null").select(*COLUMNS).unionByName(one.select(*COLUMNS))


def _held(ids: DataFrame) -> DataFrame:
    """A broadcast if there are few enough ids; else a shuffle join moves the texts once."""
    return F.broadcast(ids) if ids.count() <= near_dedup.HELD_IDS else ids


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is generalised."""
    done = pii.sanitise(docs.select(*COLUMNS))
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    plan = mixing.mix_plan(stored(mixing.measured(docs), "pipe-measured")).filter("copies > 0").select("row_id", "copies").dropDuplicates(["row_id"])  # rows of one row_id have the same copies
    taken = docs.select(*COLUMNS).withColumn("row_id", mixing.row_id()).join(plan, "row_id")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids in sequences; copies of a document are packed each."""
    return packing.pack(docs)


STAGES = [("toxicity", clean), ("near_dedup", distinct), ("pii", private), ("mixing", mixed), ("packing", packed)]

# Trained models, signatures and a tokenizer are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage stored on its way goes when its result is written."""
    docs, where = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{where}/{i}-{name}"
        with scratch():
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
