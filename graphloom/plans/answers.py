"""Answers: questions against chunks and graph facts, with citations, the context for a language model, and its answer."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions import text as tx
from graphloom.operators import facts, retrieval, vectors

# What is said without a model.
NOTHING_FOUND = "当前知识库没有检索到足够相关的资料。建议补充资料或换一种更具体的问法。"
NO_MODEL = "我检索到了相关资料，但当前大模型未启用。"
JUDGED_CONTEXT = 6000


class AnswerProvider(Protocol):
    """A language model, or what stands in for one."""

    def __call__(self, question: str, context: str) -> str: ...


class Judge(Protocol):
    """A model that judges an answer as a JSON object of 0/1 fields."""

    def __call__(self, record: dict) -> str: ...


def local_answer(question: str, context: str) -> str:
    return NO_MODEL if context.strip() else NOTHING_FOUND


def answered(question: Column, context: Column, provider: AnswerProvider = local_answer) -> Column:
    """The provider's answer; if it gives none or fails, the local one, with the error."""

    def one(q, c):
        try:
            return provider(q, c) or local_answer(q, c)
        except Exception as e:  # noqa: BLE001 - a failed call must not fail the job
            return f"{local_answer(q, c)}\n\n{e}"

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for questions, contexts in batches:
            yield pd.Series([one(q or "", c or "") for q, c in zip(questions, contexts, strict=True)], dtype=object)

    return run(question, context)


def judged(record: Column, judge: Judge) -> Column:
    """The judge's verdict on a struct of question, answer, context and what is expected, as it came."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for frame in batches:
            yield pd.Series([judge(r) for r in frame.to_dict("records")], dtype=object)

    return run(record)


def ask(questions: DataFrame, chunks: DataFrame, edges: DataFrame, k_chunks: int = retrieval.CHUNKS, k_facts: int = facts.K, provider: AnswerProvider | None = None, nodes: DataFrame | None = None, index: str | None = None) -> DataFrame:
    """(qid, context, n_parts, citations, and answer with a ``provider``) of questions (qid, question, vector).

    Chunks: id, vector, text, document, page, and source if there; edges: as a graph scan gives them,
    with document and page, and source.  A hit without document is cited by its source.  ``index`` is
    where the chunks' stored vectors are; without it their own are compared.  If it cannot be read,
    answers go on with facts alone, and ``error`` says why.
    """
    source = lambda df: F.col("source") if "source" in df.columns else F.lit(None).cast("string")
    cited = lambda df: df.withColumns({"cited": tx.document_of(F.col("document"), source(df)), "cited_page": tx.page_of(F.col("document"), F.col("page"), source(df))})
    found = retrieval.top_chunks(questions, chunks, k_chunks) if index is None else vectors.items(questions, index, k_chunks)
    hits_ = found if index is None else found.filter("error is null").drop("error")
    near = cited(hits_.join(chunks.drop("vector"), "id"))
    linked = cited(facts.top_facts(questions, edges, k_facts, nodes))
    hit = lambda df, kind: df.select("qid", F.lit(kind).alias("kind"), "rank", F.col("cited").alias("source"), F.col("cited_page").alias("page"))
    hits = hit(near, 0).unionByName(hit(linked, 1))
    parts = near.select("qid", F.lit(0).alias("kind"), "rank", retrieval.chunk_part(F.col("cited"), F.col("cited_page"), F.col("text")).alias("text"))
    parts = parts.unionByName(linked.select("qid", F.lit(1).alias("kind"), "rank", retrieval.fact_part(F.col("source_name"), F.col("type"), F.col("target_name"), F.col("evidence")).alias("text")))
    labels = retrieval.citations(hits).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "label"))), lambda c: c["label"]).alias("citations"))
    out = retrieval.context(parts).join(labels, "qid", "left")
    if index is not None:
        out = out.join(found.filter("error is not null").groupBy("qid").agg(F.first("error").alias("error")), "qid", "left")
    if provider is None:
        return out
    return out.join(questions.select("qid", "question"), "qid").withColumn("answer", answered(F.col("question"), F.col("context"), provider)).drop("question")
