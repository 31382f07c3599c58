"""Retrieval: nearest chunks, ranked graph facts, citations and the context of an answer."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions import text as tx
from graphloom.functions.arrays import let
from graphloom.operators import matching
from graphloom.operators.vectors import unit

CHUNKS, CITATIONS, PARTS = 4, 8, 16
DIMENSIONS = 384
KEPT_TOKENS = 500_000  # tokens whose places a worker remembers
HELD_GRAMS = 1_000_000  # n-grams of items that a broadcast may hold; beyond, a shuffle join
HELD_VALUES = 40_000_000  # numbers of questions' vectors that tasks hold at a time; more are scored in rounds


def hash_tokens(text: str) -> list[str]:
    """ASCII words of the lowered text, and pairs and triples of each run of CJK characters.

    A run of one or two characters comes twice, as a piece of its own for both sizes.
    """
    out = re.findall(r"[a-z0-9_]+", text.lower())
    for run in re.findall(r"[一-鿿]+", text):
        for n in (2, 3):
            out += [run] if len(run) <= n - (n == 3 and len(run) < 3) and len(run) < 3 else [run[i : i + n] for i in range(len(run) - n + 1)]
    return out


def place(token: str, dimensions: int) -> tuple[int, float]:
    """A token's bucket and sign."""
    h = hashlib.blake2b(token.encode(), digest_size=8).digest()
    return int.from_bytes(h[:4], "little") % dimensions, 1.0 if h[4] % 2 == 0 else -1.0


def hash_vector(text: str, dimensions: int = DIMENSIONS, known: dict | None = None) -> np.ndarray:
    """A unit vector of signed token counts; zero without tokens.  ``known`` remembers tokens' places."""
    known = {} if known is None else known
    v = np.zeros(dimensions)
    for token in hash_tokens(text):
        at = known.get(token)
        if at is None:
            at = place(token, dimensions)
            if len(known) < KEPT_TOKENS:
                known[token] = at
        v[at[0]] += at[1]
    n = np.sqrt((v * v).sum())
    return v / n if n else v


class Embedder(Protocol):
    """A model that turns texts into unit vectors, a batch at a time; models and their weights are the caller's."""

    dimensions: int

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Needs no model: signed counts of hashed tokens."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions, self.known = dimensions, {}

    def __call__(self, texts: list[str]) -> np.ndarray:
        return np.array([hash_vector(t, self.dimensions, self.known) for t in texts]).reshape(len(texts), self.dimensions)


def embedding(text: Column, embedder: Embedder | None = None) -> Column:
    """Vectors of a text column, by hashing or by a model; null counts as empty."""
    embedder = embedder or HashingEmbedder()

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(embedder(texts.fillna("").tolist()).astype(np.float32)), index=texts.index)

    return run(text)


def cosine(a: Column, b: Column) -> Column:
    """In double precision, summed in order; null where a vector is zero."""
    num = lambda x: x.cast("double")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: num(p) * num(q)), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _near_part(held: Broadcast, k: int):
    def run(batches):
        asked = held.value
        q, out = unit(list(asked["vector"])), [[] for _ in range(len(asked))]
        for frame in batches:
            if not len(frame):
                continue
            ids, x = frame["id"].to_numpy(), unit(list(frame["vector"]))
            for at in range(0, len(q), 1024):
                scores = np.round(q[at : at + 1024] @ x.T, 6)
                for i, row in enumerate(scores, at):
                    some = np.arange(len(ids)) if len(ids) <= 4 * k else np.flatnonzero(row >= np.partition(row, -k)[-k])
                    out[i] = sorted([*out[i], *((-float(row[j]), ids[j]) for j in some)])[:k]
        rows = [(asked["qid"].iloc[i], v, -s) for i, best in enumerate(out) for s, v in best]
        yield pd.DataFrame(rows, columns=["qid", "id", "score"])

    return run


def top_chunks(questions: DataFrame, chunks: DataFrame, k: int = CHUNKS) -> DataFrame:
    """(qid, id, score, rank): each question's ``k`` nearest chunks by cosine to six places, ties by id.

    ``questions`` (qid, vector) are held by every task, in rounds of ``HELD_VALUES`` numbers; chunks
    (id, vector) stream past them as matrix products, and only each task's best move.  ``vectors``
    keeps an index for those that are asked often.
    """
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    asked = questions.filter("vector is not null").select("qid", "vector")
    values, found = asked.agg(F.sum(F.size("vector"))).first()[0] or 0, None
    rounds = max(1, -(-values // HELD_VALUES))
    for b in range(rounds):
        rows = (asked if rounds == 1 else asked.filter(F.pmod(F.xxhash64("qid"), F.lit(rounds)) == b)).toPandas()
        if len(rows):
            held = questions.sparkSession.sparkContext.broadcast(rows)
            part = chunks.filter("vector is not null").select("id", "vector").mapInPandas(_near_part(held, k), f"qid {kind(questions, 'qid')}, id {kind(chunks, 'id')}, score double")
            found = part if found is None else found.unionByName(part)
    if found is None:
        return questions.sparkSession.createDataFrame([], f"qid {kind(questions, 'qid')}, id {kind(chunks, 'id')}, score double, rank int")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _grams(words: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.xxhash64(F.array_join(F.slice(words, i, F.lit(n)), " ")))


def _met(docs: DataFrame, items: DataFrame, grams: DataFrame, n: int) -> DataFrame:
    """(doc_id, item_id): documents that hold one of the items' n-grams (gram, item_id); items are the smaller side."""
    grams_of = let(_words(F.col("text")), lambda ws: F.when(F.size(ws) >= n, F.array_distinct(_grams(ws, n))).otherwise(F.array().cast("array<bigint>")))
    own = docs.select("doc_id", F.explode(grams_of).alias("gram"))
    held = grams.count() <= HELD_GRAMS
    return own.join(F.broadcast(grams) if held else grams, "gram").select("doc_id", "item_id").distinct()


def sharing(docs: DataFrame, items: DataFrame, n: int = 5) -> DataFrame:
    """Pairs of documents (doc_id, text) and items (item_id, item) that share ``n`` words in a row."""
    words = _words(F.col("item"))
    grams = items.filter(F.size(words) >= n).select("item_id", F.explode(let(words, lambda ws: F.array_distinct(_grams(ws, n)))).alias("gram"))
    return _met(docs, items, grams, n).join(docs, "doc_id").join(items, "item_id")


def containing(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs of documents (doc_id, text) and items (item_id, item) whose text holds the item's, letter by letter.

    Automata of the items read each text once.  Empty items, and nulls, are nowhere.
    """
    found = matching.in_texts(docs.select("doc_id", "text"), matching.automata(items.select("item"))).toDF("doc_id", "item")
    return found.join(items, "item").select("doc_id", "item_id")


def fact_text(source: Column, kind: Column, target: Column, evidence: Column) -> Column:
    fact = F.concat(source, F.lit(" --"), kind, F.lit("--> "), target)
    return F.when(F.coalesce(evidence, F.lit("")) != "", F.concat(fact, F.lit("。证据："), evidence)).otherwise(fact)


def citation_label(source: Column, page: Column) -> Column:
    return F.when(F.coalesce(page, F.lit("")) != "", F.concat(source, F.lit("，第 "), page, F.lit(" 页"))).otherwise(source)


def first_of(rows: DataFrame, keys: list[str], order: list[str], per: list[str]) -> DataFrame:
    """The first row by ``order`` of each key, within ``per``."""
    w = Window.partitionBy(*per, *keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def citations(hits: DataFrame, most: int = CITATIONS) -> DataFrame:
    """Hits (qid, kind, rank, source, page) to citations (qid, place, source, page, label).

    Chunks (kind 0) come before facts (kind 1); a source and page are cited once; a source is
    needed; where any of a question's citations has a page those without go.
    """
    rows = first_of(hits.filter(F.coalesce("source", F.lit("")) != "").withColumn("page", F.coalesce("page", F.lit(""))), ["source", "page"], ["kind", "rank"], ["qid"])
    paged = F.max((F.col("page") != "").cast("int")).over(Window.partitionBy("qid")) == 1
    kept = rows.withColumn("paged", paged).filter(~F.col("paged") | (F.col("page") != ""))
    placed = kept.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("kind", "rank", "source", "page"))).filter(F.col("place") <= most)
    return placed.select("qid", "place", "source", "page", citation_label(F.col("source"), F.col("page")).alias("label"))


def eval_citations(hits: DataFrame) -> DataFrame:
    """Hits (qid, kind, rank, document, page, source_ref, any others in ``qid``'s place) to those cited in evaluation.

    Chunks (kind 0) come before facts (kind 1); a document, page and source_ref are cited once, nulls
    alike; nothing is left out.
    """
    w = Window.partitionBy("qid", "document", "page", "source_ref").orderBy("kind", "rank")
    first = hits.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("kind", "rank")))


def chunk_part(document: Column, page: Column, text: Column) -> Column:
    """A chunk as a part of an answer's context."""
    head = F.when(F.coalesce(page, F.lit("")) != "", F.concat(document, F.lit(" 第 "), page, F.lit(" 页"))).otherwise(document)
    return F.concat(F.lit("[文档] "), head, F.lit("\n"), F.coalesce(text, F.lit("")))


def fact_part(source: Column, kind: Column, target: Column, evidence: Column) -> Column:
    """An edge as a part of an answer's context."""
    return F.concat(F.lit("[图谱] "), fact_text(source, kind, target, evidence))


def context(parts: DataFrame, most: int | None = PARTS) -> DataFrame:
    """Parts (qid, kind, rank, text) to (qid, n_parts, context): the first ``most`` (None: all), parted by blank lines."""
    placed = parts.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("kind", "rank", "text")))
    placed = placed if most is None else placed.filter(F.col("place") <= most)
    whole = placed.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("own"))
    return whole.select("qid", F.size("own").alias("n_parts"), F.array_join(F.transform("own", lambda p: p["text"]), "\n\n").alias("context"))
