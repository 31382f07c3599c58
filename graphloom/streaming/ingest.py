"""Incremental ingestion: page windows as pages arrive, and a graph that batches are folded into once each."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from graphloom.operators import graph
from graphloom.operators.chunking import split_text
from graphloom.plans import ingest
from graphloom.sources import tables

WINDOW_SCHEMA = "doc string, first int, last int, text string"


def page_stream(spark: SparkSession, path: str, schema: str, files: int = 8) -> DataFrame:
    """Pages as files land; a trigger takes a bounded number of files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def buffered_windows(pages: DataFrame, size: int = 20, overlap: int = 1, patience_ms: int | None = None) -> DataFrame:
    """Windows of pages (doc, page, text, last: whether the document ends) as soon as they are full.

    State is a document's buffered pages, never more than a window, and goes with its last page.  A gap
    or the end of the document flushes the buffer; the last ``overlap`` pages of a full window begin
    the next.  A document of which nothing comes for ``patience_ms`` is taken to have ended.
    """
    state_schema = "pages array<int>, texts array<string>"

    def run(key, frames, state):
        pages_, texts = ([list(x) for x in state.get] if state.exists else [[], []])
        out = []

        def emit():
            if pages_:
                out.append((key[0], pages_[0], pages_[-1], "\n\n".join(texts)))

        if state.hasTimedOut:
            emit()
            state.remove()
            yield pd.DataFrame(out, columns=["doc", "first", "last", "text"])
            return
        rows = pd.concat(list(frames)).sort_values("page")
        for page, text, last in zip(rows["page"], rows["text"], rows["last"], strict=True):
            if pages_ and page != pages_[-1] + 1:
                emit()
                pages_, texts = [], []
            pages_.append(int(page))
            texts.append(text)
            if len(pages_) == size:
                emit()
                pages_, texts = (pages_[-overlap:], texts[-overlap:]) if overlap else ([], [])
            if last:
                emit()
                pages_, texts = [], []
        if pages_:
            state.update((pages_, texts))
            if patience_ms is not None:
                state.setTimeoutDuration(patience_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["doc", "first", "last", "text"])

    patience = GroupStateTimeout.NoTimeout if patience_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return pages.groupBy("doc").applyInPandasWithState(run, WINDOW_SCHEMA, state_schema, "append", patience)


def _once(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingest_stream(docs: DataFrame, out: str, checkpoint: str) -> None:
    """Chunks of the arriving documents (source, text), appended by batch; a batch that runs again replaces its own files."""
    _once(docs, checkpoint, lambda batch, i: split_text(batch).write.mode("overwrite").parquet(f"{out}/batch={i}"))


def window_stream(pages: DataFrame, out: str, checkpoint: str, size: int = 20, overlap: int = 1) -> None:
    """Windows of the arriving pages, by batch."""
    _once(buffered_windows(pages, size, overlap), checkpoint, lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch={i}"))


KEYS = {"nodes": graph.NODE_KEY, "edges": graph.EDGE_KEY}
MAKERS = {"nodes": graph.node_state, "edges": graph.edge_state}
FAN = 8  # states of a size that are merged into one


def segments(batch: int) -> list[tuple[int, int]]:
    """(level, number) of the states that together are the graph after a batch, oldest first.

    A state of level n holds ``FAN`` to the power n batches, so they are as few as the digits of the
    number of batches add up to.
    """
    out, n, start = [], batch + 1, 0
    level = 0
    while FAN ** (level + 1) <= n:
        level += 1
    for at in range(level, -1, -1):
        width = FAN**at
        while n >= width:
            out.append((at, start // width))
            start, n = start + width, n - width
    return out


def _at(out: str, level: int, number: int) -> str:
    return f"{out}/state/{level}-{number}"


def _read(spark: SparkSession, path: str, kind: str) -> graph.State:
    return graph.State(spark.read.parquet(f"{path}/{kind}-rows"), spark.read.parquet(f"{path}/{kind}-lists"))


def _write(state: graph.State, path: str, kind: str) -> None:
    state.rows.write.mode("overwrite").parquet(f"{path}/{kind}-rows")
    state.lists.write.mode("overwrite").parquet(f"{path}/{kind}-lists")


def _whole(spark: SparkSession, out: str, parts: list[tuple[int, int]], kind: str) -> graph.State:
    """The states ``parts`` as one, by one aggregation over all."""
    states = [_read(spark, _at(out, *p), kind) for p in parts]
    return states[0] if len(states) == 1 else graph.merged_all(states, KEYS[kind])


def graph_stream(chunks: DataFrame, out: str, checkpoint: str, extracted: Callable[[DataFrame], DataFrame]) -> None:
    """Folds arriving chunks (source, index, text, document, pages) into the graph kept under ``out``.

    ``extracted`` turns chunks into extractions, once: a batch's log is written before it is read.  The
    stream itself drops a chunk that has come before, by keyed state.  A batch writes its own state of
    the graph alone; ``FAN`` states of a size are merged into one of the next, so a mention is written
    as often as there are sizes, not batches.  A batch that runs again replaces what it wrote, and
    states that were merged go a batch later, when no run needs them.
    """

    def fold(batch: DataFrame, i: int) -> None:
        spark = batch.sparkSession
        ingest.log_of(extracted(batch)).write.mode("overwrite").parquet(f"{out}/log/batch={i}")
        rows = dict(zip(KEYS, ingest.graph_rows(spark.read.parquet(f"{out}/log/batch={i}")), strict=True))
        for kind, make in MAKERS.items():
            _write(make(rows[kind]), _at(out, 0, i), kind)
            width = FAN
            while (i + 1) % width == 0:
                level, number = round(math.log(width, FAN)), (i + 1) // width - 1
                _write(_whole(spark, out, [(level - 1, number * FAN + j) for j in range(FAN)], kind), _at(out, level, number), kind)
                width *= FAN
        if i:
            before = set(segments(i - 1))
            for part in (set(segments(i - 2)) if i > 1 else set()) | {(0, i - 1)}:
                if part not in before:
                    tables.delete(spark, _at(out, *part))

    _once(chunks.dropDuplicates(["source", "index"]), checkpoint, fold)


def stream_graph(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after the last batch."""
    last = spark.read.parquet(f"{out}/log").agg(F.max("batch")).first()[0]
    whole = {kind: _whole(spark, out, segments(last), kind) for kind in KEYS}
    nodes = graph.nodes_of(whole["nodes"])
    return nodes, graph.attached(graph.edges_of(whole["edges"]), nodes)
