"""Streams of many batches: what is kept, what is written, and that all of it is the batch result."""

import pandas as pd
from pyspark.sql import functions as F

from graphloom.operators import graph
from graphloom.plans import ingest as plans
from graphloom.streaming import ingest


def test_segments_cover_all_batches():
    for last in range(300):
        parts = ingest.segments(last)
        covered = [b for level, number in parts for b in range(number * ingest.FAN**level, (number + 1) * ingest.FAN**level)]
        assert covered == list(range(last + 1))
        digits, n = 0, last + 1
        while n:
            digits, n = digits + n % ingest.FAN, n // ingest.FAN
        assert len(parts) == digits


def test_many_batches_are_one_and_write_what_is_new(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "FAN", 3)
    provider = lambda text, error: '{"nodes": [{"name": "valve", "label": "Unit", "aliases": ["%s"]}], "relationships": [{"source": "valve", "type": "PRODUCES", "target": "naphtha", "evidence": "valve makes naphtha"}]}' % text[-1]
    texts = spark.createDataFrame([(f"{i}.txt", f"valve makes naphtha number {i}") for i in range(11)], "source string, text string")
    chunks = plans.chunking.split_text(texts)
    for i in range(10):  # a file a batch; each brings its own text and one that came before
        chunks.filter(F.col("source").isin(f"{i}.txt", f"{max(i - 1, 0)}.txt")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    calls = spark.sparkContext.accumulator(0)

    def paid(text, error):
        calls.add(1)
        return provider(text, error)

    stream = lambda: spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = lambda: ingest.graph_stream(stream(), str(tmp_path / "out"), str(tmp_path / "check"), lambda batch: plans.extract(batch, paid))
    run()
    assert calls.value == 10
    nodes, edges = ingest.stream_graph(spark, str(tmp_path / "out"))
    assert edges.first()["support_count"] == 10 and len(edges.first()["documents"]) == 10
    log = plans.log_of(plans.extract(chunks.filter("source <> '10.txt'"), provider))
    want = graph.upsert_nodes(plans.graph_rows(log)[0])
    key = lambda r: r["canonical_key"]
    assert [(key(r), r["support_count"], sorted(r["aliases"])) for r in sorted(nodes.collect(), key=key)] == [(key(r), r["support_count"], sorted(r["aliases"])) for r in sorted(want.collect(), key=key)]
    # of ten batches the states kept are those of the digits of ten, and the ones merged last
    kept = {p.name for p in (tmp_path / "out" / "state").iterdir()}
    assert {f"{a}-{b}" for a, b in ingest.segments(9)} <= kept and len(kept) <= 2 * 3 + 2
    # a stream that goes on folds what is new
    chunks.filter("source in ('10.txt', '3.txt')").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert ingest.stream_graph(spark, str(tmp_path / "out"))[1].first()["support_count"] == 11 and calls.value == 11


class State:
    """What a stream keeps of one document."""

    def __init__(self):
        self.value, self.hasTimedOut, self.patience = None, False, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):  # noqa: N802 - Spark's name
        self.patience = ms


def window_function(monkeypatch, **options):
    found = {}

    class Grouped:
        def applyInPandasWithState(self, run, *rest):  # noqa: N802 - Spark's name
            found["run"], found["patience"] = run, rest[-1]

    class Pages:
        groupBy = staticmethod(lambda key: Grouped())  # noqa: N815

    ingest.buffered_windows(Pages(), **options)
    return found["run"]


def test_page_state_goes_with_the_document_and_with_patience(monkeypatch):
    run, state = window_function(monkeypatch, size=3, overlap=1, patience_ms=500), State()
    step = lambda *rows: [tuple(r) for f in run(("d",), iter([pd.DataFrame(rows, columns=["page", "text", "last"])]), state) for r in f[["first", "last"]].values]
    assert step((1, "a", False), (2, "b", False)) == [] and state.exists and state.patience == 500
    assert step((3, "c", False), (4, "d", True)) == [(1, 3), (3, 4)] and not state.exists
    assert step((7, "e", False)) == [] and state.exists
    state.hasTimedOut = True
    assert [tuple(r) for f in run(("d",), iter([]), state) for r in f[["first", "last"]].values] == [(7, 7)] and not state.exists
    state.hasTimedOut = False
    assert step((9, "f", True)) == [(9, 9)] and not state.exists
