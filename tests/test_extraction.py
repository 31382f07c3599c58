"""A provider is asked once a chunk, and everything after reads what was written."""

import json
import uuid

from graphloom.operators import chunking, vectors
from graphloom.plans import ingest


def paid(folder):
    """A model whose answers differ each time, and that leaves a file for each call."""

    def provider(text, error):
        (folder / uuid.uuid4().hex).write_text(text)
        name = uuid.uuid4().hex
        return json.dumps({"nodes": [{"name": "valve", "label": "Unit", "description": name}], "relationships": [{"source": "valve", "type": "PRODUCES", "target": "naphtha", "evidence": "valve makes naphtha"}]})

    return provider


def calls(folder):
    return len(list(folder.iterdir()))


def texts_of(spark, n, start=0):
    return spark.createDataFrame([(f"{i}.txt", f"valve makes naphtha number {i}") for i in range(start, n)], "source string, text string").repartition(3)


def test_one_call_a_chunk_for_log_nodes_and_edges(spark, tmp_path):
    (folder := tmp_path / "calls").mkdir()
    log, nodes, edges = ingest.build_graph(texts_of(spark, 7), paid(folder))
    assert (edges.first()["support_count"], nodes.count(), log.count()) == (7, 2, 7)
    told = {r["n"]["description"] for r in log.selectExpr("explode(extraction.nodes) n").collect()} - {""}
    assert nodes.filter("name = 'valve'").first()["description"] in told
    assert calls(folder) == 7


def test_waves_and_runs_ask_for_what_is_missing_alone(spark, tmp_path):
    (folder := tmp_path / "calls").mkdir()
    kept = ingest.ExtractionLog(spark, f"file://{tmp_path}/log")
    assert kept.read() is None
    chunks = lambda n: chunking.split_text(texts_of(spark, n))
    assert kept.add(chunks(10), paid(folder), wave=4).count() == 10 and calls(folder) == 10
    assert len(list((tmp_path / "log").glob("_SUCCESS"))) == 1
    assert kept.add(chunks(10).unionByName(chunks(3)), paid(folder)).count() == 10 and calls(folder) == 10
    assert kept.add(chunks(14), paid(folder), wave=2, workers=1).count() == 14 and calls(folder) == 14
    got = kept.read()
    assert got.select("source", "chunk").distinct().count() == 14
    assert set(chunks(1).columns) - {"index"} <= set(got.columns)


def test_a_lost_run_keeps_its_waves(spark, tmp_path):
    (folder := tmp_path / "calls").mkdir()
    kept, chunks = ingest.ExtractionLog(spark, f"file://{tmp_path}/log"), chunking.split_text(texts_of(spark, 12))
    real, done = ingest.extract, []

    def broken(*args):
        if len(done) == 2:
            raise RuntimeError("lost")
        done.append(1)
        return real(*args)

    ingest.extract = broken
    try:
        kept.add(chunks, paid(folder), wave=4)
    except RuntimeError:
        pass
    finally:
        ingest.extract = real
    before = calls(folder)
    assert 0 < before == kept.read().count() < 12
    assert kept.add(chunks, paid(folder), wave=4).count() == 12 and calls(folder) == 12


def test_no_chunks(spark, tmp_path):
    kept = ingest.ExtractionLog(spark, f"file://{tmp_path}/log")
    assert kept.add(chunking.split_text(texts_of(spark, 1).limit(0)), lambda t, e: "{}").count() == 0


def test_files_become_a_graph_and_vectors(spark, tmp_path):
    (folder := tmp_path / "calls").mkdir()
    (files := tmp_path / "in").mkdir()
    for i in range(3):
        (files / f"{i}.txt").write_text(f"valve makes naphtha number {i}")
    run = lambda: ingest.ingest_files(spark, f"file://{files}", f"file://{tmp_path}/out", paid(folder))
    at = run()
    assert calls(folder) == 3
    assert spark.read.parquet(at["edges"]).first()["support_count"] == 3
    (files / "3.txt").write_text("valve makes naphtha number 3")
    run()
    assert calls(folder) == 4 and spark.read.parquet(at["edges"]).first()["support_count"] == 4
    spark.conf.set("spark.graphloom.chunk_size", "20")
    spark.conf.set("spark.graphloom.chunk_overlap", "0")
    try:
        small = ingest.ingest_files(spark, f"file://{files}", f"file://{tmp_path}/small", paid(folder))
    finally:
        spark.conf.unset("spark.graphloom.chunk_size")
        spark.conf.unset("spark.graphloom.chunk_overlap")
    assert spark.read.parquet(small["chunks"]).count() == 8 == spark.read.parquet(small["extractions"]).count()
    index = vectors.read(spark, at["vectors"])
    assert index.count() == 4 == spark.read.parquet(at["chunks"]).count()
    asked = index.selectExpr("id qid", "vector")
    assert all(r["qid"] == r["id"] for r in vectors.search(asked, index, 1).collect())
