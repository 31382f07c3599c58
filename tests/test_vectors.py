"""The stored vector index against brute force, its versions, and what happens without it."""

import numpy as np
import pytest

from graphloom.operators import retrieval, vectors
from graphloom.plans import answers


def rows(seed, n, dim=24, ties=False):
    rng = np.random.default_rng(seed)
    x = rng.integers(-1, 2, (n, dim)).astype(float) if ties else rng.normal(size=(n, dim))
    x[n // 2] = 0
    return [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]


def brute(asked, kept, k):
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    return {q: sorted(((-round(float(unit(v) @ unit(w)), 6) + 0.0, i) for i, w in kept))[:k] for q, v in asked}


def found(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r["qid"], []).append((-r["score"] + 0.0, r["id"]))
    return out


@pytest.mark.parametrize("ties", [False, True])
def test_search_is_brute_force(spark, tmp_path, monkeypatch, ties):
    """Also where scores tie by the hundred, vectors are zero, and questions come in rounds."""
    monkeypatch.setattr(vectors, "HELD_VALUES", 24 * 9)
    monkeypatch.setattr(vectors, "SPARE", 2)
    kept, asked = rows(1, 700, ties=ties), rows(2, 25, ties=ties)
    frame = spark.createDataFrame(kept, "id long, vector array<double>").repartition(5)
    questions = spark.createDataFrame([*asked, (99, None)], "qid long, vector array<double>")
    path = f"file://{tmp_path}/index"
    assert vectors.create(frame, path) == 0 == vectors.create(frame.limit(0), path)
    got, want = found(vectors.search(questions, vectors.read(spark, path), 4)), brute(asked, kept, 4)
    assert got.keys() == want.keys()
    for q in want:
        assert [s for s, _ in got[q]] == pytest.approx([s for s, _ in want[q]], abs=2e-6)
        assert [i for _, i in got[q]] == [i for _, i in want[q]] or ties is False
    exact = retrieval.top_chunks(questions, frame, 4)
    assert vectors.recall(vectors.search(questions, vectors.read(spark, path), 4), exact) >= 0.99


def test_more_is_asked_than_there_is(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    vectors.create(spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "id long, vector array<float>"), path)
    asked = spark.createDataFrame([(7, [1.0, 1.0])], "qid long, vector array<double>")
    assert [tuple(r) for r in vectors.search(asked, vectors.read(spark, path), 4).collect()] == [(7, 1, 0.707107, 1)]
    assert vectors.search(asked.limit(0), vectors.read(spark, path), 4).count() == 0


def test_versions(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    frame = lambda data: spark.createDataFrame(data, "id long, vector array<double>")
    ids = lambda: {(r["id"], r["vector"][0]) for r in vectors.read(spark, path).collect()}
    with pytest.raises(vectors.NoIndex):
        vectors.read(spark, path)
    assert vectors.refresh(frame([(1, [1.0, 0.0]), (2, [2.0, 0.0])]), path) == 0
    assert vectors.refresh(frame([(2, [3.0, 0.0]), (3, [4.0, 0.0])]), path, frame([(1, [0.0])])) == 1
    assert ids() == {(2, 3.0), (3, 4.0)}
    # a version that was not finished is not read, and the next one replaces it
    vectors._write(frame([(9, [9.0, 0.0])]), path, 2)
    assert ids() == {(2, 3.0), (3, 4.0)}
    assert vectors.refresh(frame([(4, [5.0, 0.0])]), path) == 2 and ids() == {(2, 3.0), (3, 4.0), (4, 5.0)}
    assert sorted(p.name for p in (tmp_path / "index").glob("v=*")) == ["v=1", "v=2"]
    assert vectors.drop(spark, path) and not vectors.drop(spark, path) and vectors.versions(spark, path) is None
    asked = spark.createDataFrame([(7, [1.0, 1.0])], "qid long, vector array<double>")
    item = vectors.items(asked, path, 4).first()
    assert item["qid"] == 7 and item["id"] is None and item["error"].startswith(vectors.FAILED)


def test_bytes_are_as_near_as_they_say():
    x = vectors.unit(np.random.default_rng(3).normal(size=(500, 64)))
    code, scale, off = vectors.encode(x)
    assert (np.linalg.norm(x - code * scale[:, None].astype(float), axis=1) <= off).all() and off.max() < 0.03


def test_answers_read_the_index_and_go_on_without_it(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    data = [(f"d::{i}", [float(v) for v in x], f"text {i}", "doc", str(i), "doc.txt") for i, (_, x) in enumerate(rows(4, 40))]
    chunks = spark.createDataFrame(data, "id string, vector array<double>, text string, document string, page string, source string")
    edges = spark.createDataFrame([("gas", "oil", "T", "gas is no oil", 0.9, 1, "a", "b", "doc", "3")], "source_name string, target_name string, type string, evidence string, confidence double, support_count int, src_key string, dst_key string, document string, page string")
    asked = spark.createDataFrame([(i, f"what of gas {i}", x) for i, x in rows(5, 3)], "qid long, question string, vector array<double>")
    vectors.create(chunks, path)
    with_index = {r["qid"]: r for r in answers.ask(asked, chunks, edges, index=path).collect()}
    without = {r["qid"]: r for r in answers.ask(asked, chunks, edges).collect()}
    assert {q: (r["context"], r["citations"]) for q, r in with_index.items()} == {q: (r["context"], r["citations"]) for q, r in without.items()}
    assert all(r["error"] is None for r in with_index.values())
    vectors.drop(spark, path)
    left = answers.ask(asked, chunks, edges, index=path).collect()
    assert len(left) == 3 and all(r["error"].startswith(vectors.FAILED) and r["n_parts"] == 1 for r in left)
