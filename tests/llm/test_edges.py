"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import time

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from graphloom.llm import ann, fingerprints, licenses, lm_scoring, mixing, near_dedup, packing, pii, toxicity, url_filters

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, row_id long, score double, target string, rank int, word string, n long, digest string, spans string, held string, url int, `rng` int"
LONG = "x" * 150_000
MANY = "alpha beta gamma " * 20_000


def rows():
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, LONG), (5, MANY), (6, "one two three"), (7, "same words here again and again"), (7, "same words here again and again"), (None, "no id at all but words"), (8, "same words here again and again"), (9, "mail a.b@c.de, call +1 (555) 555-0101; 4111111111111111; 999.1.1.1; 10.0.0.1"), (10, "é" * 40 + " \U0001f600 ok")]
    return [(i, t, None if i == 2 else "en", None if i in (3, 6) else f"src{(i or 0) % 2}", None if t is None else len(t), 1, "k", 2, 0.5, "t", 3, "w", 4, "d", "s", "h", 5, 6) for i, t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(7, 1, 1), (7, 1, 0), (6, 0, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


OPS = {
    "lm": lm_scoring.lm_score, "fingerprints": fingerprints.fingerprints, "near": near_dedup.near_dedup, "mix": mixing.mix,
    "licenses": licenses.scan, "pii": pii.find,
}


@pytest.mark.parametrize("name", OPS)
def test_every_row_has_a_result(name, docs, none):
    got = OPS[name](docs).collect()
    assert len(got) == 12
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows())
    assert OPS[name](none).count() == 0


def test_toxicity(docs, none, labels):
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 12 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1
    assert toxicity.toxicity(none, labels).count() == 0
    assert toxicity.toxicity(docs, labels.limit(0)).count() == 12


def test_lm_values(docs):
    got = {r["doc_id"]: r for r in lm_scoring.lm_score(docs).collect()}
    assert got[1]["n_tokens"] == got[3]["n_tokens"] == 1 and got[None]["held_out"]
    assert got[5]["n_tokens"] == 60_001


def test_near_values(docs):
    got = {r["doc_id"]: r for r in near_dedup.near_dedup(docs).collect()}
    assert got[8]["component_id"] == 7 and not got[8]["kept"] and got[7]["kept"]
    assert got[1]["n_shingles"] == 0 and got[1]["component_id"] == 1
    assert got[6]["n_shingles"] == 1 and got[None]["component_id"] is None and got[None]["kept"]
    assert got[5]["n_shingles"] == 3


def test_rows_of_one_id_are_one_document(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen fourteen"
    rows = spark.createDataFrame([(3, b), (5, a), (5, b), (9, a), (9, ""), (12, "other words that stand alone in here")], "doc_id long, text string")
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_dedup(rows).collect()]
    assert sorted(got) == [(3, 3, True), (5, 3, False), (5, 3, False), (9, 3, False), (9, 3, False), (12, 12, True)]


def test_long_runs_take_no_square_time(spark):
    began = time.time()
    assert not toxicity.rules("A" * 150_000 + " !") and toxicity.rules("a" * 150_000 + "*" * 150_000) == [4]
    assert time.time() - began < 2
    many = spark.createDataFrame([(1, " ".join(f"a{i}@b.c w{i}" for i in range(20_000)))], "doc_id long, text string")
    began = time.time()
    assert pii.find(many).first()["n_email"] == 20_000
    assert pii.sanitise(many).first()["text"].count("<EMAIL>") == 20_000
    assert time.time() - began < 90


def test_pii_values(docs):
    got = {r["doc_id"]: r for r in pii.find(docs).collect()}
    assert (got[9]["n_email"], got[9]["n_ip"], got[9]["n_card"], got[9]["n_phone"]) == (1, 1, 1, 1)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[9] == "mail <EMAIL>, call <PHONE>; <CARD>; 999.1.1.1; <IP>" and clean[1] is None and clean[4] == LONG


def test_packing(docs, none):
    got = packing.pack(docs).collect()
    assert sum(r["length"] for r in got if r["doc_id"] == 1) == 1
    assert packing.pack(none).count() == 0
    for group in {r["sequence_id"] for r in got}:
        own = sorted((r["offset"], r["length"]) for r in got if r["sequence_id"] == group)
        used = sum(n for _, n in own)
        assert used == 4096 or used & (used - 1) == 0
        assert all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:], strict=False)) and own[0][0] == 0


def test_urls(spark):
    schema = "page_id long, url string, html string, host string, tokens int, verdict string"
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?q#f", "http://example.com/en/1", "http://a.net/es/", "http://a.net", "x://net/fr/" + "y/" * 5000, "http://b.org/es/?a&a=1&b"]
    pages = spark.createDataFrame([(i, u, "", "h", 1, "v") for i, u in enumerate([*urls, urls[5]])], schema)
    got = sorted(url_filters.filter_urls(pages).collect(), key=lambda r: r["page_id"])
    assert [r["rule"] for r in got] == [None, None, None, None, "www.example.com/en/", "example.com/en/", "net/es/", None, "net/fr/", None, "example.com/en/"]
    assert (got[0]["host"], got[0]["path"], got[2]["host"], got[4]["host"], got[4]["path"], got[7]["path"]) == ("", "", "", "www.example.com", "/en/x", "")
    assert url_filters.filter_urls(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filters.filter_urls(pages.filter("page_id < 4")).collect()} == {"allow"}


def test_vectors(spark):
    v = [1.0, 0.0, 0.0]
    data = [(0, v), (1, v), (2, [0.0, 2.0, 0.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 2.0]), (6, [float("nan"), 1.0, 1.0]), (7, [float("inf"), 1.0, 1.0]), (8, []), (100, [1.0, 0.0]), (200, v), (200, v), (None, v), (9, v)]
    frame = spark.createDataFrame([(i, x, 1, "s") for i, x in data], "vec_id long, embedding array<float>, rank int, score string")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(frame).collect())
    assert [g[2] for g in got if g[0] == 0] == [1, 9, 200, 200, 2]
    assert [g[2] for g in got if g[0] == 200] == [0, 1, 9, 2] and not [g for g in got if g[0] == 100]
    assert ann.nearest(frame.limit(0)).count() == 0


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages(stage, spark, docs, none, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    run = dict(corpus_pipeline.STAGES)[stage]
    got = run(spark, docs, str(tmp_path))
    if stage != "packing":
        assert got.columns == list(corpus_pipeline.COLUMNS)
    got.write.parquet(str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    if stage == "near_dedup":
        assert sorted(r["doc_id"] or 0 for r in back.collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 9, 10]
        shared = spark.createDataFrame([(1, "a b c d e f g"), (1, "h i j k l m n"), (1, "a b c d e f g"), (None, "x"), (None, "x"), (None, "y")], "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "1L n_chars")
        assert sorted((r["doc_id"] or 0, r["text"]) for r in run(spark, shared, str(tmp_path)).collect()) == [(0, "x"), (0, "y"), (1, "a b c d e f g"), (1, "h i j k l m n")]
    if stage in ("toxicity", "pii"):
        assert back.count() == 12
    assert run(spark, none, str(tmp_path)).count() == 0


def test_mixing_takes_what_it_plans(spark, docs):
    plan = {(r["doc_id"], r["size"]): r["taken"] for r in mixing.mix(docs).collect()}
    assert all(t % max(s, 1) == 0 and t <= 3 * s for (_, s), t in plan.items())
    mixed = corpus_pipeline.mixed(spark, docs, "").withColumn("w", mixing.word_count(F.col("text"))).groupBy("doc_id").agg(F.sum("w").alias("w")).collect()
    taken = {}
    for r in mixing.mix(docs).collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"]
    assert all(taken[r["doc_id"]] == r["w"] for r in mixed)
