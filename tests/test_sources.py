"""Numbered lines by splits, snapshots that serve when the source is down, settings and health."""

import pytest

from graphloom.plans import answers, settings
from graphloom.sources import files


def test_lines_are_numbered_as_a_reader_counts(spark, tmp_path):
    texts = {f"{k}.jsonl": "".join(("\n" if i % 5 == 0 else f"# note {i}\n" if i % 7 == 0 else '{"v": "%s"}%s' % ("x" * (i % 90), "\r\n" if i % 2 else "\n")) for i in range(700 + k)) for k in range(3)}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000b")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        lines = files.numbered_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 20
        got = {(r["file"].rsplit("/", 1)[-1], r["number"]): r["line"] for r in lines.collect()}
        ids = {r["id"] for r in files.read_json_lines(spark, str(tmp_path / "1.jsonl"), "id string, v string", "id").collect()}
        (tmp_path / "bad").mkdir()
        (tmp_path / "bad" / "b.jsonl").write_text(texts["2.jsonl"] + "{oops\n")
        with pytest.raises(Exception, match="invalid JSON at line 703"):
            files.read_json_lines(spark, str(tmp_path / "bad"), "v string").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = {(name, n): line for name, text in texts.items() for n, line in enumerate(text.splitlines(), 1)}
    assert got == want
    assert ids == {f"q{n:04d}" for (name, n), line in want.items() if name == "1.jsonl" and line and not line.startswith("#")}


def test_the_snapshot_serves_when_the_source_is_down(spark, tmp_path):
    nodes, edges = spark.createDataFrame([("A", "a")], "label string, canonical_key string"), spark.createDataFrame([("e",)], "type string")
    assert files.refreshed(spark, str(tmp_path), "r1", lambda: (nodes, edges))[2] is None

    def down():
        raise ConnectionError("no route")

    n, e, error = files.refreshed(spark, str(tmp_path), "r2", down)
    assert (n.count(), e.count(), error) == (1, 1, "no route")


def test_settings(spark, monkeypatch):
    assert settings.setting(spark, "chunk_size") == 2600 and settings.settings(spark)["workers"] == 3
    monkeypatch.setenv("GRAPHLOOM_ZOOM", "3.5")
    assert settings.setting(spark, "zoom") == 3.5
    provider = lambda q, c: "said"
    assert settings.model(spark, provider) is provider and settings.model(spark, None) is answers.local_answer
    spark.conf.set("spark.graphloom.model", "false")
    try:
        assert settings.model(spark, provider) is answers.local_answer
        spark.conf.set("spark.graphloom.model", "perhaps")
        with pytest.raises(ValueError, match="true or false"):
            settings.setting(spark, "model")
    finally:
        spark.conf.unset("spark.graphloom.model")


def test_health(spark):
    ok = lambda: spark.range(3)
    got = {r["need"]: (r["ok"], r["detail"]) for r in settings.health(spark, {"a": ok, "b": lambda: spark.range(0), "c": lambda: spark.read.parquet("/nowhere")}).collect()}
    assert got["a"] == (True, "") and got["b"] == (True, "empty") and not got["c"][0] and "/nowhere" in got["c"][1]


def test_pages_are_rendered_and_read():
    provider = files.by_ocr(lambda raw, zoom: [(raw[:1], zoom), (raw[1:], zoom)], lambda image: f"{image[0].decode()}x{image[1]}", 3.0)
    assert provider(b"ab") == ["ax3.0", "bx3.0"]
