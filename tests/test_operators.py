"""Traps of single operators, with expected values worked out by hand."""

import itertools
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from graphloom.functions import records
from graphloom.functions import text as tx
from graphloom.functions.arrays import running
from graphloom.operators import chunking, evaluation, graph, pages, quality, retrieval
from graphloom.plans import answers, evaluate
from graphloom.plans import ingest as ingesting
from graphloom.sources import files
from graphloom.streaming import ingest


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize("n", [0, 1, 2599, 2600, 2601, 4950, 4951, 30000])
def test_chunk_count_is_the_loop(spark, n):
    want, at = 0, 0
    while n and True:
        want += 1
        if at + 2600 >= n:
            break
        at += 2350
    assert spark.range(1).select(chunking.chunk_count(F.lit(n)).alias("n")).first()["n"] == want


def test_chunks_know_their_pages(spark):
    text = "===== PAGE 3 =====\n" + "a" * 50 + "\n\n===== PAGE 4 =====\n" + "b" * 50
    rows = chunking.split_text(spark.createDataFrame([(text, "x.txt")], "text string, source string"), size=60, overlap=10).orderBy("index").collect()
    assert [(r["page_start"], r["page_end"]) for r in rows] == [(3, 3), (3, 4), (4, 4)]
    named = chunking.split_text(spark.createDataFrame([("abc", "doc_page_7.txt"), (None, "y"), ("  ", "z")], "text string, source string")).collect()
    assert [(r["page"], r["source_ref"]) for r in named] == [("7", "doc#page=7#chunk=1")]


@pytest.mark.parametrize(("n", "overlap"), [(n, o) for n in (1, 4, 5, 8, 9, 13) for o in (0, 1, 2)])
def test_buffered_windows_differ_by_the_tail_only(spark, n, overlap):
    rows = spark.createDataFrame([(1, p) for p in range(1, n + 1)], "doc int, page int")

    def got(buffered):
        spread = pages.windows(rows, "doc", 5, overlap, buffered=buffered)
        return sorted(tuple(sorted(r["p"])) for r in spread.groupBy("win").agg(F.collect_list("page").alias("p")).collect())

    buffer, want = [], []
    for p in range(1, n + 1):
        buffer.append(p)
        if len(buffer) == 5:
            want.append(tuple(buffer))
            buffer = buffer[-overlap:] if overlap else []
    if buffer:
        want.append(tuple(buffer))
    assert got(True) == sorted(want)
    assert got(False) == sorted(w for w in want if not any(set(w) < set(v) for v in want))


def test_bad_windows_are_refused(spark):
    with pytest.raises(ValueError):
        pages.windows(spark.createDataFrame([(1, 1)], "doc int, page int"), "doc", 2, 2)


def test_names_and_evidence(spark):
    assert one(spark, "　The  Big，Pump；", tx.clean_name) == "Big,Pump"
    assert one(spark, "ＡＢＣ　Ｐｕｍｐ，", tx.clean_name) == "ABC Pump" and one(spark, "ＡＢＣ　Ｐｕｍｐ，", tx.canonical_key) == "abcpump"
    assert one(spark, "ﬁne②", tx.match_key) == "fine2" and one(spark, "ｒｉｓｋ", tx.bad_name)
    assert one(spark, "x" * 200, tx.clean_evidence) == "x" * 180 + "..."
    assert one(spark, None, tx.match_key) == ""
    assert one(spark, "ﬁne Ａ", tx.nfkc) == "fine A" and one(spark, None, tx.nfkc) is None


def test_edge_upsert_takes_the_latest_of_equals(spark):
    rows = spark.createDataFrame([("A", "a", "T", "B", "b", s, f"e{s}", c, "d", 1, 1, str(s % 2), 1, f"r{s}", [f"f{s}"], 1, "src") for s, c in ((1, 0.9), (2, 0.9), (3, 0.5))], "src_label string, src_key string, type string, dst_label string, dst_key string, seq long, evidence string, confidence double, document string, page_start int, page_end int, page string, chunk_index int, source_ref string, quality_flags array<string>, support_count int, source string")
    r = graph.upsert_edges(rows).first()
    assert (r["evidence"], r["quality_flags"], r["support_count"], r["pages"]) == ("e2", ["f3"], 3, ["1", "0"])


def test_chunk_merge_keeps_the_first_best_and_resets_support(spark):
    rng = random.Random(1)
    rows = [(c, f"s{rng.randrange(2)}", "T", "t", i, rng.choice([0.7, 0.8, 0.9])) for c in range(20) for i in range(rng.randrange(9))]
    want: dict = {}
    for c, s, t, o, i, conf in rows:
        old = want.get((c, s, t, o))
        want[c, s, t, o] = (i, conf, 1) if old is None or conf > old[1] else (old[0], old[1], old[2] + 1)
    frame = spark.createDataFrame(rows, "chunk int, source_key string, type string, target_key string, pos int, confidence double")
    got = {(r["chunk"], r["source_key"], r["type"], r["target_key"]): (r["pos"], r["confidence"], r["support_count"]) for r in quality.merged_edges(frame, "chunk").collect()}
    assert got == want


def test_the_gate_reads_wide_names_and_infers_labels_in_order(spark):
    nodes = [("Ｐｕｍｐ　Ｐ１", "device", "a", ["Ｐ－１"]), (None, "Unit", None, None), ("risk", "Risk", "", None)]
    edges = [("valve", "PRODUCES", "naphtha", "valve makes naphtha"), ("valve", "has parameter", "level", "valve level"), ("valve", "PRODUCES", "naphtha", "valve makes naphtha")]
    text = "pump p1, valve makes naphtha. valve level. 阀门的主要组分是钢材。阀门的主要组分是钢材"
    schema = "source string, chunk int, text string, nodes array<struct<name:string,label:string,description:string,aliases:array<string>>>, relationships array<struct<source:string,type:string,target:string,evidence:string>>"
    rows = spark.createDataFrame([("s", 1, text, nodes, edges), ("s", 2, None, None, None), ("s", 3, "", [], [])], schema)
    got = {r["chunk"]: r for r in quality.gate(rows).collect()}
    assert [(n["name"], n["label"], n["aliases"]) for n in got[1]["nodes"]] == [("Pump P1", "Equipment", ["P-1"]), ("naphtha", "Material", []), ("钢材", "Material", []), ("level", "Parameter", []), ("valve", "Plant", []), ("阀门", "Product", [])]
    assert [(e["source_label"], e["type"], e["support_count"]) for e in got[1]["relationships"]] == [("Plant", "PRODUCES", 2), ("Plant", "HAS_PARAMETER", 1), ("Product", "HAS_COMPONENT", 2)]
    assert [d["reason"] for d in got[1]["dropped"]] == ["bad_name", "bad_name"] and got[2]["dropped_count"] == 0 and got[3]["relationships"] == []


def test_an_edge_of_very_many_mentions(spark):
    n = 1_000_000
    rows = spark.range(n).select(*(F.lit(c).alias(k) for k, c in zip(graph.EDGE_KEY, "ABCDE", strict=True)), F.col("id").alias("seq"), F.lit("e").alias("evidence"), (F.col("id") % 7 / 7).alias("confidence"), F.concat(F.lit("d"), (F.col("id") % 3).cast("string")).alias("document"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), (F.col("id") % 50).cast("string").alias("page"), F.lit(1).alias("chunk_index"), F.lit("r").alias("source_ref"), F.array(F.lit("f")).alias("quality_flags"), F.lit(1).alias("support_count"), F.lit("s").alias("source"))
    r = graph.upsert_edges(rows).first()
    assert (r["support_count"], r["documents"], r["pages"][:3], len(r["pages"])) == (n, ["d0", "d1", "d2"], ["0", "1", "2"], 50)


def test_states_merge_in_any_grouping(spark):
    rows = spark.createDataFrame([("A", "a", "T", "B", "b", s, f"e{s}", (0.9, 0.5, 0.9, None)[s % 4], f"d{s % 3}", 1, 1, str(s % 2), 1, None, [f"f{s}"], s, "src" if s > 2 else None) for s in range(12)], "src_label string, src_key string, type string, dst_label string, dst_key string, seq long, evidence string, confidence double, document string, page_start int, page_end int, page string, chunk_index int, source_ref string, quality_flags array<string>, support_count int, source string")
    whole = graph.upsert_edges(rows).first()
    parts = [graph.edge_state(rows.filter(F.col("seq") % 3 == k)) for k in range(3)]
    both = graph.merged(parts[2], graph.merged(parts[0], parts[1], graph.EDGE_KEY), graph.EDGE_KEY)
    assert graph.edges_of(both).first() == whole and whole["evidence"] == "e10" and whole["source"] == "src"


def test_chunks_of_a_long_text(spark):
    text = "".join(f"===== PAGE {i} =====\n{'é😀ab ' * 500}\n\n" for i in range(1, 1001))
    frame = spark.createDataFrame([(text, "x.txt")], "text string, source string").repartition(1)
    began = time.time()
    rows = chunking.split_text(frame).orderBy("index").collect()
    assert time.time() - began < 60
    body = text.strip()
    assert [r["text"] for r in rows] == [body[i : i + 2600] for i in range(0, max(1, len(body) - 250), 2350)]
    assert (rows[0]["page_start"], rows[-1]["page_end"]) == (1, 1000)


def test_page_spans_and_segments(spark):
    text = "intro\x01\n\n===== PAGE 2 =====\none\x01\n[Page 3]\n\ntwo"
    spans = spark.createDataFrame([(text,), ("none",), ("",), (None,)], "t string").select(tx.page_spans(F.col("t")).alias("s"), tx.page_segments(F.col("t")).alias("g")).collect()
    assert [(text[s["start"] : s["end"]].strip()[:10], s["page"]) for s in spans[0]["s"]] == [("===== PAGE", 2), ("[Page 3]\n\n", 3)]
    assert [(g["page"], g["text"].strip()) for g in spans[0]["g"]] == [(2, "one\x01"), (3, "two")] and not spans[1]["s"] and not spans[2]["s"]
    found = spark.createDataFrame([(text,)], "t string").select(*chunking.page_range(F.array().cast("array<struct<page:int,start:int,end:int>>"), F.lit(0), F.lit(5), F.col("t"))).first()
    assert tuple(found) == (2, 3)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5000])
def test_running_sums(spark, n):
    got = spark.range(1).select(running(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: (x % 7).cast("int")) if n else F.array().cast("array<int>")).alias("r")).first()["r"]
    assert got == list(itertools.accumulate(i % 7 for i in range(1, n + 1)))


def test_answers_by_a_provider(spark):
    q = spark.createDataFrame([(1, "alpha", [1.0, 0.0]), (2, "beta", [0.0, 1.0])], "qid int, question string, vector array<float>")
    c = spark.createDataFrame([("a::1", [1.0, 0.0], "alpha text", None, None, "My_Doc_page_7.txt"), ("b::1", [0.0, 1.0], "beta text", "B", "2", "x")], "id string, vector array<float>, text string, document string, page string, source string")
    e = spark.createDataFrame([("alpha", "T", "z", "alpha is z", 0.9, 2, "a", "z", "B", "3")], "source_name string, type string, target_name string, evidence string, confidence double, support_count int, src_key string, dst_key string, document string, page string")

    def provider(question, context):
        if question == "beta":
            raise ValueError("no model")
        return f"{question}: {len(context)}"

    got = {r["qid"]: r for r in answers.ask(q, c, e, 1, 1, provider).collect()}
    assert got[1]["context"].startswith("[文档] My Doc 第 7 页\nalpha text\n\n[图谱] alpha --T--> z") and got[1]["citations"] == ["My Doc，第 7 页", "B，第 3 页"]
    assert got[1]["answer"] == f"alpha: {len(got[1]['context'])}" and got[2]["answer"] == answers.NO_MODEL + "\n\nno model"
    assert answers.local_answer("q", " ") == answers.NOTHING_FOUND


def test_extraction_is_read_mended_or_given_up():
    calls = []

    def provider(text, error):
        calls.append(error)
        return "{bad" if len(calls) < 3 else '```json\n{"nodes": [{"name": 5}], "relationships": 7}\n```'

    assert ingesting.extracted_one("t", provider, None)[2:] == ("Expecting property name enclosed in double quotes: line 1 column 2 (char 1)", "{bad")
    assert ingesting.extracted_one("t", provider, None)[0] == [{"name": "5", "label": None, "description": None, "aliases": None}]
    assert ingesting.extracted_one("t", lambda t, e: "{bad", lambda content, error: '{"relationships": [{"source": "a"}]}')[1][0]["source"] == "a"
    with pytest.raises(ValueError):
        ingesting.parsed("[1]")


def test_hash_vector_repeats_short_runs():
    assert retrieval.hash_tokens("Ab_1 催化剂 水") == ["ab_1", "催化", "化剂", "催化剂", "水", "水"]
    assert math.isclose(float((retrieval.hash_vector("a b c") ** 2).sum()), 1.0)
    assert not retrieval.hash_vector("").any()


def test_decisions(spark):
    def decided(*rows):
        return evaluation.decide(spark.createDataFrame(list(rows), "mode string, metric string, value double")).first()["decision"]

    gain, risk = ("triple_recall@5", "noise_edge_rate@5")
    assert decided(("hybrid", gain, 0.4)) == "unknown" and decided(("vector", "other", 0.1), ("hybrid", "other", 0.4)) == "neutral"
    assert decided(("vector", gain, 0.4), ("hybrid", gain, 0.5)) == "helpful"
    assert decided(("vector", gain, 0.4), ("hybrid", gain, 0.5), ("vector", "citation_accuracy@5", 0.4), ("hybrid", "citation_accuracy@5", 0.3)) == "mixed_helpful"
    assert decided(("vector", gain, 0.4), ("hybrid", gain, 0.5), ("vector", risk, 0.1), ("hybrid", risk, 0.3)) == "risky"
    assert decided(("vector", gain, 0.4), ("hybrid", gain, 0.3)) == "neutral"
    rows = evaluation.compare(spark.createDataFrame([("vector", risk, 0.5), ("hybrid", risk, 0.4)], "mode string, metric string, value double")).first()
    assert (rows["versus_vector"], rows["versus_graph"]) == ("提升", "无法比较")
    assert evaluation.displayed(evaluation.compare(spark.createDataFrame([("hybrid", "b", 0.5), ("hybrid", "a", 0.4)], "mode string, metric string, value double"))).orderBy("place").first()["metric"] == "a"
    assert records.int_list("3, 5,-1, ") == [3, 5]


def test_files(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes("催化".encode("gbk"))
    (tmp_path / "b.md").write_text("ok")
    (tmp_path / "c.csv").write_text("no")
    assert {(r["source"], r["text"]) for r in files.read_texts(spark, str(tmp_path)).collect()} == {("a.TXT", "催化"), ("b.md", "ok")}
    (tmp_path / "q.jsonl").write_text('# note\n{"question": "x"}\n\n{"id": "k", "question": "y"}\n')
    rows = files.read_json_lines(spark, str(tmp_path / "q.jsonl"), "id string, question string", "id").collect()
    assert {(r["id"], r["question"]) for r in rows} == {("q0002", "x"), ("k", "y")}
    assert files.read_log(spark, str(tmp_path / "missing.json")).count() == 0
    (tmp_path / "bad.jsonl").write_text('{"id": "k"}\n\n{oops\n')
    with pytest.raises(Exception, match="invalid JSON at line 3"):
        files.read_json_lines(spark, str(tmp_path / "bad.jsonl"), "id string").collect()
    with pytest.raises(FileNotFoundError):
        files.source_files(spark, str(tmp_path), "missing.txt")
    with pytest.raises(ValueError, match="not supported"):
        files.source_files(spark, str(tmp_path), "c.csv")
    assert [r["name"] for r in files.source_names(spark, str(tmp_path)).collect()] == ["a.TXT", "b.md"]
    assert {r["name"] for r in files.source_files(spark, str(tmp_path)).collect()} == {"a.TXT", "b.md"}
    (tmp_path / "only").mkdir()
    (tmp_path / "only" / "d.csv").write_text("no")
    with pytest.raises(FileNotFoundError):
        files.source_files(spark, str(tmp_path / "only"))


def test_gold_files(spark, tmp_path):
    row = '{"id": "1", "entities": ["The Pump", {"name": "Unit A"}], "triples": [["Pump", "has unit", "Unit A"]]}'
    other = '{"expected_entities": ["pump"], "expected_triples": [{"source": "x", "relation": "owns", "target": "y"}]}'
    for name, text in (("g.jsonl", f"{row}\n{other}\n"), ("l.json", f"[{row}, {other}]"), ("i.json", f'{{"items": [{row}, {other}]}}'), ("o.json", f'{{"gold": [{row}, {other}]}}')):
        (tmp_path / name).write_text(text)
        entities, triples = evaluate.gold(files.read_gold(spark, str(tmp_path / name)), "")
        assert {r["entity"] for r in entities.collect()} == {"pump", "unita"}
        assert {tuple(r) for r in triples.collect()} == {("pump", "HAS_UNIT", "unita"), ("x", "OWNS", "y")}


def test_preparing_and_reading_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "my notes!.md").write_text("  hello \n\n")
    (tmp_path / "in" / "scan.pdf").write_bytes(b"|".join(f"page {i} {'x' * 30}".encode() for i in range(1, 6)))
    (tmp_path / "in" / "image.PDF").write_bytes(b"a|b")
    extract = lambda raw: raw.decode().split("|")
    ocr = lambda raw: [f"seen {p}" for p in raw.decode().split("|")]
    got = {r["source"]: r["text"] for r in ingesting.prepare(spark, str(tmp_path / "in"), extract=extract, ocr=ocr, spec="1-2,4", window=2, overlap=1).collect()}
    assert set(got) == {"my_notes.txt", "scan_pages_0001_0002.txt", "scan_page_0004.txt", "image_pages_0001_0002.txt"}
    assert got["my_notes.txt"] == "hello\n" and got["image_pages_0001_0002.txt"] == "===== PAGE 1 =====\nseen a\n\n===== PAGE 2 =====\nseen b"
    single = ingesting.prepare(spark, str(tmp_path / "in"), extract=extract, ocr=ocr, spec="2", window=0)
    assert {r["source"] for r in single.collect()} == {"my_notes.txt", "scan_page_0002.txt", "image_page_0002.txt"}
    whole = {r["source"]: r["text"] for r in files.read_documents(spark, str(tmp_path / "in"), extract).collect()}
    assert whole["image.PDF"] == "[Page 1]\na\n\n[Page 2]\nb" and whole["my notes!.md"] == "  hello \n\n"
    with pytest.raises(ValueError, match="page provider"):
        files.read_documents(spark, str(tmp_path / "in"))


def test_snapshots_and_outputs(spark, tmp_path):
    at, nodes, edges = str(tmp_path / "g"), spark.createDataFrame([("A", "a", None)], "label string, canonical_key string, name string"), spark.createDataFrame([("A", "a", "T", "A", "b")], ", ".join(f"{c} string" for c in graph.EDGE_KEY))
    files.snapshot(nodes, edges, at, "r1")
    files.snapshot(nodes.limit(0), edges, at, "r2")
    got = files.load_snapshot(spark, at)
    assert got[0].count() == 0 and got[1].count() == 1
    assert graph.backfilled(nodes.withColumn("canonical_key", F.lit(None).cast("string")).withColumn("name", F.lit("n"))).first()["canonical_key"] == "n"
    left, kept = graph.without(nodes, edges, nodes)
    assert left.count() == kept.count() == 0
    files.write_csv(spark.createDataFrame([('a "b",\nc', None)], "q string, v double"), str(tmp_path / "csv"), mark=True)
    assert spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "csv")).first()[0] == 'a "b", c'
    files.write_table(nodes, str(tmp_path / "t"), "label")
    files.write_table(nodes, str(tmp_path / "t"), "label")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_a_graph_is_built_resumed_and_read(spark, tmp_path):
    texts = spark.createDataFrame([("a.txt", "valve makes naphtha here"), ("b.txt", "valve makes naphtha there")], "source string, text string")
    provider = lambda text, error: '{"nodes": [{"name": "valve", "label": "Unit"}], "relationships": [{"source": "valve", "type": "PRODUCES", "target": "naphtha", "evidence": "valve makes naphtha"}]}'
    log, nodes, edges = ingesting.build_graph(texts.filter("source = 'a.txt'"), provider)
    assert edges.first()["documents"] == ["a"] and nodes.count() == 2
    log.write.parquet(str(tmp_path / "log"))  # a log is a table: later runs read it
    log = spark.read.parquet(str(tmp_path / "log"))
    more = ingesting.build_graph(texts, lambda t, e: "{" if "here" in t and "there" not in t else provider(t, e), log=log)
    assert more[2].first()["support_count"] == 2 and {r["name"]: r["support_count"] for r in more[1].collect()} == {"valve": 2, "naphtha": 2}


def test_identifiers_are_checked(spark):
    with pytest.raises(Exception, match="not allowed: X"):
        spark.createDataFrame([("X",)], "v string").select(tx.safe_identifier(F.col("v"), ("A",))).collect()


def test_stream_windows(spark, tmp_path):
    rows = spark.createDataFrame([("d", p, f"t{p}", p == 6) for p in (1, 2, 3, 5, 6)], "doc string, page int, text string, last boolean")
    rows.write.parquet(str(tmp_path / "in"))
    stream = ingest.page_stream(spark, str(tmp_path / "in"), "doc string, page int, text string, last boolean")
    query = ingest.buffered_windows(stream, 2, 1).writeStream.format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r["first"], r["last"]) for r in spark.table("w").collect())
    assert got == [(1, 2), (2, 3), (3, 3), (5, 6), (6, 6)]


def test_writes_count_what_they_see_and_refuse_equal_keys(spark, tmp_path):
    schema = "label string, canonical_key string, seq long, name string, description string, aliases array<string>, support_count int, source string, document string, page string"
    rows = [("A", f"k{i % 3}", i, "n" if i % 5 else None, "", None, 1, "s", "d", None) for i in range(20)] + [("", "x", 99, "n", "", None, 1, "s", "d", None)]
    got = graph.write_counted(spark.createDataFrame(rows, schema).repartition(4), str(tmp_path / "n"), "nodes")
    assert got == {"attempted": 21, "refused": 5, "merged": 13, "written": 3} and spark.read.parquet(str(tmp_path / "n")).count() == 3
    pairs = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 1, "z")], "k string, n int, v string")
    graph.write_unique(pairs, str(tmp_path / "u"), "k", "n")
    assert spark.read.parquet(str(tmp_path / "u")).count() == 3
    with pytest.raises(Exception, match="more than once: a, 1"):
        graph.write_unique(pairs.unionByName(pairs.limit(1)), str(tmp_path / "v"), "k", "n")
    assert not (tmp_path / "v" / "_SUCCESS").exists()
