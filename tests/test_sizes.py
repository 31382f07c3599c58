"""Tables as larger inputs have them: of many files, with evidence that is only alike, and with many copies."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom import catalog
from graphloom.functions import text as tx
from graphloom.operators import quality

SF = "/root/testdata/sf0.001"


def test_stream_of_a_table_of_many_files(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    rows = lambda sf: sorted(map(tuple, catalog.queries()["stream_ingest"](spark, sf).collect()))
    assert rows(str(tmp_path)) == rows(SF)


def test_evidence_that_is_alike_is_located(spark):
    said = "the quick brown fox jumps over a lazy dog"
    texts = ["x. " + said, "x\nthe quick brown fox jumped over a lazy dog\ny", "nothing of it", "ﬁne。" + said.replace("fox", "box"), None]
    rows = spark.createDataFrame([(i, said, t) for i, t in enumerate(texts)], "i int, e string, t string")
    got = {r["i"]: r["located"] for r in quality.with_located(rows, F.col("e"), F.col("t"), "i").collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: False}


def test_questions_of_one_wording_are_asked_once(spark):
    from graphloom.operators import facts

    edges = spark.range(400).select(
        F.concat(F.lit("pump p"), (F.col("id") % 7).cast("string")).alias("source_name"), F.lit("FEEDS").alias("type"), F.concat(F.lit("tank "), (F.col("id") % 5).cast("string")).alias("target_name"),
        F.when(F.col("id") % 3 != 0, F.lit("said so")).alias("evidence"), (F.lit(0.6) + (F.col("id") % 40) / 100).alias("confidence"), (F.col("id") % 2 + 1).alias("support_count"), F.col("id").cast("string").alias("src_key"), F.lit("t").alias("dst_key"),
    )
    asked = spark.range(60).select(F.col("id").alias("qid"), F.concat(F.lit("what does pump p"), (F.col("id") % 3).cast("string"), F.lit(" feed?")).alias("question"))
    index, seen = facts.FactIndex.build(edges), []
    alone = index._top
    index._top = lambda questions, k: seen.append(questions.count()) or alone(questions, k)
    rows = index.top(asked, 5).select("qid", "src_key", "score", "rank").collect()
    assert seen == [3] and len(rows) == 300
    best = {q: [(r["src_key"], r["score"], r["rank"]) for r in sorted(rows, key=lambda r: r["rank"]) if r["qid"] == q] for q in range(60)}
    assert all(best[q] == best[q % 3] for q in range(60)) and best[0] != best[1]


def test_counted_ideals_are_those_of_all_gains(spark):
    from graphloom.operators import evaluation

    gains = spark.range(40).select((F.col("id") % 3).alias("qid"), F.col("id").alias("item"), F.lit(1.0).alias("gain"))
    hits = spark.range(45).select((F.col("id") % 3).alias("qid"), (F.col("id") / 3 + 1).cast("int").alias("rank"), (F.col("id") * 2).alias("item"))
    own = evaluation.even_ideals(gains.groupBy("qid").agg(F.count("item").alias("wanted")))
    few = gains.join(hits.select("qid", "item"), ["qid", "item"], "left_semi")
    rows = lambda df: sorted(map(tuple, df.select("qid", "k", "metric", "value").collect()))
    assert rows(evaluation.ranked_metrics(hits, few, own=own)) == rows(evaluation.ranked_metrics(hits, gains))


def test_the_gate_folds_a_few_chunks_at_a_time(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(quality, "_folded", str.upper)
    n = 2 * quality.FOLDED + 5
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([f"c{i}" for i in range(n)])], names=["source", "folded"])
    got = list(quality._fold_part([batch, batch.slice(0, 0)]))
    assert [b.num_rows for b in got] == [quality.FOLDED, quality.FOLDED, 5]
    assert [r for b in got for r in b.to_pylist()] == [{"source": i, "folded": f"C{i}"} for i in range(n)]


def test_plain_texts_need_no_python():
    import unicodedata

    stable = [chr(c) for a, z in ((0, 0x7F), (0x2018, 0x201D), (0x3001, 0x3002), (0x300A, 0x3011), (0x4E00, 0x9FFF)) for c in range(a, z + 1)]
    assert all(unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c) for c in stable)
    assert unicodedata.normalize("NFKC", tx.WIDE) == tx.NARROW


def test_keys_and_names_of_any_text_are_those_of_the_patterns(spark):
    import re
    import unicodedata

    blanks = [chr(c) for c in range(0x10000) if chr(c).isspace() and not 0x1C <= c <= 0x1F]
    assert set(tx.KEY_DROPPED) == {*blanks, *"-_./\\:：,，.;；()（）[]【】{}<>《》\"'“”‘’"}
    said = ["the Pump", " a  b", "a\tb\n", "Pump\n", "Ｐ１　ｘ", "H₂O", "é", "中文，。Ａ", "x" + "".join(blanks) + "y", "`a b`", "", None, "A1"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string").select("i", tx.nfkc(F.col("s")).alias("n"), tx.nfkc_each(F.array("s")).alias("e"), tx.match_key(F.col("s")).alias("k"), tx.normal_space(F.col("s")).alias("p"), tx.clean_evidence(F.col("s")).alias("v")).collect()
    for i, n, each, key, space, evidence in rows:
        normal = said[i] and unicodedata.normalize("NFKC", said[i])
        flat = re.sub(r"\s+", " ", normal or "").strip()
        assert (n, each, key, space, evidence) == (normal, [normal], re.sub(tx.KEY_DROPS, "", (normal or "").lower()), flat, flat.strip("` "))


def test_rows_of_one_row_group_are_dealt_out(spark, tmp_path):
    from graphloom.queries import gate

    spark.read.parquet(f"{SF}/documents.parquet").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:  # the table has parts enough, of which one holds all rows
        sizes = gate.extractions(spark, str(tmp_path)).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(sizes) >= 4


def test_the_graph_is_made_of_a_written_log(spark):
    plan = catalog.queries()["build_graph"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "EvalPython" not in plan


def test_metrics_of_all_ks_are_of_one_pass(spark):
    from graphloom.operators import evaluation

    hits = spark.createDataFrame([(1, r, i) for r, i in ((1, "a"), (2, "b"), (4, "a"), (5, "c"), (9, "d"))], "qid int, rank int, item string")
    gains = spark.createDataFrame([(1, "a", 1.0, True), (1, "c", 2.0, False), (1, "d", 1.0, True), (2, "a", 1.0, True)], "qid int, item string, gain double, expected boolean")
    facts = spark.createDataFrame([(1, 1, "s", "T", "o", "e", "1"), (1, 2, "s", "T", "o", "", "1"), (1, 4, None, None, None, "e", "2"), (1, 9, "x", "T", "o", "e", "2")], "qid int, rank int, source string, type string, target string, evidence string, page string")
    want = spark.createDataFrame([(1, "s", "T", "o"), (1, "x", "T", "o"), (2, "s", "T", "o")], "qid int, source string, type string, target string")
    ranked, linked = evaluation.ranked_metrics(hits, gains), evaluation.edge_metrics(facts, want)
    assert all("Union" not in df._jdf.queryExecution().optimizedPlan().toString() for df in (ranked, linked))
    got = {(r["qid"], r["metric"], r["k"]): r["value"] for df in (ranked, linked) for r in df.collect()}
    assert [got[1, "page_recall", k] for k in (3, 5, 10)] == [0.5, 0.5, 1.0] and got[2, "page_recall", 10] == 0.0
    assert [got[1, "triple_recall", k] for k in (3, 5, 10)] == [0.5, 0.5, 1.0] and got[2, "triple_recall", 3] == 0.0
    assert [got[1, "relation_precision", k] for k in (3, 5, 10)] == [1.0, 1.0, 1.0]
    assert [got[1, "relation_evidence_coverage", k] for k in (3, 5, 10)] == [0.5, 0.666667, 0.75]


def _mentions(spark):
    given = lambda c, n: F.when(F.col("id") % n != 0, F.concat(F.lit(c), (F.col("id") % n).cast("string")))
    return spark.range(600).select(
        F.lit("A").alias("src_label"), F.concat(F.lit("s"), (F.col("id") % 11).cast("string")).alias("src_key"), F.when(F.col("id") % 2 == 0, "T").otherwise("U").alias("type"), F.lit("B").alias("dst_label"), F.concat(F.lit("t"), (F.col("id") % 3).cast("string")).alias("dst_key"), (F.col("id") * 7 % 97).alias("seq"),
        F.concat(F.lit("e"), F.col("id").cast("string")).alias("evidence"), F.when(F.col("id") % 5 != 0, F.col("id") % 4 / 4).alias("confidence"), given("d", 7).alias("document"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), given("", 13).alias("page"), F.lit(1).alias("chunk_index"), given("r", 4).alias("source_ref"),
        F.array(F.concat(F.lit("f"), F.col("id").cast("string"))).alias("quality_flags"), F.when(F.col("id") % 3 != 0, 2).alias("support_count"), given("src", 5).alias("source"),
    )


def test_edges_of_mentions_are_those_of_their_state(spark):
    from graphloom.operators import graph

    once = _mentions(spark).filter("seq < 40").withColumn("dst_key", F.col("evidence"))
    rows = _mentions(spark).unionByName(once)
    got, want = (sorted(map(repr, df.collect())) for df in (graph.upsert_edges(rows), graph.edges_of(graph.edge_state(rows))))
    assert got == want and len(got) > 60


def test_mentions_of_edges_are_moved_once(spark):
    from graphloom.operators import graph
    from graphloom.plans import fixtures

    for rows in (_mentions(spark), fixtures.edge_rows(spark, SF)):
        moved = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange")
        assert moved(graph.upsert_edges(rows)) == moved(rows) + 1


def test_lines_alike_but_in_quantity_are_counted_apart(spark, tmp_path):
    lines, orders = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("lineitem", "orders"))
    one = lines.limit(1).localCheckpoint()
    one.withColumn("l_quantity", F.lit(10.0)).unionByName(one.withColumn("l_quantity", F.lit(50.0))).write.parquet(f"{tmp_path}/lineitem.parquet")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["kind"]: tuple(r)[1:] for r in catalog.queries()["counted_writes"](spark, str(tmp_path)).collect()}
    assert got["edges"] == (2, 1, 0, 1)


def test_no_side_of_an_evaluation_is_sent_whole(spark):
    for name in ("evaluate_modes", "mode_summary"):
        plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        # hits of chunks and of facts, and questions, are dealt by question once each; a summary is dealt once more
        assert "Broadcast" not in plan and plan.count("Exchange hashpartitioning(qid") == 3


def test_hits_of_no_question_are_not_measured(spark, tmp_path):
    customers, orders = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("customer", "orders"))
    customers.filter("c_custkey < 5").write.parquet(f"{tmp_path}/customer.parquet")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    rows = lambda sf: sorted(tuple(r) for r in catalog.queries()["evaluate_modes"](spark, sf).collect() if r["qid"] in {"c0", "c1", "c2", "c3", "c4"})
    got = rows(str(tmp_path))
    assert got == rows(SF) and len(got) == catalog.queries()["evaluate_modes"](spark, str(tmp_path)).count()


def test_metrics_in_a_row_are_those_of_rows(spark):
    """Ranks with several hits, gains that are null or of what is not expected, repeated triples and hits beyond the largest k."""
    from graphloom.functions import records
    from graphloom.operators import evaluation
    from graphloom.plans import evaluate

    asked = [("a", '["1-3", "9"]', '{"2": 2.0, "7": 0.5, "9": null}', '["s->T->o", "x->T->o"]'), ("b", None, None, None), ("c", '"4"', None, '"s->T->o"')]
    none = F.lit(None).cast("string")
    rows = spark.createDataFrame(asked, "qid string, expected_pages string, relevant_pages string, expected_triples string")
    questions = evaluate.samples(rows.select("*", F.lit("q").alias("question"), *(none.alias(c) for c in ("expected_chunks", "expected_source_refs", "relevant_chunks", "expected_entities", "expected_answer_keywords", "forbidden_answer_keywords"))))
    paged = [("a", 1, "7"), ("a", 1, "2, 3"), ("a", 4, "2"), ("a", 5, "9"), ("a", 8, "1"), ("a", 12, "3"), ("b", 1, "1")]
    hit = spark.createDataFrame(paged, "qid string, rank int, page string")
    hits = hit.select("*", *(none.alias(c) for c in ("id", "source", "document", "source_ref", "text")), *(F.lit(None).cast("int").alias(c) for c in ("index", "page_start", "page_end")))
    edges = [("a", 1, "s", "T", "o", "e", "1"), ("a", 2, "s", "T", "o", "", "2"), ("a", 4, "s", "", "o", "e", None), ("a", 9, "X", "t", "o", "e", "8"), ("b", 2, "s", "T", "o", "e", "1")]
    facts = spark.createDataFrame(edges, "qid string, rank int, source_name string, type string, target_name string, evidence string, page string").select("*", none.alias("document"), none.alias("source_ref"))
    got = {(r["qid"], r["metric"], r["k"]): r["value"] for r in evaluate.evaluate(questions, hits, facts).filter("mode = 'hybrid' and value is not null").collect()}
    gains = questions.select("qid", F.explode("page_gains").alias("item", "gain"), F.col("pages").alias("w")).select("qid", "item", "gain", F.array_contains("w", F.col("item")).alias("expected"))
    by_page = hits.select("qid", "rank", F.explode(records.item_pages(F.col("page"), F.col("page_start"), F.col("page_end"))).alias("item"))
    told = facts.withColumn("t", records.edge_triple(F.col("source_name"), F.col("type"), F.col("target_name"))).select("qid", "rank", "t.*", "evidence", "page")
    want = evaluation.ranked_metrics(by_page, gains).unionByName(evaluation.edge_metrics(told, questions.select("qid", F.explode("triples").alias("t")).select("qid", "t.*")))
    for r in want.filter("value is not null").collect():
        assert got.pop((r["qid"], r["metric"], r["k"])) == r["value"]
    assert {m for _, m, _ in got} == {"citation_hit", "citation_accuracy"}
    assert [got["a", "citation_accuracy", k] for k in (3, 5, 10)] == [0.75, 0.8, 0.666667]


def test_large_cells_have_seeds_and_no_edge_is_moved_whole(spark, monkeypatch):
    """Each cell of a name is beyond what is scored to find the best; a part of it still tells how good they are."""
    from graphloom.operators import facts

    monkeypatch.setattr(facts, "SEEDS", 100)
    monkeypatch.setattr(facts, "SAMPLED", 20)
    edges = spark.range(6000).select(
        F.concat(F.lit("pump p"), (F.col("id") % 2).cast("string")).alias("source_name"), F.lit("FEEDS").alias("type"), F.lit("tank").alias("target_name"), F.when(F.col("id") % 3 != 0, F.lit("said so")).alias("evidence"),
        (F.lit(0.6) + (F.col("id") % 20) / 50).alias("confidence"), F.lit(1).alias("support_count"), F.format_string("%05d", "id").alias("src_key"), F.lit("t").alias("dst_key"),
    )
    asked = spark.createDataFrame([(1, "what does pump p1 feed?")], "qid int, question string")
    index, scored = facts.FactIndex.build(edges), []
    assert not {"hay", "term", "level"} & set(index.facts.sparkSession.read.parquet(index.facts.inputFiles()[0]).columns)
    alone = index._scored
    index._scored = lambda pairs, of: scored.append(pairs.count()) or alone(pairs, of)
    got = [r["src_key"] for r in index.top(asked, 3).orderBy("rank").collect()]
    best = [r["src_key"] for r in edges.filter("source_name = 'pump p1' and evidence is not null").orderBy(F.desc("confidence"), "src_key").limit(3).collect()]
    assert got == best and 0 < scored[0] <= 6 * 100 and scored[1] <= 1500


def test_nodes_are_made_of_written_rows(spark):
    plan = catalog.queries()["graph_nodes"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "EvalPython" not in plan
