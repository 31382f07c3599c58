"""Evaluation of every customer's question in all modes: orders as ranked hits and facts, JSON of several shapes as what is expected."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.operators import evaluation, retrieval
from graphloom.plans import evaluate
from graphloom.plans.fixtures import read
from graphloom.registry import query


def _ranked(spark, sf):
    o = F.col("o_orderkey")
    rows = read(spark, sf, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("qid"), F.col("o_custkey").alias("c"), o.alias("o"))
    # ranked where a question's hits are wanted together: orders are dealt by question once
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("o"))
    return rows.withColumn("rank", rank).filter("rank <= 10").withColumn("p", (F.col("o") % 9 + 1).cast("int"))


def _text(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def chunk_hits(spark, sf):
    o, p = F.col("o"), F.col("p")
    return _ranked(spark, sf).select("qid", "rank", _text("ch", o % 20).alias("id"), F.lit("s").alias("source"), (o % 20 + 1).cast("int").alias("index"), _text("doc", o % 3).alias("document"), F.when(o % 5 != 0, p.cast("string")).alias("page"), p.alias("page_start"), (p + 1).alias("page_end"), _text("ref", o % 20).alias("source_ref"), _text("text ", o).alias("text"))


def fact_hits(spark, sf):
    o, p = F.col("o"), F.col("p")
    return _ranked(spark, sf).select("qid", "rank", _text("Customer ", F.col("c")).alias("source_name"), F.lit("ORDERED").alias("type"), _text("Part ", o % 6).alias("target_name"), F.when(o % 3 != 0, _text("order ", o)).alias("evidence"), _text("doc", o % 3).alias("document"), F.when(o % 4 != 0, p.cast("string")).alias("page"), _text("e", o % 8).alias("source_ref"))


def questions(spark, sf):
    c = F.col("c_custkey")
    pages = F.when(c % 4 == 0, F.lit('"2-3"')).when(c % 4 == 1, F.lit('[1, "4"]')).when(c % 4 == 2, F.lit("5"))
    triples = F.when(c % 3 != 2, _text('["Customer ', c, ' -> ordered -> Part 2", {"source": "Customer ', c, '", "type": "ORDERED", "target": "Part 3"}]'))
    rows = read(spark, sf, "customer").select(
        _text("c", c).alias("qid"), _text("What did Customer ", c, " order?").alias("question"), pages.alias("expected_pages"), F.when(c % 3 == 0, F.lit('{"2": 2.0, "9": 0.5}')).alias("relevant_pages"), F.when(c % 2 == 0, F.lit('["ch3", {"source_ref": "ref7"}]')).alias("expected_chunks"), F.when(c % 5 == 0, F.lit('"s::4"')).alias("expected_source_refs"),
        F.lit(None).cast("string").alias("relevant_chunks"), _text('["Customer ', c, '", "Part 1", "Nobody"]').alias("expected_entities"), triples.alias("expected_triples"), F.lit('["Customer", "zz"]').alias("expected_answer_keywords"), F.when(c % 2 == 0, F.lit('["did"]')).alias("forbidden_answer_keywords"),
    )
    return evaluate.samples(rows)


def _metrics(spark, sf, **more):
    return evaluate.evaluate(questions(spark, sf), chunk_hits(spark, sf), fact_hits(spark, sf), **more)


BASE = """
WITH q AS (SELECT 'c' || c_custkey AS qid, c_custkey AS c FROM customer), ks AS (SELECT unnest([3, 5, 10]) AS k), modes AS (SELECT unnest(['vector', 'graph', 'hybrid']) AS mode),
 h AS (SELECT 'c' || o_custkey AS qid, o_custkey AS c, o_orderkey AS o, o_orderkey % 9 + 1 AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders QUALIFY rank <= 10),
 mh AS (SELECT mode, h.* FROM h, modes WHERE mode <> 'graph'), mf AS (SELECT mode, h.* FROM h, modes WHERE mode <> 'vector'),
 page_want AS (SELECT qid, unnest(CASE c % 4 WHEN 0 THEN ['2', '3'] WHEN 1 THEN ['1', '4'] WHEN 2 THEN ['5'] ELSE [] END) AS item FROM q),
 page_gain AS (SELECT qid, x.item, x.gain FROM q, (VALUES ('2', 2.0::DOUBLE), ('9', 0.5)) x(item, gain) WHERE c % 3 = 0 UNION ALL SELECT qid, item, 1.0 FROM page_want JOIN q USING (qid) WHERE NOT (c % 3 = 0 AND item IN ('2', '9'))),
 page_hits AS (SELECT mode, qid, rank, unnest(CASE WHEN o % 5 <> 0 THEN [p::VARCHAR] ELSE [p::VARCHAR, (p + 1)::VARCHAR] END) AS item FROM mh),
 chunk_want AS (SELECT qid, unnest(CASE WHEN c % 2 = 0 THEN ['ch3', 'ref7'] WHEN c % 5 = 0 THEN ['s::4'] ELSE [] END) AS item FROM q),
 chunk_gain AS (SELECT qid, item, 1.0::DOUBLE AS gain FROM chunk_want),
 chunk_hits AS (SELECT mode, qid, rank, unnest(['ref' || (o % 20), 'ch' || (o % 20), 's::' || (o % 20 + 1)]) AS item FROM mh)"""
RANKED = """
 {n}_a AS (SELECT mode, qid, k, wanted FROM (SELECT qid, count(*) AS wanted FROM {n}_want GROUP BY qid), ks, modes),
 {n}_g AS (SELECT mode, h.qid, k, count(DISTINCT h.item) AS got, min(rank) AS first FROM {n}_hits h JOIN {n}_want w ON w.qid = h.qid AND w.item = h.item, ks WHERE rank <= k GROUP BY ALL),
 {n}_b AS (SELECT a.*, coalesce(got, 0) AS got, first FROM {n}_a a LEFT JOIN {n}_g g USING (mode, qid, k)),
 {n}_i AS (SELECT qid, k, sum(gain / log2(nth + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY gain DESC, item) AS nth FROM {n}_gain), ks WHERE nth <= k GROUP BY ALL),
 {n}_r AS (SELECT mode, h.qid, rank, max(gain) AS gain FROM {n}_hits h JOIN {n}_gain g ON g.qid = h.qid AND g.item = h.item GROUP BY ALL),
 {n}_d AS (SELECT mode, qid, k, sum(gain / log2(rank + 1)) AS dcg FROM {n}_r, ks WHERE rank <= k GROUP BY ALL),
 {n}_m AS (SELECT mode, qid, k, '{n}_recall' AS metric, got / wanted::DOUBLE AS value FROM {n}_b UNION ALL SELECT mode, qid, k, '{n}_hit', (got > 0)::INT::DOUBLE FROM {n}_b UNION ALL SELECT mode, qid, k, 'mrr_{n}', coalesce(1.0::DOUBLE / first, 0) FROM {n}_b
   UNION ALL SELECT modes.mode, i.qid, i.k, 'ndcg_{n}', coalesce(dcg, 0) / ideal FROM {n}_i i CROSS JOIN modes LEFT JOIN {n}_d d ON d.mode = modes.mode AND d.qid = i.qid AND d.k = i.k)"""
LINKED = """
 cp AS (SELECT mode, qid, rank, p::VARCHAR AS item FROM mh WHERE o % 5 <> 0 UNION ALL SELECT mode, qid, rank, p::VARCHAR FROM mf WHERE o % 4 <> 0),
 cu AS (SELECT mode, qid, k, count(DISTINCT item) AS n, count(DISTINCT CASE WHEN (qid, item) IN (FROM page_want) THEN item END) AS hits FROM cp, ks WHERE rank <= k GROUP BY ALL),
 ca AS (SELECT a.mode, a.qid, a.k, coalesce(n, 0) AS n, coalesce(hits, 0) AS hits FROM page_a a LEFT JOIN cu USING (mode, qid, k)),
 cm AS (SELECT mode, qid, k, 'citation_hit' AS metric, (hits > 0)::INT::DOUBLE AS value FROM ca UNION ALL SELECT mode, qid, k, 'citation_accuracy', CASE WHEN n = 0 THEN 0 ELSE hits / n::DOUBLE END FROM ca),
 al AS (SELECT mode, qid, c, k FROM q, modes, ks),
 fa AS (SELECT mode, qid, k, count(*) AS n, count(*) FILTER (o % 6 = 1) AS part1, count(*) FILTER (o % 6 IN (2, 3)) AS hits, count(DISTINCT o % 6) FILTER (o % 6 IN (2, 3)) AS triples, count(*) FILTER (o % 3 <> 0 AND o % 4 <> 0) AS covered FROM mf, ks WHERE rank <= k GROUP BY ALL),
 fj AS (SELECT al.*, coalesce(n, 0) AS n, coalesce(part1, 0) AS part1, coalesce(hits, 0) AS hits, coalesce(triples, 0) AS triples, covered FROM al LEFT JOIN fa USING (mode, qid, k)),
 fp AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE hits / n::DOUBLE END AS precision FROM fj WHERE c % 3 <> 2),
 fm AS (SELECT mode, qid, k, 'entity_recall' AS metric, ((n > 0)::INT + (part1 > 0)::INT) / 3::DOUBLE AS value FROM fj UNION ALL SELECT mode, qid, k, 'triple_recall', triples / 2::DOUBLE FROM fp UNION ALL SELECT mode, qid, k, 'relation_precision', precision FROM fp UNION ALL SELECT mode, qid, k, 'noise_edge_rate', 1 - precision FROM fp UNION ALL SELECT mode, qid, k, 'relation_evidence_coverage', covered / n::DOUBLE FROM fj WHERE n > 0),
 every_metric AS (SELECT mode, qid, k::INT AS k, metric, round_even(value, 6) AS value FROM (FROM page_m UNION ALL FROM chunk_m UNION ALL FROM cm UNION ALL FROM fm))"""
EVALUATED = BASE + "," + RANKED.format(n="page") + "," + RANKED.format(n="chunk") + "," + LINKED
MEANS = EVALUATED + ", means AS (SELECT mode, metric || '@' || k AS metric, round_even(avg(value), 6) AS value FROM every_metric GROUP BY ALL), wide AS (SELECT metric, max(value) FILTER (mode = 'vector') AS vector, max(value) FILTER (mode = 'graph') AS graph, max(value) FILTER (mode = 'hybrid') AS hybrid, metric IN ('noise_edge_rate@5', 'noise_edge_rate@10') AS lower FROM means GROUP BY metric), deltas AS (SELECT *, round_even(hybrid - vector, 6) AS dv, round_even(hybrid - graph, 6) AS dg FROM wide) "
VERDICT = "CASE WHEN {d} IS NULL THEN '无法比较' WHEN abs({d}) <= 1e-9 THEN '持平' WHEN ({d} > 0) <> lower THEN '提升' ELSE '下降' END"


@query(EVALUATED + " FROM every_metric")
def evaluate_modes(spark, sf):
    return _metrics(spark, sf).filter("value is not null").select("mode", "qid", "k", "metric", "value")


@query(EVALUATED + " SELECT mode, metric, k, round_even(avg(value), 6) AS mean, count(*)::BIGINT AS n FROM every_metric GROUP BY ALL")
def mode_summary(spark, sf):
    return evaluation.summary(_metrics(spark, sf), "mode")


@query(MEANS + f"SELECT metric, CASE WHEN lower THEN 'lower' ELSE 'higher' END AS direction, vector, graph, hybrid, dv AS delta_vector, dg AS delta_graph, {VERDICT.format(d='dv')} AS versus_vector, {VERDICT.format(d='dg')} AS versus_graph FROM deltas")
def mode_compare(spark, sf):
    return evaluation.compare(evaluate.mode_means(_metrics(spark, sf)))


@query(MEANS + "SELECT metric, hybrid, row_number() OVER (ORDER BY list_position(['page_recall@5', 'citation_accuracy@5', 'entity_recall@5', 'triple_recall@5', 'relation_precision@5', 'noise_edge_rate@5'], metric))::INT AS place FROM deltas WHERE metric IN ('page_recall@5', 'citation_accuracy@5', 'entity_recall@5', 'triple_recall@5', 'relation_precision@5', 'noise_edge_rate@5')")
def mode_display(spark, sf):
    return evaluation.displayed(evaluation.compare(evaluate.mode_means(_metrics(spark, sf)))).select("metric", "hybrid", "place")


@query(MEANS + ", s AS (SELECT metric, CASE WHEN lower THEN -dv ELSE dv END AS better FROM deltas), n AS (SELECT count(*) FILTER (metric IN ('citation_accuracy@5', 'triple_recall@5', 'relation_precision@5') AND better > 1e-9) AS positive, count(*) FILTER (metric IN ('citation_accuracy@5', 'triple_recall@5', 'relation_precision@5') AND better < -1e-9) AS negative, count(*) FILTER (metric = 'noise_edge_rate@5' AND better < -1e-9) AS risk_worse FROM s) SELECT *, CASE WHEN positive > 0 AND risk_worse = 0 AND negative = 0 THEN 'helpful' WHEN positive > 0 AND risk_worse = 0 THEN 'mixed_helpful' WHEN risk_worse = 0 THEN 'neutral' ELSE 'risky' END AS decision FROM n")
def mode_decision(spark, sf):
    return evaluation.decide(evaluate.mode_means(_metrics(spark, sf)))


def _echo(question: str, context: str) -> str:
    return question


def _judge(record: dict) -> str:
    return '```json\n{"answer_supported": 1, "hallucination": 0.5}\n```'


@query("WITH q AS (SELECT mode, 'c' || c_custkey AS qid, c_custkey AS c FROM customer, (SELECT unnest(['vector', 'graph', 'hybrid']) AS mode)) SELECT mode, qid, metric, value FROM (SELECT mode, qid, unnest(['answer_supported_rate', 'missing_evidence_rate', 'hallucination_rate', 'judge_answer_supported_rate', 'judge_citation_accuracy', 'judge_missing_evidence_rate', 'judge_hallucination_rate']) AS metric, unnest([0.5, 0.5, CASE WHEN c % 2 = 0 THEN 1.0 END, 1.0, 0.0, 0.0, 0.5])::DOUBLE AS value FROM q) WHERE value IS NOT NULL")
def answer_metrics(spark, sf):
    """Answers and verdicts of stand-ins for models: one says the question again, one always says the same."""
    found = _metrics(spark, sf, provider=_echo, judge=_judge)
    return found.filter("k is null and value is not null").select("mode", "qid", "metric", "value")


CITED = BASE + ", c AS (SELECT mode, qid, 0 AS kind, rank, 'doc' || (o % 3) AS document, CASE WHEN o % 5 <> 0 THEN p::VARCHAR END AS page, 'ref' || (o % 20) AS source_ref FROM mh WHERE rank <= 5 UNION ALL SELECT mode, qid, 1, rank, 'doc' || (o % 3), CASE WHEN o % 4 <> 0 THEN p::VARCHAR END, 'e' || (o % 8) FROM mf WHERE rank <= 5), u AS (SELECT mode, qid, document, page, source_ref, min(kind * 100 + rank) AS spot FROM c GROUP BY ALL) "


@query(CITED + "SELECT mode, qid, row_number() OVER (PARTITION BY mode, qid ORDER BY spot)::INT AS place, document, page, source_ref FROM u")
def evaluation_citations(spark, sf):
    near, linked = evaluate.in_modes(chunk_hits(spark, sf), "vector"), evaluate.in_modes(fact_hits(spark, sf), "graph")
    return evaluate.cited(near, linked, 5)


@query(BASE + ", c AS (SELECT mode, qid, rank AS spot, '[文档] doc' || (o % 3) || CASE WHEN o % 5 <> 0 THEN ' 第 ' || p || ' 页' ELSE '' END || chr(10) || 'text ' || o AS part FROM mh WHERE rank <= 3 UNION ALL SELECT mode, qid, 100 + rank, '[图谱] Customer ' || c || ' --ORDERED--> Part ' || (o % 6) || CASE WHEN o % 3 <> 0 THEN '。证据：order ' || o ELSE '' END FROM mf WHERE rank <= 5) SELECT mode, qid, string_agg(part, chr(10) || chr(10) ORDER BY spot) AS context FROM c GROUP BY ALL")
def evaluation_contexts(spark, sf):
    near, linked = evaluate.in_modes(chunk_hits(spark, sf), "vector"), evaluate.in_modes(fact_hits(spark, sf), "graph")
    return evaluate.contexts(near, linked, 3, 5)


@query("WITH d AS (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey), p AS (SELECT lower(replace(n_name, ' ', '')) AS s, 'LOCATED_IN' AS t, lower(replace(r_name, ' ', '')) AS o FROM d), n AS (SELECT lower(replace(n_name, ' ', '')) AS s, 'LOCATED_IN' AS t, lower(replace(r_name, ' ', '')) AS o FROM nation JOIN region ON r_regionkey = n_nationkey % 5), c AS (SELECT (SELECT count(*) FROM (FROM p INTERSECT FROM n)) AS tp, (SELECT count(*) FROM (FROM p EXCEPT FROM n)) AS fp, (SELECT count(*) FROM (FROM n EXCEPT FROM p)) AS fn) SELECT *, round_even(tp / (tp + fp)::DOUBLE, 6) AS precision, round_even(tp / (tp + fn)::DOUBLE, 6) AS recall, round_even(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c")
def gold_triples(spark, sf):
    """Predicted triples against gold ones that come as JSON, as objects or lists."""
    n, r = read(spark, sf, "nation"), read(spark, sf, "region")
    shape = F.when(F.col("n_nationkey") % 2 == 0, _text('[{"source": "The ', F.col("n_name"), '", "relation": "located in", "target": "', F.col("r_name"), '"}]')).otherwise(_text('[["', F.col("n_name"), '", "Located-In", "', F.col("r_name"), '"]]'))
    gold = n.join(r, F.col("r_regionkey") == F.col("n_nationkey") % 5).select(F.lit("[]").alias("entities"), shape.alias("triples"))
    mine = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.lit("[]").alias("entities"), _text('[["', F.col("n_name"), '", "LOCATED_IN", "', F.col("r_name"), '"]]').alias("triples"))
    return evaluation.gold_scores(evaluate.gold(mine, "")[1], evaluate.gold(gold, "")[1], "source", "type", "target")


@query("WITH p AS (SELECT DISTINCT lower(p_brand) AS item FROM part), g AS (SELECT 'brand#' || unnest(range(10, 40)) AS item), d AS (SELECT 'fp' AS kind, item FROM p WHERE item NOT IN (FROM g) UNION ALL SELECT 'fn', item FROM g WHERE item NOT IN (FROM p)) SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY item)::INT AS place, item FROM d QUALIFY place <= 20")
def gold_examples(spark, sf):
    mine = read(spark, sf, "part").select(F.lower("p_brand").alias("item"))
    return evaluation.gold_examples(mine, spark.range(10, 40).select(_text("brand#", F.col("id")).alias("item")), "item")


@query("WITH m AS (SELECT o_orderkey AS qid, unnest([3, 5]) AS k, o_orderpriority AS metric, o_totalprice AS value FROM orders) SELECT qid, max(value) FILTER (metric = '1-URGENT' AND k = 3) AS urgent3, max(value) FILTER (metric = '5-LOW' AND k = 5) AS low5 FROM m GROUP BY qid")
def wide_metrics(spark, sf):
    from graphloom.sources import files

    rows = read(spark, sf, "orders").select(F.col("o_orderkey").alias("qid"), F.explode(F.array(F.lit(3), F.lit(5))).alias("k"), F.col("o_orderpriority").alias("metric"), F.col("o_totalprice").alias("value"))
    return files.wide_metrics(rows).select("qid", F.col("`1-URGENT@3`").alias("urgent3"), F.col("`5-LOW@5`").alias("low5"))


@query("WITH h AS (SELECT vec_id % 50 AS qid, vec_id % 2 AS kind, vec_id // 50 AS rank, 'd' || (label % 3) AS source FROM embeddings), p AS (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY kind, rank) AS n FROM h), o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY kind, rank, source) AS place FROM p WHERE n = 1) SELECT qid, place::INT AS place, source, '' AS page, source AS label FROM o WHERE place <= 8")
def citations_of_both(spark, sf):
    """Citations of chunks and facts without pages."""
    i = F.col("vec_id")
    hits = read(spark, sf, "embeddings").select((i % 50).alias("qid"), (i % 2).cast("int").alias("kind"), F.floor(i / 50).alias("rank"), _text("d", F.col("label") % 3).alias("source"), F.lit(None).cast("string").alias("page"))
    return retrieval.citations(hits)
