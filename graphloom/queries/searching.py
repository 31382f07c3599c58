"""Names in texts, facts for many questions, and stored vectors, over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import facts, matching, vectors
from graphloom.plans.fixtures import read, scratch
from graphloom.registry import query

HELD_SUPPLIERS = 500_000  # that a broadcast may hold

SUPPLY = """WITH f AS (SELECT p_name AS s, s_name AS t, CASE WHEN p % 3 <> 0 THEN p_name || ' of type ' || p_type || ' by ' || s_name END AS ev, CASE WHEN p % 4 <> 0 THEN 0.6 + (p % 40) / 100.0 END::DOUBLE AS conf, n AS sup, 'p' || p AS sk, 's' || u AS tk FROM (SELECT l_partkey AS p, l_suppkey AS u, count(*) AS n FROM lineitem GROUP BY ALL) JOIN part ON p_partkey = p JOIN supplier ON s_suppkey = u),
 names AS (SELECT s AS name FROM f UNION SELECT t FROM f),
 q AS (SELECT p_partkey AS qid, 'Who delivers ' || p_name || ' or other things ' || lower(p_type) || '?' AS question FROM part WHERE p_partkey % 50 = 0) """


def supply(spark, sf):
    """Parts and those who supply them, as scanned edges."""
    # lines are dealt by part once, for their count and for the part; few suppliers are broadcast
    lines = read(spark, sf, "lineitem").select("l_partkey", "l_suppkey").repartition("l_partkey").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("support_count"))
    suppliers = read(spark, sf, "supplier").select("s_suppkey", "s_name")
    suppliers = F.broadcast(suppliers) if suppliers.count() <= HELD_SUPPLIERS else suppliers.hint("merge")
    rows = lines.join(read(spark, sf, "part").hint("merge"), F.col("l_partkey") == F.col("p_partkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    p = F.col("l_partkey")
    said = F.concat("p_name", F.lit(" of type "), "p_type", F.lit(" by "), "s_name")
    return rows.select(F.col("p_name").alias("source_name"), F.lit("SUPPLIED_BY").alias("type"), F.col("s_name").alias("target_name"), F.when(p % 3 != 0, said).alias("evidence"), F.when(p % 4 != 0, F.lit(0.6) + (p % 40) / 100).alias("confidence"), "support_count", F.concat(F.lit("p"), p.cast("string")).alias("src_key"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst_key"))


def part_questions(spark, sf):
    text = F.concat(F.lit("Who delivers "), "p_name", F.lit(" or other things "), F.lower("p_type"), F.lit("?"))
    return read(spark, sf, "part").filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("qid"), text.alias("question"))


@query(
    SUPPLY
    + """, k AS (SELECT qid, question, list_distinct(list_concat(regexp_extract_all(lower(question), '[a-z0-9_]+'), (SELECT list(name) FILTER (contains(question, name)) FROM names))) AS toks, (SELECT coalesce(list(name) FILTER (contains(question, name)), []) FROM names) AS held FROM q),
 x AS (SELECT qid, held, toks, f.*, lower(s || ' ' || t || ' SUPPLIED_BY ' || coalesce(ev, '')) AS hay FROM k, f),
 y AS (SELECT *, round((CASE WHEN list_contains(held, s) OR list_contains(held, t) THEN 8.0 ELSE 0.0 END + list_sum(list_transform(toks, lambda w: CASE WHEN contains(hay, lower(w)) THEN CASE WHEN length(w) >= 3 THEN 3.0 ELSE 1.0 END ELSE 0.0 END)) + CASE WHEN ev IS NOT NULL THEN 1.5 ELSE 0.0 END)::DOUBLE * greatest(0.1, least(coalesce(conf, 0.75), 1.0))::DOUBLE + least(sup, 5) * 0.4::DOUBLE, 6) AS score FROM x),
 r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, sup DESC, coalesce(conf, 1.0) DESC, sk, tk) AS rank FROM y) SELECT qid, s AS source_name, t AS target_name, score, rank::INT AS rank FROM r WHERE rank <= 12"""
)
def fact_search(spark, sf):
    """Every fiftieth part asked about, against all pairs of part and supplier, by the index."""
    return facts.top_facts(part_questions(spark, sf), supply(spark, sf)).select("qid", "source_name", "target_name", "score", "rank")


@query("SELECT o_orderkey, c_name AS name FROM (SELECT o_orderkey, 'Did ' || a.c_name || ' or ' || b.c_name || '1 order ' || o_orderpriority || '?' AS t FROM orders JOIN customer a ON a.c_custkey = o_custkey JOIN customer b ON b.c_custkey = o_orderkey % 97 + 1 WHERE o_orderkey % 20 = 0) q JOIN (SELECT DISTINCT c_name FROM customer) c ON contains(t, c_name)")
def names_in_questions(spark, sf):
    """The customers whose names a question about an order holds: all names begin alike."""
    c = read(spark, sf, "customer")
    orders = read(spark, sf, "orders").filter("o_orderkey % 20 = 0").join(c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("a")), "o_custkey")
    both = orders.withColumn("other", F.col("o_orderkey") % 97 + 1).join(c.select(F.col("c_custkey").alias("other"), F.col("c_name").alias("b")), "other")
    asked = both.select("o_orderkey", F.concat(F.lit("Did "), "a", F.lit(" or "), "b", F.lit("1 order "), "o_orderpriority", F.lit("?")).alias("t"))
    return matching.in_few_texts(asked, matching.automata(c.select("c_name"))).toDF("o_orderkey", "name")


def _asked(spark, sf):
    return read(spark, sf, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))


def _kept(spark, sf):
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


NEAR = "WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0), d AS (SELECT qid, vec_id AS id, round(list_cosine_similarity(q, {vector}), 6) AS score FROM q, embeddings WHERE {where}), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM d) SELECT qid, id, score, rank::INT AS rank FROM r WHERE rank <= 4"


@query(NEAR.format(vector="embedding::DOUBLE[]", where="true"))
def vector_index_topk(spark, sf):
    """The stored index, made and asked."""
    path = scratch(spark, "vector-index")
    vectors.create(_kept(spark, sf), path)
    return vectors.search(_asked(spark, sf), vectors.read(spark, path), 4)


@query(NEAR.format(vector="CASE WHEN vec_id % 3 = 0 THEN list_transform(embedding, lambda x: -x::DOUBLE) ELSE embedding::DOUBLE[] END", where="vec_id % 7 <> 0"))
def vector_index_refresh(spark, sf):
    """A part is indexed first; then every third comes in, against its direction, and every seventh leaves."""
    path, rows = scratch(spark, "vector-index"), _kept(spark, sf)
    turned = rows.withColumn("vector", F.transform("vector", lambda x: -x.cast("double")))
    vectors.create(rows.filter("id % 3 <> 0 or id % 2 = 0"), path)
    vectors.refresh(turned.filter("id % 3 = 0 and id % 7 <> 0"), path, rows.filter("id % 7 = 0"))
    return vectors.search(_asked(spark, sf), vectors.read(spark, path), 4)


@query("SELECT vec_id AS qid, NULL::BIGINT AS id, NULL::DOUBLE AS score, NULL::INT AS rank, 'VectorRetriever 检索失败：' AS error FROM embeddings WHERE vec_id % 50 = 0")
def vector_index_dropped(spark, sf):
    """After the index is dropped each question gets an item that says so."""
    path = scratch(spark, "vector-index")
    vectors.create(_kept(spark, sf), path)
    vectors.drop(spark, path)
    return vectors.items(_asked(spark, sf), path, 4).withColumn("error", F.substring("error", 1, len(vectors.FAILED)))
