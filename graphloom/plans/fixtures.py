"""The driver's tables in the shapes that the engine's operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph
from graphloom.sources.tables import scratch, spread  # noqa: F401 - queries take their folders from here


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pages(spark: SparkSession, sf: str, gaps: bool = True) -> DataFrame:
    """Conversations as paged documents (doc, page, text); with ``gaps`` page numbers leap, so that documents have islands."""
    leap = F.floor((F.col("conv_id") % 5 + F.col("turn")) / 3) * 2 if gaps else F.lit(0)
    return spread(read(spark, sf, "conversations").select("conv_id", "turn", "text")).select(F.col("conv_id").alias("doc"), (F.col("turn") + 1 + leap).cast("int").alias("page"), "text")


def paged_text(spark: SparkSession, sf: str) -> DataFrame:
    """(doc, text): the pages of a document under their marker lines."""
    own = F.array_sort(F.collect_list(F.struct("page", "text")))
    part = lambda p: F.concat(F.lit("===== PAGE "), p["page"].cast("string"), F.lit(" =====\n"), p["text"])
    return pages(spark, sf, False).groupBy("doc").agg(F.array_join(F.transform(own, part), "\n\n").alias("text"))


def edge_rows(spark: SparkSession, sf: str, lacking: Column | None = None) -> DataFrame:
    """Line items as mentions that a supplier produces a part, with ``seq`` as their order; those that are ``lacking`` have no part."""
    seq = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    lines = spread(read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_discount", "l_returnflag", "l_quantity"))
    part = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    return lines.select(
        F.lit("Unit").alias("src_label"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src_key"), F.lit("PRODUCES").alias("type"), F.lit("Product").alias("dst_label"), (part if lacking is None else F.when(lacking, None).otherwise(part)).alias("dst_key"), seq.alias("seq"),
        F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("evidence"), F.round(1 - F.col("l_discount") * 3, 3).alias("confidence"), F.concat(F.lit("doc"), (F.col("l_orderkey") % 7).cast("string")).alias("document"), (F.col("l_orderkey") % 50 + 1).cast("int").alias("page_start"), (F.col("l_orderkey") % 50 + 1).cast("int").alias("page_end"), (F.col("l_orderkey") % 50 + 1).cast("string").alias("page"), F.col("l_linenumber").cast("int").alias("chunk_index"), F.concat_ws("#", (F.col("l_orderkey") % 7).cast("string"), F.col("l_linenumber").cast("string")).alias("source_ref"),
        F.array(F.col("l_returnflag")).alias("quality_flags"), F.lit(1).alias("support_count"), F.concat(F.lit("src"), (F.col("l_orderkey") % 7).cast("string")).alias("source"),
    )


def node_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers, parts and nations as node mentions."""
    row = lambda label, key, name, seq, told: (F.lit(label).alias("label"), key.alias("canonical_key"), seq.cast("long").alias("seq"), name.alias("name"), told.alias("description"), F.array(name).alias("aliases"), F.lit(1).alias("support_count"), F.lit("star").alias("source"), F.lit("star").alias("document"), F.lit(None).cast("string").alias("page"))
    s, p, n = (read(spark, sf, t) for t in ("supplier", "part", "nation"))
    return (
        s.select(*row("Unit", F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), F.col("s_name"), F.col("s_suppkey"), F.lit("")))
        .unionByName(p.select(*row("Product", F.concat(F.lit("p"), F.col("p_partkey").cast("string")), F.col("p_name"), F.col("p_partkey"), F.col("p_type"))))
        .unionByName(n.select(*row("Plant", F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.col("n_name"), F.col("n_nationkey"), F.lit("nation"))))
    )


def customer_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as mentions of their customers."""
    key = F.col("o_orderkey")
    return spread(read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")).select(
        F.lit("Company").alias("label"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("canonical_key"), key.alias("seq"), F.concat(F.lit("Customer "), F.col("o_orderpriority")).alias("name"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).otherwise("").alias("description"), F.array("o_orderpriority").alias("aliases"), F.lit(1).alias("support_count"),
        F.concat(F.lit("src"), (key % 7).cast("string")).alias("source"), F.lit("orders").alias("document"), F.when(key % 3 != 0, (key % 50).cast("string")).alias("page"),
    )


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges without the lists that scans do not read."""
    return graph.folded_edges(edge_rows(spark, sf))


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """Nations that lie in regions, as scanned edges."""
    n, r = read(spark, sf, "nation"), read(spark, sf, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(
        F.col("n_name").alias("source_name"), F.lit("LOCATED_IN").alias("type"), F.col("r_name").alias("target_name"), F.when(F.col("n_nationkey") % 3 != 0, F.concat(F.col("n_name"), F.lit(" in "), F.col("r_name"))).alias("evidence"), F.when(F.col("n_nationkey") % 4 != 0, F.lit(0.7) + F.col("n_nationkey") / 100).alias("confidence"), (F.col("n_nationkey") % 7 + 1).alias("support_count"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src_key"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("dst_key"), F.concat(F.lit("doc"), (F.col("n_nationkey") % 3).cast("string")).alias("document"), F.when(F.col("n_nationkey") % 5 != 0, (F.col("n_nationkey") % 5).cast("string")).alias("page"),
    )


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """(qid, question): each nation asked about with the region of another."""
    n, r = read(spark, sf, "nation"), read(spark, sf, "region")
    return n.join(r, F.col("r_regionkey") == F.col("n_nationkey") % 5).select(F.col("n_nationkey").cast("int").alias("qid"), F.concat(F.lit("Is "), F.col("n_name"), F.lit(" located_in "), F.lower("r_name"), F.lit(" or elsewhere?")).alias("question"))
