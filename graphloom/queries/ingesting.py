"""Ingestion: extraction by a provider, resumed and streamed folding, page windows as pages arrive."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.operators import chunking, graph, retrieval
from graphloom.plans import fixtures, ingest
from graphloom.plans.fixtures import read
from graphloom.queries import gate
from graphloom.queries.sql import CHUNKS
from graphloom.registry import query
from graphloom.sources.tables import dealt, spread


def _provider(text: str, error: str | None) -> str:
    """A stand-in for a model: its first answer is no JSON for even lengths, its second none for multiples of three."""
    if error is None and len(text) % 2 == 0 or error is not None and len(text) % 3 == 0:
        return "I cannot {say"
    return "Here: ```json\n" + json.dumps({"nodes": [{"name": text[:10], "label": "Unit", "aliases": ["a", 1]}, "odd"], "relationships": None}) + "\n```"


def _repairer(content: str, error: str) -> str:
    return '{"nodes": [{"name": "mended"}]}' if error and content else "{"


def _chunks(spark, sf):
    docs = dealt(read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("source"), "text"))
    return chunking.split_text(docs)


@query(CHUNKS + "SELECT doc_id::VARCHAR AS source, idx AS chunk, CASE WHEN length(chunk) % 6 = 0 THEN 'mended' ELSE left(chunk, 10) END AS name, CASE WHEN length(chunk) % 6 = 0 THEN '' ELSE 'a,1' END AS aliases FROM c")
def extraction_attempts(spark, sf):
    """Two attempts and a repair for every chunk."""
    found = ingest.extract(_chunks(spark, sf).select("source", "index", "text"), _provider, _repairer)
    return found.select("source", "chunk", F.col("nodes")[0]["name"].alias("name"), F.coalesce(F.array_join(F.col("nodes")[0]["aliases"], ","), F.lit("")).alias("aliases"))


@query(CHUNKS + "SELECT doc_id::VARCHAR AS source, idx AS chunk, 'I cannot {say' AS preview FROM c WHERE length(chunk) % 6 = 0")
def extraction_failures(spark, sf):
    """Without a repairer, chunks whose answers could not be read are kept with the answer."""
    found = ingest.extract(_chunks(spark, sf).select("source", "index", "text"), _provider)
    return found.filter("error is not null").select("source", "chunk", "preview")


@query(CHUNKS + "SELECT doc_id::VARCHAR AS source, idx AS \"index\" FROM c WHERE doc_id NOT IN (SELECT doc_id FROM labels) OR idx > 1")
def resume_chunks(spark, sf):
    """Chunks that a log of the labelled documents' first chunks does not have."""
    log = read(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("source"), F.lit(1).alias("chunk"))
    return ingest.not_yet(_chunks(spark, sf), log).select("source", "index")


@query(CHUNKS + "SELECT 'doc' || (doc_id % 5) AS document, count(*)::BIGINT AS chunks, count(DISTINCT doc_id || '::' || idx)::BIGINT AS ids FROM c GROUP BY ALL")
def chunk_tables(spark, sf):
    """Chunks written twice, by id: the documents that they link to."""
    chunks = _chunks(spark, sf).withColumn("document", F.concat(F.lit("doc"), (F.col("source").cast("long") % 5).cast("string")))
    twice = chunks.withColumn("run", F.lit(1)).unionByName(chunks.withColumn("run", F.lit(2)))
    kept, docs, links = graph.chunk_tables(twice, "run")
    return links.join(docs.select(F.col("id").alias("document")), "document").groupBy("document").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("chunk").alias("ids"))


@query(gate.GRAPH + "SELECT * FROM g")
def stream_graph(spark, sf):
    """Chunks that arrive in several batches, some twice, fold into the graph that one batch gives."""
    from graphloom.streaming import ingest as streaming

    out = fixtures.scratch(spark, "graph")
    chunks = _chunks(spark, sf)
    files = chunks.rdd.getNumPartitions()  # a batch's: each is written by all tasks
    for part in range(3):
        rows = chunks.filter((F.col("source").cast("long") % 3 == part) | (F.col("index") == 1))
        rows.write.mode("append").parquet(f"{out}/in")
    stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", files).parquet(f"{out}/in")
    streaming.graph_stream(stream, f"{out}/graph", f"{out}/checkpoint", lambda batch: gate.candidates(batch).withColumnRenamed("index", "chunk"))
    return gate._edges_out(streaming.stream_graph(spark, f"{out}/graph")[1])


_PAGES = "WITH p AS (SELECT conv_id AS doc, (turn + 1 + (conv_id % 5 + turn) // 3 * 2)::INT AS page FROM conversations), i AS (SELECT *, (page - row_number() OVER (PARTITION BY doc ORDER BY page))::INT AS island FROM p), s AS (SELECT *, row_number() OVER (PARTITION BY doc, island ORDER BY page) AS pos, count(*) OVER (PARTITION BY doc, island) AS n FROM i), w AS (SELECT *, CASE WHEN n <= 2 THEN 1 ELSE n - 1 END + (n >= 2)::INT AS wins FROM s)"


@query(_PAGES + " SELECT doc::VARCHAR AS doc, min(page)::INT AS first, max(page)::INT AS last FROM (SELECT *, unnest(generate_series(0, wins - 1)) AS win FROM w) WHERE pos - 1 >= win AND pos - 1 < win + 2 GROUP BY doc, island, win")
def stream_windows(spark, sf):
    """Windows of two pages that share one, as pages arrive."""
    from graphloom.streaming import ingest as streaming

    out = fixtures.scratch(spark, "windows")
    rows = fixtures.pages(spark, sf).withColumn("last", F.lead("page").over(Window.partitionBy("doc").orderBy("page")).isNull()).withColumn("doc", F.col("doc").cast("string"))
    rows.repartition(4, "doc").sortWithinPartitions("doc", "page").write.parquet(f"{out}/in")
    streaming.window_stream(streaming.page_stream(spark, f"{out}/in", rows.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", "), 2), f"{out}/out", f"{out}/checkpoint", 2, 1)
    return spark.read.parquet(f"{out}/out").select("doc", "first", "last")


@query(CHUNKS + "SELECT doc_id::VARCHAR || '::' || idx AS id, 384 AS dimensions FROM c")
def build_vectors(spark, sf):
    docs = spread(read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("source"), "text"))
    kept, _, _ = ingest.build_vectors(docs, retrieval.HashingEmbedder())
    return kept.select("id", F.size("vector").alias("dimensions"))
