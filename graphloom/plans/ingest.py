"""Ingestion as batch plans: files to texts, texts to chunks, chunks to extractions, to a graph and to vectors."""

from __future__ import annotations

import json
import re
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.operators import chunking, graph, pages, quality, retrieval, vectors
from graphloom.sources import files, tables

WINDOW, OVERLAP = 20, 1
ATTEMPTS, PREVIEW = 2, 1000
NODES = "array<struct<name:string,label:string,description:string,aliases:array<string>>>"
EDGES = "array<struct<source:string,type:string,target:string,evidence:string>>"
FOUND = f"nodes {NODES}, relationships {EDGES}, error string, preview string"
WORKERS, WAVE = 3, 10_000  # calls at a time in a task; chunks that are committed together


# --- prepared texts


def prepare(spark: SparkSession, path: str, name: str | None = None, extract: files.PageProvider | None = None, ocr: files.PageProvider | None = None, spec: str | None = None, force_ocr: bool = False, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """(source, text): texts and markdown as they are kept, PDF files as windows of their pages (one file a page for a window of 0)."""
    found = files.source_files(spark, path, name)
    texts = files.prepared(files.decoded(found))
    if extract is None:
        return texts
    paged = files.picked_pages(files.pdf_pages(found, extract, ocr, force_ocr), spec)
    return texts.unionByName(windowed(paged, window, overlap))


def windowed(paged: DataFrame, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """(source, text) of pages (source, page, text): a row for each window, named by its pages."""
    from graphloom.functions import text as tx

    rows = paged.withColumn("stem", tx.safe_stem(F.col("source")))
    if window <= 0:
        return rows.select(tx.window_filename(F.col("stem"), F.col("page"), F.col("page")).alias("source"), tx.page_section(F.col("page"), F.col("text")).alias("text"))
    return pages.window_texts(pages.windows(rows, "stem", window, overlap), "stem").select(F.col("filename").alias("source"), "text")


def work_items(paged: DataFrame, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """(source, items): how many windows each source's pages make."""
    return pages.windows(paged, "source", window, overlap).groupBy("source").agg(F.count_distinct("island", "win").alias("items"))


# --- extraction


class Extractor(Protocol):
    """A language model that answers a chunk with JSON; ``error`` is what was wrong with its last answer."""

    def __call__(self, text: str, error: str | None) -> str: ...


class Repairer(Protocol):
    """A language model that mends an answer that is no JSON."""

    def __call__(self, content: str, error: str) -> str: ...


def parsed(content: str) -> dict:
    """The JSON object in an answer; an error if there is none.  Lists that are missing or no lists are empty."""
    bare = re.sub(r"```$", "", re.sub(r"^```(?:json)?", "", content.strip())).strip()
    try:
        found = json.loads(bare)
    except ValueError:
        outer = re.search(r"\{.*\}", bare, re.S)
        if not outer:
            raise
        found = json.loads(outer[0])
    if not isinstance(found, dict):
        raise ValueError("no JSON object")
    return {k: found[k] if isinstance(found.get(k), list) else [] for k in ("nodes", "relationships")}


def _record(item: dict, fields: tuple[str, ...]) -> dict:
    return {f: None if item.get(f) is None else str(item[f]) for f in fields}


def extracted_one(text: str, provider: Extractor, repair: Repairer | None) -> tuple[list, list, str | None, str | None]:
    """Nodes, relationships, and what went wrong: two attempts, then one repair, then nothing."""
    content, error = "", None
    for attempt in range(ATTEMPTS + (repair is not None)):
        try:
            content = provider(text, error) if attempt < ATTEMPTS else repair(content, error or "")
            found = parsed(content or "{}")
            nodes = [_record(n, ("name", "label", "description")) | {"aliases": [str(a) for a in n["aliases"]] if isinstance(n.get("aliases"), list) else None} for n in found["nodes"] if isinstance(n, dict)]
            edges = [_record(r, ("source", "type", "target", "evidence")) for r in found["relationships"] if isinstance(r, dict)]
            return nodes, edges, None, None
        except Exception as e:  # noqa: BLE001 - an answer that cannot be read must not fail the job
            error = str(e) or type(e).__name__
    return [], [], error, (content or "")[:PREVIEW]


def extract(chunks: DataFrame, provider: Extractor, repair: Repairer | None = None, workers: int = WORKERS) -> DataFrame:
    """``chunks`` (source, index, text, any others) with nodes, relationships, and error and preview where no answer could be read.

    The index is called chunk.  Each task asks ``workers`` at a time.  The provider is asked wherever
    the result is read: to ask once, write it, as ``ExtractionLog`` does.
    """
    rows = chunks.withColumn("chunk", F.col("index").cast("int")).drop("index")
    rows = rows.select("source", "chunk", "text", *(c for c in rows.columns if c not in ("source", "chunk", "text", "nodes", "relationships", "error", "preview")))
    found = StructType.fromDDL(FOUND)
    schema = StructType([*rows.schema.fields, *found.fields])

    def run(batches):
        from concurrent.futures import ThreadPoolExecutor

        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in found.fields]
        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                answers = list(pool.map(lambda t: extracted_one(t or "", provider, repair), batch.column(2).to_pylist()))
                columns = [pa.array([r[i] for r in answers], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    return rows.mapInArrow(run, schema)


class ExtractionLog:
    """Extractions written before anything reads them: a model is asked once a chunk, whatever is made of its answers.

    Chunks are asked in waves, each of which is committed whole; what a lost run has paid for is lost
    with its last wave at most.  A chunk that is in the log, read or failed, is not asked again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame | None:
        """(source, chunk, text, the chunks' other columns, nodes, relationships, error, preview), null before the first wave."""
        return self.spark.read.parquet(self.path) if tables.exists(self.spark, self.path) else None

    def add(self, chunks: DataFrame, provider: Extractor, repair: Repairer | None = None, wave: int = WAVE, workers: int = WORKERS) -> DataFrame:
        """The log with all of ``chunks`` (source, index, text, any others), of which those it lacks are asked."""
        held = self.read()
        new = chunks if held is None else not_yet(chunks, held)
        n = new.count()
        waves = max(1, -(-n // wave))
        for w in range(waves if n else 0):
            # the log grows by each wave; a wave's chunks are told by a hash alone
            part = chunks if waves == 1 else chunks.filter(F.pmod(F.xxhash64("source", "index"), F.lit(waves)) == w)
            held = self.read()
            part = part if held is None else not_yet(part, held)
            extract(part.dropDuplicates(["source", "index"]), provider, repair, workers).write.mode("append").parquet(self.path)
        if (done := self.read()) is None:
            extract(chunks.limit(0), provider, repair, workers).write.parquet(self.path)
            done = self.read()
        return done


def not_yet(chunks: DataFrame, log: DataFrame) -> DataFrame:
    """Chunks whose (source, index) the log does not have; failed ones are in it too and are not tried again."""
    return chunks.join(log.select("source", F.col("chunk").cast("int").alias("index")), ["source", "index"], "left_anti")


def log_of(extracted: DataFrame, text: bool = True) -> DataFrame:
    """Extraction-log items: gated extractions with the chunk's document, pages, text (unless it is not wanted: it goes through the gate) and quality."""
    kept = [c for c in ("document", "page_start", "page_end", "page", "source_ref", "text", "error", "preview") if c in extracted.columns and (text or c != "text")]
    gated = quality.gate(extracted, *kept)
    quality_ = F.struct("input_nodes", "input_relationships", "accepted_nodes", "accepted_relationships", "dropped_count", "dropped").alias("quality")
    return gated.select("source", "chunk", *kept, F.struct("nodes", "relationships").alias("extraction"), quality_)


# --- the graph


def _of(log: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in log.columns else F.lit(None).cast(kind)


def graph_rows(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node rows, edge rows) of a log's accepted nodes and relationships; ``seq`` is (source, chunk, place)."""
    seq = F.struct("source", "chunk", "pos").alias("seq")
    document, page = _of(log, "document", "string").alias("document"), _of(log, "page", "string").alias("page")
    nodes = log.select("source", "chunk", document, page, F.posexplode("extraction.nodes").alias("pos", "n")).select("n.label", "n.canonical_key", seq, "n.name", "n.description", "n.aliases", "n.support_count", "source", "document", "page")
    placed = log.select("source", "chunk", document, page, *(_of(log, c, t).alias(c) for c, t in (("page_start", "int"), ("page_end", "int"), ("source_ref", "string"))), F.posexplode("extraction.relationships").alias("pos", "r"))
    end = lambda side, as_: (F.col(f"r.{side}_label").alias(f"{as_}_label"), F.col(f"r.{side}_key").alias(f"{as_}_key"))
    edges = placed.select(*end("source", "src"), F.col("r.type").alias("type"), *end("target", "dst"), seq, "r.evidence", "r.confidence", "document", "page_start", "page_end", "page", F.col("chunk").alias("chunk_index"), "source_ref", "r.quality_flags", "r.support_count", "source")
    return nodes, edges


def build_graph(texts: DataFrame, provider: Extractor, repair: Repairer | None = None, log: DataFrame | None = None, path: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(log, nodes, edges) of texts (source, text): chunked, extracted unless the log has them, gated and folded with the log's.

    Extractions are written under ``path``, or a folder of their own, before they are read, and so is
    the log, of which nodes, edges and the lists of both are made.
    """
    chunks = chunking.split_text(texts)
    kept = ExtractionLog(texts.sparkSession, path or tables.scratch(texts.sparkSession, "extractions"))
    new = tables.written(log_of(kept.add(chunks if log is None else not_yet(chunks, log), provider, repair)), tag="log")
    whole = new if log is None else log.unionByName(new, allowMissingColumns=True)
    nodes, edges = graph_rows(whole)
    named = graph.upsert_nodes(nodes)
    return whole, named, graph.attached(graph.upsert_edges(edges), named)


def build_vectors(texts: DataFrame, embedder: retrieval.Embedder | None = None, **sizes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks with vectors, documents, links) of texts (source, text)."""
    chunks = chunking.split_text(texts, **sizes)
    kept, docs, links = graph.chunk_tables(chunks, "index")
    return kept.withColumn("vector", retrieval.embedding(F.col("text"), embedder)), docs, links


def ingest_files(spark: SparkSession, path: str, out: str, provider: Extractor, repair: Repairer | None = None, embedder: retrieval.Embedder | None = None, **reading) -> dict[str, str]:
    """From the files under ``path`` to the graph and the vectors: where each of what ``out`` then holds stands.

    ``texts``, ``extractions`` (paid once: a run that comes again asks for new chunks alone), ``log``,
    ``nodes``, ``edges``, ``chunks``, ``documents``, ``links`` are tables, ``vectors`` is an index.
    Sizes of chunks and windows, workers and waves are the session's settings; ``reading`` goes to
    ``prepare``.
    """
    from graphloom.plans.settings import setting

    sizes = {"size": setting(spark, "chunk_size"), "overlap": setting(spark, "chunk_overlap")}
    reading = {"window": setting(spark, "window"), "overlap": setting(spark, "window_overlap")} | reading
    at = {name: f"{out}/{name}" for name in ("texts", "extractions", "log", "nodes", "edges", "chunks", "documents", "links", "vectors")}
    texts = tables.written(prepare(spark, path, **reading), at["texts"])
    chunks = chunking.split_text(texts, **sizes)
    log = tables.written(log_of(ExtractionLog(spark, at["extractions"]).add(chunks, provider, repair, setting(spark, "wave"), setting(spark, "workers"))), at["log"])
    nodes, edges = graph_rows(log)
    named = tables.written(graph.upsert_nodes(nodes), at["nodes"])
    tables.written(graph.attached(graph.upsert_edges(edges), named), at["edges"])
    kept, documents, links = build_vectors(texts, embedder, **sizes)
    kept = tables.written(kept, at["chunks"])
    tables.written(documents, at["documents"])
    tables.written(links, at["links"])
    vectors.refresh(kept.select("id", "vector"), at["vectors"])
    return at
