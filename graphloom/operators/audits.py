"""Audits of what was extracted and of how well chunks bridge pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.operators import chunking, evaluation, pages

EXAMPLES, LOW = 12, 0.72


def log_nodes(log: DataFrame) -> DataFrame:
    return log.select("source", "chunk", F.explode("extraction.nodes").alias("n")).select("source", "chunk", "n.*")


def log_edges(log: DataFrame) -> DataFrame:
    """(chunk_source, chunk, text if the log has it, pos, the relationship's fields)."""
    text = F.col("text") if "text" in log.columns else F.lit(None).cast("string")
    return log.select(F.col("source").alias("chunk_source"), "chunk", text.alias("text"), F.posexplode("extraction.relationships").alias("pos", "r")).select("chunk_source", "chunk", "text", "pos", "r.*")


def totals(log: DataFrame) -> DataFrame:
    """One row over a log (source, chunk, extraction, quality): chunks, what was accepted, what came in, and what was dropped."""
    total = lambda c, name: F.coalesce(F.sum(F.coalesce(c, F.lit(0)).cast("long")), F.lit(0)).alias(name)
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    dropped = F.coalesce(F.nullif(F.col("quality.dropped_count"), F.lit(0)), size("quality.dropped"))
    return log.agg(F.count(F.lit(1)).alias("chunks"), total(size("extraction.nodes"), "accepted_nodes"), total(F.col("quality.input_nodes"), "input_nodes"), total(size("extraction.relationships"), "accepted_relationships"), total(F.col("quality.input_relationships"), "input_relationships"), total(dropped, "dropped"))


def histogram(rows: DataFrame, column: str, most: int | None = None) -> DataFrame:
    """(column, n, place): counts, the most frequent first, ties by name; ``most`` of them."""
    counts = rows.groupBy(F.coalesce(column, F.lit("")).alias(column)).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.orderBy(F.desc("n"), column).limit(most) if most else counts
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), column)))


def drop_reasons(log: DataFrame, most: int = EXAMPLES) -> DataFrame:
    """The most frequent reasons among the drops that chunks kept."""
    return histogram(log.select(F.explode("quality.dropped").alias("d")).select(F.coalesce("d.reason", F.lit("unknown")).alias("reason")), "reason", most)


def low_confidence(log: DataFrame, below: float = LOW) -> DataFrame:
    """Accepted relationships whose confidence (none counts as 0) is under ``below``."""
    edges = log_edges(log).withColumn("confidence", F.coalesce("confidence", F.lit(0.0))).filter(F.col("confidence") < below)
    return edges.select(F.col("chunk_source").alias("source"), "chunk", F.concat(F.col("source"), F.lit(" -"), F.col("type"), F.lit("-> "), F.col("target")).alias("triple"), "confidence", F.array_join(F.coalesce("quality_flags", F.array().cast("array<string>")), ",").alias("flags"))


def merged_names(log: DataFrame) -> DataFrame:
    """Keys under which nodes of several names were merged."""
    named = log_nodes(log).select(F.coalesce(F.nullif(F.col("canonical_key"), F.lit("")), "name").alias("key"), "name").filter((F.coalesce("key", F.lit("")) != "") & (F.coalesce("name", F.lit("")) != ""))
    return evaluation.alias_groups(named, "key", "name")


def page_files(texts: DataFrame) -> DataFrame:
    """Files ``name_page_N.txt`` (source, text) as (document, page, source, text); other files are left out."""
    named = texts.withColumns({"page": tx.page_of_source(F.col("source")), "document": F.regexp_extract("source", r"(?i)^(.+?)_page_\d{1,6}\.txt$", 1)})
    return named.filter("page is not null").select("document", "page", "source", "text")


def joined_files(files: DataFrame) -> DataFrame:
    """(document, source, text): a document's page files in order, under their markers where they have none."""
    part = F.when(F.size(tx.page_spans(F.col("text"))) > 0, F.col("text")).otherwise(F.concat(F.lit("===== PAGE "), F.col("page").cast("string"), F.lit(" =====\n"), F.col("text")))
    own = files.withColumn("part", part).groupBy("document").agg(F.array_sort(F.collect_list(F.struct("page", "part"))).alias("own"))
    return own.select("document", F.concat("document", F.lit(".txt")).alias("source"), F.array_join(F.transform("own", lambda p: p["part"]), "\n\n").alias("text"))


def audit_page_files(texts: DataFrame, tail: int = 80, head: int = 80, least: int = 24) -> DataFrame:
    """Boundaries between adjacent page files of a document, against the chunks of the joined document."""
    files = page_files(texts)
    return _audited(files, joined_files(files), tail, head, least)


def audit_documents(texts: DataFrame, tail: int = 80, head: int = 80, least: int = 24) -> DataFrame:
    """Boundaries between adjacent marked pages inside each document (source, text), against its chunks."""
    marked = texts.select(F.col("source").alias("document"), F.explode(tx.page_segments(F.col("text"))).alias("p")).select("document", "p.page", "p.text")
    return _audited(marked, texts.select(F.col("source").alias("document"), "source", "text"), tail, head, least)


def _audited(rows: DataFrame, whole: DataFrame, tail: int, head: int, least: int) -> DataFrame:
    chunks = chunking.split_text(whole.select(F.col("document").alias("of"), "source", "text")).select(F.col("of").alias("document"), "page_start", "page_end", "text")
    audit = pages.audit_boundaries(pages.boundaries(rows, "document", tail=tail, head=head), chunks, "document", least)
    return audit.withColumn("boundary_ref", tx.neighbour_ref(tx.document_name(F.col("document")), F.col("page"), "to_next"))
