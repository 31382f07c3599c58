"""Chunks: overlapping character windows of a text that know their pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.functions.arrays import Cutter, let

SIZE, OVERLAP = 2600, 250


def chunk_count(length: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Windows of ``size`` that step by ``size - overlap``; the last ends with the text."""
    return F.when(length == 0, 0).when(length <= size, 1).otherwise(F.ceil((length - size) / (size - overlap)) + 1).cast("int")


def page_range(spans: Column, start: Column, end: Column, segment: Column | None = None) -> tuple[Column, Column]:
    """First and last page whose span overlaps [start, end); without one, of the markers inside ``segment``."""
    pages = F.transform(F.filter(spans, lambda s: (s["start"] < end) & (s["end"] > start)), lambda s: s["page"])
    if segment is None:
        return F.array_min(pages), F.array_max(pages)
    inside = F.transform(tx.page_spans(segment), lambda s: s["page"])
    return F.coalesce(F.array_min(pages), F.array_min(inside)), F.coalesce(F.array_max(pages), F.array_max(inside))


def body_of(text: Column) -> Column:
    """A text as it is chunked: no blanks at its ends, at most one empty line in a row."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def chunk_array(body: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """array<struct<index,text,first,last>> of a body, with the pages that each chunk overlaps.

    Chunks are cut in the row, each in time of its own length, and only they leave it.
    """
    step = size - overlap

    def cut(v):
        piece, length = Cutter(v["wide"]), v["length"]

        def one(i):
            start = (i - 1) * step
            end = F.least(start + size, length)
            first, last = page_range(v["spans"], start, end)
            text = F.when(length <= size, v["body"]).otherwise(piece(start, F.lit(size)))
            return F.struct(i.alias("index"), text.alias("text"), first.alias("first"), last.alias("last"))

        return F.transform(F.sequence(F.lit(1), chunk_count(length, size, overlap)), one)

    whole = let(body, lambda b: F.struct(b.alias("body"), F.length(b).alias("length"), F.when(F.length(b) > size, Cutter.widened(b)).alias("wide"), tx.page_spans(b).alias("spans")))
    return let(whole, lambda v: F.when(v["length"] > 0, cut(v)).otherwise(F.array().cast("array<struct<index:int,text:string,first:int,last:int>>")))


def split_text(docs: DataFrame, text: str = "text", source: str = "source", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """One row per chunk with index (from 1), text, document, page_start, page_end, page and source_ref.

    Every other column of ``docs`` stays.  One generator: no shuffle, no Python.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    rows = docs.withColumn("__chunk", F.explode(chunk_array(body_of(F.col(text)), size, overlap))).withColumn(text, F.col("__chunk.text"))
    file = tx.page_of_source(F.col(source))
    rows = rows.withColumns({"index": F.col("__chunk.index"), "document": tx.document_name(F.col(source)), "page_start": F.coalesce(file, "__chunk.first"), "page_end": F.coalesce(file, "__chunk.last")})
    rows = rows.withColumn("page", tx.page_label(F.col("page_start"), F.col("page_end")))
    return rows.withColumn("source_ref", tx.source_ref(F.col("document"), F.col("page_start"), F.col("page_end"), F.col("index"))).drop("__chunk")
