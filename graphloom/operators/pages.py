"""Pages: islands of consecutive pages, sliding windows of them, and audits of their boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as tx


def islands(pages: DataFrame, key: str, page: str = "page") -> DataFrame:
    """``pages`` with ``island``, equal for runs of consecutive pages of a key, and ``pos`` and ``size`` in it."""
    numbered = pages.withColumn("island", F.col(page) - F.row_number().over(Window.partitionBy(key).orderBy(page)))
    own = Window.partitionBy(key, "island")
    return numbered.withColumn("pos", F.row_number().over(own.orderBy(page))).withColumn("size", F.count(F.lit(1)).over(own))


def windows(pages: DataFrame, key: str, size: int, overlap: int, page: str = "page", buffered: bool = False) -> DataFrame:
    """``pages`` once for each window (``win``, from 0) that holds them; windows step by size - overlap within an island.

    A window starts only where the one before does not reach the island's end.  ``buffered`` adds
    what a one-pass buffer emits: after a last window that fits exactly, one of the overlap alone.
    """
    if size > 0 and not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    rows = islands(pages, key, page)
    if size <= 0:
        return rows.withColumn("win", F.lit(0)).drop("pos", "size")
    step, n = size - overlap, F.col("size")
    wins = F.when(n <= size, 1).otherwise(F.ceil((n - size) / step) + 1)
    if buffered and overlap:
        wins = wins + F.when((n >= size) & ((n - size) % step == 0), 1).otherwise(0)
    at = F.col("pos") - 1
    low = F.greatest(F.lit(0), F.floor((at - size) / step) + 1).cast("int")
    high = F.least(F.floor(at / step), wins - 1).cast("int")
    spread = rows.withColumn("win", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))))
    return spread.drop("pos", "size")


def window_texts(spread: DataFrame, key: str, page: str = "page", text: str = "text") -> DataFrame:
    """(key, island, win, first, last, filename, text) of what ``windows`` gave."""
    whole = spread.groupBy(key, "island", "win").agg(F.min(page).alias("first"), F.max(page).alias("last"), F.array_sort(F.collect_list(F.struct(page, text))).alias("own"))
    body = F.array_join(F.transform("own", lambda s: tx.page_section(s[page], s[text])), "\n\n")
    return whole.withColumn("filename", tx.window_filename(F.col(key).cast("string"), F.col("first"), F.col("last"))).withColumn("text", body).drop("own")


def boundaries(pages: DataFrame, key: str, page: str = "page", text: str = "text", tail: int = 80, head: int = 80) -> DataFrame:
    """Adjacent pages a, a + 1 of a key with the end of the one and the start of the other, blanks removed."""
    order = Window.partitionBy(key).orderBy(page)
    rows = pages.withColumn("next_page", F.lead(page).over(order)).withColumn("next_text", F.lead(text).over(order)).filter(F.col("next_page") == F.col(page) + 1)
    tail_text, head_text = tx.compact(F.col(text)), tx.compact(F.col("next_text"))
    return rows.select(key, F.col(page).alias("page"), "next_page", F.right(tail_text, F.lit(tail)).alias("tail"), F.left(head_text, F.lit(head)).alias("head"), F.regexp_replace(F.col(text), r"(?U)\s+$", "").rlike(r"[。！？!?；;：:.]$").alias("closed"))


def audit_boundaries(bounds: DataFrame, chunks: DataFrame, key: str, least: int = 24) -> DataFrame:
    """``bounds`` with status ok, warning or fail, from the chunks (key, page_start, page_end, text) that span them.

    ok: a chunk holds both sides; warning: one covers both pages without holding both sides.
    """
    c = chunks.select(key, "page_start", "page_end", tx.compact(F.col("text")).alias("chunk_text"))
    both = bounds.join(c, (bounds[key] == c[key]) & (c["page_start"] <= bounds["page"]) & (c["page_end"] >= bounds["next_page"]), "left").drop(c[key])
    held = both["chunk_text"].contains(F.right("tail", F.lit(least))) & both["chunk_text"].contains(F.left("head", F.lit(least)))
    found = both.groupBy(key, "page", "next_page", "closed").agg(F.count("chunk_text").alias("covering"), F.coalesce(F.sum(held.cast("int")), F.lit(0)).alias("holding"))
    status = F.when(F.col("holding") > 0, "ok").when(F.col("covering") > 0, "warning").otherwise("fail")
    return found.withColumn("status", status).withColumn("likely_sentence_split", ~F.col("closed")).drop("closed")


def boundary_summary(audit: DataFrame) -> DataFrame:
    """Counts by status with bridge_rate and risk_rate, null without boundaries."""
    of = lambda s: F.coalesce(F.sum((F.col("status") == s).cast("int")), F.lit(0)).alias(s)
    sums = audit.agg(F.count(F.lit(1)).alias("boundaries"), of("ok"), of("warning"), of("fail"))
    rate = lambda c: F.bround(F.try_divide(c, F.col("boundaries")), 6)
    return sums.withColumn("bridge_rate", rate(F.col("ok"))).withColumn("risk_rate", rate(F.col("warning") + F.col("fail")))
