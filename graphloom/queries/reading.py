"""Files written from the tables and read again: texts in two encodings, numbered JSON lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.plans import fixtures
from graphloom.plans.fixtures import read
from graphloom.registry import query
from graphloom.sources import files


@query("SELECT source, count(*)::BIGINT AS texts, md5(string_agg(CASE WHEN source IN ('src1', 'src3') THEN '催化剂' || doc_id ELSE text END || chr(10), '' ORDER BY doc_id)) AS digest FROM documents GROUP BY source")
def file_texts(spark, sf):
    """A file for each source; two of them are GBK, which is told by what is no UTF-8."""
    out = fixtures.scratch(spark, "texts")
    wide = F.concat(F.unhex(F.lit("催化剂".encode("gbk").hex())), F.col("doc_id").cast("string").cast("binary")).cast("string")
    rows = read(spark, sf, "documents").select("doc_id", "source", F.when(F.col("source").isin("src1", "src3"), wide).otherwise(F.col("text")).alias("value"))
    rows.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "value").write.partitionBy("source").text(out)
    sizes = read(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("texts"))
    found = files.list_files(spark, out, "txt").select(F.regexp_extract("path", r"/source=([^/]+)/[^/]+$", 1).alias("name"), "suffix", "content")
    return files.decoded(found).join(sizes, "source").select("source", "texts", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'd' || doc_id ELSE printf('q%04d', line) END AS id, question FROM (SELECT doc_id, left(text, 30) AS question, (row_number() OVER (ORDER BY doc_id) + sum(CASE doc_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END) OVER (ORDER BY doc_id))::BIGINT AS line FROM documents)")
def json_line_numbers(spark, sf):
    """Records without an id are named by their line, among notes and blank lines."""
    out = fixtures.scratch(spark, "lines")
    i = F.col("doc_id")
    record = F.to_json(F.struct(F.when(i % 2 == 0, F.concat(F.lit("d"), i.cast("string"))).alias("id"), i.alias("doc_id"), F.left("text", F.lit(30)).alias("question")))
    before = F.when(i % 5 == 0, F.lit("# a note\n")).when(i % 5 == 1, F.lit("\n  \t\n")).otherwise("")
    # one file in order is what is numbered
    rows = read(spark, sf, "documents").select(i, F.concat(before, record).alias("value"))
    rows.repartitionByRange(1, "doc_id").sortWithinPartitions("doc_id").select("value").write.text(out)
    return files.read_json_lines(spark, out, "id string, doc_id long, question string", "id").select("doc_id", "id", "question")
