"""Names of files and sources, page segments, and records of several JSON shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import records
from graphloom.functions import text as tx
from graphloom.operators import audits
from graphloom.plans import fixtures, ingest
from graphloom.plans.fixtures import read
from graphloom.registry import query


@query(r"SELECT page_id, regexp_replace(regexp_replace(name, '[^A-Za-z0-9\-_.]', '_', 'g'), '^_+|_+$', '', 'g') AS stem, 'doc ' || page_id AS bare, name || '#page=' || coalesce((page_id % 9)::VARCHAR, 'unknown') || '#boundary=to_next' AS boundary FROM (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '\.[^./]*$', '') || ' x' AS name FROM pages)")
def file_stems(spark, sf):
    name = F.concat(F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"\.[^./]*$", ""), F.lit(" x"))
    rows = read(spark, sf, "pages").select("page_id", name.alias("name"))
    ranged = F.when(F.col("page_id") % 2 == 0, F.format_string("doc %d_pages_%04d_%04d", "page_id", F.col("page_id") % 99, F.col("page_id") % 99 + 1)).otherwise(F.format_string("doc %d_Page_%d", "page_id", F.col("page_id") % 99))
    return rows.select("page_id", tx.safe_stem(F.concat("name", F.lit(".txt"))).alias("stem"), tx.document_stem(ranged).alias("bare"), tx.neighbour_ref(F.col("name"), F.col("page_id") % 9, "to_next").alias("boundary"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Given' ELSE 'My Book ' || page_id END AS document, CASE page_id % 3 WHEN 0 THEN (page_id % 7)::VARCHAR WHEN 1 THEN (page_id % 50)::VARCHAR END AS page FROM pages")
def hit_sources(spark, sf):
    i = F.col("page_id")
    source = F.when(i % 3 == 1, F.format_string("My_Book_%d_page_%04d.txt", i, i % 50)).otherwise(F.format_string("My_Book_%d.pdf", i))
    rows = read(spark, sf, "pages").select("page_id", F.when(i % 3 == 0, F.lit(" Given ")).alias("document"), (i % 7).cast("string").alias("page"), source.alias("source"))
    args = F.col("document"), F.col("page"), F.col("source")
    return rows.select("page_id", tx.document_of(args[0], args[2]).alias("document"), tx.page_of(*args).alias("page"))


@query("SELECT conv_id AS doc, (turn + 1)::INT AS page, md5(chr(10) || text || CASE WHEN turn < max(turn) OVER (PARTITION BY conv_id) THEN chr(10) ELSE '' END) AS digest FROM conversations")
def page_segments(spark, sf):
    rows = fixtures.paged_text(spark, sf).select("doc", F.explode(tx.page_segments(F.col("text"))).alias("p"))
    return rows.select("doc", "p.page", F.md5(F.col("p.text").cast("binary")).alias("digest"))


@query("SELECT conv_id::VARCHAR AS source, (CASE WHEN count(*) <= 3 THEN 1 ELSE CAST(ceil((count(*) - 3) / 2.0) AS INT) + 1 END)::BIGINT AS items FROM conversations GROUP BY conv_id")
def work_items(spark, sf):
    rows = fixtures.pages(spark, sf, False).withColumn("source", F.col("doc").cast("string"))
    return ingest.work_items(rows, 3, 1)


_COMPACT = r"regexp_replace(regexp_replace({}, '(?m)^\s*===== PAGE \s*\d+\s*(=====\s*)?$', '', 'g'), '\s+', '', 'g')"
# pages joined under their markers, cut into chunks, each of which knows its pages
AUDITED = rf"""WITH t AS (SELECT conv_id::VARCHAR AS document, (turn + 1)::INT AS page, text, '===== PAGE ' || (turn + 1) || ' =====' || chr(10) || text AS part FROM conversations),
 s AS (SELECT document, page, sum(length(part) + 2) OVER (PARTITION BY document ORDER BY page) - length(part) - 2 AS start, length(part) AS len, max(page) OVER (PARTITION BY document) AS last FROM t),
 e AS (SELECT document, page, CASE WHEN page = 1 THEN start ELSE start - 1 END AS a, start + len + (page < last)::INT AS z FROM s),
 d AS (SELECT document, string_agg(part, chr(10) || chr(10) ORDER BY page) AS body FROM t GROUP BY document),
 c AS (SELECT document, i, (i - 1) * 2350 AS a, least((i - 1) * 2350 + 2600, length(body)) AS z, {_COMPACT.format('substring(body, ((i - 1) * 2350 + 1)::BIGINT, 2600)')} AS held FROM (SELECT *, unnest(generate_series(1, CASE WHEN length(body) <= 2600 THEN 1 ELSE CAST(ceil((length(body) - 2600) / 2350.0) AS INT) + 1 END)) AS i FROM d)),
 r AS (SELECT c.document, c.i, any_value(held) AS held, min(page) AS page_start, max(page) AS page_end FROM c JOIN e ON e.document = c.document AND e.a < c.z AND e.z > c.a GROUP BY c.document, c.i),
 b AS (SELECT t.document, t.page, n.page AS next_page, right({_COMPACT.format('t.text')}, 24) AS tail, left({_COMPACT.format('n.text')}, 24) AS head FROM t JOIN t n ON n.document = t.document AND n.page = t.page + 1),
 f AS (SELECT b.document, b.page, b.next_page, count(held)::BIGINT AS covering, coalesce(sum((contains(held, tail) AND contains(held, head))::INT), 0)::BIGINT AS holding FROM b LEFT JOIN r ON r.document = b.document AND page_start <= b.page AND page_end >= b.next_page GROUP BY ALL)
SELECT *, CASE WHEN holding > 0 THEN 'ok' WHEN covering > 0 THEN 'warning' ELSE 'fail' END AS status FROM f"""
_AUDIT = ("document", "page", "next_page", "covering", "holding", "status")


@query(AUDITED)
def page_file_boundaries(spark, sf):
    """Page files ``name_page_N.txt`` of a document are joined again; their boundaries are held against its chunks."""
    rows = fixtures.pages(spark, sf, False).select(F.format_string("%d_page_%d.txt", "doc", "page").alias("source"), "text")
    return audits.audit_page_files(rows).select(*_AUDIT)


@query(AUDITED)
def marked_boundaries(spark, sf):
    """Marked pages inside documents: their boundaries against the documents' chunks."""
    rows = fixtures.paged_text(spark, sf).select(F.col("doc").cast("string").alias("source"), "text")
    return audits.audit_documents(rows).select(*_AUDIT)


# --- records: JSON of several shapes made of each row, and what it stands for

_I = "page_id"


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN page_id::VARCHAR WHEN 1 THEN array_to_string([page_id::VARCHAR, (page_id + 1)::VARCHAR], ',') WHEN 2 THEN array_to_string(list_distinct(['7', (page_id % 9)::VARCHAR, 'iv']), ',') ELSE '' END AS pages FROM pages".replace("list_distinct(['7', (page_id % 9)::VARCHAR, 'iv'])", "CASE WHEN page_id % 9 = 7 THEN ['7', 'iv'] ELSE ['7', (page_id % 9)::VARCHAR, 'iv'] END"))
def record_pages(spark, sf):
    i = F.col(_I)
    json = F.when(i % 4 == 0, i.cast("string")).when(i % 4 == 1, F.format_string('"%d-%d"', i, i + 1)).when(i % 4 == 2, F.format_string('["07", %d, "iv"]', i % 9))
    return read(spark, sf, "pages").select(_I, F.array_join(records.pages(json), ",").alias("pages"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'r' || page_id WHEN 1 THEN 'a' || page_id || ',b' WHEN 2 THEN 's' || page_id || ',i,c' ELSE '' END AS refs FROM pages")
def record_refs(spark, sf):
    i = F.col(_I)
    json = F.when(i % 4 == 0, F.format_string('" r%d "', i)).when(i % 4 == 1, F.format_string('["a%d", "b", "b", ""]', i)).when(i % 4 == 2, F.format_string('[{"source_ref": "s%d", "id": "x"}, {"source_ref": "", "id": "i"}, {"chunk_id": "c"}, {}]', i))
    return read(spark, sf, "pages").select(_I, F.array_join(records.chunk_refs(json), ",").alias("refs"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'ab' || page_id || '|HAS_PART|c' WHEN 1 THEN 'ab' || page_id || '|HAS PART|c' ELSE 'ab' || page_id || '|OWNS|c' END AS triple FROM pages")
def record_triples(spark, sf):
    i = F.col(_I)
    json = F.when(i % 3 == 0, F.format_string('[{"source": "A b%d", "relation": "has_part", "target": "C"}, {"source": "x"}, 5]', i)).when(i % 3 == 1, F.format_string('[["A b%d", " has part ", "C", "more"], ["x", "y"]]', i)).otherwise(F.format_string('["a B%d => owns --> C", "no arrows"]', i))
    t = records.triples(json)
    return read(spark, sf, "pages").select(_I, F.explode(t).alias("t")).select(_I, F.concat_ws("|", "t.source", "t.type", "t.target").alias("triple"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN '1=2.0,7=1.0,9=0.5' WHEN 1 THEN '7=1.0,9=3.0' ELSE '7=1.0,9=1.0' END AS relevance FROM pages")
def record_relevance(spark, sf):
    i = F.col(_I)
    json = F.when(i % 3 == 0, F.lit('{"1": 2, "9": 0.5}')).when(i % 3 == 1, F.lit('[{"page": "9", "relevance": 1}, {"id": 9, "score": 3}, "7"]'))
    found = records.relevance(json, F.array(F.lit("7"), F.lit("9")))
    pairs = F.transform(F.array_sort(F.map_entries(found)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return read(spark, sf, "pages").select(_I, F.array_join(pairs, ",").alias("relevance"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN '3,4' WHEN 1 THEN '5,6,7' ELSE '' END AS pages, CASE WHEN page_id % 2 = 0 THEN 'ref,id' || page_id || ',src::' || (page_id + 1) ELSE 'id' || page_id END AS refs FROM pages")
def hit_items(spark, sf):
    i = F.col(_I)
    page, start, end = F.when(i % 3 == 0, F.lit("3-4")), F.when(i % 3 != 2, F.lit(5)), F.when(i % 3 == 1, F.lit(7))
    refs = records.item_refs(F.when(i % 2 == 0, F.lit("ref")), F.format_string("id%d", i), F.when(i % 2 == 0, F.lit("src")), (i + 1).cast("int"))
    return read(spark, sf, "pages").select(_I, F.array_join(records.item_pages(page, start, end), ",").alias("pages"), F.array_join(refs, ",").alias("refs"))
