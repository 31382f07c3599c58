"""The quality gate over chunks of the documents, the graph it gives, and audits of its log.

Candidates are made of each chunk's words, so that every reason to drop one occurs, keys merge, labels
are inferred, and rules meet what was extracted.  The SQL says what the gate must answer for them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.operators import audits, chunking, evaluation, graph, quality
from graphloom.plans import ingest
from graphloom.plans.fixtures import read
from graphloom.queries.sql import CHUNKS, KEY_CHARS
from graphloom.registry import query
from graphloom.sources.tables import dealt, written

WIDE = str.maketrans({chr(c): chr(c + 0xFEE0) for c in range(ord("a"), ord("z") + 1)})
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def extractions(spark, sf, source: str = "documents"):
    """(source, chunk, text, document, page, nodes, relationships): candidates of each chunk of the documents."""
    docs = dealt(read(spark, sf, source).select(F.col("doc_id").cast("string").alias("source"), "text"))
    return candidates(chunking.split_text(docs)).withColumnRenamed("index", "chunk")


def candidates(chunks):
    """``chunks`` (source, index, text, any others) with nodes and relationships; a sentence is added to each text."""
    ws = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))
    rows = chunks.withColumn("ws", ws).withColumn("has", F.size("ws") >= 6)
    w = lambda i: F.col("ws")[i - 1]
    said = F.concat("text", F.lit("\n"), w(1), F.lit("的主要组分是"), w(2), F.lit("、"), w(3), F.lit("。"))
    rows = rows.withColumn("text", F.when(F.col("has"), said).otherwise(F.col("text")))
    s = lambda x: F.lit(x) if isinstance(x, str) else x
    none = F.lit(None).cast("array<string>")
    node = lambda name, label, told="", aliases=none: F.struct(s(name).alias("name"), F.lit(label).alias("label"), s(told).alias("description"), aliases.alias("aliases"))
    stray = F.concat(F.lit("zz"), w(5), F.lit("qq"))
    nodes = F.array(
        node(F.upper(w(1)), "device", "", F.array(w(2))),
        node(w(1), "Equipment", F.concat(F.lit("about "), w(1))),
        node(F.concat(F.lit("the "), w(2)), "Unit"),
        node(w(3), "finished_product", "made"),
        node(w(4), "Gadget"),
        node("12.5", "Unit"),
        node(stray, "Risk"),
        node(F.translate(w(6), LETTERS, LETTERS.translate(WIDE)), "Material"),
    )
    e1, e2, e3, e4 = F.substring("text", 1, 100), F.substring("text", 1, 300), F.right("text", F.lit(60)), F.substring("text", 200, 80)
    edge = lambda source, kind, target, evidence: F.struct(s(source).alias("source"), F.lit(kind).alias("type"), s(target).alias("target"), s(evidence).alias("evidence"))
    edges = F.array(
        edge(w(1), "contains", w(3), e1), edge(w(2), "PRODUCES", w(3), e1), edge(w(2), "produces", w(3), e2), edge(w(2), "PRODUCES", w(3), e1), edge(w(2), "PRODUCES", w(6), e3),
        edge(w(1), "loves", w(2), e1), edge("12.5", "PRODUCES", w(3), e1), edge(stray, "PRODUCES", w(3), e1), edge(w(3), "PRODUCES", F.upper(w(3)), e1), edge(w(2), "PRODUCES", w(3), ""),
        edge(w(2), "PRODUCES", w(3), F.concat(F.lit("completely absent evidence "), w(5), F.lit(" qqqq zzzz"))), edge(w(3), "PRODUCES", w(1), e1), edge(w(1), "contains", w(6), e4), edge(w(4), "PRODUCES", w(6), e1),
    )
    return rows.withColumns({"nodes": F.when(F.col("has"), nodes), "relationships": F.when(F.col("has"), edges)}).drop("ws", "has")


# --- the same in SQL

_KEY = "regexp_replace(lower({}), '" + KEY_CHARS.replace("{", "{{").replace("}", "}}") + "', '', 'g')"
_GENERIC = ", ".join(repr(g) for g in tx.GENERIC_NAMES)
_BAD = f"(({{k}}) = '' OR {{n}} IN ({_GENERIC}) OR {{k}} IN ({_GENERIC}) OR length({{n}}) > 60 OR length({{k}}) < 2 OR regexp_full_match({{k}}, '[\\d.]+'))"


def _clean(x):
    flat = rf"trim(regexp_replace({x}, '\s+', ' ', 'g'), ' `')"
    return f"CASE WHEN length({flat}) > 180 THEN rtrim(left({flat}, 180)) || '...' ELSE {flat} END"


def _edges():
    stray = "'zz' || ws[5] || 'qq'"
    rows = (
        ("ws[1]", "HAS_COMPONENT", "ws[3]", "e1"), ("ws[2]", "PRODUCES", "ws[3]", "e1"), ("ws[2]", "PRODUCES", "ws[3]", "e2"), ("ws[2]", "PRODUCES", "ws[3]", "e1"), ("ws[2]", "PRODUCES", "ws[6]", "e3"),
        ("ws[1]", None, "ws[2]", "e1"), ("'12.5'", "PRODUCES", "ws[3]", "e1"), (stray, "PRODUCES", "ws[3]", "e1"), ("ws[3]", "PRODUCES", "upper(ws[3])", "e1"), ("ws[2]", "PRODUCES", "ws[3]", "''"),
        ("ws[2]", "PRODUCES", "ws[3]", "'completely absent evidence ' || ws[5] || ' qqqq zzzz'"), ("ws[3]", "PRODUCES", "ws[1]", "e1"), ("ws[1]", "HAS_COMPONENT", "ws[6]", "e4"), ("ws[4]", "PRODUCES", "ws[6]", "e1"),
    )
    typed = lambda t: f"'{t}'" if t else "NULL::VARCHAR"
    return ", ".join(f"{{'pos': {i}, 'f': {f}, 'ty': {typed(t)}, 't': {o}, 'ev': {e}}}" for i, (f, t, o, e) in enumerate(rows))


GATE = (
    CHUNKS
    + f""", x AS (SELECT doc_id::VARCHAR AS source, idx AS chunk, regexp_extract_all(lower(chunk), '[a-z]{{4,}}') AS ws, chunk AS base FROM c),
 k AS (SELECT *, len(ws) >= 6 AS has, CASE WHEN len(ws) >= 6 THEN base || chr(10) || ws[1] || '的主要组分是' || ws[2] || '、' || ws[3] || '。' ELSE base END AS text FROM x),
 t AS (SELECT *, {_KEY.format('text')} AS tk, {_clean('substring(text, 1, 100)')} AS e1, {_clean('substring(text, 1, 300)')} AS e2, {_clean('right(text, 60)')} AS e3, {_clean('substring(text, 200, 80)')} AS e4 FROM k WHERE has),
 rn AS (SELECT source, chunk, tk, unnest([{{'pos': 0, 'name': upper(ws[1]), 'label': 'Equipment', 'told': '', 'al': [ws[2]]}}, {{'pos': 1, 'name': ws[1], 'label': 'Equipment', 'told': 'about ' || ws[1], 'al': []}}, {{'pos': 2, 'name': ws[2], 'label': 'Unit', 'told': '', 'al': []}}, {{'pos': 3, 'name': ws[3], 'label': 'Product', 'told': 'made', 'al': []}}, {{'pos': 4, 'name': ws[4], 'label': NULL, 'told': '', 'al': []}}, {{'pos': 5, 'name': '12.5', 'label': 'Unit', 'told': '', 'al': []}}, {{'pos': 6, 'name': 'zz' || ws[5] || 'qq', 'label': 'Risk', 'told': '', 'al': []}}, {{'pos': 7, 'name': ws[6], 'label': 'Material', 'told': '', 'al': []}}], recursive := true) FROM t),
 kn AS (SELECT *, {_KEY.format('name')} AS key FROM rn),
 jn AS (SELECT *, CASE WHEN label IS NULL THEN 'unknown_label' WHEN {_BAD.format(n='name', k='key')} THEN 'bad_name' WHEN NOT contains(tk, key) THEN 'name_not_found_in_chunk' END AS reason FROM kn),
 mn AS (SELECT source, chunk, key, arg_min(name, pos) AS name, arg_min(label, pos) AS label, coalesce(arg_min(told, pos) FILTER (told <> ''), '') AS description, count(*)::INT AS support, arg_min(al, pos) AS first_al, list_sort(list_distinct(flatten(list(al)))) AS names FROM jn WHERE reason IS NULL GROUP BY ALL),
 re AS (SELECT source, chunk, tk, unnest([{_edges()}], recursive := true) FROM t),
 ke AS (SELECT *, {_KEY.format('f')} AS fk, {_KEY.format('t')} AS ok, {_KEY.format('ev')} AS evk FROM re),
 je AS (SELECT *, CASE WHEN ty IS NULL THEN 'unknown_type' WHEN {_BAD.format(n='f', k='fk')} OR {_BAD.format(n='t', k='ok')} THEN 'bad_endpoint' WHEN NOT contains(tk, fk) OR NOT contains(tk, ok) THEN 'endpoint_not_found_in_chunk' WHEN fk = ok THEN 'self_loop' WHEN ev = '' THEN 'missing_evidence' WHEN evk = '' OR NOT contains(tk, evk) THEN 'evidence_not_found' END AS reason,
   0.2::DOUBLE + 0.35::DOUBLE + CASE WHEN contains(evk, fk) THEN 0.15 ELSE 0.05 END::DOUBLE + CASE WHEN contains(evk, ok) THEN 0.15 ELSE 0.05 END::DOUBLE + 0.1::DOUBLE + CASE WHEN length(ev) BETWEEN 8 AND 180 THEN 0.05 ELSE 0 END::DOUBLE AS base FROM ke),
 le AS (SELECT je.*, s.name AS sname, o.name AS oname, coalesce(s.label, CASE ty WHEN 'PRODUCES' THEN 'Plant' ELSE 'Material' END) AS sl, coalesce(o.label, 'Material') AS ol FROM je LEFT JOIN mn s ON s.source = je.source AND s.chunk = je.chunk AND s.key = fk LEFT JOIN mn o ON o.source = je.source AND o.chunk = je.chunk AND o.key = ok),
 oe AS (SELECT *, (CASE ty WHEN 'PRODUCES' THEN sl NOT IN ('Plant', 'Unit', 'Process') ELSE sl NOT IN ('Material', 'Product') END)::INT AS so, (ol NOT IN ('Material', 'Product'))::INT AS oo FROM le),
 se AS (SELECT *, greatest(0, least(base - 0.14::DOUBLE * (so + oo), 1.0))::DOUBLE AS conf FROM oe),
 de AS (SELECT *, coalesce(reason, CASE WHEN so + oo = 2 THEN 'double_schema_mismatch' WHEN conf < 0.7 THEN 'low_confidence:' || printf('%.2f', conf) END) AS drop_reason FROM se),
 ae AS (SELECT source, chunk, pos, fk, ty, ok, coalesce(sname, f) AS sname, coalesce(oname, t) AS oname, sl, ol, ev, round(conf, 3) AS conf, concat_ws(',', CASE WHEN so = 1 THEN 'source_schema_mismatch' END, CASE WHEN oo = 1 THEN 'target_schema_mismatch' END) AS flags FROM de WHERE drop_reason IS NULL),
 inf AS (SELECT source, chunk, fk AS key, arg_min(f, pos) AS name, arg_min(sl, pos) AS label FROM de WHERE drop_reason IS NULL AND sname IS NULL GROUP BY ALL),
 nodes AS (SELECT source, chunk, key, name, label, description, support, CASE WHEN support > 1 THEN list_filter(names, lambda a: a <> name) ELSE first_al END AS aliases FROM mn UNION ALL SELECT source, chunk, key, name, label, '', 1, [] FROM inf),
 bst AS (SELECT source, chunk, fk, ty, ok, max(conf) AS best FROM ae GROUP BY ALL),
 fst AS (SELECT ae.source, ae.chunk, ae.fk, ae.ty, ae.ok, min(pos) AS at FROM ae JOIN bst USING (source, chunk, fk, ty, ok) WHERE conf = best GROUP BY ALL),
 cnt AS (SELECT f.source, f.chunk, f.fk, f.ty, f.ok, f.at, count(*) AS n FROM fst f JOIN ae USING (source, chunk, fk, ty, ok) WHERE ae.pos >= f.at GROUP BY ALL),
 acc AS (SELECT ae.*, n FROM ae JOIN cnt ON cnt.source = ae.source AND cnt.chunk = ae.chunk AND cnt.fk = ae.fk AND cnt.ty = ae.ty AND cnt.ok = ae.ok AND cnt.at = ae.pos),
 rr AS (SELECT source, chunk, unnest([{{'pos': 0, 'f': ws[1], 't': ws[2]}}, {{'pos': 1, 'f': ws[1], 't': ws[3]}}], recursive := true), {_clean("ws[1] || '的主要组分是' || ws[2] || '、' || ws[3]")} AS ev FROM t),
 rk AS (SELECT *, {_KEY.format('f')} AS fk, {_KEY.format('t')} AS ok FROM rr),
 ru AS (SELECT rk.source, rk.chunk, fk, ok, arg_min(s.name, pos) AS sname, arg_min(o.name, pos) AS oname, arg_min(s.label, pos) AS sl, arg_min(o.label, pos) AS ol, min(ev) AS ev, count(*) AS n FROM rk JOIN nodes s ON s.source = rk.source AND s.chunk = rk.chunk AND s.key = fk JOIN nodes o ON o.source = rk.source AND o.chunk = rk.chunk AND o.key = ok WHERE fk <> ok GROUP BY ALL),
 edges AS (SELECT acc.source, acc.chunk, acc.fk, acc.ty, acc.ok, acc.sname, acc.oname, acc.sl, acc.ol, acc.ev, acc.conf, acc.flags, (acc.n + coalesce(ru.n, 0))::INT AS support FROM acc LEFT JOIN ru ON ru.source = acc.source AND ru.chunk = acc.chunk AND ru.fk = acc.fk AND ru.ok = acc.ok AND acc.ty = 'HAS_COMPONENT'
   UNION ALL SELECT ru.source, ru.chunk, ru.fk, 'HAS_COMPONENT', ru.ok, ru.sname, ru.oname, ru.sl, ru.ol, ru.ev, 0.92::DOUBLE, 'rule_based', ru.n::INT FROM ru WHERE NOT EXISTS (SELECT 1 FROM acc WHERE acc.source = ru.source AND acc.chunk = ru.chunk AND acc.fk = ru.fk AND acc.ok = ru.ok AND acc.ty = 'HAS_COMPONENT')) """
)


@query(GATE + "SELECT source, chunk, name, label, key AS canonical_key, description, array_to_string(aliases, ',') AS aliases, support AS support_count FROM nodes")
def gate_nodes(spark, sf):
    rows = quality.gate(extractions(spark, sf)).select("source", "chunk", F.explode("nodes").alias("n"))
    return rows.select("source", "chunk", "n.name", "n.label", "n.canonical_key", "n.description", F.array_join("n.aliases", ",").alias("aliases"), "n.support_count")


@query(GATE + "SELECT source AS document, chunk, sname AS source, sl AS source_label, ty AS type, oname AS target, ol AS target_label, ev AS evidence, conf AS confidence, flags, support AS support_count FROM edges")
def gate_edges(spark, sf):
    rows = quality.gate(extractions(spark, sf)).select(F.col("source").alias("document"), "chunk", F.explode("relationships").alias("e"))
    return rows.select("document", "chunk", *(f"e.{c}" for c in ("source", "source_label", "type", "target", "target_label", "evidence", "confidence")), F.array_join("e.quality_flags", ",").alias("flags"), "e.support_count")


@query(GATE + "SELECT 'node' AS kind, reason, count(*)::BIGINT AS n FROM jn WHERE reason IS NOT NULL GROUP BY reason UNION ALL SELECT 'relationship', drop_reason, count(*) FROM de WHERE drop_reason IS NOT NULL GROUP BY drop_reason")
def gate_drop_reasons(spark, sf):
    return evaluation.reason_counts(quality.gate(extractions(spark, sf)))


@query(GATE + "SELECT (SELECT count(*) FROM k)::BIGINT AS chunks, (SELECT count(*) FROM rn)::BIGINT AS input_nodes, (SELECT count(*) FROM nodes)::BIGINT AS accepted_nodes, (SELECT count(*) FROM re)::BIGINT AS input_relationships, (SELECT count(*) FROM edges)::BIGINT AS accepted_relationships, ((SELECT count(*) FROM jn WHERE reason IS NOT NULL) + (SELECT count(*) FROM de WHERE drop_reason IS NOT NULL))::BIGINT AS dropped_count")
def quality_counters(spark, sf):
    return evaluation.quality_totals(quality.gate(extractions(spark, sf)))


# --- the graph that the gate's log gives


GRAPH = GATE + ", g AS (SELECT sl AS src_label, fk AS src_key, ty AS type, ol AS dst_label, ok AS dst_key, arg_max(ev, row(conf, source, chunk)) AS evidence, max(conf) AS confidence, sum(support)::BIGINT AS support_count, count(DISTINCT source)::BIGINT AS documents FROM edges GROUP BY ALL) "


def _log(spark, sf, text: bool = True):
    return ingest.log_of(extractions(spark, sf), text)


def _edges_out(edges):
    return edges.select(*graph.EDGE_KEY, "evidence", "confidence", "support_count", F.size("documents").cast("long").alias("documents"))


@query(GRAPH + "SELECT * FROM g")
def build_graph(spark, sf):
    # the log is written once: nodes, edges and the lists of both are made of it
    nodes, edges = ingest.graph_rows(written(_log(spark, sf).drop("text", "quality"), tag="log"))
    return _edges_out(graph.attached(graph.upsert_edges(edges), graph.upsert_nodes(nodes)))


@query(GATE + "SELECT label, key AS canonical_key, arg_min(name, row(source, chunk)) AS name, coalesce(arg_min(description, row(source, chunk)) FILTER (description <> ''), '') AS description, arg_min(source, row(source, chunk)) AS source, sum(support)::BIGINT AS support_count, (SELECT count(DISTINCT a) FROM (SELECT unnest(m.aliases) AS a FROM nodes m WHERE m.label = nodes.label AND m.key = nodes.key))::BIGINT AS aliases FROM nodes GROUP BY label, key")
def graph_nodes(spark, sf):
    # the gate's nodes are written once: their values and the lists of their aliases are made of them
    nodes = graph.upsert_nodes(written(ingest.graph_rows(_log(spark, sf, False))[0], tag="nodes"))
    return nodes.select("label", "canonical_key", "name", F.coalesce("description", F.lit("")).alias("description"), "source", "support_count", F.size("aliases").cast("long").alias("aliases"))


@query(GATE + "SELECT (SELECT count(*) FROM nodes)::BIGINT AS attempted, (SELECT count(*) FROM nodes WHERE label <> '' AND name <> '')::BIGINT AS written")
def write_counts(spark, sf):
    return graph.written(ingest.graph_rows(_log(spark, sf))[0], "label", "name")


# --- audits of the log


@query(GATE + "SELECT (SELECT count(*) FROM k)::BIGINT AS chunks, (SELECT count(*) FROM nodes)::BIGINT AS accepted_nodes, (SELECT count(*) FROM rn)::BIGINT AS input_nodes, (SELECT count(*) FROM edges)::BIGINT AS accepted_relationships, (SELECT count(*) FROM re)::BIGINT AS input_relationships, ((SELECT count(*) FROM jn WHERE reason IS NOT NULL) + (SELECT count(*) FROM de WHERE drop_reason IS NOT NULL))::BIGINT AS dropped")
def audit_totals(spark, sf):
    return audits.totals(_log(spark, sf))


@query(GATE + "SELECT reason, n, row_number() OVER (ORDER BY n DESC, reason)::INT AS place FROM (SELECT reason, count(*)::BIGINT AS n FROM (SELECT reason FROM jn WHERE reason IS NOT NULL UNION ALL SELECT drop_reason FROM de WHERE drop_reason IS NOT NULL) GROUP BY reason) ORDER BY n DESC, reason LIMIT 12")
def audit_drop_reasons(spark, sf):
    return audits.drop_reasons(_log(spark, sf))


@query(GATE + "SELECT label, n, row_number() OVER (ORDER BY n DESC, label)::INT AS place FROM (SELECT label, count(*)::BIGINT AS n FROM nodes GROUP BY label)")
def audit_labels(spark, sf):
    return audits.histogram(audits.log_nodes(_log(spark, sf)), "label")


@query(GATE + "SELECT type, n, row_number() OVER (ORDER BY n DESC, type)::INT AS place FROM (SELECT ty AS type, count(*)::BIGINT AS n FROM edges GROUP BY ty)")
def audit_types(spark, sf):
    return audits.histogram(audits.log_edges(_log(spark, sf)), "type")


@query(GATE + "SELECT source, chunk, sname || ' -' || ty || '-> ' || oname AS triple, conf AS confidence, flags FROM edges WHERE conf < 0.85")
def audit_low_confidence(spark, sf):
    return audits.low_confidence(_log(spark, sf), 0.85)


@query(GATE + "SELECT key, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM nodes GROUP BY key HAVING count(DISTINCT name) > 1")
def audit_merged_names(spark, sf):
    return audits.merged_names(_log(spark, sf)).select("key", F.array_join("names", ",").alias("names"))


@query(GATE + f", v AS (SELECT e.ev, k.text, {_KEY.format('e.ev')} AS ek, {_KEY.format('k.text')} AS kk FROM edges e JOIN k ON k.source = e.source AND k.chunk = e.chunk) SELECT count(*)::BIGINT AS count, round(avg((ev <> '')::INT), 6) AS has_evidence_rate, round(avg((ek <> '' AND contains(kk, ek))::INT), 6) AS evidence_support_rate FROM v")
def evidence_rates(spark, sf):
    edges = audits.log_edges(_log(spark, sf)).withColumn("known", F.coalesce("text", F.lit("")) != "")
    found = quality.with_located(edges, F.col("evidence"), F.col("text"), "evidence", "known")
    return evaluation.evidence_rates(found.select("evidence", F.when(F.col("known"), F.col("located")).alias("located")))


_PAIRS = "list_transform(range(1, greatest(length({t}), 2)), lambda i: {t}[i:i + 1])"
_NEAR = f"CASE WHEN 2 * least(length(e), length(s)) >= {tx.ALIKE}::DOUBLE * (length(e) + length(s)) THEN len(list_filter({_PAIRS.format(t='e')}, lambda p: list_contains({_PAIRS.format(t='s')}, p))) >= {1.5 * tx.ALIKE - 1!r}::DOUBLE * (length(e) + length(s)) - 1 ELSE false END"


@query(f"WITH d AS (SELECT doc_id, {_KEY.format('left(text, 60)')} AS e, unnest(list_filter(list_transform(regexp_split_to_array(text, '[\n。！？!?；;]'), lambda x: {_KEY.format('x')}), lambda k: length(k) >= 8)) AS s FROM documents) SELECT doc_id, count(*)::BIGINT AS sentences, count(*) FILTER ({_NEAR})::BIGINT AS verified FROM d GROUP BY doc_id")
def evidence_bounds(spark, sf):
    """How many of a document's sentences may be like its first 60 characters: those alone are compared in Python."""
    docs = dealt(read(spark, sf, "documents").select("doc_id", "text"))
    rows = docs.select("doc_id", tx._key(F.substring("text", 1, 60)).alias("key"), tx.segment_keys(F.col("text")).alias("segments")).filter(F.size("segments") > 0)
    return rows.select("doc_id", F.size("segments").cast("long").alias("sentences"), F.size(tx.near_segments(F.col("key"), F.col("segments"))).cast("long").alias("verified"))


@query(CHUNKS + ", x AS (SELECT doc_id::VARCHAR AS source, idx AS chunk, regexp_extract_all(lower(chunk), '[a-z]{4,}') AS ws FROM c) SELECT source, chunk, len(ws)::INT AS dropped_count, least(len(ws), 30)::INT AS kept, md5(array_to_string(list_transform(ws[1:30], lambda w: 'zz' || w || 'qq'), ',')) AS first_names FROM x")
def gate_drop_cap(spark, sf):
    """A candidate of no chunk for every word: all are counted, the first thirty are kept."""
    docs = dealt(read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("source"), "text"))
    chunks = chunking.split_text(docs).withColumnRenamed("index", "chunk")
    ws = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))
    none = F.lit(None).cast("array<string>").alias("aliases")
    nodes = F.transform(ws, lambda w: F.struct(F.concat(F.lit("zz"), w, F.lit("qq")).alias("name"), F.lit("Risk").alias("label"), F.lit("").alias("description"), none))
    rows = chunks.select("source", "chunk", "text", nodes.alias("nodes"), F.lit(None).cast(quality._RAW_EDGES).alias("relationships"))
    found = quality.gate(rows)
    return found.select("source", "chunk", "dropped_count", F.size("dropped").alias("kept"), F.md5(F.array_join(F.transform("dropped", lambda d: d["name"]), ",").cast("binary")).alias("first_names"))


@query(GATE + "SELECT (SELECT count(*) FROM nodes)::BIGINT AS attempted, (SELECT count(*) FROM nodes WHERE support = 1)::BIGINT AS written")
def write_refusals(spark, sf):
    """As ``write_counts``, where nodes met more than once have lost their names."""
    rows = ingest.graph_rows(_log(spark, sf))[0]
    return graph.written(rows.withColumn("name", F.when(F.col("support_count") == 1, F.col("name"))), "label", "name")
