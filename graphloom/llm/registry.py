"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

import corpus_pipeline

from graphloom.llm.ann import op10_ann
from graphloom.llm.centroids import op12_centroids
from graphloom.llm.fingerprints import op2_fingerprints
from graphloom.llm.licenses import op7_licenses
from graphloom.llm.lm_scoring import op1_lm_scoring
from graphloom.llm.merkle import op13_merkle
from graphloom.llm.mixing import op6_mixing
from graphloom.llm.near_dedup import op3_near_dedup
from graphloom.llm.packing import op8_packing
from graphloom.llm.pii import op9_pii
from graphloom.llm.toxicity import op5_toxicity
from graphloom.llm.url_filters import op4_url_filters
from graphloom.llm.warc import op11_warc

OPERATORS = (op1_lm_scoring, op2_fingerprints, op3_near_dedup, op4_url_filters, op5_toxicity, op6_mixing, op7_licenses, op8_packing, op9_pii, op10_ann, op11_warc, op12_centroids, op13_merkle)


NEAR_DEDUP_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
 l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
 e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
 c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

# the plan without slices: every source sorted whole, and the same digest as the draw
MIXING_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
 w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, source_size * 3.0::DOUBLE AS ceiling FROM s),
 l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(ceiling) OVER f, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER f, 0)) AS share FROM w WINDOW f AS (ORDER BY ceiling / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 g AS (SELECT *, ceiling / w <= share AS is_full, (SELECT arg_min(share, ceiling / w) FROM l WHERE NOT ceiling / w <= share) AS level FROM l),
 t AS (SELECT source, source_size, CASE WHEN is_full THEN ceiling ELSE w * level END AS target FROM g),
 k AS (SELECT d.*, source_size, target, coalesce(floor(target / nullif(source_size, 0)), 0) AS epochs, coalesce(doc_id::VARCHAR, '') || ':' || md5(t) AS row_id,
   CASE WHEN length(t) / greatest(size, 1)::DOUBLE BETWEEN 3 AND 12 THEN 1.0 ELSE 0.5 END * CASE WHEN size >= 20 THEN 1.0 ELSE 0.5 END AS q FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
 o AS (SELECT *, target - epochs * source_size AS budget, -ln((('0x' || substr(md5('17:' || row_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / q::DOUBLE AS key FROM k),
 b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o)
SELECT doc_id, size, source_size, target, (size * least(epochs + (before < budget AND before + size / 2::DOUBLE <= budget)::INT, 3))::BIGINT AS taken FROM b
"""

WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
 f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, nullif(first, page_id) AS refers_to FROM f
"""


def _centroids_sql(rounds: int = 10) -> str:
    """Every round against all centroids: no bounds."""
    squares = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    parts = [
        "v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS j, x FROM v ORDER BY sha256('3:' || vec_id) LIMIT 8)",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT vec_id, min(row({squares}, j)) AS near FROM v, c{i} c GROUP BY vec_id)")
        if i < rounds:
            parts.append(f"s{i} AS MATERIALIZED (SELECT j, i, sum(e)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT near[2] AS j, unnest(x) AS e, unnest(range(64)) AS i FROM a{i} JOIN v USING (vec_id)) GROUP BY j, i)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT j, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (SELECT j, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM s{i} GROUP BY j) m USING (j))")
    return "WITH " + ",\n ".join(parts) + f"\nSELECT vec_id, j::INT AS cluster, near[1] AS distance, sum(near[1]) OVER (PARTITION BY j)::BIGINT AS cluster_inertia, sum(near[1]) OVER ()::BIGINT AS inertia, sha256(array_to_string(x, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON j = near[2]"


def _leaf_sql(text: str) -> str:
    part = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}, '-')"
    return f"sha256({' || '.join(part(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


def _tree_sql(leaves: str, out: str) -> str:
    """``out`` (tree, id, top, proof, fold) of leaves (tree, id, pos, n, d, fold), a level at a time."""
    return f"""{out}_t(tree, lvl, pos, n, d) AS (SELECT tree, 0, pos, n, d FROM {leaves} UNION ALL SELECT tree, lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(d, '' ORDER BY pos)) FROM {out}_t WHERE n > 1 GROUP BY tree, lvl, pos // 16, n),
 {out}_r AS (SELECT tree, lvl, pos // 16 AS run, list(d ORDER BY pos) AS ds FROM {out}_t WHERE n > 1 GROUP BY ALL),
 {out}_p(tree, id, lvl, pos, n, proof, fold) AS (SELECT tree, id, 0, pos, n, '', fold FROM {leaves} UNION ALL
  SELECT p.tree, id, p.lvl + 1, pos // 16, (n + 15) // 16, proof || array_to_string(ds[1:pos % 16], '') || array_to_string(ds[pos % 16 + 2:16], ''), sha256(array_to_string(ds[1:pos % 16], '') || fold || array_to_string(ds[pos % 16 + 2:16], '')) FROM {out}_p p JOIN {out}_r r ON r.tree = p.tree AND r.lvl = p.lvl AND run = pos // 16 WHERE n > 1),
 {out} AS (SELECT p.tree, id, t.d AS top, proof, fold FROM {out}_p p JOIN {out}_t t ON t.tree = p.tree AND t.n = 1 WHERE p.n = 1)"""


# crc32 bit by bit, over the id's digits
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
MERKLE_SQL = f"""
WITH RECURSIVE k AS (SELECT doc_id, source, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree, {_leaf_sql('text')} AS d, {_leaf_sql(_LOWER)} AS low, {_CRC} % 5 = 0 AS bad FROM documents),
 l AS (SELECT tree, doc_id AS id, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n, d, CASE WHEN bad THEN low ELSE d END AS fold FROM k),
 {_tree_sql('l', 'own')},
 s AS (SELECT 1 AS tree, tree AS id, tree - 1 AS pos, count(*) OVER () AS n, top AS d, top AS fold FROM (SELECT DISTINCT tree, top FROM own)),
 {_tree_sql('s', 'all_')},
 j AS (SELECT own.id, own.tree, own.top AS subroot, own.proof || a.proof AS proof, own.fold, a.top AS root FROM own JOIN all_ a ON a.id = own.tree),
 f(id, tree, lvl, pos, n, fold) AS (SELECT j.id, j.tree, 0, s.pos, s.n, j.fold FROM j JOIN s ON s.id = j.tree UNION ALL
  SELECT f.id, f.tree, f.lvl + 1, pos // 16, (n + 15) // 16, sha256(array_to_string(ds[1:pos % 16], '') || fold || array_to_string(ds[pos % 16 + 2:16], '')) FROM f JOIN all__r r ON r.lvl = f.lvl AND run = pos // 16 WHERE n > 1)
SELECT j.id AS doc_id, l.d AS leaf, subroot, root, sha256(proof) AS proof_sha256, f.fold AS folded_root, f.fold = root AS verified FROM j JOIN f ON f.id = j.id AND f.n = 1 JOIN l ON l.id = j.id
"""


def queries():
    return {f.__name__: f for f in OPERATORS} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    return {"op3_near_dedup": NEAR_DEDUP_SQL, "op6_mixing": MIXING_SQL, "op11_warc": WARC_SQL, "op12_centroids": _centroids_sql(), "op13_merkle": MERKLE_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
