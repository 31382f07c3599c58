"""Pieces of SQL that several queries' checks share."""

BODY = r"regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
CHUNKS = rf"""
WITH b AS (SELECT doc_id, lang, source, {BODY} AS body FROM documents),
 n AS (SELECT *, length(body) AS len, CASE WHEN length(body) = 0 THEN 0 WHEN length(body) <= 2600 THEN 1 ELSE CAST(ceil((length(body) - 2600) / 2350.0) AS INT) + 1 END AS n FROM b),
 c AS (SELECT doc_id, lang, source, i::INT AS idx, substring(body, ((i - 1) * 2350 + 1)::INT, 2600) AS chunk FROM n, LATERAL (SELECT unnest(generate_series(1, n.n)) AS i))
"""
# What names lose at their edges, what keys drop and how names are cleaned, as in functions/text.py.
EDGE_CHARS = r"[\s:：,，.;；\-—_()（）\[\]【】\x22\x27“”]+"
KEY_CHARS = r"[\s\-_./\\:：,，.;；()（）\[\]【】{}<>《》\x22\x27“”‘’]+"
CLEAN = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(name, '\s+', ' ', 'g')), '^{EDGE_CHARS}', ''), '{EDGE_CHARS}$', ''), '(?i)^(the|a|an)\s+', ''), '(的)?(主要|最重要的|重要的)?(组分|成分|质量|控制|工艺|操作)$', '')"
