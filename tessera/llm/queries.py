"""The queries of this subpackage, by name, for ``__spark_entry__.py``."""

from __future__ import annotations

from .context_mixing import op8_context_mixing
from .filter_audit import op12_filter_audit
from .langid import op10_language_id
from .matroska import op4_matroska
from .merkle import op5_merkle
from .mixing import op3_fair_queue_mix
from .ngram_join import op6_ngram_join
from .packing import op1_best_fit_packing
from .product_codes import op11_heap_lloyd
from .quality import op9_quality
from .token_counts import op13_token_counts
from .toxicity import op7_toxicity
from .warc import op2_warc_salvage

QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_warc_salvage, op3_fair_queue_mix, op4_matroska, op5_merkle, op6_ngram_join, op7_toxicity, op8_context_mixing, op9_quality, op10_language_id, op11_heap_lloyd, op12_filter_audit, op13_token_counts)}

_DIGITS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(({part} // {32**j}) % 32 AS INTEGER) + 1, 1)"
    for part in ("a", "b", "c", "d")
    for j in range(7, -1, -1)
)
_PARTS = ", ".join(f"CAST('0x' || substr(h, {1 + 10 * i}, 10) AS BIGINT) AS {x}" for i, x in enumerate("abcd"))

_WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
 d AS (SELECT page_id, octet_length(encode(t)) AS payload_bytes, sha1(t) AS h FROM p),
 e AS (SELECT page_id, payload_bytes, {_PARTS} FROM d),
 f AS (SELECT page_id, payload_bytes, {_DIGITS} AS payload_digest FROM e),
 g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id <> top THEN top END AS refers_to FROM g"""

_JOIN = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+') AS ws FROM documents),
 s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)] END)) AS g FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE 100 * i >= 75 * (u.n + v.n - i)),
 e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
 r AS (SELECT DISTINCT x AS doc_id, x AS c FROM e UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, w.doc_id) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id
 LEFT JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) m ON m.doc_id = w.doc_id"""

_AUDIT = r"""WITH m AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
 d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
 w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
 f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
   (CASE WHEN len(ws) < 50 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 'B' ELSE '' END) ||
   (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 'C' ELSE '' END) ||
   (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN coalesce(w.doc_id > least, false) THEN 'E' ELSE '' END) AS fails
   FROM w LEFT JOIN m ON m.doc_id = w.doc_id),
 n AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY 1, 2),
 l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
 o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM l a, l b, l c, l d, l e WHERE length(replace(replace(replace(replace(replace(a.x || b.x || c.x || d.x || e.x, 'A', ''), 'B', ''), 'C', ''), 'D', ''), 'E', '')) = 0
   AND a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
 s AS (SELECT o, unnest(range(1, 6)) AS step FROM o),
 r AS (SELECT n.part, s.o, s.step, substr(s.o, s.step, 1) AS x,
   CASE WHEN fails = '' OR len(list_filter(string_split(fails, ''), lambda c: contains(s.o[1:s.step], c))) = 0 THEN n.n ELSE 0 END AS kept,
   contains(fails, substr(s.o, s.step, 1)) AS hit, len(list_filter(string_split(fails, ''), lambda c: contains(s.o[1:s.step - 1], c) AND c <> '')) > 0 AS gone,
   fails, n.n, n.good, n.toxic FROM n, s),
 q AS (SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, any_value(x) AS x, CAST(sum(kept) AS BIGINT) AS kept,
   CAST(coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (hit AND gone), 0) AS BIGINT) AS redundant,
   CAST(coalesce(sum(n) FILTER (fails = x), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(good) FILTER (hit AND NOT gone), 0) AS BIGINT) AS good_lost,
   CAST(coalesce(sum(toxic) FILTER (hit AND NOT gone), 0) AS BIGINT) AS toxic_lost FROM r GROUP BY 1, 2, 3)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM q"""



def _lloyd(rounds: int = 4, parts: int = 4, entries: int = 256) -> str:
    """Each round written out: all distances, the nearest entry, and the floors of the clusters' means."""
    near = "(SELECT v.vec_id, v.p, arg_min(c.e, {d} * 256 + c.e) AS e, min({d}) AS d FROM v JOIN c{r} c ON c.p = v.p GROUP BY 1, 2)"
    distance = "CAST(list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) AS BIGINT)"
    steps = [
        """k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda y: CAST(floor(y::DOUBLE * 1024) AS BIGINT)) AS x FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0)""",
        f"v AS MATERIALIZED (SELECT vec_id, p, x[p * len(x) // {parts} + 1:(p + 1) * len(x) // {parts}] AS x FROM k, range({parts}) r(p))",
        f"c0 AS MATERIALIZED (SELECT p, n AS e, x FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS n FROM k) JOIN v USING (vec_id) WHERE n < {entries})",
    ]
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED {near.format(d=distance, r=r)}")
        steps.append(
            f"""m{r} AS MATERIALIZED (SELECT p, e, list(m ORDER BY i) AS x FROM (SELECT p, e, i, CAST(floor(sum(y)::DOUBLE / count(*)) AS BIGINT) AS m
 FROM (SELECT a.p, a.e, unnest(v.x) AS y, generate_subscripts(v.x, 1) AS i FROM a{r} a JOIN v ON v.vec_id = a.vec_id AND v.p = a.p) GROUP BY 1, 2, 3) GROUP BY 1, 2)"""
        )
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m ON m.p = c.p AND m.e = c.e)")
    steps.append(f"z AS MATERIALIZED {near.format(d=distance, r=rounds)}")
    steps.append("t AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM z GROUP BY 1)")
    digest = f"(SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM c{rounds})"
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, {digest} AS codebooks_sha256 FROM t JOIN k USING (vec_id)"


#: The others learn models, use hashes or stored forms that SQL has no words for; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op2_warc_salvage": _WARC, "op6_ngram_join": _JOIN, "op11_heap_lloyd": _lloyd(), "op12_filter_audit": _AUDIT}
