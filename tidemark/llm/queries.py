"""Queries of the corpus operators over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from .bpe import op1_bpe
from .decontaminate import op2_decontaminate
from .katz import op3_katz
from .knn_quality import op5_knn_quality
from .langid import op10_langid
from .linededup import op7_linededup
from .neardup import op6_neardup
from .pii import op8_pii
from .quality_rules import op9_quality
from .token_counts import op4_token_counts

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_decontaminate": op2_decontaminate,
    "op3_katz": op3_katz,
    "op4_token_counts": op4_token_counts,
    "op5_knn_quality": op5_knn_quality,
    "op6_neardup": op6_neardup,
    "op7_linededup": op7_linededup,
    "op8_pii": op8_pii,
    "op9_quality": op9_quality,
    "op10_langid": op10_langid,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: op2: windows of items as joined words, looked up in the documents' windows of each length.
_OP2 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
ip AS (SELECT item, w, least(10, len(w)) AS m, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS p FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item, m, array_to_string(list_slice(w, p, p + m - 1), ' ') AS k FROM ip),
ms AS (SELECT DISTINCT m FROM iw),
dp AS (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS p FROM d JOIN ms ON len(w) >= m),
dw AS (SELECT doc_id, m, p, array_to_string(list_slice(w, p, p + m - 1), ' ') AS k FROM dp),
hits AS (SELECT doc_id, p, dw.m AS m, item FROM dw JOIN iw ON dw.m = iw.m AND dw.k = iw.k),
words_hit AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + m - 1)) AS q FROM hits),
n AS (SELECT doc_id, count(*) AS n_hit FROM words_hit GROUP BY doc_id),
held AS (SELECT DISTINCT doc_id, item FROM hits),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM held GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id
"""

#: op6: shared shingles of all pairs, and what links reach.
_OP6 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
dp AS (SELECT doc_id, w, least(4, len(w)) AS m, unnest(generate_series(1, len(w) - least(4, len(w)) + 1)) AS p FROM d WHERE len(w) > 0),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + m - 1), ' ') AS k FROM dp),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT x, y FROM pair JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT y AS node, root FROM reach JOIN both_ways ON node = x),
least_of AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN least_of ON node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

#: op7: lines in runs of eight words that an earlier text holds, and blank lines between them.
_OP7 = """
WITH docs AS (SELECT doc_id, text, md5(coalesce(text, '')) AS t FROM documents),
texts AS (SELECT t, min(doc_id) AS id, any_value(coalesce(text, '')) AS text FROM docs GROUP BY t),
split AS (SELECT t, id, string_split(text, chr(10)) AS ls FROM texts),
numbered AS (SELECT t, id, ls, unnest(generate_series(1, len(ls))) AS i FROM split),
worded AS (SELECT t, id, i, ls[i] AS line, regexp_extract_all(ls[i], '[^\\x20\\x09-\\x0D]+') AS w FROM numbered),
lines AS (SELECT t, id, i, line, len(w) AS n, array_to_string(w, ' ') AS plain, sum(len(w)) OVER (PARTITION BY t ORDER BY i) AS upto FROM worded),
held AS (SELECT t, id, i, line, n, plain, upto, upto - n AS before FROM lines),
begun AS (SELECT a.t, a.id, a.i AS lo, min(b.i) AS hi FROM held a JOIN held b ON a.t = b.t AND b.i >= a.i AND b.upto >= a.before + 8 WHERE a.n > 0 GROUP BY a.t, a.id, a.i),
ended AS (SELECT b.t, b.id, max(a.i) AS lo, b.i AS hi FROM held a JOIN held b ON a.t = b.t AND a.i <= b.i AND a.before <= b.upto - 8 WHERE b.n > 0 GROUP BY b.t, b.id, b.i),
runs AS (SELECT t, id, lo, hi FROM begun UNION SELECT t, id, lo, hi FROM ended),
keyed AS (SELECT r.t, r.id, r.lo, r.hi, string_agg(h.plain, chr(10) ORDER BY h.i) AS k FROM runs r JOIN held h ON h.t = r.t AND h.i BETWEEN r.lo AND r.hi GROUP BY r.t, r.id, r.lo, r.hi),
ranked AS (SELECT t, lo, hi, first_value(t) OVER (PARTITION BY k ORDER BY id, t) AS owner FROM keyed),
gone_words AS (SELECT DISTINCT h.t, h.i FROM ranked r JOIN held h ON h.t = r.t AND h.i BETWEEN r.lo AND r.hi WHERE r.owner <> r.t AND h.n > 0),
around AS (SELECT k.t, k.i, max(CASE WHEN h.i < k.i THEN h.i END) AS p, min(CASE WHEN h.i > k.i THEN h.i END) AS q FROM held k JOIN held h ON h.t = k.t AND h.n > 0 WHERE k.n = 0 GROUP BY k.t, k.i),
gone AS (SELECT t, i FROM gone_words UNION SELECT a.t, a.i FROM around a JOIN gone_words x ON x.t = a.t AND x.i = a.p JOIN gone_words y ON y.t = a.t AND y.i = a.q),
marked AS (SELECT h.t, h.id, h.i, h.line, sum(h.n) OVER (PARTITION BY h.t) AS n_words, g.i IS NOT NULL AS gone FROM held h LEFT JOIN gone g ON g.t = h.t AND g.i = h.i),
found AS (SELECT d.doc_id, d.text, m.i, m.line, CASE WHEN d.text IS NULL THEN false WHEN d.doc_id <> m.id THEN n_words >= 8 ELSE gone END AS gone FROM docs d JOIN marked m ON m.t = d.t)
SELECT doc_id, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed, coalesce(string_agg(CAST(i - 1 AS VARCHAR), ',' ORDER BY i) FILTER (gone), '') AS removed_lines,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS text_sha256
FROM found GROUP BY doc_id
"""

ORACLE_SQL: dict[str, str] = {"op7_linededup": _OP7, "op2_decontaminate": _OP2, "op6_neardup": _OP6}
