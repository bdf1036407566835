"""DuckDB SQL for the rows of those queries that SQL can express."""

from __future__ import annotations

from tessera.llm.chat import ORACLE_SQL as CHAT

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUFFIX = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
k AS (SELECT doc_id, len(x) AS m, b, substr(x, 2 * b + 1, 1098) AS y FROM (SELECT doc_id, x, unnest(range(0, (len(x) // 2)::BIGINT, 500)) AS b FROM d)),
p AS (SELECT doc_id, m, y, b, unnest(range(1, least(500, m // 2 - b)::BIGINT + 1)) AS i FROM k),
w AS (SELECT doc_id, b + i AS pos, substr(y, 2 * i - 1, 2) AS byte, CASE WHEN 2 * (b + i) + 98 <= m THEN md5_number(substr(y, 2 * i - 1, 100)) END AS win FROM p),
f AS (SELECT win, min(doc_id) AS first FROM w WHERE win IS NOT NULL GROUP BY 1),
s AS (SELECT w.doc_id, pos, byte, coalesce(f.first < w.doc_id, false) AS start FROM w LEFT JOIN f USING (win)),
c AS (SELECT doc_id, pos, byte, max(start) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM s),
r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS head FROM c),
g AS (SELECT doc_id, count(*) AS n, count_if(gone) AS removed, count_if(head) AS spans, sha256(unhex(coalesce(string_agg(byte, '' ORDER BY pos) FILTER (WHERE NOT gone), ''))) AS sha FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, coalesce(sha, sha256('')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
"""

COVER = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS t FROM documents),
p AS (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS pos FROM d),
w AS (SELECT doc_id, pos, t[pos] AS word, CASE WHEN pos + 34 <= len(t) THEN md5_number(array_to_string(t[pos:pos + 34], ' ')) END AS win FROM p),
f AS (SELECT win FROM w WHERE win IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
s AS (SELECT doc_id, pos, word, f.win IS NOT NULL AS start FROM w LEFT JOIN f USING (win)),
c AS (SELECT doc_id, pos, word, max(start) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM s),
g AS (SELECT doc_id, count(*) AS n, count_if(gone) AS removed, sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone), '')) AS sha FROM c GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(sha, sha256('')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
"""

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NGRAM = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) >= 5 THEN list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' ')) WHEN len(t) > 0 THEN [array_to_string(t, ' ') || chr(10)] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
w(node, other) AS (SELECT a, a FROM e UNION SELECT w.node, e.b FROM w JOIN e ON e.a = w.other),
c AS (SELECT node, min(other) AS component FROM w GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = d.doc_id
"""

EMBEDDING = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM v WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id < b.vec_id AND list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.95),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
w(node, other) AS (SELECT a, a FROM e UNION SELECT w.node, e.b FROM w JOIN e ON e.a = w.other),
c AS (SELECT node, min(other) AS component FROM w GROUP BY 1),
k AS (SELECT a, count(*) AS k FROM e GROUP BY 1)
SELECT vec_id, coalesce(k, 0)::BIGINT AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept FROM v LEFT JOIN k ON k.a = vec_id LEFT JOIN c ON c.node = vec_id
"""

ORACLE_SQL = {"op2_suffix_dedup": SUFFIX, "op4_embedding_join": EMBEDDING, "op5_ngram_join": NGRAM, "op6_chat": CHAT, "op8_cover_dedup": COVER}
