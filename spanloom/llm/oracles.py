"""DuckDB SQL for the training-data queries that SQL can express.

No SQL: op2 (learned lexicon), op4 (order MinHash with alignment), op7 (Hilbert
curve), op9 (DOM densities), op10 (Markov models); tests hold them against
brute-force versions, laws or held-out accuracy.
"""

from __future__ import annotations

from spanloom.llm.queries import FETCH_DAYS, FIRST_FETCH, LIST_LOG

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_NORMAL = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_ENTRIES = ", ".join(f"('{k}', '{n}', '{a}', DATE '{t}')" for k, n, a, t in LIST_LOG)


def _shingles(width: str) -> str:
    return f"list_distinct(list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i:i + {width} - 1], ' ')))"


OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, c AS component_id, vec_id = c AS kept
FROM embeddings JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) g ON g.a = vec_id LEFT JOIN n ON n.a = vec_id"""

OP3 = rf"""
WITH e(key, list, action, "at") AS (VALUES {_ENTRIES}),
iv AS (SELECT key, list, action, "at" AS f, lead("at") OVER (PARTITION BY key, list ORDER BY "at") AS u FROM e),
p AS (SELECT page_id, url, DATE '{FIRST_FETCH}' + CAST((page_id * 37) % {FETCH_DAYS} AS INTEGER) AS t,
  string_split(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)), '.') AS h,
  list_filter(string_split(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS s FROM pages),
k AS (SELECT page_id, t, array_to_string(h[len(h) - i + 1:], '.') AS key, i AS rank FROM p, unnest(range(1, len(h) + 1)) x(i)
  UNION ALL SELECT page_id, t, array_to_string(h, '.') || '/' || array_to_string(s[1:i], '/'), 1000 + i FROM p, unnest(range(1, len(s) + 1)) x(i)),
act AS (SELECT k.*, iv.list, iv.action, count(*) OVER (PARTITION BY page_id) AS n,
  row_number() OVER (PARTITION BY page_id ORDER BY rank DESC, action <> 'allow', list, iv.key) AS o
  FROM k JOIN iv ON iv.key = k.key AND iv.action <> 'remove' AND f <= t AND (u IS NULL OR t < u))
SELECT p.page_id, url, strftime(p.t, '%Y-%m-%d') AS fetched_at, coalesce(n, 0) AS n_active, list, key, coalesce(action = 'allow', true) AS allowed
FROM p LEFT JOIN act ON act.page_id = p.page_id AND o = 1"""

OP5 = f"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS weight FROM s),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM w),
t AS (SELECT a.source, a.source_size, a.cap, a.weight,
  (SELECT arg_min(lv, top) FROM (SELECT (any_value(y.total) - coalesce(sum(CASE WHEN x.cap / x.weight < y.cap / y.weight THEN x.cap END), 0::DOUBLE)) / sum(CASE WHEN x.cap / x.weight >= y.cap / y.weight THEN x.weight END) AS lv,
     any_value(y.cap / y.weight) AS top FROM c x, c y GROUP BY y.source) WHERE lv <= top) AS water FROM c a),
g AS (SELECT source, source_size, least(cap, water * weight) AS target, CASE WHEN source_size > 0 THEN least(cap, water * weight) / source_size ELSE 0 END AS rate FROM t),
u AS (SELECT d.*, g.source_size, g.target, g.rate, k AS seed,
  CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || CAST(k AS VARCHAR)), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0::DOUBLE < rate - floor(rate) AS lucky
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source, unnest(range(0, 32)) x(k)),
best AS (SELECT source, seed FROM (SELECT source, seed, abs(sum(CASE WHEN lucky THEN size ELSE 0 END) + floor(any_value(rate)) * any_value(source_size) - any_value(target)) AS off FROM u GROUP BY source, seed)
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY off, seed) = 1)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN lucky THEN 1 ELSE 0 END) AS BIGINT) AS taken, CAST(floor(rate) + CASE WHEN lucky THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM u JOIN best ON u.source IS NOT DISTINCT FROM best.source AND u.seed = best.seed"""

OP6 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i AS s, array_to_string(w[i:i + 19], ' ') AS k FROM d, unnest(range(1, len(w) - 18)) x(i)),
late AS (SELECT doc_id, s FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1),
ws AS (SELECT doc_id, i, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) x(i)),
m AS (SELECT ws.doc_id, i, word, coalesce(max(late.s) OVER (PARTITION BY ws.doc_id ORDER BY i) >= i - 19, false) AS gone FROM ws LEFT JOIN late ON late.doc_id = ws.doc_id AND late.s = ws.i),
g AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS r, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS t FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(r, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN g ON g.doc_id = d.doc_id"""

OP8 = f"""
WITH b0 AS (SELECT item_id, {_NORMAL} AS w FROM benchmark), b1 AS (SELECT item_id, w, least(len(w), 5) AS width FROM b0 WHERE len(w) > 0),
b AS (SELECT item_id, width, {_shingles('width')} AS s FROM b1),
bs AS (SELECT item_id, width, len(s) AS q, unnest(s) AS sh FROM b), d0 AS (SELECT doc_id, {_NORMAL} AS w FROM documents),
ds AS (SELECT doc_id, width, unnest({_shingles('width')}) AS sh FROM d0, (SELECT DISTINCT width FROM b1) WHERE len(w) >= width)
SELECT doc_id, item_id, CAST(any_value(q) AS INTEGER) AS n_item, CAST(count(*) AS INTEGER) AS n_shared, CAST(count(*) AS DOUBLE) / any_value(q) AS containment
FROM ds JOIN bs USING (width, sh) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(q) - 1e-9"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embedding_dedup": OP1,
        "op3_url_filter": OP3,
        "op5_mixing": OP5,
        "op6_substring_dedup": OP6,
        "op8_decontamination": OP8,
    }
