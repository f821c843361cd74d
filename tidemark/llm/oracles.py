"""DuckDB SQL for the operators' queries that SQL can express over whole tables."""

from __future__ import annotations

import re

from .url_automaton import BLOCK_GLOBS, HOST_RULES

_LOW = "translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"coalesce(regexp_extract_all(" + _LOW.format(c="text") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

DECONTAMINATION = f"""WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents), iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS g FROM iw, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
seen AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM dw, sizes, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
occ AS (SELECT DISTINCT doc_id, n, i, item_id FROM seen JOIN win USING (n, g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM occ, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN names USING (doc_id)"""


JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all({_LOW.format(c="text")}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes sx ON sx.doc_id = x JOIN sizes sy ON sy.doc_id = y WHERE 100 * c >= 90 * (sx.n + sy.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN both_ways ON r = x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)"""


def _as_expression(glob: str) -> str:
    return "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p).replace("'", "''")) for p in re.findall(r"\*\*|.", glob, re.S))


def url_filter() -> str:
    ranked = sorted(HOST_RULES, key=lambda r: (-len(r.name), r.verdict != "block", r.name))
    fits = [(f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')", r) for r in ranked]
    rule = " ".join(f"WHEN {c} THEN '{r.name}'" for c, r in fits)
    verdict = " ".join(f"WHEN {c} THEN '{r.verdict}'" for c, r in fits)
    blocked = "|".join(map(_as_expression, BLOCK_GLOBS))
    return (
        "WITH p AS (SELECT page_id, coalesce(" + _LOW.format(c="regexp_extract(url, '://([^/?#]*)', 1)") + ", '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages) "
        f"SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN regexp_full_match('.' || host || path, '(?s){blocked}') THEN 'block' ELSE 'allow' END AS verdict FROM p"
    )


PREFERENCES = """WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM t),
answers AS (SELECT conv_id, max(pos) AS last FROM n WHERE role = 'assistant' GROUP BY conv_id),
given AS (SELECT conv_id, last, text FROM n JOIN answers USING (conv_id) WHERE pos = last),
sides AS (SELECT 'chosen' AS part, conv_id, pos, role, text FROM n JOIN answers USING (conv_id) UNION ALL SELECT 'rejected', conv_id, pos, role, text FROM n JOIN answers USING (conv_id) WHERE pos < last UNION ALL SELECT 'rejected', g.conv_id, g.last, 'assistant', coalesce(o.text, '') FROM given g LEFT JOIN given o ON o.conv_id = xor(g.conv_id, CAST(1 AS BIGINT))),
own AS (SELECT conv_id AS pair_id, conv_id AS chosen_id, conv_id AS rejected_id, part, pos, role, text FROM sides),
places AS (SELECT pair_id, pos, count(*) AS n, count(DISTINCT (role, text)) AS kinds FROM own GROUP BY ALL),
pre AS (SELECT pair_id, coalesce(min(pos) FILTER (n <> 2 OR kinds <> 1), max(pos)) - 1 AS shared FROM places GROUP BY pair_id),
kept AS (SELECT own.*, pos <= shared AS inside, CASE WHEN pos <= shared THEN 'prompt' ELSE part END AS piece, '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS rendered FROM own JOIN pre USING (pair_id) WHERE NOT (pos <= shared AND part = 'rejected')),
whole AS (SELECT pair_id, coalesce(sum(length(rendered)) FILTER (inside), 0) AS size FROM kept GROUP BY pair_id),
placed AS (SELECT kept.*, CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY pair_id, piece ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN inside THEN 0 ELSE size END AS BIGINT) AS begin FROM kept JOIN whole USING (pair_id))
SELECT pair_id, piece AS part, pos, role, rendered, begin, begin + length(rendered) AS finish, NOT inside AND role IN ('assistant') AS train, chosen_id, rejected_id FROM placed"""


HARD_NEGATIVES = """WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS a, a.label = r.label AS same, r.id AS id, CAST(list_sum(list_transform(list_zip(a.v, r.v), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM r a JOIN r ON a.id <> r.id WHERE a.id % 50 = 0),
pos AS (SELECT a, id AS p, score AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id) <= 5)
SELECT pos.a AS anchor_id, p AS positive_id, CAST(row_number() OVER (PARTITION BY pos.a, p ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, ps AS positive_score, score AS negative_score
FROM pos JOIN s ON s.a = pos.a AND NOT same AND 50 * ps <= 100 * score AND 100 * score <= 95 * ps
QUALIFY row_number() OVER (PARTITION BY pos.a, p ORDER BY score DESC, id) <= 3"""

#: The level is the highest of (words left by the sources before) / (weights from here on), in the order of cap to weight.
SOURCE_MIXING = r"""WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
  CAST('0x' || substr(md5(concat_ws(':', '0', CAST(doc_id AS VARCHAR), text)), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
o AS (SELECT *, 3 * source_size AS cap, row_number() OVER (ORDER BY 3 * source_size / w, source) AS i FROM s),
c AS (SELECT *, CAST((SELECT sum(source_size) FROM o) - coalesce(sum(cap) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
  CAST(sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS shares FROM o),
level AS (SELECT rest, shares FROM c ORDER BY rest / shares DESC, i LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN cap < level.rest * w / level.shares THEN CAST(cap AS DOUBLE) ELSE level.rest * w / level.shares END AS target FROM c, level),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM t),
r AS (SELECT d.doc_id, d.source, size, source_size, target, passes, target - passes * source_size AS left_over, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, size, source_size, target, CAST(size * (passes + CASE WHEN left_over > 0 AND 2 * (left_over - before) >= size THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r"""
