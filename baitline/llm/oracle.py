"""DuckDB SQL for the queries that SQL can express, written apart from the operators."""
from __future__ import annotations

_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sharding(shards: list[str], slots: int) -> str:
    """The table filled turn by turn in a recursive query, then a lookup."""
    names = ", ".join(f"'{s}'" for s in shards)
    n = len(shards)
    return f"""
WITH RECURSIVE
names AS (SELECT [{names}] AS s),
perm AS (
  SELECT list_transform(s, lambda x: ('0x' || substr(md5(x || '#offset'), 1, 15))::BIGINT % {slots}) AS o,
         list_transform(s, lambda x: ('0x' || substr(md5(x || '#skip'), 1, 15))::BIGINT % {slots - 1} + 1) AS k
  FROM names),
fill(turn, slot, free) AS (
  SELECT -1::BIGINT, -1::BIGINT, range({slots})
  UNION ALL
  SELECT turn + 1, pick, list_filter(free, lambda f: f <> pick)
  FROM (
    SELECT f.turn, f.free,
           -- the place of a slot in a permutation is (slot - offset) / skip in arithmetic modulo a prime
           list_filter(list_transform(range({slots}),
             lambda j: (p.o[(f.turn + 1) % {n} + 1] + j * p.k[(f.turn + 1) % {n} + 1]) % {slots}),
             lambda x: list_contains(f.free, x))[1] AS pick
    FROM fill f, perm p WHERE f.turn < {slots - 1}))
SELECT d.doc_id, f.slot::INTEGER AS slot, (SELECT s FROM names)[f.turn % {n} + 1] AS shard
FROM documents d JOIN fill f
  ON f.slot = ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 15))::BIGINT % {slots}
"""


CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -1, turn, role, '<|im_end|><|im_start|>assistant ok'
  FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
e AS (
  SELECT *, replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<|', '<\|') AS er,
         replace(replace(text, '\', '\\'), '<|', '<\|') AS et
  FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))
         AS loss_sha256,
       sum(length('<|im_start|>') + length(er) + 1 + length(et) + length('<|im_end|>') + 1)::BIGINT
         AS formatted_chars,
       false AS rewrites
FROM e GROUP BY conv_id
"""

LINE_DEDUP = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
line AS (
  SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM docs),
keyed AS (
  SELECT *, translate(trim(line, {_SPACE}), '{_UPPER}', '{_LOWER}') AS k FROM line),
gone AS (
  SELECT k, max(coalesce(doc_id, -9223372036854775808)) AS keeper
  FROM (SELECT DISTINCT r, doc_id, k FROM keyed WHERE length(k) >= 20) x
  GROUP BY k HAVING count(*) >= 3),
marked AS (
  SELECT keyed.*, gone.k IS NOT NULL AND gone.keeper <> coalesce(doc_id, -9223372036854775808) AS dropped
  FROM keyed LEFT JOIN gone ON keyed.k = gone.k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY r
"""

_WORDS = (f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

#: All windows of the items against all runs of as many words: no filter, no prefix.
DECONTAMINATION = f"""
WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, array_to_string(w[s + 1:s + 10], ' ') AS x, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 9, 1))) AS s FROM item WHERE len(w) > 0)),
doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
size AS (SELECT DISTINCT n FROM win),
run AS (
  SELECT r, n, s, array_to_string(w[s + 1:s + n], ' ') AS x
  FROM (SELECT r, w, n, unnest(range(len(w) - n + 1)) AS s FROM doc, size WHERE len(w) >= n)),
hit AS (SELECT run.r, run.s, run.n, win.item_id FROM run JOIN win ON run.x = win.x AND run.n = win.n),
word AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
item_of AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (r) LEFT JOIN item_of USING (r)
"""

MINHASH = f"""
WITH RECURSIVE
w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
      FROM documents),
shingle AS MATERIALIZED (
  SELECT DISTINCT r, unnest(CASE
    WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s
  FROM w),
n AS (SELECT r, count(*) AS n FROM shingle GROUP BY r),
common AS (
  SELECT a.r AS a, b.r AS b, count(*) AS c FROM shingle a JOIN shingle b ON a.s = b.s AND a.r <> b.r GROUP BY 1, 2),
link AS MATERIALIZED (
  SELECT a, b FROM common JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(r, other) AS (
  SELECT r, r FROM w
  UNION
  SELECT reach.r, link.b FROM reach JOIN link ON link.a = reach.other)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id,
       w.doc_id = min(o.doc_id) AS kept
FROM w LEFT JOIN n ON n.r = w.r JOIN reach ON reach.r = w.r JOIN w o ON o.r = reach.other
GROUP BY w.r, w.doc_id
"""

PHRASES = f"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, list_filter(regexp_split_to_array(p, '[ \\t]+'), lambda x: x <> '') AS ws
  FROM (SELECT lang, unnest(regexp_split_to_array(
          translate(text, '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)),
gram AS (
  SELECT lang, size, unnest(list_transform(range(1, len(ws) - size + 2),
           lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS phrase
  FROM piece, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE len(ws) >= size),
freq AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS f FROM gram GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM freq WHERE size = 1 GROUP BY lang),
cand AS MATERIALIZED (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM freq WHERE size > 1 AND f >= 30),
cut AS (
  SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS tail
  FROM cand, (SELECT unnest([1, 2, 3]) AS k) WHERE k < size),
scored AS (
  SELECT c.lang, c.phrase, c.a, h.f AS l, t.f AS r, c.k,
         (2000000::HUGEINT * c.a // (h.f::HUGEINT + t.f))::BIGINT AS score
  FROM cut c JOIN freq h ON h.lang = c.lang AND h.phrase = c.head
             JOIN freq t ON t.lang = c.lang AND t.phrase = c.tail),
best AS (SELECT * FROM scored
         QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, part, max(a) AS longer FROM (
    SELECT c.lang, c.phrase, c.a, array_to_string(c.ws[i:j], ' ') AS part
    FROM cand c, (SELECT unnest([1, 2, 3]) AS i), (SELECT unnest([2, 3, 4]) AS j)
    WHERE i < j AND j <= c.size) WHERE part <> phrase GROUP BY lang, part),
kept AS (
  SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.part = b.phrase
  WHERE i.longer IS NULL OR 100::HUGEINT * i.longer < 80::HUGEINT * b.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n, score
FROM kept k JOIN total t ON t.lang = k.lang
QUALIFY rank <= 2000
"""

NEGATIVES = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM (SELECT vec_id, label, embedding FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, embedding) = 1)),
pair AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT a, b, score FROM pair WHERE same
        QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id,
       row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b)::INTEGER AS rank,
       n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM pos p JOIN pair n ON n.a = p.a AND NOT n.same
  AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""
