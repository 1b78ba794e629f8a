"""The same results in SQL, where SQL can express them on whole tables."""

from __future__ import annotations

from vecflow.llm import backoff, decontamination

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

BACKOFF = f"""
WITH d AS (SELECT doc_id, {_SPACED} AS v FROM documents),
t AS (SELECT doc_id, unnest(v) AS w, generate_subscripts(v, 1) AS i FROM d),
g AS (SELECT *, lag(w, 1) OVER o AS w1, lag(w, 2) OVER o AS w2 FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
d1 AS (SELECT doc_id, w, count(*) AS n FROM g GROUP BY ALL), c1 AS (SELECT w, sum(n) AS n FROM d1 GROUP BY ALL),
d2 AS (SELECT doc_id, w1, w, count(*) AS n FROM g WHERE w1 IS NOT NULL GROUP BY ALL), c2 AS (SELECT w1, w, sum(n) AS n FROM d2 GROUP BY ALL),
d3 AS (SELECT doc_id, w2, w1, w, count(*) AS n FROM g WHERE w2 IS NOT NULL GROUP BY ALL), c3 AS (SELECT w2, w1, w, sum(n) AS n FROM d3 GROUP BY ALL),
l1 AS (SELECT d1.doc_id, d1.w, c1.n - d1.n AS n FROM d1 JOIN c1 USING (w)),
l2 AS (SELECT d2.doc_id, d2.w1, d2.w, c2.n - d2.n AS n FROM d2 JOIN c2 USING (w1, w)),
l3 AS (SELECT d3.doc_id, d3.w2, d3.w1, d3.w, c3.n - d3.n AS n FROM d3 JOIN c3 USING (w2, w1, w)),
r AS (SELECT doc_id, (SELECT sum(len(v)) FROM d) - len(v) AS n FROM d),
x AS (SELECT g.doc_id, g.i, r.n AS rest, a.n AS n1, b.n AS n2, c.n AS n3, p.n AS p1, q.n AS p2,
             CASE WHEN c.n > 0 THEN 3 WHEN b.n > 0 THEN 2 WHEN a.n > 0 THEN 1 ELSE 0 END AS k, least(g.i, {backoff.ORDER}) AS longest
      FROM g JOIN r ON r.doc_id = g.doc_id
      JOIN l1 a ON a.doc_id = g.doc_id AND a.w = g.w
      LEFT JOIN l2 b ON b.doc_id = g.doc_id AND b.w1 = g.w1 AND b.w = g.w
      LEFT JOIN l3 c ON c.doc_id = g.doc_id AND c.w2 = g.w2 AND c.w1 = g.w1 AND c.w = g.w
      LEFT JOIN l1 p ON p.doc_id = g.doc_id AND p.w = g.w1
      LEFT JOIN l2 q ON q.doc_id = g.doc_id AND q.w1 = g.w2 AND q.w = g.w1),
s AS (SELECT doc_id, k, ln({backoff.ALPHA}::DOUBLE) * (longest - greatest(k, 1))
             + ln(CASE k WHEN 3 THEN n3 / p2 WHEN 2 THEN n2 / p1 WHEN 1 THEN n1 / rest ELSE {backoff.ALPHA}::DOUBLE / greatest(rest, 1) END) AS score FROM x)
SELECT d.doc_id, len(d.v) AS n_words, round(coalesce(sum(score), 0), 4) AS log_score, round(sum(score) / nullif(len(d.v), 0), 6) AS mean_log_score,
       count(*) FILTER (k = 0) AS seen_0, count(*) FILTER (k = 1) AS seen_1, count(*) FILTER (k = 2) AS seen_2, count(*) FILTER (k = 3) AS seen_3
FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id, d.v"""

_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"


def _seeds(table: str, id: str, items: bool) -> str:
    """A row per mask and place: the words that the mask counts; of items only the masks for their number of words."""
    short = decontamination.SHORT_MASKS
    every = list(dict.fromkeys([*decontamination.MASKS, *(m for masks in short.values() for m in masks)]))
    parts = []
    for number, mask in enumerate(every):
        least = len(mask)
        fits = f"len(v) >= {least}"
        if items and mask not in decontamination.MASKS:
            fits = f"len(v) IN ({', '.join(str(n) for n, masks in short.items() if mask in masks)})"
        counted = ", ".join(f"v[p + {k + 1}]" for k, bit in enumerate(mask) if bit == "1")
        parts.append(f"SELECT {id}, {number} AS mask, p, concat_ws(' ', {counted}) AS key FROM (SELECT {id}, v, unnest(range(len(v) - {least - 1})) AS p FROM {table} WHERE {fits})")
    return " UNION ALL ".join(parts)


DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS v FROM documents), b AS (SELECT item_id, {_WORDS} AS v FROM benchmark),
sd AS ({_seeds("d", "doc_id", False)}), sb AS ({_seeds("b", "item_id", True)}),
l AS (SELECT DISTINCT doc_id, item_id, sd.p - sb.p AS g FROM sd JOIN sb USING (mask, key)),
o AS (SELECT doc_id, item_id, g, len(b.v) AS words, d.v AS dv, b.v AS bv, unnest(range(greatest(0, -g), least(len(b.v), len(d.v) - g))) AS j
      FROM l JOIN d USING (doc_id) JOIN b USING (item_id)),
e AS (SELECT doc_id, item_id, g, words, j, CASE WHEN dv[g + j + 1] = bv[j + 1] THEN 1 ELSE 0 END AS hit FROM o),
s AS (SELECT *, sum(CASE hit WHEN 1 THEN 1 ELSE -4 END) OVER (PARTITION BY doc_id, item_id, g ORDER BY j) AS upto FROM e),
m AS (SELECT *, upto - least(0, coalesce(min(upto) OVER (PARTITION BY doc_id, item_id, g ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS run FROM s),
a AS (SELECT doc_id, item_id, g, words, sum(hit) AS matched, max(run) AS run FROM m GROUP BY ALL),
f AS (SELECT doc_id, item_id, max(matched) AS matched, any_value(words) AS words FROM a
      WHERE matched >= {decontamination.SIMILARITY} * words - 1e-9 OR run >= {decontamination.MIN_RUN} GROUP BY ALL)
SELECT d.doc_id, count(f.item_id) > 0 AS leaked, count(f.item_id) AS n_items, coalesce(string_agg(f.item_id, ',' ORDER BY f.item_id), '') AS items,
       coalesce(max(f.matched), 0)::BIGINT AS matched, coalesce(max(f.matched::DOUBLE / f.words), 0) AS share
FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACED} AS v FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(v) >= 4 THEN list_transform(range(1, len(v) - 2), lambda i: array_to_string(v[i:i + 3], ' '))
                                        WHEN len(v) > 0 THEN [array_to_string(v, ' ')] ELSE [] END) AS s FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS m, b.n AS n, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * i >= 80 * (m + n - i)),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, len(s.s) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)"""

_SITE = r"([<\[])(\\*)(/?INST\]|/?ROLE\]|SAYS\]|/?s>|</?SYS>>)"
_MARKED = " ".join(f"WHEN '{role}' THEN {sum(map(len, marks)) + 2}" for role, marks in (("user", ("[INST]", "[/INST]")), ("system", ("<<SYS>>", "<</SYS>>")), ("assistant", ("<s>", "</s>"))))

CHAT = rf"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) AS r(i)),
e AS (SELECT *, regexp_replace(text, '{_SITE}', '\1\\\2\3', 'g') AS escaped FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS turns,
             coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS said,
             sum(length(escaped) + CASE role {_MARKED} END) + count(*) - 1 AS formatted_chars, count(*) FILTER (escaped <> text) AS n_escaped
      FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(said) AS loss_chars, sha256(said) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars, n_escaped FROM g"""


def _field(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


# CRC-32 of a decimal id, bit by bit; 3988292384 is the reversed polynomial
_CRC = """xor(4294967295, list_reduce(list_transform(range(1, strlen(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k, 1))::BIGINT),
  lambda c, b: list_reduce(range(8), lambda x, s: xor(x >> 1, (x & 1) * 3988292384), xor(c, b)), 4294967295::BIGINT))"""

MANIFEST = f"""
WITH RECURSIVE d AS (SELECT *, row_number() OVER () AS row, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n
  FROM (SELECT doc_id, coalesce('1' || source, '0') AS source, {_leaf("text")} AS leaf, CASE WHEN {_CRC} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS changed FROM documents)),
t AS (SELECT source, 0 AS level, i AS j, n, leaf AS h FROM d
  UNION ALL SELECT source, level + 1, j // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY j)) FROM t WHERE n > 1 GROUP BY source, level, j // 3),
s AS (SELECT source, h, row_number() OVER (ORDER BY source) - 1 AS place, count(*) OVER () AS n FROM t WHERE n = 1),
r AS (SELECT 0 AS level, place AS j, n, h FROM s
  UNION ALL SELECT level + 1, j // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY j)) FROM r WHERE n > 1 GROUP BY level, j // 3),
p AS (SELECT d.row, 0 AS stage, t.level, t.j, t.h, d.i // (3 ** t.level)::BIGINT AS own FROM d JOIN t ON t.source = d.source AND t.n > 1 AND t.j // 3 = d.i // (3 ** (t.level + 1))::BIGINT
  UNION ALL SELECT d.row, 1, r.level, r.j, r.h, s.place // (3 ** r.level)::BIGINT FROM d JOIN s ON s.source = d.source JOIN r ON r.n > 1 AND r.j // 3 = s.place // (3 ** (r.level + 1))::BIGINT),
steps AS (SELECT row, row_number() OVER (PARTITION BY row ORDER BY stage, level) AS step, coalesce(string_agg(h, '' ORDER BY j) FILTER (j < own), '') AS l, coalesce(string_agg(h, '' ORDER BY j) FILTER (j > own), '') AS g FROM p GROUP BY row, stage, level),
f AS (SELECT row, 0 AS step, changed AS h FROM d UNION ALL SELECT f.row, f.step + 1, sha256(l || f.h || g) FROM f JOIN steps ON steps.row = f.row AND steps.step = f.step + 1),
e AS (SELECT row, arg_max(h, step) AS folded_root FROM f GROUP BY row),
q AS (SELECT row, string_agg(l || g, '' ORDER BY step) AS said FROM steps GROUP BY row),
root AS (SELECT h FROM r WHERE n = 1)
SELECT doc_id, leaf, s.h AS subroot, root.h AS root, sha256(coalesce(said, '')) AS proof_sha256, folded_root, folded_root = root.h AS verified
FROM d JOIN s ON s.source = d.source JOIN e ON e.row = d.row LEFT JOIN q ON q.row = d.row, root"""

PHRASES = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
q AS (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS v FROM p),
t AS (SELECT lang, id, unnest(v) AS w, generate_subscripts(v, 1) AS i FROM q),
g AS (SELECT lang, w, w || ' ' || lead(w) OVER o AS w2, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS w3,
             w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o AS w4 FROM t WINDOW o AS (PARTITION BY id ORDER BY i)),
totals AS (SELECT lang, count(*) AS n FROM t GROUP BY lang),
f AS MATERIALIZED (SELECT lang, 1 AS m, w AS phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, 2, w2, count(*) FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, 3, w3, count(*) FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, 4, w4, count(*) FROM g WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS v FROM f WHERE m > 1),
k AS (SELECT lang, m, phrase, a, k, array_to_string(v[1:k], ' ') AS one, array_to_string(v[k + 1:], ' ') AS two FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
s AS (SELECT k.lang, k.m, k.phrase, a, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.one JOIN f y ON y.lang = k.lang AND y.phrase = k.two
  QUALIFY row_number() OVER (PARTITION BY k.lang, k.phrase ORDER BY score, k) = 1),
z AS (SELECT lang, a, v, m, unnest(range(2, m)) AS z FROM c WHERE m > 2),
i AS (SELECT lang, array_to_string(v[x:x + z - 1], ' ') AS phrase, max(a) AS inside FROM (SELECT *, unnest(range(1, m - z + 2)) AS x FROM z) GROUP BY ALL),
o AS (SELECT s.* FROM s LEFT JOIN i ON i.lang = s.lang AND i.phrase = s.phrase WHERE inside IS NULL OR 100 * inside < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM o JOIN totals USING (lang) QUALIFY rank <= 2000"""

NEAR_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, e FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
  WHERE len(e) > 0 AND list_bool_and(list_transform(e, lambda x: coalesce(isfinite(x), false))) AND list_bool_or(list_transform(e, lambda x: x <> 0))),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
c AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT p.b, c.c FROM c JOIN p ON p.a = c.vec_id),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a), m AS (SELECT vec_id, min(c) AS component_id FROM c GROUP BY vec_id)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM m LEFT JOIN n ON n.a = m.vec_id"""
