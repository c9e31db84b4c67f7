"""DuckDB SQL for the corpus queries that SQL can express."""

OP13 = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM t WINDOW same AS (PARTITION BY text_sha256)
"""

OP12 = r"""
WITH t AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
occ AS (SELECT lang, source, rid, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM t),
kept AS (SELECT lang, term FROM occ GROUP BY ALL HAVING count(DISTINCT rid) >= 10),
grp AS (SELECT DISTINCT lang, source FROM t),
cnt AS (SELECT lang, source, term, count(*) AS c FROM occ JOIN kept USING (lang, term) GROUP BY ALL),
dense AS (SELECT g.lang, g.source, k.term, coalesce(cnt.c, 0)::HUGEINT AS c FROM grp g JOIN kept k USING (lang) LEFT JOIN cnt ON cnt.lang = g.lang AND cnt.source = g.source AND cnt.term = k.term),
p AS (SELECT lang, source, term, c, 1 + 1000000000::HUGEINT * (c + 2) // (sum(c) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source))::HUGEINT AS p FROM dense),
whole AS (SELECT lang, term, sum(c)::HUGEINT AS c FROM dense GROUP BY ALL),
q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (c + 2) // (sum(c) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang))::HUGEINT AS q FROM whole),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(pairs.value, 0)::BIGINT AS value
  FROM grp g JOIN grp h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN pairs ON pairs.lang = g.lang AND pairs.source = g.source AND pairs.item = h.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

OP11 = r"""
WITH piece AS (
  SELECT row_number() OVER () AS pid, lang, words FROM (
    SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS words
    FROM documents)),
total AS (SELECT lang, sum(len(words))::HUGEINT AS n FROM piece GROUP BY lang),
place AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM piece),
size AS (SELECT unnest(range(1, 6)) AS m),
f AS (SELECT lang, m, words[i : i + m - 1] AS phrase, count(*)::HUGEINT AS f FROM place, size WHERE i + m - 1 <= len(words) GROUP BY ALL HAVING count(*) >= 100),
cut AS (
  SELECT c.lang, c.phrase, c.f AS a, c.k, l.f AS l, r.f AS r, n, 1000 * c.f * n // (l.f * r.f) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1) c
  JOIN f l ON l.lang = c.lang AND l.phrase = c.phrase[1 : c.k]
  JOIN f r ON r.lang = c.lang AND r.phrase = c.phrase[c.k + 1 : c.m]
  JOIN total ON total.lang = c.lang),
weakest AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_part AS (
  SELECT lang, phrase[s : s + w - 1] AS phrase, max(f) AS f
  FROM (SELECT lang, phrase, f, m, w, unnest(range(1, m - w + 2)) AS s FROM (SELECT *, unnest(range(2, m)) AS w FROM f WHERE m > 2)) GROUP BY ALL),
kept AS (SELECT w.* FROM weakest w LEFT JOIN inner_part i ON i.lang = w.lang AND i.phrase = w.phrase WHERE i.f IS NULL OR 100 * i.f < 100 * w.a),
ranked AS (SELECT *, array_to_string(phrase, ' ') AS p, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(phrase, ' ')) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, p AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""

OP5 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(text) + (length(text) - length(replace(text, '\', ''))) + (length(text) - length(replace(text, '</turn>', ''))) // 7
      + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0) AS text_size,
    length(role) + (length(role) - length(replace(role, '\', ''))) + (length(role) - length(replace(role, chr(10), ''))) + (length(role) - length(replace(role, '</turn>', ''))) // 7
      + coalesce(list_sum(list_transform(regexp_extract_all(role, '#{3,}'), lambda x: length(x) - 2)), 0) AS role_size
  FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  sum(length('### ') + role_size + 1 + text_size + length('</turn>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
