"""DuckDB SQL of the training-data queries that SQL can express.

The others hash (op3, op4, op6), decode HTML (op5), train (op1, op8) or rank
(op10) and are tested against brute force instead.
"""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP2 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM p),
r AS (SELECT doc_id, count(DISTINCT pos) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 3)) AS pos FROM g WHERE n > 1)
      GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines) AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(list_filter(w, lambda x: length(regexp_replace(x, '[^\p{{Lu}}]', '', 'g')) > 1 AND NOT regexp_matches(x, '\p{{Ll}}'))) AS n_upper,
    len(list_filter(w, lambda x: 2 * length(regexp_replace(x, '[^\p{{L}}]', '', 'g')) > length(x))) AS n_plain
  FROM d LEFT JOIN r USING (doc_id)),
b AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
    + 8 * (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines)::BIGINT
    + 16 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::BIGINT
    + 32 * (10 * n_upper > 3 * n_words)::BIGINT + 64 * (10 * n_plain < 7 * n_words)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept,
  fail_bits FROM b"""

_CONTROL = r"[<\[](\||s>|/s>|INST\]|/INST\])"  # what the template escapes


def _escaped_length(c: str) -> str:
    doubled = f"replace({c}, chr(92), chr(92) || chr(92))"
    return f"(length({doubled}) + len(regexp_extract_all({doubled}, '{_CONTROL}')))"


OP7 = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (SELECT *, coalesce(lag(role) OVER w <> role, true) AS first FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum({_escaped_length('text')} + CASE WHEN first THEN length('<|turn|><|text|><|end|>') + {_escaped_length('role')}
      ELSE length('<|part|>') END)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id"""

OP9 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS k FROM p),
f AS (SELECT k, min(doc_id) AS least FROM g GROUP BY k),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos FROM g JOIN f USING (k) WHERE least < doc_id),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM x ANTI JOIN c USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id"""

OP11 = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, list_filter(regexp_split_to_array(unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[\x20\x09]+'), lambda x: x <> '') AS w FROM documents),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM s, range(1, 6) t(k) WHERE i + k - 1 <= len(w)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM g GROUP BY lang, k, phrase HAVING count(*) >= 100),
x AS (SELECT lang, phrase, k, f, unnest(range(2, k)) AS size FROM f WHERE k > 2),
y AS (SELECT x.lang, x.f, array_to_string(string_split(x.phrase, ' ')[i:i + size - 1], ' ') AS phrase
    FROM x, range(1, 5) t(i) WHERE i + size - 1 <= x.k),
z AS (SELECT lang, phrase, max(f) AS longer FROM y GROUP BY lang, phrase),
c AS (SELECT f.* FROM f LEFT JOIN z ON f.lang = z.lang AND f.phrase = z.phrase WHERE k > 1 AND (longer IS NULL OR 100 * longer < 100 * f)),
u AS (SELECT c.lang, c.phrase, c.f AS a, l.f AS l, r.f AS r, n.n, cut, ((1000::HUGEINT * c.f * n.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
    FROM c JOIN range(1, 5) t(cut) ON cut < c.k JOIN n ON n.lang = c.lang
    JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:cut], ' ')
    JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1:], ' ')),
b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "C") AS rank FROM b)
SELECT lang, rank, phrase, a, l, r, n, score, cut::INTEGER AS cut FROM o WHERE rank <= 2000"""

OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id::VARCHAR) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
n AS (SELECT *, len(u)::BIGINT AS n, [('0x' || substr(h, 8 * i + 1, 8))::BIGINT FOR i IN range(4)] AS r FROM d),
c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b FROM n),
f AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s,
    CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR r[3] % 100 >= 50 THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END
    AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM f"""

OP13 = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)] END) AS s FROM d),
t AS MATERIALIZED (SELECT doc_id, unnest(s) AS x FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN g x ON x.doc_id = a JOIN g y ON y.doc_id = b
    WHERE 100 * common >= 90 * (len(x.s) + len(y.s) - common)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM g UNION SELECT e.b, r.c FROM r JOIN e ON r.doc_id = e.a AND r.c < e.b)
SELECT g.doc_id, len(s)::BIGINT AS n_shingles, component_id FROM g JOIN (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id) c
  ON c.doc_id = g.doc_id"""

ORACLE_SQL = {"op11_collocations": OP11, "op13_jaccard_join": OP13, "op12_fill_in_middle": OP12, "op2_quality_rules": OP2, "op7_chat_format": OP7, "op9_substring_dedup": OP9}
