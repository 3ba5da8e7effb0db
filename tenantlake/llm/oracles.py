"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tenantlake.llm.licenses import TEMPLATES
from tenantlake.llm.queries import CONTROL

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _folded(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}')"


OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, text
           FROM documents),
w AS (SELECT rid, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS ws FROM d),
wu AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
g AS (SELECT rid, pos, word || ' ' || lead(word, 1) OVER p || ' ' || lead(word, 2) OVER p
             || ' ' || lead(word, 3) OVER p || ' ' || lead(word, 4) OVER p AS gram
      FROM wu WINDOW p AS (PARTITION BY rid ORDER BY pos)),
again AS (SELECT rid, pos, count(*) OVER (PARTITION BY rid, gram) AS n FROM g
          WHERE gram IS NOT NULL),
covered AS (SELECT rid, count(DISTINCT pos + k) AS n FROM again, range(5) AS r(k)
            WHERE n >= 2 GROUP BY rid),
lines AS (SELECT rid, host, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line
          FROM d),
normal AS (SELECT rid, host, text, line, regexp_extract_all(
               regexp_replace({_folded('line')}, '[0-9]', '0', 'g'), {_ALNUM}) AS ws
           FROM lines),
dups AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines
         WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
frequent AS (SELECT host, ws FROM normal WHERE len(ws) > 0 GROUP BY host, ws
             HAVING count(DISTINCT text) > 10),
gone AS (SELECT n.rid, count(f.host) AS n_lines, sum(len(n.ws)) AS total,
                coalesce(sum(CASE WHEN f.host IS NOT NULL THEN len(n.ws) END), 0) AS words
         FROM normal n LEFT JOIN frequent f ON n.host = f.host AND n.ws = f.ws GROUP BY n.rid),
measured AS (
    SELECT d.doc_id, len(w.ws)::BIGINT AS n_words,
           length(array_to_string(w.ws, ''))::BIGINT AS word_chars,
           length(regexp_replace(coalesce(d.text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT
               AS n_symbols,
           coalesce(dups.n, 0)::BIGINT AS n_dup_lines,
           coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
           gone.n_lines::BIGINT AS n_removed_lines,
           (gone.total - gone.words)::BIGINT AS words_left, gone.total AS total
    FROM d JOIN w USING (rid) LEFT JOIN covered USING (rid) LEFT JOIN dups USING (rid)
    LEFT JOIN gone USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
           AND NOT words_left < 0.5 * total AS kept,
       n_removed_lines, words_left
FROM measured
"""

OP4 = rf"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations
    UNION ALL SELECT -1, 0, 'user', '{CONTROL}'
    UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}'),
spelled AS (
    SELECT *, row_number() OVER p AS n, count(*) OVER (PARTITION BY conv_id) AS turns,
           length('<|im_start|>') + length(replace(replace(replace(role, '\', '\\'),
               '<|', '<\|'), chr(10), '<\n>')) + 1
           + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length('<|im_end|>') + 1
               AS chars
    FROM rows WINDOW p AS (PARTITION BY conv_id ORDER BY turn, role, text)),
prefixes AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY n) AS upto FROM spelled)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), ''))
           AS loss_sha256,
       sum(upto) FILTER (role = 'assistant' OR n = turns)::BIGINT AS formatted_chars
FROM prefixes GROUP BY conv_id
"""

OP5 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                  regexp_extract_all({_folded('text')}, {_ALNUM}) AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_folded('text')}, {_ALNUM}) AS ws
      FROM benchmark),
windows AS (
    SELECT DISTINCT item, least(10, len(ws)) AS size, array_to_string(
        ws[i:i + least(10, len(ws)) - 1], ' ') AS gram
    FROM (SELECT item, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM b
          WHERE len(ws) > 0)),
grams AS (
    SELECT rid, i, size, array_to_string(ws[i:i + size - 1], ' ') AS gram
    FROM (SELECT rid, ws, size, unnest(range(1, len(ws) - size + 2)) AS i
          FROM d, (SELECT DISTINCT size FROM windows) WHERE len(ws) >= size)),
hits AS (SELECT g.rid, g.i, g.size, w.item FROM grams g JOIN windows w USING (size, gram)),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM hits, range(10) AS r(k)
            WHERE k < size GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item) AS n,
                 string_agg(DISTINCT item, ',' ORDER BY item) AS listed
          FROM hits GROUP BY rid)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(covered.n, 0)::BIGINT AS n_hit,
       coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)
"""

_ROWS = ", ".join("('{}', '{}')".format(name, wording.replace("'", "''"))
                  for name, wording in TEMPLATES)


def _grams(words: str) -> str:
    return (f"list_distinct([{words}[i] || ' ' || {words}[i + 1] "
            f"FOR i IN range(1, len({words}))])")


OP7 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
known AS (
    SELECT license, {_grams('ws')} AS grams FROM (
        SELECT license, regexp_extract_all({_folded('wording')}, {_ALNUM}) AS ws
        FROM (VALUES {_ROWS}) AS t(license, wording))),
passages AS (
    SELECT rid, passage, {_grams('ws')} AS grams FROM (
        SELECT rid, passage, regexp_extract_all({_folded('passage')}, {_ALNUM}) AS ws FROM (
            SELECT DISTINCT rid, unnest(list_concat(
                string_split(text, chr(10)), string_split(regexp_replace(text,
                    '([.!?])[\t\n\x0B\f\r ]+', '\1' || chr(10), 'g'), chr(10)))) AS passage
            FROM d WHERE text IS NOT NULL))),
compared AS (
    SELECT rid, passage, license, 2 * len(list_intersect(p.grams, k.grams))
           / (len(p.grams) + len(k.grams)) AS dice
    FROM passages p, known k WHERE len(p.grams) > 0),
best AS (SELECT rid, passage, max(dice) AS dice,
                arg_min(license, (-dice, license)) AS license
         FROM compared WHERE dice >= 0.8 GROUP BY rid, passage),
named AS (SELECT rid, license, max(dice) AS dice, count(*) AS n FROM best GROUP BY ALL),
listed AS (SELECT rid, sum(n) AS n, string_agg(license || ':' || printf('%.4f', dice), ','
                  ORDER BY license) AS licenses FROM named GROUP BY rid)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_notices, coalesce(licenses, '') AS licenses
FROM d LEFT JOIN listed USING (rid)
"""


_CRC = ("xor(list_reduce(list_concat([4294967295], list_transform(string_split("
        "doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda x, c: list_reduce("
        "list_concat([xor(x, c)], range(8)), lambda y, k: xor(y >> 1, 3988292384 * (y & 1)))),"
        " 4294967295)")

OP11 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_CRC} AS h,
                  regexp_extract_all(coalesce(text, ''), {_SPACED}) AS ws FROM documents),
g AS (SELECT *, h // 10 AS g, len(ws) AS n,
             CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
v AS (SELECT rid, doc_id, CASE WHEN a IS NULL THEN ws ELSE list_concat(ws[:a],
             [ws[1 + a + i % p] FOR i IN range(n - a)]) END AS ws FROM p),
w AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM v),
six AS (SELECT rid, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o
               || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o || ' '
               || lead(word, 5) OVER o AS gram
        FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
pairs AS (SELECT a.rid, a.i, b.i - a.i AS q FROM six a JOIN six b
          ON a.rid = b.rid AND a.gram = b.gram AND a.i < b.i),
islands AS (SELECT rid, q, min(i) AS start, count(*) + 5 AS same FROM (
                SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island
                FROM pairs) GROUP BY rid, q, island),
runs AS (SELECT rid, start, same + q AS length, min(q) AS period FROM islands
         WHERE same >= q AND same >= 12 - q GROUP BY rid, start, same + q),
best AS (SELECT rid, count(*) AS n_runs,
                arg_min({{'s': start, 'l': length, 'p': period}}, (-length, start, period)) AS b,
                string_agg(start || ',' || length || ',' || period || chr(10), ''
                           ORDER BY start, period) AS listed
         FROM runs GROUP BY rid),
gone AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS text
         FROM w ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.s::BIGINT AS start,
       b.l::BIGINT AS length, b.p::BIGINT AS period, (1000 * b.l // b.p)::BIGINT AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept.text, ''))
           AS collapsed_sha256
FROM v LEFT JOIN best USING (rid) LEFT JOIN kept USING (rid)
"""

_LONGER = " UNION ALL ".join(
    f"SELECT lang, array_to_string(ws[{i}:{j}], ' ') AS phrase, n AS longest FROM candidates"
    f" WHERE len(ws) = {size}"
    for size in (3, 4, 5) for i in range(1, size) for j in range(i + 1, size + 1)
    if j - i + 1 < size)

OP12 = rf"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(
        regexp_split_to_array({_folded('text')}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
grams AS (
    SELECT lang, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (
        SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i
        FROM w, range(1, 6) AS r(k) WHERE len(ws) >= k)),
f AS MATERIALIZED (SELECT lang, phrase, count(*) AS n FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(n)::HUGEINT AS total FROM f WHERE NOT contains(phrase, ' ')
           GROUP BY lang),
often AS MATERIALIZED (SELECT * FROM f WHERE n >= 100),
candidates AS MATERIALIZED (SELECT lang, phrase, n, string_split(phrase, ' ') AS ws FROM often
                            WHERE contains(phrase, ' ')),
cuts AS (SELECT lang, phrase, a, k, array_to_string(ws[:k], ' ') AS head,
                array_to_string(ws[k + 1:], ' ') AS rest
         FROM (SELECT lang, phrase, ws, n AS a, unnest(range(1, len(ws))) AS k FROM candidates)),
scored AS (
    SELECT c.lang, c.phrase, c.a, c.k, x.n AS l, y.n AS r, total,
           1000 * c.a::HUGEINT * total // (x.n::HUGEINT * y.n::HUGEINT) AS score
    FROM cuts c JOIN often x ON c.lang = x.lang AND c.head = x.phrase
    JOIN often y ON c.lang = y.lang AND c.rest = y.phrase JOIN totals t ON c.lang = t.lang),
weakest AS (SELECT * FROM scored
            QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, phrase, max(longest) AS longest FROM ({_LONGER}) GROUP BY lang, phrase),
kept AS (SELECT s.* FROM weakest s
         LEFT JOIN longer o ON s.lang = o.lang AND s.phrase = o.phrase
         WHERE o.longest IS NULL OR 100 * o.longest < 100 * s.a)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, total::BIGINT AS n,
       score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)
             AS rank FROM kept)
WHERE rank <= 2000
"""

OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                  coalesce(doc_id, -9223372036854775808) AS id,
                  regexp_extract_all(coalesce(text, ''), {_SPACED}) AS ws FROM documents),
windows AS (
    SELECT rid, id, i, array_to_string(ws[i:i + 19], ' ') AS words
    FROM (SELECT rid, id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20)),
earliest AS (SELECT words, min((id, i)) AS first FROM windows GROUP BY words),
gone AS (SELECT DISTINCT rid, i + k AS i FROM windows JOIN earliest USING (words),
                range(20) AS r(k) WHERE (id, i) > first),
w AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n
         FROM w ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""


def llm_oracles() -> dict[str, str]:
    return {"op1_line_frequency": OP1, "op4_prefix_targets": OP4, "op5_wu_manber": OP5,
            "op7_dice_licenses": OP7, "op11_lyndon_runs": OP11, "op12_stripes": OP12,
            "op13_seed_extend": OP13}
