"""DuckDB SQL for the queries that SQL can express, over the same tables."""


OP1 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host,
                  row_number() OVER () AS rid FROM documents),
w AS (SELECT rid, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
win AS (SELECT rid, i, list_aggregate(ws[i:i + 4], 'string_agg', ' ') AS g
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
rep AS (SELECT rid, count(DISTINCT p) AS n_repeat_words
        FROM (SELECT rid, unnest(range(i, i + 5)) AS p
              FROM win SEMI JOIN (SELECT rid, g FROM win GROUP BY ALL HAVING count(*) > 1) USING (rid, g))
        GROUP BY rid),
lines AS (SELECT rid, doc_id, host, text, raw,
                 list_filter(string_split_regex(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS lw
          FROM (SELECT rid, doc_id, host, text, unnest(string_split(text, chr(10))) AS raw FROM d)),
full_lines AS (SELECT *, array_to_string(lw, ' ') AS line FROM lines WHERE len(lw) > 0),
dup AS (SELECT rid, sum(c - 1) AS n_dup_lines
        FROM (SELECT rid, raw, count(*) AS c FROM full_lines GROUP BY ALL) GROUP BY rid),
common AS (SELECT host, line, min(doc_id) AS first FROM full_lines
           GROUP BY host, line HAVING count(DISTINCT (doc_id, text)) > 20),
gone AS (SELECT rid, count(DISTINCT line) AS n_removed_lines, sum(len(lw)) AS n_removed_words
         FROM full_lines JOIN common USING (host, line) WHERE doc_id IS DISTINCT FROM first GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words - n_removed_words >= n_words * 0.3 AS kept, n_removed_lines, n_removed_words
FROM (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
      FROM (SELECT d.doc_id, len(ws)::BIGINT AS n_words,
                   length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
                   (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                   coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
                   coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
                   coalesce(n_removed_lines, 0)::BIGINT AS n_removed_lines,
                   coalesce(n_removed_words, 0)::BIGINT AS n_removed_words
            FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN gone USING (rid)))
"""

OP4 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
l AS (SELECT rid, i, raw, translate(regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM (SELECT rid, unnest(string_split(text, chr(10))) AS raw,
                   generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)),
common AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT rid) >= 10),
kept AS (SELECT rid, count(*) AS n, string_agg(raw, chr(10) ORDER BY i) AS t FROM l ANTI JOIN common USING (k) GROUP BY rid)
SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS n_lines,
       (len(string_split(text, chr(10))) - coalesce(n, 0))::BIGINT AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""

OP7 = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, i, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
s AS (SELECT *, length('<|im_start|>') + length(replace(replace(replace(role, chr(92), repeat(chr(92), 2)), '<|', '<' || chr(92) || '|'),
                                                        chr(10), chr(92) || chr(10)))
                + 1 + length(replace(replace(text, chr(92), repeat(chr(92), 2)), '<|', '<' || chr(92) || '|')) + length('<|im_end|>') + 1 AS n,
             row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS last
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
e AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM s)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       length(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), ''))::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(CASE WHEN role = 'assistant' OR i = last THEN upto END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP11 = r"""
WITH d AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
                  (('0x' || substr(sha256('11:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
           FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source),
o AS (SELECT *, 2 * source_size AS cap, row_number() OVER (ORDER BY 2 * source_size / w, source NULLS LAST) AS k,
             1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
l AS (SELECT *, ((total - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
                 / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT)::DOUBLE AS level FROM o),
t AS (SELECT source, source_size, least(cap::DOUBLE, w * coalesce((SELECT arg_min(level, k) FROM l WHERE level <= cap / w), 0)) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
q AS (SELECT *, target - whole * source_size AS rest FROM r),
h AS (SELECT source, size, count(*)::BIGINT AS n FROM d WHERE size > 0 GROUP BY ALL),
m AS (SELECT h.source, h.size, (rest - (source_size - sum(n * h.size) OVER v::BIGINT)) / sum(n * h.size * sqrt(h.size::DOUBLE)) OVER v AS c
      FROM h JOIN q ON h.source IS NOT DISTINCT FROM q.source WHERE rest > 0
      WINDOW v AS (PARTITION BY h.source ORDER BY h.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
c AS (SELECT source, arg_max(c, size) AS c FROM m WHERE c * sqrt(size::DOUBLE) <= 1 GROUP BY source),
p AS (SELECT d.*, source_size, target, whole, rest, least(1.0::DOUBLE, c * sqrt(size::DOUBLE)) AS p, c IS NOT NULL AND size > 0 AS able
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source),
z AS (SELECT *, CASE WHEN p >= 1 THEN -1 ELSE (u / (1 - u)) * ((1 - p) / p) / (1 + (u / (1 - u)) * ((1 - p) / p)) END AS z FROM p WHERE able),
e AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY z, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM z)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN floor((rest - before) / size + 0.5) >= 1 THEN 1 ELSE 0 END))::BIGINT AS taken FROM e
UNION ALL SELECT doc_id, size, source_size, target, (size * whole)::BIGINT FROM p WHERE NOT able
"""

OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
lab AS (SELECT doc_id, max(coalesce((quality = 1)::INT, 0)) AS good, max(coalesce((toxic = 1)::INT, 0)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
                   + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text))::INT
                   + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > first, false)::INT AS mask,
             coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
      FROM w LEFT JOIN lab ON w.doc_id = lab.doc_id),
m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT l1.f || l2.f || l3.f || l4.f || l5.f AS filter_order, [l1.b, l2.b, l3.b, l4.b, l5.b] AS bs
      FROM l l1 JOIN l l2 ON l2.f <> l1.f JOIN l l3 ON l3.f NOT IN (l1.f, l2.f) JOIN l l4 ON l4.f NOT IN (l1.f, l2.f, l3.f)
      JOIN l l5 ON l5.f NOT IN (l1.f, l2.f, l3.f, l4.f)),
s AS (SELECT filter_order, i AS step, bs[i] AS bit, coalesce(list_sum(bs[1:i - 1]), 0)::INT AS before FROM o, range(1, 6) r(i)),
x AS (SELECT part, filter_order, step::INT AS step,
             sum(n) FILTER (mask & bit = 0 AND mask & before = 0) AS kept, sum(n) FILTER (mask & bit <> 0 AND mask & before = 0) AS removed,
             sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
             sum(good) FILTER (mask & bit <> 0 AND mask & before = 0) AS good_lost,
             sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0) AS toxic_lost, bit
      FROM m, s GROUP BY part, filter_order, step, bit),
y AS (SELECT part, bit, sum(coalesce(removed, 0)) AS shapley FROM x GROUP BY part, bit)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, shapley::BIGINT AS shapley
FROM x JOIN y USING (part, bit)
"""

OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
l AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS u FROM d),
c AS (SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
             text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
             OR ('0x' || h[17:24])::BIGINT % 100 >= 100 AS plain, ('0x' || h[25:32])::BIGINT % 100 < 50 AS spm FROM l),
p AS (SELECT *, array_to_string(u[1:least(a, b)], '') AS pre, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS mid,
             array_to_string(u[greatest(a, b) + 1:n], '') AS suf FROM c)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT plain THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN NOT plain THEN length(mid)::BIGINT END AS middle_chars,
       sha256(CASE WHEN plain THEN text WHEN spm THEN '<S>' || suf || '<P>' || pre || '<M>' || mid
                   ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""

ORACLE = {"op11_source_mix": OP11, "op12_filter_audit": OP12, "op13_fill_middle": OP13, "op7_chat_format": OP7, "op1_quality_rules": OP1, "op4_line_dedup": OP4}
