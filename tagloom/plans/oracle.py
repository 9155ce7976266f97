"""DuckDB SQL equal in meaning to each named query (the correctness oracle)."""

from __future__ import annotations

from ..functions.text import ENGLISH_STOP_WORDS, sql_string_list

STOP = sql_string_list(ENGLISH_STOP_WORDS)
TOK = r"regexp_extract_all(lower(coalesce({t}, '')), '[\p{{L}}\p{{N}}_]{{2,}}')"


def tok(t: str) -> str:
    return TOK.format(t=t)


TOPIC_TERMS = f"""
  assign AS (
    SELECT d.doc_id, CAST(coalesce(e.label, -1) AS INTEGER) AS topic, d.text
    FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
  occ AS (SELECT topic, unnest({tok('text')}) AS term FROM assign),
  cnt AS (SELECT topic, term, count(*) AS n FROM occ WHERE term NOT IN ({STOP}) GROUP BY 1, 2),
  tot AS (SELECT topic, sum(n) AS total FROM cnt GROUP BY 1),
  aa AS (SELECT floor(avg(total)) AS A FROM tot),
  tf AS (SELECT term, sum(n) AS f FROM cnt GROUP BY 1),
  w AS (SELECT c.topic, c.term, c.n, (c.n / t.total) * ln(aa.A / tf.f + 1) AS weight
        FROM cnt c JOIN tot t USING (topic) JOIN tf USING (term) CROSS JOIN aa),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS rank FROM w)
"""

ORACLE: dict[str, str] = {}

ORACLE["ctfidf_top_words"] = f"""
WITH {TOPIC_TERMS}
SELECT CAST(topic AS BIGINT) AS topic, CAST(rank AS BIGINT) AS rank, term AS word,
       CAST(round(CAST(round(weight, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS weight
FROM ranked WHERE rank <= 10
"""

# -- sources, augmentation, cleaning, filters --------------------------------

WS = r"[\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}]"
NL2 = "chr(10) || chr(10)"


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '\A{WS}+|{WS}+\z', '', 'g')"


def html_text_sql(h: str) -> str:
    x = rf"regexp_replace({h}, '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g')"
    x = rf"regexp_replace({x}, '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g')"
    x = rf"regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g')"
    x = rf"regexp_replace({x}, '(?s)<[^>]*>', ' ', 'g')"
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{ent}', '{ch}')"
    x = f"regexp_replace({x}, '{WS}+', ' ', 'g')"
    return strip_sql(x)


CATALOGUE = """catalogue AS (
    SELECT doc_id AS dataset_id, source || '-' || CAST(doc_id AS VARCHAR) AS name,
           coalesce(text, '') AS description, lang, source,
           string_split(coalesce(text, ''), ' ') AS feature_names
    FROM documents)"""

SCRAPED = f"""scraped AS (
    SELECT page_id AS dataset_id, {html_text_sql('html')} AS scraped_data FROM pages)"""

REMOVALS = """removals AS (
    SELECT doc_id AS dataset_id, list(source) AS rm FROM documents
    WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1)"""

ORACLE["catalogue_load"] = f"""
WITH {CATALOGUE}
SELECT dataset_id, name, description, concat_ws(',', lang, source) AS tags,
       CAST(len(feature_names) AS BIGINT) AS n_features FROM catalogue
"""

ORACLE["exclude_ids"] = f"""
WITH {CATALOGUE}
SELECT dataset_id, name FROM catalogue WHERE dataset_id NOT IN (4537, 4546, 4562)
"""

ORACLE["augment_name"] = f"""
WITH {CATALOGUE}
SELECT dataset_id, 'Name: ' || name || {NL2} || description AS augmented_description FROM catalogue
"""

TAGS_EXPR = (f"'Tags: ' || array_to_string(list_filter([c.lang, c.source], "
             f"lambda t: NOT coalesce(list_contains(r.rm, t), false)), ', ') || {NL2}")

ORACLE["augment_tags"] = f"""
WITH {CATALOGUE}, {REMOVALS}
SELECT c.dataset_id, {TAGS_EXPR} || c.description AS augmented_description
FROM catalogue c LEFT JOIN removals r USING (dataset_id)
"""

FEATURES_EXPR = (f"{NL2} || 'Features: ' || array_to_string(CASE WHEN len(c.feature_names) > 10 "
                 f"THEN list_concat(c.feature_names[1:10], ['and ' || CAST(len(c.feature_names) - 10 AS VARCHAR) "
                 f"|| ' more...']) ELSE c.feature_names END, ', ')")

ORACLE["augment_features"] = f"""
WITH {CATALOGUE}
SELECT c.dataset_id, c.description || {FEATURES_EXPR} AS augmented_description FROM catalogue c
"""

ORACLE["augment_id"] = f"""
WITH {CATALOGUE}
SELECT dataset_id, 'ID: ' || CAST(dataset_id AS VARCHAR) || {NL2} || description AS augmented_description
FROM catalogue
"""

ORACLE["augment_scraped"] = f"""
WITH {CATALOGUE}, {SCRAPED}
SELECT c.dataset_id, coalesce(s.scraped_data, '') AS scraped_data,
       CASE WHEN coalesce(s.scraped_data, '') <> ''
            THEN c.description || {NL2} || 'Scraped Data: ' || s.scraped_data
            ELSE c.description END AS augmented_description
FROM catalogue c LEFT JOIN scraped s USING (dataset_id)
"""

ORACLE["augment_all"] = f"""
WITH {CATALOGUE}, {SCRAPED}, {REMOVALS},
  a AS (
    SELECT c.dataset_id,
           ({TAGS_EXPR} || 'Name: ' || c.name || {NL2} || 'ID: ' || CAST(c.dataset_id AS VARCHAR) || {NL2}
            || c.description || {FEATURES_EXPR}) AS base
    FROM catalogue c LEFT JOIN removals r USING (dataset_id))
SELECT a.dataset_id,
       CASE WHEN coalesce(s.scraped_data, '') <> '' THEN a.base || {NL2} || 'Scraped Data: ' || s.scraped_data
            ELSE a.base END AS augmented_description
FROM a LEFT JOIN scraped s USING (dataset_id)
"""

ORACLE["attach_rewrites"] = """
SELECT doc_id AS dataset_id, 'Rewritten: ' || text AS prompt_description FROM documents
WHERE doc_id IN (SELECT doc_id FROM labels)
"""

ORACLE["rewrite_prompts"] = f"""
WITH {CATALOGUE}
SELECT dataset_id, description || {NL2} || 'Rewrite the description above as one clear paragraph that states what '
       || 'the data is about, how it was collected and what it can be used for.' AS rewrite_prompt
FROM catalogue
"""

ORACLE["repair_urls"] = """
WITH m AS (SELECT DISTINCT url AS from_url, regexp_replace(url, '#.*$', '') AS to_url FROM pages WHERE contains(url, '#'))
SELECT p.page_id, coalesce(m.to_url, p.url) AS url FROM pages p LEFT JOIN m ON p.url = m.from_url
"""

ORACLE["clean_text"] = """
SELECT doc_id, lower(replace(text, chr(10), ' ')) AS clean FROM documents
"""

ORACLE["squash_whitespace"] = f"""
SELECT doc_id, regexp_replace(text, '{WS}+', ' ', 'g') AS squashed FROM documents
"""

PARA = "text"
for a, b in (("'Mr.' || chr(10)", "'Mr. '"), ("'.' || chr(10)", r"' \p '"), ("'. ' || chr(10) || ' '", r"' \p '"),
             ("'. ' || chr(10)", r"' \p '"), ("chr(10)", "' '")):
    PARA = f"replace({PARA}, {a}, {b})"

ORACLE["paragraphs"] = f"""
WITH p AS (SELECT doc_id, string_split({PARA}, '\\p') AS parts FROM documents),
  u AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM p)
SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, lower({strip_sql('part')}) AS paragraph FROM u
"""

ORACLE["html_text"] = f"""
SELECT page_id, {html_text_sql('html')} AS text FROM pages
"""

ORACLE["route_by_domain"] = """
SELECT page_id, CASE WHEN contains(url, '.example.com') THEN 'com' WHEN contains(url, '.example.net') THEN 'net'
                     WHEN contains(url, '.example.org') THEN 'org' END AS site FROM pages
"""

ORACLE["drop_short"] = """
SELECT doc_id, CAST(CASE WHEN text IS NULL OR length(text) <= 2 THEN 0 ELSE 1 END AS BIGINT) AS kept FROM documents
"""

ORACLE["drop_flagged"] = """
SELECT event_id FROM events WHERE event_type <> 'error' AND props <> '' AND length(props) > 2
"""

ORACLE["min_length"] = """
SELECT doc_id AS dataset_id FROM documents WHERE coalesce(text, '') <> '' AND length(coalesce(text, '')) >= 100
"""

ORACLE["keep_domains"] = """
SELECT page_id, url FROM pages WHERE url IS NOT NULL AND (contains(url, '.example.com') OR contains(url, '.example.org'))
"""

ORACLE["align_embeddings"] = """
SELECT vec_id AS doc_id, CAST(label AS BIGINT) AS label FROM embeddings
WHERE vec_id IN (SELECT doc_id FROM documents WHERE coalesce(text, '') <> '' AND length(coalesce(text, '')) >= 100)
"""

ORACLE["backlog"] = """
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
"""

ALPHA_TOKENS = (r"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+'), "
                r"lambda t: regexp_full_match(t, '[a-z]{2,}'))")

DOC_TOKENS = f"""doc_tokens AS (
    SELECT doc_id, term FROM (SELECT doc_id, unnest({ALPHA_TOKENS}) AS term FROM documents)
    WHERE term NOT IN ({STOP}))"""

ORACLE["limit_vocabulary"] = f"""
WITH {DOC_TOKENS},
  freq AS (SELECT term, count(*) AS n FROM doc_tokens GROUP BY 1),
  top AS (SELECT term FROM freq ORDER BY n DESC, term LIMIT 2000)
SELECT doc_id, count(*) AS n_tokens FROM doc_tokens WHERE term IN (SELECT term FROM top) GROUP BY 1
"""

WORD_TOKENS = f"""word_tokens AS (
    SELECT doc_id, term FROM (SELECT doc_id, unnest({tok('text')}) AS term FROM documents)
    WHERE term NOT IN ({STOP}))"""

ORACLE["min_count"] = f"""
WITH {WORD_TOKENS}
SELECT term, count(*) AS n FROM word_tokens GROUP BY 1 HAVING count(*) > 50
"""

ORACLE["remove_stopwords"] = f"""
WITH {WORD_TOKENS}
SELECT doc_id, count(*) AS n_tokens FROM word_tokens GROUP BY 1
"""

# topic words are words and pairs of words; the vocabulary has words only
ORACLE["fill_oov"] = f"""
WITH {TOPIC_TERMS.replace("occ AS (SELECT topic, unnest(" + tok('text') + ") AS term FROM assign)",
    "occ AS (SELECT topic, unnest(list_concat(t, CASE WHEN len(t) >= 2 THEN list_transform(range(1, len(t)), "
    "lambda i: t[i] || ' ' || t[i + 1]) ELSE [] END)) AS term FROM (SELECT topic, list_filter(" + tok('text')
    + f", lambda x: x NOT IN ({STOP})) AS t FROM assign))")},
  vocab AS (SELECT DISTINCT unnest({tok('text')}) AS term FROM documents),
  firstw AS (SELECT {tok('text')}[1] AS term FROM documents WHERE len({tok('text')}) > 0 ORDER BY doc_id LIMIT 1)
SELECT CAST(r.topic AS BIGINT) AS topic, CAST(r.rank AS BIGINT) AS rank,
       CASE WHEN r.term IN (SELECT term FROM vocab) THEN r.term ELSE (SELECT term FROM firstw) END AS term
FROM ranked r WHERE r.rank <= 10
"""

ORACLE["exact_dedupe"] = """
SELECT DISTINCT sha256(text) AS text_hash FROM documents
"""

# -- TF-IDF, similarity join, near-duplicate removal --------------------------

TFIDF = f"""
  toks AS (SELECT doc_id, list_filter({tok('text')}, lambda t: t NOT IN ({STOP})) AS t FROM documents),
  occ2 AS (SELECT doc_id, unnest(t) AS term FROM toks),
  cnt2 AS (SELECT doc_id, term, count(*) AS n FROM occ2 GROUP BY 1, 2),
  ndoc AS (SELECT count(*) AS N FROM documents),
  dfq AS (SELECT term, count(*) AS df FROM cnt2 GROUP BY 1),
  raw AS (SELECT c.doc_id, c.term, d.df, c.n * (ln((1.0 + ndoc.N) / (1 + d.df)) + 1) AS w
          FROM cnt2 c JOIN dfq d USING (term) CROSS JOIN ndoc),
  nrm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY 1),
  tw AS (SELECT r.doc_id, r.term, r.w / nrm.norm AS weight FROM raw r JOIN nrm USING (doc_id)),
  grp AS (SELECT doc_id, sha256(array_to_string(list_sort(t), ' ')) AS fp FROM toks WHERE len(t) > 0),
  grp2 AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY fp) AS rep FROM grp),
  reps AS (SELECT doc_id FROM grp2 WHERE doc_id = rep),
  rw AS (SELECT * FROM tw WHERE doc_id IN (SELECT doc_id FROM reps))
"""


def pairs_sql(t: float, rows: str = "rw") -> str:
    return f"""
  pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(x.weight * y.weight) AS cosine
            FROM {rows} x JOIN {rows} y ON x.term = y.term AND x.doc_id < y.doc_id
            GROUP BY 1, 2 HAVING sum(x.weight * y.weight) > {t})"""


ORACLE["tfidf_weights"] = f"""
WITH {TFIDF}
SELECT doc_id, term, CAST(round(CAST(round(weight, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS weight FROM tw
"""

ORACLE["twin_groups"] = f"""
WITH {TFIDF}
SELECT doc_id, rep FROM grp2
"""

ORACLE["similar_pairs"] = f"""
WITH {TFIDF}, {pairs_sql(0.9)}
SELECT a, b, CAST(round(CAST(round(cosine, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS cosine FROM pairs
UNION ALL SELECT rep, doc_id, CAST(1 AS DOUBLE) FROM grp2 WHERE doc_id <> rep
"""

ORACLE["similar_documents"] = f"""
WITH {TFIDF}, {pairs_sql(0.9, "tw")},
  l AS (SELECT doc_id, count(*) AS n FROM (SELECT a AS doc_id FROM pairs UNION ALL SELECT b FROM pairs) GROUP BY 1)
SELECT d.doc_id, coalesce(g.rep, d.doc_id) AS rep, coalesce(l.n, 0) AS n_links
FROM documents d LEFT JOIN grp2 g USING (doc_id) LEFT JOIN l USING (doc_id)
"""

GREEDY = f"""
WITH RECURSIVE {TFIDF}, {pairs_sql(0.99)},
  nodes AS (SELECT a AS node FROM pairs UNION SELECT b FROM pairs),
  x AS (SELECT a AS src, b AS dst FROM pairs UNION ALL SELECT node, node FROM nodes),
  st(it, node, kept, und) AS (
    SELECT 0, node, CASE WHEN node NOT IN (SELECT b FROM pairs) THEN 1 END, 1 FROM nodes
    UNION ALL
    SELECT it, node, kept, sum(CASE WHEN kept IS NULL THEN 1 ELSE 0 END) OVER () FROM (
      SELECT max(s.it) + 1 AS it, x.dst AS node,
             CASE WHEN max(CASE WHEN x.src = x.dst THEN s.kept END) IS NOT NULL
                    THEN max(CASE WHEN x.src = x.dst THEN s.kept END)
                  WHEN max(CASE WHEN x.src <> x.dst AND s.kept = 1 THEN 1 ELSE 0 END) = 1 THEN 0
                  WHEN min(CASE WHEN x.src <> x.dst THEN CASE WHEN s.kept = 0 THEN 1 ELSE 0 END ELSE 1 END) = 1
                    THEN 1 END AS kept
      FROM st s JOIN x ON s.node = x.src
      WHERE s.und > 0
      GROUP BY x.dst)),
  final AS (SELECT node, kept FROM st WHERE it = (SELECT max(it) FROM st)),
  rep_kept AS (SELECT r.rep, coalesce(f.kept, 1) AS kept FROM (SELECT DISTINCT rep FROM grp2) r
               LEFT JOIN final f ON f.node = r.rep),
  member AS (SELECT g.doc_id, g.rep, k.kept FROM grp2 g JOIN rep_kept k USING (rep)),
  dropped AS (SELECT doc_id FROM member WHERE kept = 0 OR doc_id <> rep),
  sim AS (
    SELECT rep AS kept_id, doc_id AS similar_id FROM member WHERE kept = 1 AND doc_id <> rep
    UNION ALL
    SELECT adj.rep AS kept_id, m.doc_id AS similar_id
    FROM (SELECT a AS rep, b AS other FROM pairs UNION ALL SELECT b, a FROM pairs) adj
    JOIN rep_kept k ON k.rep = adj.rep AND k.kept = 1
    JOIN grp2 m ON m.rep = adj.other)
"""

ORACLE["drop_similar_kept"] = GREEDY + """
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM dropped)
"""

ORACLE["drop_similar_pairs"] = GREEDY + """
SELECT kept_id, similar_id FROM sim
"""

# -- topic quality and topic tables ------------------------------------------

QUALITY = f"""
  tw AS (SELECT topic, term, rank FROM ranked WHERE rank <= 10 AND topic <> -1),
  words AS (SELECT DISTINCT term FROM tw),
  ptoks AS (SELECT doc_id, list_filter({tok('text')}, lambda t: t NOT IN ({STOP})) AS t FROM documents),
  lens AS (SELECT doc_id, len(t) AS L FROM ptoks),
  occp AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM ptoks),
  occw AS (SELECT o.doc_id, o.term, o.pos, l.L FROM occp o JOIN lens l USING (doc_id)
           WHERE o.term IN (SELECT term FROM words)),
  tpairs AS (SELECT a.topic, a.term AS w1, b.term AS w2 FROM tw a JOIN tw b ON a.topic = b.topic AND a.term < b.term)
"""


def npmi_sql(mode: str) -> str:
    if mode == "window":
        units = """units AS (SELECT DISTINCT doc_id, u, term FROM (
            SELECT doc_id, term, unnest(CASE WHEN L > 10 THEN range(greatest(0, pos - 9), least(pos, L - 10) + 1)
                                             ELSE [0] END) AS u FROM occw)),
          nunits AS (SELECT sum(CASE WHEN L > 10 THEN L - 9 ELSE 1 END) AS N FROM lens)"""
    else:
        units = """units AS (SELECT DISTINCT doc_id, 0 AS u, term FROM occw),
          nunits AS (SELECT count(*) AS N FROM lens)"""
    return f"""
  {units},
  wc AS (SELECT term, count(*) AS c FROM units GROUP BY 1),
  pc AS (SELECT x.term AS w1, y.term AS w2, count(*) AS c12 FROM units x
         JOIN units y ON x.doc_id = y.doc_id AND x.u = y.u AND x.term < y.term GROUP BY 1, 2),
  j AS (SELECT p.topic, coalesce(c1.c, 0) AS c1, coalesce(c2.c, 0) AS c2, coalesce(pc.c12, 0) AS c12
        FROM tpairs p LEFT JOIN wc c1 ON c1.term = p.w1 LEFT JOIN wc c2 ON c2.term = p.w2
        LEFT JOIN pc ON pc.w1 = p.w1 AND pc.w2 = p.w2),
  per_topic AS (SELECT topic, avg(ln((c12 / N + 1e-12) / ((c1 / N) * (c2 / N))) / (-ln(c12 / N + 1e-12))) AS npmi
                FROM j CROSS JOIN nunits GROUP BY topic)"""


ORACLE["npmi_window"] = f"""
WITH {TOPIC_TERMS}, {QUALITY}, {npmi_sql('window')}
SELECT CAST(topic AS BIGINT) AS topic, CAST(round(CAST(round(npmi, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS npmi FROM per_topic
"""

ORACLE["npmi_document"] = f"""
WITH {TOPIC_TERMS}, {QUALITY}, {npmi_sql('document')}
SELECT CAST(topic AS BIGINT) AS topic, CAST(round(CAST(round(npmi, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS npmi FROM per_topic
"""

ORACLE["diversity"] = f"""
WITH {TOPIC_TERMS}, {QUALITY}
SELECT CAST(round(CAST(round(count(DISTINCT term) / (10 * count(DISTINCT topic)), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS diversity FROM tw
"""

ORACLE["weighted_quality"] = f"""
WITH {TOPIC_TERMS}, {QUALITY}, {npmi_sql('window')},
  c AS (SELECT avg(npmi) AS npmi FROM per_topic),
  d AS (SELECT count(DISTINCT term) / (10 * count(DISTINCT topic)) AS diversity FROM tw)
SELECT CAST(round(CAST(round(npmi, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS npmi, CAST(round(CAST(round(diversity, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS diversity,
       CAST(round(CAST(round(ln((npmi + 1) / 2 + 1e-10), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS log_coherence, CAST(round(CAST(round(ln(diversity + 1e-10), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS log_diversity,
       CAST(round(CAST(round(ln((npmi + 1) / 2 + 1e-10) + ln(diversity + 1e-10), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS weighted
FROM c CROSS JOIN d
"""

SIL = """
  p AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label <> -1),
  d AS (SELECT a.id, a.label AS la, b.label AS lb, list_distance(a.v, b.v) AS dist FROM p a JOIN p b ON a.id <> b.id),
  m AS (SELECT id, la, lb, avg(dist) AS md FROM d GROUP BY 1, 2, 3),
  sa AS (SELECT id, md AS a FROM m WHERE la = lb),
  sb AS (SELECT id, min(md) AS b FROM m WHERE la <> lb GROUP BY 1),
  s AS (SELECT p.id, p.label, CASE WHEN sa.a IS NOT NULL AND sb.b IS NOT NULL AND greatest(sa.a, sb.b) > 0
                                  THEN (sb.b - sa.a) / greatest(sa.a, sb.b) ELSE 0 END AS s
        FROM p LEFT JOIN sa ON sa.id = p.id LEFT JOIN sb ON sb.id = p.id)
"""

ORACLE["silhouette_samples"] = f"""
WITH {SIL}
SELECT id AS doc_id, CAST(label AS BIGINT) AS label, CAST(round(CAST(round(s, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS s FROM s
"""

ORACLE["silhouette"] = f"""
WITH {SIL}
SELECT CAST(round(CAST(round(avg(s), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS silhouette FROM s
"""

CENT = """
  ex AS (SELECT vec_id AS doc_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
  cm AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM ex GROUP BY 1, 2),
  cn AS (SELECT label, i, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS c FROM cm),
  xn AS (SELECT doc_id, sqrt(sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS nx FROM ex GROUP BY 1),
  cos AS (SELECT e.doc_id, c.label AS topic, sum(CAST(e.x AS DOUBLE) * c.c) / any_value(xn.nx) AS cosine
          FROM ex e JOIN cn c ON c.i = e.i JOIN xn ON xn.doc_id = e.doc_id GROUP BY 1, 2)
"""

ORACLE["centroids"] = f"""
WITH {CENT}
SELECT CAST(label AS BIGINT) AS topic, CAST(i AS BIGINT) AS i, CAST(round(CAST(round(c, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS value FROM cn
"""

ORACLE["simplified_silhouette"] = f"""
WITH {CENT},
  dist AS (SELECT e.doc_id, e.label AS own, c.label AS other,
                  sqrt(sum((CAST(e.x AS DOUBLE) - c.m) * (CAST(e.x AS DOUBLE) - c.m))) AS d
           FROM ex e JOIN cm c ON c.i = e.i WHERE e.label <> -1 GROUP BY 1, 2, 3),
  ab AS (SELECT doc_id, max(CASE WHEN own = other THEN d END) AS a, min(CASE WHEN own <> other THEN d END) AS b
         FROM dist GROUP BY 1)
SELECT CAST(round(CAST(round(avg(CASE WHEN b IS NOT NULL AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE)
       AS silhouette FROM ab
"""

ORACLE["nearest_topic"] = f"""
WITH {CENT},
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, topic) AS rn FROM cos)
SELECT doc_id, CAST(topic AS BIGINT) AS topic, CAST(round(CAST(round(cosine, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS cosine FROM r WHERE rn = 1
"""

MEMB = f"""{CENT},
  memb AS (SELECT doc_id, topic, exp(cosine) / sum(exp(cosine)) OVER (PARTITION BY doc_id) AS prob FROM cos)
"""

ORACLE["membership"] = f"""
WITH {MEMB}
SELECT doc_id, CAST(topic AS BIGINT) AS topic, CAST(round(CAST(round(prob, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS prob FROM memb
"""

ORACLE["top_topics"] = f"""
WITH {MEMB},
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY prob DESC, topic) AS rank FROM memb WHERE topic <> -1)
SELECT doc_id, CAST(topic AS BIGINT) AS topic, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 2
"""

ORACLE["topic_info"] = f"""
WITH {TOPIC_TERMS},
  sizes AS (SELECT topic, count(*) AS count FROM assign GROUP BY 1),
  wl AS (SELECT topic, string_agg(term, '_' ORDER BY rank) FILTER (WHERE rank <= 3) AS lab,
                string_agg(term, ', ' ORDER BY rank) AS rep FROM ranked WHERE rank <= 10 GROUP BY 1)
SELECT CAST(s.topic AS BIGINT) AS topic, s.count, CAST(s.topic AS VARCHAR) || '_' || wl.lab AS name,
       wl.rep AS representation
FROM sizes s LEFT JOIN wl USING (topic)
"""

ORACLE["rank_topics"] = """
WITH assign AS (SELECT d.doc_id, CAST(coalesce(e.label, -1) AS INTEGER) AS topic
                FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
  sizes AS (SELECT topic, count(*) AS count FROM assign GROUP BY 1)
SELECT CAST(topic AS BIGINT) AS topic, count,
       CAST(CASE WHEN topic = -1 THEN -1 ELSE row_number() OVER (ORDER BY count DESC, topic) - 1 END AS BIGINT)
       AS new_topic
FROM sizes WHERE topic <> -1
UNION ALL
SELECT CAST(topic AS BIGINT), count, CAST(-1 AS BIGINT) FROM sizes WHERE topic = -1
"""

DOCVEC = f"""
  dtok AS (SELECT doc_id, unnest({tok('text')}) AS term FROM documents),
  dcnt AS (SELECT doc_id, term, count(*) AS n FROM dtok WHERE term NOT IN ({STOP}) GROUP BY 1, 2),
  dtot AS (SELECT doc_id, sum(n) AS tot FROM dcnt GROUP BY 1),
  idf AS (SELECT DISTINCT w.term, ln(aa.A / tf.f + 1) AS idf FROM cnt w JOIN tf USING (term) CROSS JOIN aa),
  dv AS (SELECT c.doc_id, c.term, c.n / t.tot * i.idf AS weight FROM dcnt c JOIN dtot t USING (doc_id) JOIN idf i USING (term)),
  dn AS (SELECT doc_id, sqrt(sum(weight * weight)) AS dn FROM dv GROUP BY 1),
  tn AS (SELECT topic, sqrt(sum(weight * weight)) AS tn FROM w GROUP BY 1)
"""

ORACLE["representative_docs"] = f"""
WITH {TOPIC_TERMS}, {DOCVEC},
  sims AS (SELECT a.doc_id, a.topic, sum(dv.weight * w.weight) / (any_value(dn.dn) * any_value(tn.tn)) AS cosine
           FROM assign a JOIN dv USING (doc_id) JOIN w ON w.topic = a.topic AND w.term = dv.term
           JOIN dn ON dn.doc_id = a.doc_id JOIN tn ON tn.topic = a.topic GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(cosine, 12) DESC, doc_id) AS rank FROM sims)
SELECT CAST(topic AS BIGINT) AS topic, CAST(rank AS BIGINT) AS rank, doc_id, CAST(round(CAST(round(cosine, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS cosine
FROM r WHERE rank <= 4
"""

ORACLE["reassign_outliers"] = f"""
WITH {TOPIC_TERMS}, {DOCVEC},
  sims AS (SELECT a.doc_id, w.topic, sum(dv.weight * w.weight) / (any_value(dn.dn) * any_value(tn.tn)) AS score
           FROM assign a JOIN dv USING (doc_id) JOIN w ON w.term = dv.term AND w.topic <> -1
           JOIN dn ON dn.doc_id = a.doc_id JOIN tn ON tn.topic = w.topic WHERE a.topic = -1 GROUP BY 1, 2),
  best AS (SELECT doc_id, topic FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, topic) AS rn
                                      FROM sims) WHERE rn = 1 AND score > 0)
SELECT a.doc_id, CAST(CASE WHEN a.topic = -1 AND b.topic IS NOT NULL THEN b.topic ELSE a.topic END AS BIGINT) AS topic
FROM assign a LEFT JOIN best b USING (doc_id)
"""

ORACLE["reassigned_words"] = f"""
WITH {TOPIC_TERMS}, {DOCVEC},
  sims AS (SELECT a.doc_id, w.topic, sum(dv.weight * w.weight) / (any_value(dn.dn) * any_value(tn.tn)) AS score
           FROM assign a JOIN dv USING (doc_id) JOIN w ON w.term = dv.term AND w.topic <> -1
           JOIN dn ON dn.doc_id = a.doc_id JOIN tn ON tn.topic = w.topic WHERE a.topic = -1 GROUP BY 1, 2),
  best AS (SELECT doc_id, topic FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, topic) AS rn
                                      FROM sims) WHERE rn = 1 AND score > 0),
  moved AS (SELECT a.doc_id, CASE WHEN a.topic = -1 THEN coalesce(b.topic, -1) ELSE a.topic END AS topic
            FROM assign a LEFT JOIN best b USING (doc_id)),
  cnt2 AS (SELECT m.topic, c.term, CAST(sum(c.n) AS BIGINT) AS n FROM moved m JOIN dcnt c USING (doc_id) GROUP BY 1, 2),
  tot2 AS (SELECT topic, sum(n) AS total FROM cnt2 GROUP BY 1),
  aa2 AS (SELECT floor(avg(total)) AS A FROM tot2),
  tf2 AS (SELECT term, sum(n) AS f FROM cnt2 GROUP BY 1),
  w2 AS (SELECT c.topic, c.term, (c.n / t.total) * ln(aa2.A / tf2.f + 1) AS weight
         FROM cnt2 c JOIN tot2 t USING (topic) JOIN tf2 USING (term) CROSS JOIN aa2),
  r2 AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS rank FROM w2)
SELECT CAST(topic AS BIGINT) AS topic, CAST(rank AS BIGINT) AS rank, term AS word,
       CAST(round(CAST(round(weight, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS weight
FROM r2 WHERE rank <= 10
"""

ORACLE["topic_similarity"] = f"""
WITH {TOPIC_TERMS},
  tn AS (SELECT topic, sqrt(sum(weight * weight)) AS tn FROM w GROUP BY 1),
  dots AS (SELECT a.topic AS t1, b.topic AS t2, sum(a.weight * b.weight) AS dot FROM w a JOIN w b
           ON a.term = b.term AND a.topic < b.topic GROUP BY 1, 2)
SELECT CAST(t1 AS BIGINT) AS t1, CAST(t2 AS BIGINT) AS t2, CAST(round(CAST(round(dot / (n1.tn * n2.tn), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS cosine
FROM dots JOIN tn n1 ON n1.topic = t1 JOIN tn n2 ON n2.topic = t2
"""

# -- prompts, payloads and tags ------------------------------------------------

from .fixtures import DIRTY_PAYLOADS  # noqa: E402

DIRTY_VALUES = ", ".join(f"({t}, '{r}')" for t, r in DIRTY_PAYLOADS)

REPDOCS = f"""
  sims_r AS (SELECT a.doc_id, a.topic, sum(dv.weight * w.weight) / (any_value(dn.dn) * any_value(tn.tn)) AS cosine
             FROM assign a JOIN dv USING (doc_id) JOIN w ON w.topic = a.topic AND w.term = dv.term
             JOIN dn ON dn.doc_id = a.doc_id JOIN tn ON tn.topic = a.topic GROUP BY 1, 2),
  rep_all AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(cosine, 12) DESC, doc_id) AS rank FROM sims_r)
"""

PAYLOAD = f"""
  rep AS (SELECT topic, doc_id // 100 AS part, doc_id FROM assign WHERE topic <> -1),
  tt AS (SELECT topic, term, rank AS trank FROM ranked WHERE rank <= 10 AND topic <> -1),
  sc AS (SELECT r.topic, r.part, r.doc_id, t.term, t.trank, least(1.0, coalesce(c.n, 0) / 10.0) AS score
         FROM rep r JOIN tt t ON t.topic = r.topic LEFT JOIN dcnt c ON c.doc_id = r.doc_id AND c.term = t.term),
  dj AS (SELECT topic, part, doc_id, '"' || CAST(doc_id AS VARCHAR) || '": {{' ||
                string_agg('"' || term || '": ' || printf('%.1f', score), ', ' ORDER BY trank) || '}}' AS dj
         FROM sc GROUP BY topic, part, doc_id),
  tx AS (SELECT topic, part, string_agg(dj, ', ' ORDER BY doc_id) AS tx FROM dj GROUP BY 1, 2),
  lists AS (SELECT topic,
                   coalesce(string_agg('"' || term || '"', ', ' ORDER BY trank) FILTER (WHERE trank <= 7), '') AS th,
                   coalesce(string_agg('"' || term || '"', ', ' ORDER BY trank) FILTER (WHERE trank > 7), '') AS ov
            FROM tt GROUP BY 1),
  praw AS (SELECT CAST(l.topic AS INTEGER) AS topic_id,
                 '{{"topic": {{"themes": [' || l.th || '], "overarching_themes": [' || l.ov || ']}}, "texts": {{' ||
                 x.tx || '}}}}' AS raw
          FROM lists l JOIN tx x USING (topic)
          UNION ALL SELECT * FROM (VALUES {DIRTY_VALUES}) v(topic_id, raw)),
  parsed AS (SELECT topic_id, CASE WHEN json_valid(raw) THEN json_transform(raw,
               '{{"topic": {{"themes": ["VARCHAR"], "overarching_themes": ["VARCHAR"]}},
                 "texts": "MAP(VARCHAR, MAP(VARCHAR, JSON))"}}') END AS p FROM praw),
  okp AS (SELECT * FROM parsed WHERE p IS NOT NULL AND p.texts IS NOT NULL),
  ent0 AS (SELECT topic_id AS topic, unnest(map_keys(p.texts)) AS doc_key, unnest(map_values(p.texts)) AS tags FROM okp),
  ent1 AS (SELECT topic, TRY_CAST(doc_key AS BIGINT) AS dataset_id, unnest(map_keys(tags)) AS tag,
                  unnest(map_values(tags)) AS value FROM ent0 WHERE TRY_CAST(doc_key AS BIGINT) IS NOT NULL),
  entries AS (
    SELECT topic, dataset_id, tag, TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE) AS score, CAST(NULL AS VARCHAR) AS nested_kind
    FROM ent1 WHERE tag NOT IN ('themes', 'overarching_themes')
    UNION ALL
    SELECT topic, dataset_id, unnest(map_keys(m)) AS tag, unnest(map_values(m)) AS score, nested_kind FROM (
      SELECT topic, dataset_id, tag AS nested_kind,
             json_transform(value, '"MAP(VARCHAR, DOUBLE)"') AS m
      FROM ent1 WHERE tag IN ('themes', 'overarching_themes'))),
  tl0 AS (SELECT topic_id AS topic, unnest(p.topic.themes) AS tag, 2 AS k FROM okp
          UNION ALL SELECT topic_id, unnest(p.topic.overarching_themes), 1 FROM okp),
  tlists AS (SELECT topic, tag, CASE WHEN max(k) = 2 THEN 'themes' ELSE 'overarching_themes' END AS listed_kind
             FROM tl0 GROUP BY 1, 2),
  classified AS (
    SELECT e.dataset_id, coalesce(e.nested_kind, l.listed_kind, 'themes') AS kind, e.tag, max(e.score) AS score
    FROM entries e LEFT JOIN tlists l ON l.topic = e.topic AND l.tag = e.tag GROUP BY 1, 2, 3)
"""

TAGBASE = f"WITH {TOPIC_TERMS}, {DOCVEC}, {REPDOCS}, {PAYLOAD}"

ORACLE["payload_parse"] = TAGBASE + """
SELECT CAST(topic_id AS BIGINT) AS topic_id, CAST(CASE WHEN p IS NOT NULL AND p.texts IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS ok
FROM parsed
"""

ORACLE["classify_tags"] = TAGBASE + """
SELECT dataset_id, kind, tag, CAST(round(CAST(round(score, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS score FROM classified
"""

ORACLE["missing_ids"] = TAGBASE + """
SELECT doc_id AS dataset_id FROM documents
WHERE doc_id NOT IN (SELECT DISTINCT TRY_CAST(k AS BIGINT) FROM (SELECT unnest(map_keys(p.texts)) AS k FROM okp)
                     WHERE TRY_CAST(k AS BIGINT) IS NOT NULL)
"""

ORACLE["threshold_tags"] = TAGBASE + """
SELECT dataset_id, kind, tag, CAST(round(CAST(round(score, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS score FROM classified
WHERE (kind = 'themes' AND score > 0.7) OR (kind = 'overarching_themes' AND score > 0.5)
   OR kind NOT IN ('themes', 'overarching_themes')
"""

ORACLE["select_labels"] = TAGBASE + """,
  s AS (SELECT dataset_id AS doc_id, tag AS label, score FROM classified WHERE score IS NOT NULL),
  best AS (SELECT doc_id, label, score FROM (
             SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS rn FROM s) WHERE rn = 1)
SELECT doc_id, label, CAST(round(CAST(round(score, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS score FROM s WHERE score > 0.5
UNION ALL
SELECT doc_id, label, CAST(round(CAST(round(score, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) FROM best WHERE doc_id NOT IN (SELECT doc_id FROM s WHERE score > 0.5)
"""

ORACLE["select_label_single"] = TAGBASE + """,
  s AS (SELECT dataset_id AS doc_id, tag AS label, score FROM classified WHERE score IS NOT NULL)
SELECT doc_id, label, CAST(round(CAST(round(score, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS rn FROM s) WHERE rn = 1
"""

ORACLE["propagate_tags"] = GREEDY.replace("WITH RECURSIVE", f"WITH RECURSIVE {DOCVEC.strip()},", 1) \
    .replace("WITH RECURSIVE", f"WITH RECURSIVE {TOPIC_TERMS.strip()},", 1) + "," + REPDOCS + "," + PAYLOAD + """,
  spread AS (
    SELECT topic, dataset_id, tag, score, nested_kind FROM entries
    UNION ALL
    SELECT e.topic, s.similar_id, e.tag, e.score, e.nested_kind FROM sim s JOIN entries e ON e.dataset_id = s.kept_id)
SELECT e.dataset_id, coalesce(e.nested_kind, l.listed_kind, 'themes') AS kind, e.tag, CAST(round(CAST(round(max(e.score), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS score
FROM spread e LEFT JOIN tlists l ON l.topic = e.topic AND l.tag = e.tag GROUP BY 1, 2, 3
"""

TOPTAGS = f"""{MEMB},
  dtop AS (SELECT doc_id, topic, rank AS topic_rank FROM (
             SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY prob DESC, topic) AS rank
             FROM memb WHERE topic <> -1) WHERE rank <= 2),
  ttag AS (SELECT topic, term AS tag, rank AS tag_rank FROM ranked WHERE rank <= 10 AND topic <> -1)
"""

ORACLE["candidate_tags"] = f"""
WITH {TOPIC_TERMS}, {TOPTAGS}
SELECT DISTINCT d.doc_id, t.tag FROM dtop d JOIN ttag t USING (topic)
"""

ORACLE["ordered_distinct_tags"] = f"""
WITH {TOPIC_TERMS}, {TOPTAGS},
  seq AS (SELECT d.doc_id, t.tag, min(d.topic_rank * 100 + t.tag_rank) AS pos FROM dtop d JOIN ttag t USING (topic)
          GROUP BY 1, 2)
SELECT doc_id, string_agg(tag, ',' ORDER BY pos) AS tags FROM seq GROUP BY 1
"""

ORACLE["common_tags"] = f"""
WITH {TOPIC_TERMS}, {DOCVEC}, {REPDOCS}, {PAYLOAD}, {TOPTAGS.replace(CENT.strip() + ",", "", 0)}
SELECT DISTINCT d.doc_id, t.tag FROM dtop d JOIN ttag t USING (topic)
WHERE (d.doc_id, t.tag) IN (SELECT dataset_id, tag FROM classified)
"""

ORACLE["tag_shares"] = TAGBASE + """,
  f AS (SELECT kind, tag, count(*) AS n FROM classified GROUP BY 1, 2),
  t AS (SELECT kind, count(*) AS tot FROM classified GROUP BY 1)
SELECT f.kind, f.tag, f.n, CAST(round(CAST(round(f.n * 100.0 / t.tot, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS share FROM f JOIN t USING (kind)
"""

ORACLE["score_histogram"] = TAGBASE + """
SELECT kind, CAST(least(floor(score * 10), 9) AS BIGINT) AS bin, count(*) AS n FROM classified
WHERE score IS NOT NULL GROUP BY 1, 2
"""

WC = r"CASE WHEN regexp_replace({x}, '^\s+|\s+$', '', 'g') = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace({x}, '^\s+|\s+$', '', 'g'), '\s+')) END"


def wc_sql(x):
    return WC.format(x=x)


def trunc_sql(x, n):
    return (f"CASE WHEN {wc_sql(x)} <= {n} THEN {x} ELSE array_to_string(regexp_split_to_array("
            rf"regexp_replace({x}, '^\s+|\s+$', '', 'g'), '\s+')[1:{n}], ' ') END")


ORACLE["truncate_docs"] = f"""
SELECT doc_id, {trunc_sql('text', 50)} AS truncated, CAST({wc_sql('text')} AS BIGINT) AS words FROM documents
"""

BUDGET = f"""
  bd0 AS (SELECT r.topic, r.rank, r.doc_id,
                 'ID: ' || CAST(r.doc_id AS VARCHAR) || chr(10) || chr(10) || {trunc_sql('d.text', 50)} AS doc
          FROM rep_all r JOIN documents d USING (doc_id) WHERE r.rank <= 10),
  bd1 AS (SELECT *, {wc_sql('doc')} AS tokens FROM bd0),
  bd AS (SELECT * FROM (SELECT *, sum(tokens) OVER (PARTITION BY topic ORDER BY rank
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM bd1)
         WHERE run <= 300)
"""

ORACLE["fit_budget"] = f"""
WITH {TOPIC_TERMS}, {DOCVEC}, {REPDOCS}, {BUDGET}
SELECT CAST(topic AS BIGINT) AS topic, CAST(rank AS BIGINT) AS rank, doc_id, CAST(tokens AS BIGINT) AS tokens FROM bd
"""

ORACLE["build_prompts"] = f"""
WITH {TOPIC_TERMS}, {DOCVEC}, {REPDOCS}, {BUDGET},
  kw AS (SELECT topic, string_agg(term, ', ' ORDER BY rank) AS kw FROM ranked WHERE rank <= 10 GROUP BY 1),
  dd AS (SELECT topic, string_agg('- ' || doc || chr(10) || '---' || chr(10), '' ORDER BY rank) AS docs,
                string_agg(string_split(string_split(doc, chr(10))[1], ': ')[2], ', ' ORDER BY rank) AS ids
         FROM bd GROUP BY 1),
  j AS (SELECT coalesce(kw.topic, dd.topic) AS topic, kw.kw, dd.docs, dd.ids FROM kw FULL JOIN dd USING (topic))
SELECT CAST(topic AS BIGINT) AS topic,
       replace(replace(replace('Texts of one group:' || chr(10) || '[DOCUMENTS]' || chr(10)
         || 'Its leading words: [KEYWORDS]' || chr(10) || 'Text numbers: [IDS]' || chr(10),
         '[KEYWORDS]', coalesce(kw, '')), '[DOCUMENTS]', coalesce(docs, '')), '[IDS]', coalesce(ids, '')) AS prompt
FROM j
"""

# -- experiment runs and statistics -------------------------------------------

RUNS = """runs AS (
    SELECT o_orderkey AS run_id, o_orderpriority AS Model, CAST(month(o_orderdate) AS INTEGER) AS nr_topics,
           o_orderstatus AS Dataset, o_totalprice / 1000000.0::DOUBLE AS npmi,
           CAST(o_orderkey % 100 AS DOUBLE) / 100.0::DOUBLE AS diversity, o_orderdate AS ts
    FROM orders)"""

ORACLE["mean_by_model"] = f"""
WITH {RUNS}
SELECT Model, CAST(round(CAST(round(avg(npmi), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS npmi, CAST(round(CAST(round(avg(diversity), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS diversity FROM runs GROUP BY 1
"""

BOARD = """board AS (
    SELECT Model,
      avg(npmi) FILTER (WHERE Dataset = 'F') AS F_npmi, avg(diversity) FILTER (WHERE Dataset = 'F') AS F_diversity,
      avg(npmi) FILTER (WHERE Dataset = 'O') AS O_npmi, avg(diversity) FILTER (WHERE Dataset = 'O') AS O_diversity,
      avg(npmi) FILTER (WHERE Dataset = 'P') AS P_npmi, avg(diversity) FILTER (WHERE Dataset = 'P') AS P_diversity
    FROM runs GROUP BY 1)"""

ORACLE["leaderboard"] = f"""
WITH {RUNS}, {BOARD}
SELECT Model, CAST(row_number() OVER (ORDER BY F_npmi ASC NULLS LAST, Model) AS BIGINT) AS position,
       CAST(round(CAST(round(F_npmi, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS F_npmi, CAST(round(CAST(round(F_diversity, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS F_diversity, CAST(round(CAST(round(O_npmi, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS O_npmi,
       CAST(round(CAST(round(O_diversity, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS O_diversity, CAST(round(CAST(round(P_npmi, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS P_npmi, CAST(round(CAST(round(P_diversity, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS P_diversity
FROM board
"""

ORACLE["topic_quality"] = f"""
WITH {RUNS}
SELECT Model, Dataset, CAST(round(CAST(round(avg(npmi) * avg(diversity), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS quality FROM runs GROUP BY 1, 2
"""

ORACLE["flatten_runs"] = f"""
WITH {RUNS}, ds AS (SELECT Dataset, row_number() OVER (ORDER BY Dataset) - 1 AS fi FROM (SELECT DISTINCT Dataset FROM runs))
SELECT run_id, Model || '_' || CAST(fi AS VARCHAR) AS Model, CAST(nr_topics AS BIGINT) AS nr_topics
FROM runs JOIN ds USING (Dataset)
"""

ORACLE["flatten_slices"] = f"""
WITH {RUNS}
SELECT Model, Dataset, CAST(year(ts) AS VARCHAR) AS slice, CAST(round(CAST(round(avg(npmi), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS npmi,
       CAST(round(CAST(round(avg(diversity), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS diversity FROM runs GROUP BY 1, 2, 3
"""

ORACLE["band"] = f"""
WITH {RUNS}, g AS (SELECT Model, nr_topics, avg(npmi) AS m, stddev_samp(npmi) AS s FROM runs GROUP BY 1, 2)
SELECT Model, CAST(nr_topics AS BIGINT) AS nr_topics, CAST(round(CAST(round(m, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS mean, CAST(round(CAST(round(s, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS std,
       CAST(round(CAST(round(m - 0.5 * s, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS lower, CAST(round(CAST(round(m + 0.5 * s, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS upper FROM g
"""

ORACLE["run_summary"] = f"""
WITH {RUNS}
SELECT Model, CAST(nr_topics AS BIGINT) AS nr_topics, count(*) AS runs, CAST(round(CAST(round(avg(npmi), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS mean,
       CAST(round(CAST(round(stddev_samp(npmi), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS std, CAST(round(CAST(round(median(npmi), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS median FROM runs GROUP BY 1, 2
"""

ORACLE["grid"] = f"""
WITH {RUNS}
SELECT m.Model, CAST(t.nr_topics AS BIGINT) AS nr_topics
FROM (SELECT DISTINCT Model FROM runs) m CROSS JOIN (SELECT DISTINCT nr_topics FROM runs) t
"""

ORACLE["best_run"] = f"""
WITH {RUNS}, g AS (SELECT Model, nr_topics, avg(npmi) AS mean FROM runs GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (ORDER BY mean DESC, Model, nr_topics) AS place FROM g)
SELECT Model, CAST(nr_topics AS BIGINT) AS nr_topics, CAST(round(CAST(round(mean, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS mean, CAST(place AS BIGINT) AS place
FROM r WHERE place <= 3
"""

ORACLE["top3_marks"] = f"""
WITH {RUNS}, {BOARD},
  l AS (SELECT 'F_npmi' AS "column", Model, CAST(round(CAST(round(F_npmi, 9) AS DECIMAL(38, 9)), 3) AS DOUBLE) AS value FROM board
        UNION ALL SELECT 'F_diversity', Model, CAST(round(CAST(round(F_diversity, 9) AS DECIMAL(38, 9)), 3) AS DOUBLE) FROM board
        UNION ALL SELECT 'O_npmi', Model, CAST(round(CAST(round(O_npmi, 9) AS DECIMAL(38, 9)), 3) AS DOUBLE) FROM board
        UNION ALL SELECT 'O_diversity', Model, CAST(round(CAST(round(O_diversity, 9) AS DECIMAL(38, 9)), 3) AS DOUBLE) FROM board
        UNION ALL SELECT 'P_npmi', Model, CAST(round(CAST(round(P_npmi, 9) AS DECIMAL(38, 9)), 3) AS DOUBLE) FROM board
        UNION ALL SELECT 'P_diversity', Model, CAST(round(CAST(round(P_diversity, 9) AS DECIMAL(38, 9)), 3) AS DOUBLE) FROM board),
  r AS (SELECT *, dense_rank() OVER (PARTITION BY "column" ORDER BY value DESC) AS mark FROM l WHERE value IS NOT NULL)
SELECT "column", Model, CAST(round(CAST(round(value, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS value, CAST(mark AS BIGINT) AS mark FROM r WHERE mark <= 3
"""


def one_way_sql(src: str, value: str, by: str) -> str:
    """ANOVA parts per stratum ``by`` (may be empty) over groups Model."""
    bsel = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return f"""
  gm AS (SELECT {bsel}Model, avg({value}) AS m FROM {src} GROUP BY {bsel}Model),
  gs AS (SELECT {('s.' + by + ', ') if by else ''}s.Model, count(*) AS n, any_value(g.m) AS m, sum(({value} - g.m) * ({value} - g.m)) AS ssw_g
         FROM {src} s JOIN gm g ON g.Model = s.Model {'AND g.' + by + ' = s.' + by if by else ''}
         GROUP BY {('s.' + by + ', ') if by else ''}s.Model),
  gs2 AS (SELECT *, sum(n) OVER ({part}) AS NN, sum(n * m) OVER ({part}) / sum(n) OVER ({part}) AS MM FROM gs),
  aov AS (SELECT {bsel}sum(n * (m - MM) * (m - MM)) AS ssb, sum(ssw_g) AS ssw, count(*) AS k, any_value(NN) AS NN
          FROM gs2 {grp})"""


ORACLE["levene"] = f"""
WITH {RUNS}, med AS (SELECT nr_topics, Model, median(npmi) AS md FROM runs GROUP BY 1, 2),
  zt AS (SELECT r.nr_topics, r.Model, abs(r.npmi - m.md) AS z FROM runs r JOIN med m USING (nr_topics, Model)),
  {one_way_sql('zt', 'z', 'nr_topics').lstrip().rstrip()}
SELECT CAST(nr_topics AS BIGINT) AS nr_topics, CAST(round(CAST(round((ssb / (k - 1)) / (ssw / (NN - k)), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS W FROM aov
"""

ORACLE["anova"] = f"""
WITH {RUNS}, {one_way_sql('runs', 'npmi', 'nr_topics').lstrip()}
SELECT CAST(nr_topics AS BIGINT) AS nr_topics, CAST(round(CAST(round((ssb / (k - 1)) / (ssw / (NN - k)), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS F_stat,
       CAST(round(CAST(round(ssb / (ssb + ssw), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS np2 FROM aov
"""

ORACLE["bartlett"] = f"""
WITH {RUNS}, gs AS (SELECT nr_topics, Model, count(*) AS n, var_samp(npmi) AS v FROM runs GROUP BY 1, 2),
  a AS (SELECT nr_topics, count(*) AS k, sum(n) AS NN, sum((n - 1) * v) AS sv, sum((n - 1) * ln(v)) AS slv,
               sum(1.0 / (n - 1)) AS sinv FROM gs GROUP BY 1)
SELECT CAST(nr_topics AS BIGINT) AS nr_topics,
       CAST(round(CAST(round(((NN - k) * ln(sv / (NN - k)) - slv) / (1.0 + (1.0 / (3 * (k - 1))) * (sinv - 1.0 / (NN - k))), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS T
FROM a
"""

ORACLE["cell_residuals"] = f"""
WITH {RUNS}
SELECT run_id, CAST(round(CAST(round(npmi - avg(npmi) OVER (PARTITION BY Model, nr_topics), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS residual FROM runs
"""

GSTATS = """gst AS (SELECT Model, count(*) AS n, avg(npmi) AS mean, var_samp(npmi) AS v FROM runs GROUP BY 1)"""

ORACLE["welch_anova"] = f"""
WITH {RUNS}, {GSTATS},
  w1 AS (SELECT *, n / v AS w FROM gst),
  w2 AS (SELECT *, sum(w) OVER () AS WW, count(*) OVER () AS k, sum(w * mean) OVER () / sum(w) OVER () AS mp FROM w1),
  t AS (SELECT any_value(k) AS k, sum(w * (mean - mp) * (mean - mp)) AS A0,
               sum((1 - w / WW) * (1 - w / WW) / (n - 1)) AS lam FROM w2),
  {one_way_sql('runs', 'npmi', '').lstrip()}
SELECT CAST(round(CAST(round((A0 / (k - 1)) / (1.0 + 2 * (k - 2) / (k * k - 1) * lam), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS F_stat, CAST(round(CAST(round(CAST(k - 1 AS DOUBLE), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS df1,
       CAST(round(CAST(round((k * k - 1) / (3 * lam), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS df2, CAST(round(CAST(round((SELECT ssb / (ssb + ssw) FROM aov), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS np2 FROM t
"""

PAIRS_G = """pg AS (SELECT a.Model AS A, b.Model AS B, a.n AS na, b.n AS nb, a.mean AS ma, b.mean AS mb, a.v AS va,
                          b.v AS vb FROM gst a JOIN gst b ON a.Model < b.Model)"""

ORACLE["games_howell"] = f"""
WITH {RUNS}, {GSTATS}, {PAIRS_G},
  x AS (SELECT *, va / na AS qa, vb / nb AS qb,
               (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS d FROM pg)
SELECT A, B, CAST(round(CAST(round(ma - mb, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS diff, CAST(round(CAST(round(sqrt(qa + qb), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS se, CAST(round(CAST(round((ma - mb) / sqrt(qa + qb), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS T,
       CAST(round(CAST(round(abs((ma - mb) / sqrt(qa + qb)) * sqrt(2.0), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS q,
       CAST(round(CAST(round((qa + qb) * (qa + qb) / (qa * qa / (na - 1) + qb * qb / (nb - 1)), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS df,
       CAST(round(CAST(round(d * (1.0 - 3.0 / (4 * (na + nb) - 9)), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS hedges
FROM x
"""

ORACLE["cohens_d"] = f"""
WITH {RUNS}, {GSTATS}, {PAIRS_G}
SELECT A, B, CAST(round(CAST(round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS d FROM pg
"""

ORACLE["correlation"] = f"""
WITH {RUNS},
  r AS (SELECT Model, npmi, diversity,
               rank() OVER (PARTITION BY Model ORDER BY npmi) + (count(*) OVER (PARTITION BY Model, npmi) - 1) / 2.0 AS rx,
               rank() OVER (PARTITION BY Model ORDER BY diversity)
                 + (count(*) OVER (PARTITION BY Model, diversity) - 1) / 2.0 AS ry FROM runs)
SELECT Model, count(*) AS n, CAST(round(CAST(round(corr(npmi, diversity), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS pearson, CAST(round(CAST(round(corr(rx, ry), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS spearman
FROM r GROUP BY 1
"""

MIDRANK = """mr AS (SELECT Model, npmi,
                rank() OVER (ORDER BY npmi) + (count(*) OVER (PARTITION BY npmi) - 1) / 2.0 AS rk FROM runs),
  ties AS (SELECT sum(c * c * c - c) AS tt, sum(c) AS NN FROM (SELECT count(*) AS c FROM runs GROUP BY npmi))"""

ORACLE["kruskal"] = f"""
WITH {RUNS}, {MIDRANK},
  g AS (SELECT Model, count(*) AS n, sum(rk) AS R FROM mr GROUP BY 1),
  s AS (SELECT sum(R * R / n) AS sr, count(*) AS k FROM g),
  h AS (SELECT (12.0 / (NN * (NN + 1)) * sr - 3 * (NN + 1)) / (1.0 - tt / (NN * NN * NN - NN)) AS H, k, NN FROM s, ties)
SELECT CAST(round(CAST(round(H, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS H, CAST(round(CAST(round(CAST(k - 1 AS DOUBLE), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS df, CAST(round(CAST(round((H - k + 1) / (NN - k), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS eta2 FROM h
"""

ORACLE["dunn"] = f"""
WITH {RUNS}, {MIDRANK},
  g AS (SELECT Model, count(*) AS n, avg(rk) AS rb FROM mr GROUP BY 1)
SELECT a.Model AS A, b.Model AS B,
       CAST(round(CAST(round((a.rb - b.rb) / sqrt((NN * (NN + 1) / 12.0 - tt / (12.0 * (NN - 1))) * (1.0 / a.n + 1.0 / b.n)), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS z
FROM g a JOIN g b ON a.Model < b.Model CROSS JOIN ties
"""

ORACLE["cliffs_delta"] = f"""
WITH {RUNS}, vc AS (SELECT Model, diversity AS v, count(*) AS c FROM runs GROUP BY 1, 2),
  n AS (SELECT Model, sum(c) AS n FROM vc GROUP BY 1)
SELECT a.Model AS A, b.Model AS B,
       CAST(round(CAST(round(sum(a.c * b.c * sign(a.v - b.v)) / (any_value(na.n) * any_value(nb.n)), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS delta
FROM vc a JOIN vc b ON a.Model < b.Model JOIN n na ON na.Model = a.Model JOIN n nb ON nb.Model = b.Model
GROUP BY 1, 2
"""

ORACLE["describe_scores"] = f"""
WITH {RUNS}, m AS (SELECT Model, count(*) AS n, avg(npmi) AS mean, stddev_samp(npmi) AS sd,
                         median(npmi) AS median FROM runs GROUP BY 1),
  mo AS (SELECT Model, avg((npmi - mean) ^ 2) AS m2, avg((npmi - mean) ^ 3) AS m3,
                avg((npmi - mean) ^ 4) AS m4 FROM runs JOIN m USING (Model) GROUP BY 1),
  vc AS (SELECT Model, npmi, count(*) AS c FROM runs GROUP BY 1, 2),
  md AS (SELECT Model, npmi AS mode FROM (
           SELECT *, row_number() OVER (PARTITION BY Model ORDER BY c DESC, npmi) AS r FROM vc) WHERE r = 1)
SELECT m.Model, m.n, CAST(round(CAST(round(mean, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS mean, CAST(round(CAST(round(sd, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS sd, CAST(round(CAST(round(m3 / (m2 ^ 1.5), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS skewness,
       CAST(round(CAST(round(m4 / (m2 * m2) - 3, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS kurtosis, CAST(round(CAST(round(mode, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS mode, CAST(round(CAST(round(median, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS median
FROM m JOIN mo USING (Model) JOIN md USING (Model)
"""

# -- agreement, time, profiles -------------------------------------------------

RATINGS = """ratings AS (
    SELECT user_id % 7 AS rater, event_id % 50 AS item, event_type AS model,
           CAST(1 + floor(value) % 5 AS INTEGER) AS rating, event_id FROM events),
  one AS (SELECT rater, item, arg_max(rating, event_id) AS rating FROM ratings GROUP BY 1, 2)"""

ORACLE["fleiss_kappa"] = f"""
WITH {RATINGS},
  nij AS (SELECT item, rating, count(*) AS nij FROM one WHERE rating IS NOT NULL GROUP BY 1, 2),
  pi AS (SELECT item, sum(nij) AS ni, sum(nij * nij) AS sq FROM nij GROUP BY 1 HAVING sum(nij) >= 2),
  pb AS (SELECT avg((sq - ni) / (ni * (ni - 1))) AS pbar, sum(ni) AS total FROM pi),
  pj AS (SELECT rating, sum(nij) AS nj FROM nij WHERE item IN (SELECT item FROM pi) GROUP BY 1),
  pe AS (SELECT sum((nj / (SELECT total FROM pb)) ^ 2) AS pe FROM pj)
SELECT CAST(round(CAST(round(pbar, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS p_bar, CAST(round(CAST(round(pe, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS pe, CAST(round(CAST(round((pbar - pe) / (1 - pe), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS kappa FROM pb, pe
"""

KRIPP = f"""
WITH {RATINGS},
  nuc AS (SELECT item, rating, count(*) AS nuc FROM one WHERE rating IS NOT NULL GROUP BY 1, 2),
  mu AS (SELECT item, sum(nuc) AS mu FROM nuc GROUP BY 1 HAVING sum(nuc) >= 2),
  u AS (SELECT n.*, m.mu FROM nuc n JOIN mu m USING (item)),
  o AS (SELECT a.rating AS c, b.rating AS k, sum(a.nuc * (b.nuc - CASE WHEN a.rating = b.rating THEN 1 ELSE 0 END)
                                              / (a.mu - 1)) AS o
        FROM u a JOIN u b USING (item) GROUP BY 1, 2),
  marg AS (SELECT c, sum(o) AS nc FROM o GROUP BY 1),
  cum AS (SELECT c, nc, sum(nc) OVER (ORDER BY c) AS cum FROM marg),
  pairs AS (SELECT a.c, b.c AS k, a.nc, b.nc AS nk, a.cum AS cum_c, b.cum AS cum_k FROM cum a CROSS JOIN cum b),
  d AS (SELECT c, k, nc, nk,
          CASE WHEN c = k THEN 0.0 ELSE 1.0 END AS d_nom,
          CAST((c - k) * (c - k) AS DOUBLE) AS d_int,
          CASE WHEN c = k THEN 0.0 ELSE
            (greatest(cum_c, cum_k) - CASE WHEN c <= k THEN cum_c - nc ELSE cum_k - nk END - (nc + nk) / 2.0) ^ 2 END AS d_ord
        FROM pairs),
  agg AS (SELECT (SELECT sum(nc) FROM marg) AS n,
                 sum(coalesce(o.o, 0) * d_nom) AS do_nom, sum(nc * nk * d_nom) AS de_nom,
                 sum(coalesce(o.o, 0) * d_ord) AS do_ord, sum(nc * nk * d_ord) AS de_ord,
                 sum(coalesce(o.o, 0) * d_int) AS do_int, sum(nc * nk * d_int) AS de_int
          FROM d LEFT JOIN o USING (c, k))
SELECT 'nominal' AS level, CAST(round(CAST(round(1 - (n - 1) * do_nom / de_nom, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS alpha FROM agg
UNION ALL SELECT 'ordinal', CAST(round(CAST(round(1 - (n - 1) * do_ord / de_ord, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) FROM agg
UNION ALL SELECT 'interval', CAST(round(CAST(round(1 - (n - 1) * do_int / de_int, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) FROM agg
"""

ORACLE["krippendorff_alpha"] = KRIPP

ORACLE["icc"] = f"""
WITH {RATINGS},
  r AS (SELECT rater, item, CAST(rating AS DOUBLE) AS x FROM one WHERE rating IS NOT NULL),
  kk AS (SELECT count(DISTINCT rater) AS k FROM r),
  full_items AS (SELECT item FROM r GROUP BY 1 HAVING count(*) = (SELECT k FROM kk)),
  f AS (SELECT * FROM r WHERE item IN (SELECT item FROM full_items)),
  g AS (SELECT avg(x) AS gm, count(DISTINCT item) AS n, (SELECT k FROM kk) AS k FROM f),
  ss AS (SELECT (SELECT sum((x - gm) ^ 2) FROM f, g) AS sst,
                (SELECT sum((m - gm) ^ 2) FROM (SELECT avg(x) AS m FROM f GROUP BY item), g) * (SELECT k FROM g) AS ssr,
                (SELECT sum((m - gm) ^ 2) FROM (SELECT avg(x) AS m FROM f GROUP BY rater), g) * (SELECT n FROM g) AS ssc),
  ms AS (SELECT ssr / (n - 1) AS msr, ssc / (k - 1) AS msc, (sst - ssr - ssc) / ((n - 1) * (k - 1)) AS mse,
                (sst - ssr) / (n * (k - 1)) AS msw, n, k FROM ss, g)
SELECT 'ICC1' AS type, CAST(round(CAST(round((msr - msw) / (msr + (k - 1) * msw), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS icc FROM ms
UNION ALL SELECT 'ICC2', CAST(round(CAST(round((msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) FROM ms
UNION ALL SELECT 'ICC3', CAST(round(CAST(round((msr - mse) / (msr + (k - 1) * mse), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) FROM ms
UNION ALL SELECT 'ICC1k', CAST(round(CAST(round((msr - msw) / msr, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) FROM ms
UNION ALL SELECT 'ICC2k', CAST(round(CAST(round((msr - mse) / (msr + (msc - mse) / n), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) FROM ms
UNION ALL SELECT 'ICC3k', CAST(round(CAST(round((msr - mse) / msr, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) FROM ms
"""

ORACLE["confusion"] = """
WITH j AS (SELECT CAST(d.n_chars >= 2000 AS INTEGER) AS pred, l.quality AS truth
           FROM documents d JOIN labels l USING (doc_id)),
  c AS (SELECT sum(CASE WHEN pred = 1 AND truth = 1 THEN 1 ELSE 0 END) AS tp,
               sum(CASE WHEN pred = 1 AND truth <> 1 THEN 1 ELSE 0 END) AS fp,
               sum(CASE WHEN pred <> 1 AND truth = 1 THEN 1 ELSE 0 END) AS fn,
               sum(CASE WHEN pred <> 1 AND truth <> 1 THEN 1 ELSE 0 END) AS tn FROM j)
SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn,
       CAST(round(CAST(round((tp + tn) / (tp + fp + fn + tn), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS accuracy,
       CAST(round(CAST(round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS precision,
       CAST(round(CAST(round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS recall,
       CAST(round(CAST(round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) END, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS specificity,
       CAST(round(CAST(round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS f1 FROM c
"""

INTRUDER = f"""{TOPTAGS},
  tags5 AS (SELECT * FROM ttag WHERE tag_rank <= 5),
  shown AS (SELECT d.doc_id, t.tag FROM dtop d JOIN tags5 t USING (topic) WHERE d.topic_rank = 1),
  alien AS (SELECT d.doc_id, t.tag FROM dtop d JOIN tags5 t USING (topic) WHERE d.topic_rank = 2),
  cand AS (SELECT * FROM alien f WHERE NOT EXISTS (SELECT 1 FROM shown s WHERE s.doc_id = f.doc_id AND s.tag = f.tag)),
  tasks AS (SELECT doc_id, arg_min(tag, md5(CAST(doc_id AS VARCHAR) || '|' || tag)) AS intruder FROM cand GROUP BY 1)
"""

ORACLE["intruder_tasks"] = f"""
WITH {TOPIC_TERMS}, {INTRUDER}
SELECT doc_id, intruder FROM tasks
"""

ORACLE["intruder_rate"] = f"""
WITH {TOPIC_TERMS}, {INTRUDER},
  opts AS (SELECT doc_id, tag FROM shown UNION ALL SELECT doc_id, intruder FROM tasks),
  first AS (SELECT doc_id, topic FROM dtop WHERE topic_rank = 1),
  sc AS (SELECT o.doc_id, o.tag, coalesce(w.weight, 0.0) AS weight FROM opts o JOIN first f USING (doc_id)
         LEFT JOIN w ON w.topic = f.topic AND w.term = o.tag),
  ans AS (SELECT doc_id, arg_min(tag, (weight, tag)) AS answer FROM sc GROUP BY 1)
SELECT CAST(5 AS BIGINT) AS n_tags, CAST(round(CAST(round(avg(CASE WHEN a.answer = t.intruder THEN 1.0 ELSE 0.0 END), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS rate,
       count(*) AS tasks FROM tasks t JOIN ans a USING (doc_id)
"""

ORACLE["rating_means"] = f"""
WITH {RATINGS}
SELECT model, CAST(round(CAST(round(avg(rating), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS mean, count(rating) AS rated, count(*) - count(rating) AS na FROM ratings GROUP BY 1
"""

ORACLE["label_agreement"] = f"""
WITH {CENT},
  nr AS (SELECT doc_id, topic FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, topic) AS rn
                                    FROM cos) WHERE rn = 1),
  j AS (SELECT n.doc_id, n.topic, e.label FROM nr n JOIN embeddings e ON e.vec_id = n.doc_id),
  cnt AS (SELECT topic, label, count(*) AS c FROM j GROUP BY 1, 2),
  maj AS (SELECT topic, arg_max(label, (c, -label)) AS maj, max(c) AS cmax FROM cnt WHERE topic <> -1 GROUP BY 1),
  tot AS (SELECT count(*) AS n FROM j)
SELECT CAST(round(CAST(round((SELECT sum(cmax) FROM maj) / n, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS purity,
       CAST(round(CAST(round((SELECT count(DISTINCT maj) FROM maj) / (SELECT count(DISTINCT label) FROM embeddings), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS topic_recall,
       CAST(round(CAST(round((SELECT count(*) FROM j WHERE topic <> -1) / n, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS coverage FROM tot
"""


def bins_sql(src: str, ts: str, n: int = 10) -> str:
    return f"""
  mm AS (SELECT CAST(min(epoch_us({ts})) AS DOUBLE) AS mn, CAST(max(epoch_us({ts})) AS DOUBLE) AS mx FROM {src}),
  binned AS (SELECT s.*, CAST(least({n}, greatest(1, ceil((CAST(epoch_us(s.{ts}) AS DOUBLE) - mn) / ((mx - mn) / {n}))))
                         AS INTEGER) AS bin, mn, mx FROM {src} s, mm)"""


def bin_start_sql(k: str, n: int = 10) -> str:
    return (f"make_timestamp(CAST(floor(CASE WHEN {k} = 1 THEN mn - 0.001 * (mx - mn) "
            f"ELSE mn + CAST({k} - 1 AS DOUBLE) * ((mx - mn) / {n}) END) AS BIGINT))")


ORACLE["equal_bins"] = f"""
WITH {bins_sql('events', 'ts')}
SELECT event_id, CAST(bin AS BIGINT) AS bin, {bin_start_sql('bin')} AS bin_start FROM binned
"""

ORACLE["slice_sizes"] = f"""
WITH {bins_sql('events', 'ts')},
  allb AS (SELECT CAST(range AS INTEGER) AS bin, mn, mx FROM range(1, 11), mm),
  c AS (SELECT bin, count(*) AS size FROM binned GROUP BY 1)
SELECT CAST(a.bin AS BIGINT) AS bin, {bin_start_sql('a.bin')} AS bin_start, coalesce(c.size, 0) AS size
FROM allb a LEFT JOIN c USING (bin)
"""

ORACLE["topics_over_time"] = f"""
WITH {TOPIC_TERMS},
  timed0 AS (SELECT d.doc_id, d.text, e.ts FROM documents d JOIN events e ON e.event_id = d.doc_id),
  {bins_sql('timed0', 'ts').lstrip()},
  tocc AS (SELECT b.doc_id, b.bin, a.topic, unnest(list_filter({tok('b.text')}, lambda t: t NOT IN ({STOP}))) AS term
           FROM binned b JOIN assign a USING (doc_id)),
  tcnt AS (SELECT bin, topic, term, count(*) AS n FROM tocc WHERE topic <> -1 GROUP BY 1, 2, 3),
  ttot AS (SELECT bin, topic, sum(n) AS tot FROM tcnt GROUP BY 1, 2),
  gidf AS (SELECT DISTINCT c.term, ln(aa.A / tf.f + 1) AS idf FROM cnt c JOIN tf USING (term) CROSS JOIN aa),
  tw2 AS (SELECT c.bin, c.topic, c.term, c.n / t.tot * g.idf AS weight FROM tcnt c JOIN ttot t USING (bin, topic)
          JOIN gidf g USING (term)),
  tr AS (SELECT *, row_number() OVER (PARTITION BY bin, topic ORDER BY weight DESC, term) AS rk FROM tw2),
  wl AS (SELECT bin, topic, string_agg(term, ', ' ORDER BY rk) AS words FROM tr WHERE rk <= 5 GROUP BY 1, 2),
  fq AS (SELECT bin, topic, count(DISTINCT doc_id) AS frequency FROM tocc WHERE topic <> -1 GROUP BY 1, 2)
SELECT CAST(f.bin AS BIGINT) AS bin, CAST(f.topic AS BIGINT) AS topic, f.frequency, w.words
FROM fq f LEFT JOIN wl w USING (bin, topic)
"""


def hist_sql(src: str, col: str, bins: int = 100) -> str:
    return f"""
WITH s AS ({src}),
  mm AS (SELECT CAST(min({col}) AS DOUBLE) AS mn, CAST(max({col}) AS DOUBLE) AS mx FROM s),
  ww AS (SELECT mn, CASE WHEN mx > mn THEN (mx - mn) / {bins} ELSE 1.0 END AS w FROM mm),
  c AS (SELECT CAST(least({bins - 1}, floor((CAST({col} AS DOUBLE) - mn) / w)) AS INTEGER) AS bin, count(*) AS count
        FROM s, ww WHERE {col} IS NOT NULL GROUP BY 1),
  allb AS (SELECT CAST(range AS INTEGER) AS bin FROM range(0, {bins}))
SELECT CAST(a.bin AS BIGINT) AS bin, CAST(round(CAST(round(mn + CAST(a.bin AS DOUBLE) * w, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS "left", coalesce(c.count, 0) AS count
FROM allb a CROSS JOIN ww LEFT JOIN c USING (bin)
"""


ORACLE["histogram_length"] = hist_sql("SELECT n_chars FROM documents", "n_chars")
ORACLE["histogram_words"] = hist_sql(
    r"SELECT len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS words FROM documents", "words")

ORACLE["availability"] = r"""
WITH c AS (SELECT 2 AS n_tags, len(string_split(coalesce(text, ''), ' ')) AS n_features,
                  CAST(contains(coalesce(text, ''), 'http') AS INTEGER) AS has_url FROM documents)
SELECT 'n_tags' AS measure, CAST(n_tags AS BIGINT) AS value, count(*) AS count FROM c GROUP BY 1, 2
UNION ALL SELECT 'n_features', CAST(n_features AS BIGINT), count(*) FROM c GROUP BY 1, 2
UNION ALL SELECT 'has_url', CAST(has_url AS BIGINT), count(*) FROM c GROUP BY 1, 2
"""

ORACLE["versions"] = f"""
WITH {TFIDF}, {pairs_sql(0.9, "tw")},
  v AS (SELECT source AS name, count(*) AS versions FROM documents GROUP BY 1),
  w AS (SELECT da.source AS name, count(*) AS similar_pairs FROM pairs p JOIN documents da ON da.doc_id = p.a
        JOIN documents db ON db.doc_id = p.b WHERE da.source = db.source GROUP BY 1)
SELECT v.name, v.versions, coalesce(w.similar_pairs, 0) AS similar_pairs FROM v LEFT JOIN w USING (name)
"""

ORACLE["reading_ease"] = r"""
WITH r AS (SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS words,
                  greatest(1, len(regexp_extract_all(text, '[.!?]+'))) AS sentences,
                  len(regexp_extract_all(lower(text), '[aeiouyàâäéèêëîïôöùûüÿæœáíóúñ]+')) AS v FROM documents)
SELECT doc_id, CAST(words AS BIGINT) AS words, CAST(sentences AS BIGINT) AS sentences,
       CAST(greatest(words, v) AS BIGINT) AS syllables,
       CAST(round(CAST(round(CASE WHEN words > 0 THEN 206.835 - 1.015 * words / sentences - 84.6 * greatest(words, v) / words END, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE)
       AS ease FROM r
"""

# -- clustering and topic models ------------------------------------------------

ORACLE["knn"] = """
WITH p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  d AS (SELECT a.id AS a, b.id AS b, list_distance(a.v, b.v) AS dist FROM p a JOIN p b ON a.id <> b.id),
  r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY dist, b) AS rank FROM d)
SELECT a, b, CAST(round(CAST(round(dist, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS dist, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 5
"""

ORACLE["vector_topic_words"] = f"""
WITH {CENT},
  dterm AS (SELECT DISTINCT doc_id, term FROM (
              SELECT doc_id, unnest(list_filter({tok('text')}, lambda t: t NOT IN ({STOP}))) AS term FROM documents)),
  wv AS (SELECT t.term, e.i, avg(CAST(e.x AS DOUBLE)) AS m FROM dterm t JOIN ex e USING (doc_id) GROUP BY 1, 2),
  wn AS (SELECT term, sqrt(sum(m * m)) AS nrm FROM wv GROUP BY 1),
  sc AS (SELECT w.term, c.label AS topic, sum(w.m * c.c) / any_value(wn.nrm) AS cosine
         FROM wv w JOIN cn c ON c.i = w.i JOIN wn USING (term) GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(cosine, 12) DESC, term) AS rank FROM sc)
SELECT CAST(topic AS BIGINT) AS topic, CAST(rank AS BIGINT) AS rank, term, CAST(round(CAST(round(cosine, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS cosine
FROM r WHERE rank <= 10
"""

ORACLE["baseline_tags"] = f"""
WITH {TOPIC_TERMS}
SELECT CAST(topic AS BIGINT) AS topic, term AS tag, CAST(rank AS BIGINT) AS tag_rank FROM ranked
WHERE rank <= 10 AND topic <> -1
"""

# -- streaming (batch equivalents) -----------------------------------------------

ORACLE["stream_counts"] = """
WITH w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type FROM events),
  c AS (SELECT window_start, event_type, count(*) AS n FROM w GROUP BY 1, 2)
SELECT window_start, event_type, n FROM c
"""

ORACLE["stream_closed_windows"] = """
WITH e AS (SELECT event_type, ts, time_bucket(INTERVAL 1 DAY, ts) AS window_start,
                  (CAST(floor(epoch(ts) / 86400) AS BIGINT) + user_id % 10) // 8 AS arrival FROM events),
  a AS (SELECT arrival, max(ts) AS m FROM e GROUP BY 1),
  wm AS (SELECT arrival, max(m) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                         - INTERVAL 2 DAY AS mark FROM a),
  j AS (SELECT e.*, coalesce(window_start + INTERVAL 1 DAY <= mark, false) AS is_late FROM e JOIN wm USING (arrival))
SELECT window_start, event_type, count(*) FILTER (NOT is_late) AS n, count(*) FILTER (is_late) AS late
FROM j GROUP BY 1, 2
"""

ORACLE["stream_assign"] = f"""
WITH {CENT},
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, topic) AS rn FROM cos)
SELECT doc_id, CAST(topic AS BIGINT) AS topic, CAST(round(CAST(round(cosine, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS cosine FROM r WHERE rn = 1
"""

ORACLE["stream_dedupe"] = """
SELECT sha256(d.text) AS text_hash, 1::BIGINT AS n FROM documents d JOIN events e ON e.event_id = d.doc_id GROUP BY 1
"""

ORACLE["stream_centroids"] = f"""
WITH {CENT}
SELECT CAST(label AS BIGINT) AS topic, CAST(i AS BIGINT) AS i, CAST(round(CAST(round(m, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS value FROM cm
"""

ORACLE["tag_pipeline"] = ORACLE["propagate_tags"].replace(
    "FROM spread e LEFT JOIN tlists l ON l.topic = e.topic AND l.tag = e.tag GROUP BY 1, 2, 3",
    "FROM spread e LEFT JOIN tlists l ON l.topic = e.topic AND l.tag = e.tag GROUP BY 1, 2, 3\n"
    "HAVING (coalesce(e.nested_kind, l.listed_kind, 'themes') = 'themes' AND max(e.score) > 0.7)\n"
    "    OR (coalesce(e.nested_kind, l.listed_kind, 'themes') = 'overarching_themes' AND max(e.score) > 0.5)")

# -- remaining inventory items -----------------------------------------------------

ORACLE["document_info"] = f"""
WITH {TOPIC_TERMS},
  wl AS (SELECT topic, string_agg(term, '_' ORDER BY rank) FILTER (WHERE rank <= 3) AS lab,
                string_agg(term, ', ' ORDER BY rank) AS rep FROM ranked WHERE rank <= 10 GROUP BY 1)
SELECT a.doc_id, CAST(a.topic AS BIGINT) AS topic, CAST(a.topic AS VARCHAR) || '_' || wl.lab AS name,
       wl.rep AS representation
FROM assign a LEFT JOIN wl USING (topic)
"""

ORACLE["term_counts_bigrams"] = f"""
WITH assign AS (SELECT d.doc_id, CAST(coalesce(e.label, -1) AS INTEGER) AS topic,
                       list_filter({tok('d.text')}, lambda t: t NOT IN ({STOP})) AS t
                FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
  g AS (SELECT topic, list_concat(t, CASE WHEN len(t) >= 2 THEN
                 list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) ELSE [] END) AS grams
        FROM assign),
  o AS (SELECT topic, unnest(grams) AS term FROM g)
SELECT CAST(topic AS BIGINT) AS topic, term, count(*) AS n FROM o GROUP BY 1, 2
"""

ORACLE["vocabulary"] = f"""
WITH o AS (SELECT doc_id, unnest(list_filter({tok('text')}, lambda t: t NOT IN ({STOP}))) AS term FROM documents),
  c AS (SELECT doc_id, term, count(*) AS n FROM o GROUP BY 1, 2)
SELECT term, sum(n) AS n, count(*) AS docs FROM c GROUP BY 1
"""

ORACLE["ctfidf_reduce_frequent"] = ORACLE["ctfidf_top_words"].replace("WITH " + TOPIC_TERMS, "WITH " + TOPIC_TERMS.replace(
    "(c.n / t.total) * ln(aa.A / tf.f + 1) AS weight", "sqrt(c.n / t.total) * ln(aa.A / tf.f + 1) AS weight"))

ORACLE["tukey_hsd"] = f"""
WITH {RUNS},
  gm AS (SELECT nr_topics, Model, avg(npmi) AS m, count(*) AS n FROM runs GROUP BY 1, 2),
  ss AS (SELECT r.nr_topics, sum((r.npmi - g.m) * (r.npmi - g.m)) AS ssw, count(*) AS nn
         FROM runs r JOIN gm g USING (nr_topics, Model) GROUP BY 1),
  k AS (SELECT nr_topics, count(*) AS k FROM gm GROUP BY 1),
  e AS (SELECT ss.nr_topics, ssw / (nn - k) AS mse, CAST(nn - k AS DOUBLE) AS dfe FROM ss JOIN k USING (nr_topics))
SELECT CAST(a.nr_topics AS BIGINT) AS nr_topics, a.Model AS A, b.Model AS B,
       CAST(round(CAST(round(a.m - b.m, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS diff,
       CAST(round(CAST(round(abs(a.m - b.m) / sqrt(e.mse / 2 * (1.0 / a.n + 1.0 / b.n)), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS q,
       CAST(round(CAST(round(e.dfe, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS df
FROM gm a JOIN gm b ON a.nr_topics = b.nr_topics AND a.Model < b.Model JOIN e ON e.nr_topics = a.nr_topics
"""

# -- source / sink round trips ---------------------------------------------------

ORACLE["csv_round_trip"] = "SELECT doc_id, text FROM documents"

ORACLE["items_round_trip"] = f"""
SELECT page_id AS dataset_id, url, {html_text_sql('html')} AS scraped_data FROM pages
"""

ORACLE["run_log_round_trip"] = ORACLE["flatten_runs"]

ORACLE["text_by_id_round_trip"] = f"""
SELECT page_id AS dataset_id, {html_text_sql('html')} AS prompt_description FROM pages
"""

ORACLE["run_files_round_trip"] = f"""
WITH {RUNS}, f AS (SELECT *, run_id // 500 AS part FROM runs),
  g AS (SELECT *, dense_rank() OVER (ORDER BY part) - 1 AS fi, row_number() OVER (PARTITION BY part ORDER BY run_id) - 1 AS pos FROM f)
SELECT 'run-' || lpad(CAST(part AS VARCHAR), 12, '0') || '.json' AS file, fi AS file_index, pos, Dataset,
       Model || '_' || CAST(fi AS VARCHAR) AS Model, CAST(nr_topics AS BIGINT) AS nr_topics,
       CAST(round(CAST(round(npmi, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS npmi
FROM g
"""

ORACLE["timings_round_trip"] = f"""
WITH {RUNS}
SELECT Model, CAST(nr_topics AS BIGINT) AS nr_topics, count(*) AS n,
       CAST(round(CAST(round(avg(npmi), 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS seconds
FROM runs GROUP BY 1, 2
"""

ORACLE["corpus_round_trip"] = "SELECT replace(text, chr(10), ' ') AS line FROM documents"

ORACLE["density_clusters"] = """
WITH RECURSIVE
  v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
  d AS MATERIALIZED (SELECT a.id AS a, b.id AS b, round(list_distance(a.e, b.e), 9) AS dist FROM v a JOIN v b ON a.id <> b.id),
  core AS MATERIALIZED (SELECT a AS id, dist AS core FROM (
            SELECT a, dist, row_number() OVER (PARTITION BY a ORDER BY dist, b) AS r FROM d) WHERE r = 5),
  eps AS (SELECT median(core) AS m FROM core),
  dense AS (SELECT id FROM core, eps WHERE core <= m),
  ed AS MATERIALIZED (SELECT a, b FROM d, eps WHERE dist <= m AND a IN (SELECT id FROM dense) AND b IN (SELECT id FROM dense)),
  reach(a, b) AS (SELECT id, id FROM dense UNION SELECT r.a, e.b FROM reach r JOIN ed e ON r.b = e.a),
  comp AS (SELECT a AS id, min(b) AS comp FROM reach GROUP BY 1),
  good AS (SELECT comp FROM comp GROUP BY 1 HAVING count(*) >= 5)
SELECT v.id AS doc_id, coalesce(g.comp, -1)::BIGINT AS cluster
FROM v LEFT JOIN comp c ON c.id = v.id LEFT JOIN good g ON g.comp = c.comp
"""


# -- outliers by token windows and by given probabilities ----------------------------

WINDOWS = f"""
  ts AS (SELECT doc_id, {tok('text')} AS t FROM documents),
  st AS (SELECT doc_id, t, unnest(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 4 THEN [1] ELSE range(1, len(t) - 2) END) AS s FROM ts),
  wc AS (SELECT doc_id, s, term, count(*) AS n FROM (SELECT doc_id, s, unnest(t[s:s + 3]) AS term FROM st) GROUP BY ALL),
  widf AS (SELECT term, ln(aa.A / tf.f + 1) AS idf FROM tf CROSS JOIN aa),
  wn AS (SELECT doc_id, s, sqrt(sum(n * n * idf * idf)) AS nn FROM wc JOIN widf USING (term) GROUP BY ALL),
  wtn AS (SELECT topic, sqrt(sum(weight * weight)) AS tn FROM w WHERE topic <> -1 GROUP BY 1),
  wsim AS (SELECT wc.doc_id, wc.s, w.topic, sum(wc.n * widf.idf * w.weight) / (any_value(wn.nn) * any_value(wtn.tn)) AS c
           FROM wc JOIN widf USING (term) JOIN w ON w.term = wc.term AND w.topic <> -1
           JOIN wn ON wn.doc_id = wc.doc_id AND wn.s = wc.s JOIN wtn ON wtn.topic = w.topic GROUP BY ALL),
  wsum AS (SELECT doc_id, topic, sum(c) AS c FROM wsim WHERE round(c, 9) >= 0.1 GROUP BY 1, 2),
  wprob AS (SELECT doc_id, topic, c / sum(c) OVER (PARTITION BY doc_id) AS prob FROM wsum)
"""

ORACLE["topic_distributions"] = f"""
WITH {TOPIC_TERMS}, {WINDOWS}
SELECT doc_id, CAST(topic AS BIGINT) AS topic, CAST(round(CAST(round(prob, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS prob FROM wprob
"""

ORACLE["reassign_outliers_distributions"] = f"""
WITH {TOPIC_TERMS}, {WINDOWS},
  best AS (SELECT doc_id, topic FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(prob, 9) DESC, topic) AS rn
                                      FROM wprob) WHERE rn = 1)
SELECT a.doc_id, CAST(CASE WHEN a.topic = -1 THEN coalesce(b.topic, -1) ELSE a.topic END AS BIGINT) AS topic
FROM assign a LEFT JOIN best b USING (doc_id)
"""

ORACLE["reassign_outliers_probabilities"] = f"""
WITH {MEMB},
  near AS (SELECT doc_id, topic, cosine FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, topic) AS rn FROM cos) WHERE rn = 1),
  best AS (SELECT doc_id, topic, round(prob, 9) AS p FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(prob, 9) DESC, topic) AS rn
                                                           FROM memb WHERE topic <> -1) WHERE rn = 1)
SELECT n.doc_id, CAST(CASE WHEN round(n.cosine, 9) >= 0.25 THEN n.topic WHEN b.p > 0.105 THEN b.topic ELSE -1 END AS BIGINT) AS topic
FROM near n JOIN best b USING (doc_id)
"""

# -- hooks ------------------------------------------------------------------------

HOOKED = f"""
  top40 AS (SELECT topic, rank, term, weight FROM ranked WHERE rank <= 40),
  seen AS (SELECT topic, term, count(DISTINCT doc_id) AS docs
           FROM (SELECT doc_id, topic, unnest({tok('text')}) AS term FROM assign) GROUP BY 1, 2),
  sizes AS (SELECT topic, count(*) AS size FROM assign GROUP BY 1),
  spread AS (SELECT t.* FROM top40 t JOIN seen USING (topic, term) JOIN sizes USING (topic) WHERE docs >= size * 0.05::DOUBLE),
  own AS (SELECT * FROM spread WHERE term NOT IN (SELECT term FROM spread GROUP BY 1 HAVING count(*) > 3)),
  hooked AS (SELECT * FROM (SELECT topic, term, weight, row_number() OVER (PARTITION BY topic ORDER BY rank) AS rank FROM own)
             WHERE rank <= 10)
"""

ORACLE["hooked_words"] = f"""
WITH {TOPIC_TERMS}, {HOOKED}
SELECT CAST(topic AS BIGINT) AS topic, CAST(rank AS BIGINT) AS rank, term,
       CAST(round(CAST(round(weight, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS weight FROM hooked
"""

ORACLE["hooked_scores"] = f"""
WITH {TOPIC_TERMS}, {HOOKED}, {QUALITY.replace("FROM ranked WHERE rank <= 10 AND topic <> -1", "FROM hooked WHERE topic <> -1")
                               .replace("len(t) AS L FROM ptoks", "len(t) AS L FROM ptoks WHERE len(t) > 0")},
  {npmi_sql('document')},
  v AS (SELECT 'npmi' AS metric, avg(npmi) AS value FROM per_topic
        UNION ALL SELECT 'diversity', count(DISTINCT term) / count(*) FROM tw
        UNION ALL SELECT 'coverage', (SELECT count(DISTINCT doc_id) FROM occw) / (SELECT count(*) FROM lens))
SELECT metric, CAST(round(CAST(round(value, 9) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS value FROM v
"""
