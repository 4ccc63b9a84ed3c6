"""DuckDB statements of the results that SQL can express."""

from __future__ import annotations

from tidemark.llm import op4_mixture as mix

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def mixture(rounds: int = mix.ROUNDS, power: float = mix.POWER, rate: float = mix.RATE) -> str:
    steps = [f"""
marked AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
         CASE WHEN contains(x, ' | ') THEN 'table' WHEN contains(x, '***') OR contains(x, '%%%') THEN 'markup'
              WHEN contains(x, '@') THEN 'contact' ELSE 'prose' END AS topic,
         len(regexp_extract_all(x, '{WORD}'))::BIGINT AS n_tokens
  FROM (SELECT *, coalesce(text, '') AS x FROM documents)),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS w FROM marked GROUP BY ALL),
total AS MATERIALIZED (SELECT sum(w) AS n FROM cells),
"""]
    for kind in ("source", "lang", "topic"):
        steps.append(f"""
target_{kind} AS MATERIALIZED (
  SELECT {kind}, {rate} * n * raw / sum(raw) OVER () AS goal
  FROM (SELECT {kind}, n, pow(sum(w) / n, {power}::DOUBLE) AS raw FROM cells, total GROUP BY {kind}, n)),
f_{kind}_0 AS MATERIALIZED (SELECT {kind}, 1.0::DOUBLE AS f FROM target_{kind}),
""")
    for r in range(1, rounds + 1):
        now = {"source": r - 1, "lang": r - 1, "topic": r - 1}
        for kind in ("source", "lang", "topic"):
            joins = " ".join(f"JOIN f_{k}_{v} AS {k}_f USING ({k})" for k, v in now.items())
            steps.append(f"""
f_{kind}_{r} AS MATERIALIZED (
  SELECT g.{kind}, CASE WHEN g.e > 0 THEN g.f * goal / g.e ELSE g.f END AS f
  FROM (SELECT {kind}, any_value({kind}_f.f) AS f, sum(w * least(1.0, source_f.f * lang_f.f * topic_f.f)) AS e
        FROM cells {joins} GROUP BY {kind}) AS g JOIN target_{kind} USING ({kind})),
""")
            now[kind] = r
    last = " ".join(f"JOIN f_{k}_{rounds} AS {k}_f USING ({k})" for k in ("source", "lang", "topic"))
    return "WITH " + "".join(steps) + f"""
chance AS MATERIALIZED (SELECT source, lang, topic, least(1.0, source_f.f * lang_f.f * topic_f.f) AS p FROM cells {last})
SELECT doc_id, source, lang, topic, n_tokens, round(p, 6) AS probability,
       ('0x' || substr(md5('{mix.SALT}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < p AS selected
FROM marked JOIN chance USING (source, lang, topic)
"""


WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, sha1(body) AS hex FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS keeper FROM d)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(hex, ((k // 4) * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (k % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM keeper OR keeper IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM keeper OR keeper IS NULL THEN NULL ELSE keeper END AS refers_to
FROM g
"""

JACCARD = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(list_transform(range(0, greatest(len(ws) - 3, 1)), lambda i: ws[i + 1:i + 4])) AS g
  FROM w WHERE len(ws) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s AS a JOIN s AS b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (
  SELECT a, b FROM o JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * o >= 85 * (x.k + y.k - o)),
r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b)
SELECT w.doc_id, coalesce(any_value(n.k), 0)::BIGINT AS n_shingles, min(r.c) AS component_id
FROM w JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY w.doc_id
"""

REPEATS = f"""
WITH w AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
p AS MATERIALIZED (
  SELECT row_id, unnest(list_transform(range(1, greatest(len(ws) - 33, 1)), lambda i: md5(array_to_string(ws[i:i + 34], ' ')))) AS k,
         unnest(range(1, greatest(len(ws) - 33, 1))) AS i
  FROM w),
again AS (SELECT k FROM p GROUP BY k HAVING count(*) > 1),
starts AS MATERIALIZED (SELECT row_id, i FROM p SEMI JOIN again USING (k)),
gone AS (SELECT DISTINCT row_id, i + j AS pos FROM (SELECT row_id, i, unnest(range(0, 35)) AS j FROM starts)),
words AS (SELECT row_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
kept AS (SELECT row_id, string_agg(word, ' ' ORDER BY pos) AS t, count(*) AS n FROM words ANTI JOIN gone USING (row_id, pos) GROUP BY row_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (row_id)
"""

COLLOCATIONS = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces),
grams AS (
  SELECT lang, 1 AS size, unnest(ws) AS g FROM w UNION ALL
  SELECT lang, 2, unnest(list_transform(range(1, greatest(len(ws), 1)), lambda i: array_to_string(ws[i:i + 1], ' '))) FROM w UNION ALL
  SELECT lang, 3, unnest(list_transform(range(1, greatest(len(ws) - 1, 1)), lambda i: array_to_string(ws[i:i + 2], ' '))) FROM w),
f AS MATERIALIZED (SELECT lang, size, g, count(*) AS c FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
cand AS MATERIALIZED (SELECT lang, size, g, c AS a, string_split(g, ' ') AS v FROM f WHERE size > 1 AND c >= 10),
cuts AS (
  SELECT lang, g, a, k, array_to_string(v[1:k], ' ') AS head, array_to_string(v[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM cand)),
scored AS (
  SELECT cuts.lang, cuts.g, a, k, x.c AS l, y.c AS r, (1000000::HUGEINT * a * a // (x.c::HUGEINT * y.c))::BIGINT AS score
  FROM cuts JOIN f AS x ON x.lang = cuts.lang AND x.g = head JOIN f AS y ON y.lang = cuts.lang AND y.g = rest),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
around AS (
  SELECT lang, g, max(a) AS longer
  FROM (SELECT lang, a, unnest([array_to_string(v[1:2], ' '), array_to_string(v[2:3], ' ')]) AS g FROM cand WHERE size = 3) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, n, score
FROM worst JOIN total USING (lang) LEFT JOIN around USING (lang, g)
WHERE longer IS NULL OR 100 * longer < 50 * a
QUALIFY rank <= 2000
"""

LLM_ORACLES = {"op4_mixture": mixture(), "op6_warc": WARC, "op7_ngram_jaccard": JACCARD, "op11_repeats": REPEATS,
               "op12_collocations": COLLOCATIONS}
