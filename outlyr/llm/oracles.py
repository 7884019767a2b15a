"""DuckDB SQL of the operators that SQL can express; the constants are those of the modules."""

from __future__ import annotations

from outlyr.llm import filter_audit, license_scan, near_dup, quality, word_runs

_WORD = r"[^\x20\x09-\x0D]+"

QUALITY = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, chr(0)) AS stratum, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '{_WORD}') AS ws, [x for x in string_split(t, chr(10)) if regexp_matches(x, '{_WORD}')] AS ls FROM d
), win AS (
  SELECT rid, i, array_to_string(ws[i:i + {quality.WINDOW - 1}], ' ') AS k
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - {quality.WINDOW - 2})) AS i FROM w)
), twice AS (
  SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, k) > 1
), rep AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + {quality.WINDOW})) AS p FROM twice) GROUP BY rid
), m AS (
  SELECT doc_id, stratum, t, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS caps, length(t) - length(replace(t, '!', '')) AS excl
  FROM w LEFT JOIN rep USING (rid)
), v AS (
  SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
    [coalesce(n_symbols::DOUBLE / nullif(word_chars, 0), 0), coalesce(caps::DOUBLE / nullif(word_chars, 0), 0), coalesce(excl::DOUBLE / nullif(n_words, 0), 0),
     coalesce(n_repeat_words::DOUBLE / nullif(n_words, 0), 0), coalesce(n_dup_lines::DOUBLE / nullif(n_lines, 0), 0)] AS vs
  FROM m
), truth AS (
  SELECT doc_id, min(quality) AS q FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id
), path AS (
  SELECT unnest({list(quality.FACTORS)})::DOUBLE AS f, unnest(range({len(quality.FACTORS)})) AS j
), judged AS (
  SELECT *, list_max([len([f for f in {list(quality.FACTORS)} if vs[r] > f::DOUBLE * {list(quality.USUAL.values())}[r]::DOUBLE]) for r in range(1, 6)]) AS level FROM v
), held AS (  -- equal texts of a stratum are one draw
  SELECT stratum, t, min(q) AS q, max(level) AS level FROM judged JOIN truth USING (doc_id) WHERE NOT base_failed GROUP BY stratum, t
), tested AS (
  SELECT stratum, j, count(*) FILTER (q > 0) AS n, count(*) FILTER (q <= 0) AS nb,
    count(*) FILTER (q > 0 AND level >= {len(quality.FACTORS)} - j) AS k, count(*) FILTER (q <= 0 AND level >= {len(quality.FACTORS)} - j) AS kb
  FROM held, path GROUP BY stratum, j
), tails AS (
  SELECT *, CASE WHEN n = 0 OR k >= n * {quality.ALPHA}::DOUBLE THEN 1.0 ELSE list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({quality.ALPHA}) + (n - i) * ln(1 - {quality.ALPHA})) for i in range(k + 1)]) END AS p
  FROM tested
), chain AS (
  SELECT *, bool_and(p <= {quality.DELTA}::DOUBLE * n / (SELECT sum(n) FROM tested WHERE j = 0)) OVER (PARTITION BY stratum ORDER BY j) AS ok,
    coalesce(kb::DOUBLE / nullif(nb, 0), 0) - {quality.PRICE} * coalesce(k::DOUBLE / nullif(n, 0), 0) AS gain
  FROM tails
), cuts AS (
  SELECT stratum, j FROM chain WHERE ok AND gain > 0 QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY gain DESC, j) = 1
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(level >= {len(quality.FACTORS)} - j, false) AS kept
FROM judged LEFT JOIN cuts USING (stratum)
"""

NEAR_DUP = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + {near_dup.SHINGLE - 1}], ' ') AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {near_dup.SHINGLE - 2}, 2))) AS i FROM d WHERE len(ws) > 0)
), n AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL
), half AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {near_dup.PERCENT} * (x.n + y.n - c)
), links AS MATERIALIZED (
  SELECT a, b FROM half UNION SELECT b, a FROM half
), reach AS (
  SELECT a, a AS b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), comp AS (
  SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(comp.c, d.doc_id))::BIGINT AS component_id, d.doc_id = least(d.doc_id, coalesce(comp.c, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)
"""

_VALUES = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)

LICENSE_SCAN = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), template AS (
  SELECT *, len(string_split(words, ' ')) AS size FROM (VALUES {_VALUES((t, label, text, len(own)) for t, (label, text, own) in enumerate(license_scan.TEMPLATES))}) AS v(t, label, words, must)
), phrase AS (
  SELECT * FROM (VALUES {_VALUES((t, k, key, len(text.partition(key)[0].split())) for t, (_, text, own) in enumerate(license_scan.TEMPLATES) for k, key in enumerate(own))}) AS v(t, k, words, begin)
), base AS (
  SELECT * FROM (VALUES {_VALUES(license_scan.PHRASES.items())}) AS v(words, label)
), posting AS (
  SELECT t, word, p - 1 AS p FROM (SELECT t, unnest(string_split(words, ' ')) AS word, generate_subscripts(string_split(words, ' '), 1) AS p FROM template)
), licence AS MATERIALIZED (
  SELECT rid, word, i - 1 AS pos FROM (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d)
  WHERE word IN (SELECT word FROM posting UNION SELECT unnest(string_split(words, ' ')) FROM base)
), spot AS (  -- the places of any phrase: of its first word, where its other words follow
  SELECT rid, words, pos FROM (SELECT words FROM base UNION SELECT words FROM phrase) p JOIN licence ON word = string_split(words, ' ')[1] JOIN d USING (rid)
  WHERE ws[pos + 1:pos + len(string_split(words, ' '))] = string_split(words, ' ')
), rank AS (
  SELECT word, row_number() OVER (ORDER BY count(DISTINCT rid), word) AS r FROM licence GROUP BY word
), look AS (
  SELECT rid, t, word FROM (SELECT DISTINCT rid, t, word, r FROM licence JOIN posting USING (word) JOIN rank USING (word)) QUALIFY row_number() OVER (PARTITION BY rid, t ORDER BY r) <= {license_scan.RARE}
), start AS (
  SELECT rid, t, pos - p AS o FROM look JOIN licence USING (rid, word) JOIN posting USING (t, word) GROUP BY ALL HAVING count(*) >= {license_scan.NEED}
), proved AS (
  SELECT start.rid, t, o FROM start JOIN template USING (t) JOIN phrase USING (t) JOIN spot ON spot.rid = start.rid AND spot.words = phrase.words AND abs(spot.pos - o - begin) <= {license_scan.SLACK}
  GROUP BY start.rid, t, o HAVING count(DISTINCT k) = any_value(must)
), share AS (
  SELECT rid, t, o, count(DISTINCT p) / any_value(size) AS share
  FROM proved JOIN template USING (t) JOIN posting USING (t) JOIN licence USING (rid, word) WHERE abs(pos - p - o) <= {license_scan.SLACK} GROUP BY rid, t, o
), passed AS (
  SELECT rid, label, share FROM share JOIN template USING (t) WHERE share >= {license_scan.ACCEPT}
), places AS (
  SELECT rid, count(*) AS n, min(pos) AS f, max(pos) AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM spot JOIN base USING (words) GROUP BY rid
), every AS (
  SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM passed UNION SELECT rid, label FROM spot JOIN base USING (words)) GROUP BY rid
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, f::BIGINT AS first_word, l::BIGINT AS last_word, coalesce(places.labels, '') AS base_labels, coalesce(every.labels, '') AS labels,
  CASE WHEN n > 0 THEN 1.0 ELSE coalesce((SELECT max(share) FROM passed WHERE passed.rid = d.rid), 0.0) END::DOUBLE AS score
FROM d LEFT JOIN places USING (rid) LEFT JOIN every USING (rid)
"""

FILTER_AUDIT = rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents
), f AS (
  SELECT doc_id, part, concat(
    CASE WHEN len(ws) < {filter_audit.MIN_WORDS} THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(ws)) < {filter_audit.MIN_DISTINCT} * len(ws) THEN 'B' ELSE '' END,
    CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {filter_audit.MAX_CAPITALS} * length(t) THEN 'C' ELSE '' END,
    CASE WHEN regexp_matches(t, '{filter_audit.SYMBOLS}') THEN 'D' ELSE '' END, CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails
  FROM d
), c AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS toxic
  FROM f GROUP BY ALL
), letter AS (
  SELECT unnest(string_split('A B C D E', ' ')) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letter a, letter b, letter c, letter d, letter e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), step AS (
  SELECT o, s, o[s] AS x FROM orders, (SELECT unnest(range(1, 6)) AS s)
), fate AS (  -- the step at which each kind of document is removed, 9: never
  SELECT part, fails, n, good, toxic, o, list_min(list_append([strpos(o, y) for y in string_split(fails, '') if y <> ''], 9)) AS gone FROM c, orders
), counts AS (
  SELECT part, o, s, x, coalesce(sum(n) FILTER (gone > s), 0) AS kept, coalesce(sum(n) FILTER (gone = s), 0) AS removed, coalesce(sum(n) FILTER (gone < s AND contains(fails, x)), 0) AS redundant,
    coalesce(sum(n) FILTER (fails = x), 0) AS unique_fails, coalesce(sum(good) FILTER (gone = s), 0) AS good_lost, coalesce(sum(toxic) FILTER (gone = s), 0) AS toxic_lost
  FROM fate JOIN step USING (o) GROUP BY ALL
)
SELECT part, o AS filter_order, s::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM counts
"""

WORD_RUNS = rf"""
WITH crc AS (  -- the table of the reversed polynomial, one entry a byte
  SELECT list(list_reduce(list_prepend(k, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY k) AS tab FROM (SELECT unnest(range(256)) AS k)
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws,
    coalesce(xor(list_reduce(list_prepend(4294967295, [ascii(x)::BIGINT for x in string_split(doc_id::VARCHAR, '')]), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295), 1) AS h
  FROM documents, crc
), g AS (
  SELECT *, len(ws) AS n, (h // 10) % greatest(len(ws), 1) AS a, (h // 10) % 8 AS k FROM d
), w AS MATERIALIZED (
  SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN [ws[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + k)) END + 1] for i in range(n)] ELSE ws END AS ws FROM g
), p AS MATERIALIZED (
  SELECT rid, n, word, i FROM (SELECT rid, n, unnest(ws) AS word, unnest(range(n)) AS i FROM w)
), same AS (
  SELECT x.rid, x.i, y.i - x.i AS q FROM p x JOIN p y ON x.rid = y.rid AND x.word = y.word AND y.i > x.i AND {word_runs.EXPONENT} * (y.i - x.i) <= x.n
), island AS (
  SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS k FROM same
), stretch AS (
  SELECT rid, min(i) AS s, count(*) + q AS len, q FROM island GROUP BY rid, q, k HAVING count(*) + q >= greatest({word_runs.SHORTEST}, {word_runs.EXPONENT} * q)
), run AS MATERIALIZED (
  SELECT rid, s, len, min(q) AS q FROM stretch GROUP BY rid, s, len
), gone AS (
  SELECT DISTINCT rid, unnest(range(s + q, s + len)) AS i FROM run
), rest AS (
  SELECT rid, string_agg(word, ' ' ORDER BY i) AS kept FROM p ANTI JOIN gone USING (rid, i) GROUP BY rid
), best AS (
  SELECT rid, count(*) OVER (PARTITION BY rid) AS n_runs, s, len, q, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) OVER (PARTITION BY rid) AS listed
  FROM run QUALIFY row_number() OVER (PARTITION BY rid ORDER BY len / q DESC, s, q) = 1
)
SELECT doc_id, w.n::BIGINT AS n_words, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, len::BIGINT AS length, q::BIGINT AS period, (1000 * len // q)::BIGINT AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM w LEFT JOIN best USING (rid) LEFT JOIN rest USING (rid)
"""
