"""DuckDB SQL for the queries that SQL can express, by query name."""

ORACLE: dict[str, str] = {}

ORACLE["op2_decontam"] = r"""
WITH item AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
gram AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item WHERE len(w) > 0)),
doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
place AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM gram) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, place.n, item FROM place JOIN gram ON place.g = gram.g AND place.n = gram.n),
word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLE["op4_line_rules"] = r"""
WITH doc AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM doc)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
line AS (SELECT doc_id, source, text,
    regexp_replace(regexp_replace(lower(trim(s, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), '[0-9]+', '0', 'g'),
      '[\x20\x09-\x0D]{2,}|[\x09-\x0D]', ' ', 'g') AS norm, len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT doc_id, source, text, unnest(lines) AS s FROM doc)),
freq AS (SELECT source, norm, count(DISTINCT text) AS c FROM line GROUP BY source, norm),
host AS (SELECT source, count(DISTINCT text) AS texts FROM doc GROUP BY source),
boiler AS (SELECT doc_id, sum(line.n) AS n FROM line JOIN freq ON line.norm = freq.norm AND line.source IS NOT DISTINCT FROM freq.source
  JOIN host ON host.source IS NOT DISTINCT FROM line.source WHERE c > 10 AND c > greatest(10, texts * 0.01) GROUP BY doc_id),
base AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(cov.n, 0) AS n_repeat_words, coalesce(boiler.n, 0) AS boiler_words
  FROM doc LEFT JOIN cov USING (doc_id) LEFT JOIN boiler USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CAST(boiler_words AS BIGINT) AS boiler_words,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND boiler_words <= 0.5 * n_words AS kept
FROM base
"""

ORACLE["op10_line_dedup"] = r"""
WITH part AS (SELECT doc_id, i - 1 AS place, parts[i] AS line FROM
    (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))),
norm AS (SELECT doc_id, place, line, regexp_replace(lower(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))),
    '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM part),
judged AS (SELECT doc_id, place, t, doc_id * 10000000 + place AS o FROM norm WHERE len(string_split(t, ' ')) >= 5),
uniq AS (SELECT t, min(o) AS f, string_split(t, ' ') AS w FROM judged GROUP BY t),
rest AS (SELECT t, f, i AS gap, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') AS v
  FROM (SELECT t, f, w, unnest(range(1, len(w) + 1)) AS i FROM uniq)),
at_gap AS (SELECT v, gap, min(f) AS b FROM rest GROUP BY v, gap),
as_rest AS (SELECT v, min(f) AS b FROM rest GROUP BY v),
near AS (
  SELECT t, b FROM rest JOIN at_gap USING (v, gap)
  UNION ALL SELECT rest.t, uniq.f FROM rest JOIN uniq ON rest.v = uniq.t
  UNION ALL SELECT uniq.t, b FROM uniq JOIN as_rest ON uniq.t = as_rest.v),
early AS (SELECT t, least(min(b), f) AS e FROM (SELECT uniq.t, uniq.f, coalesce(near.b, uniq.f) AS b FROM uniq LEFT JOIN near ON uniq.t = near.t) GROUP BY t, f),
gone AS (SELECT doc_id, place FROM judged JOIN early USING (t) WHERE e < o),
kept AS (SELECT doc_id, count(*) AS n_lines, count(gone.place) AS n_removed, string_agg(line, chr(10) ORDER BY place) FILTER (WHERE gone.place IS NULL) AS t
  FROM part LEFT JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""

ORACLE["op13_hard_negatives"] = r"""
WITH clean AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
one AS (SELECT * FROM clean QUALIFY row_number() OVER (PARTITION BY id ORDER BY label, q) = 1),
scored AS (SELECT a.id AS anchor_id, a.label = b.label AS same, b.id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM one a JOIN one b ON a.id <> b.id WHERE a.id % 100 = 0),
positive AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
band AS (SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, n.id AS negative_id, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS r
  FROM positive p JOIN scored n ON p.anchor_id = n.anchor_id WHERE NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM band WHERE r <= 5
"""

ORACLE["op12_spelling_variants"] = r"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(0, 8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
    FROM (SELECT unnest(range(0, 256)) AS i))),
run AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
    FROM documents) WHERE length(run) >= 5 GROUP BY ALL),
coded AS (SELECT run, times, flatten(list_transform(string_split(doc || ':' || run, ''),
    lambda s: CASE WHEN unicode(s) < 128 THEN [CAST(unicode(s) AS BIGINT)] ELSE [CAST(192 + (unicode(s) >> 6) AS BIGINT), CAST(128 + (unicode(s) & 63) AS BIGINT)] END)) AS b FROM run),
hashed AS (SELECT run, times, xor(list_reduce(list_prepend(4294967295, b), lambda a, x: xor(a >> 8, crc.t[(xor(a, x) & 255) + 1])), 4294967295) AS h FROM coded, crc),
slip AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, times FROM hashed),
vocab AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM slip WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
gone AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS v FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab)),
near AS (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM gone a JOIN gone b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM gone a JOIN vocab b ON a.v = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM gone a JOIN vocab b ON a.v = b.word),
best AS (SELECT word, n, other, other_n, count(*) OVER (PARTITION BY word) AS n_near FROM near
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1),
judged AS (SELECT vocab.word, vocab.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * vocab.n THEN other END AS form,
    CASE WHEN other_n >= 2 * vocab.n THEN other_n END AS form_n FROM vocab LEFT JOIN best ON vocab.word = best.word),
path AS (SELECT word, word AS at, form AS further FROM judged
  UNION ALL SELECT path.word, judged.word, judged.form FROM path JOIN judged ON path.further = judged.word)
SELECT judged.word, judged.form, path.at AS root, judged.n, judged.n_near, judged.form_n
FROM judged JOIN path ON judged.word = path.word AND path.further IS NULL
"""
