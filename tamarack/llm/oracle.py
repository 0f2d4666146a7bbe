"""DuckDB SQL for the operations that SQL can express."""

from __future__ import annotations

from . import licenses, secrets

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"


def decontaminate_sql(size: int = 10) -> str:
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW}, '{_WORD}') AS w FROM benchmark),
windows AS (SELECT item_id, least(len(w), {size}) AS n, array_to_string(w[k:k + least(len(w), {size}) - 1], ' ') AS x
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - {size} + 2))) AS k FROM b WHERE len(w) > 0) s),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS x
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n) s),
hits AS (SELECT doc_id, item_id, k, n FROM grams JOIN windows USING (n, x)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT doc_id, k, n FROM hits) h) u GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) h GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


def licenses_sql(threshold: float = licenses.THRESHOLD) -> str:
    places = []
    for phrase, label in licenses.PHRASES.items():
        stand = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split()))
        places.append(f"list_transform(list_filter(range(1, len(w) + 1), lambda i: {stand}), lambda i: {{'label': '{label}', 'at': i - 1}})")
    width = licenses.widths()
    rows = [(k, w, len(ws), licenses.needed(len(ws), threshold), width[k]) for k, ws in licenses.template_words().items() for w in ws]
    templates = ", ".join(f"('{k}', '{w}', {n}, {c}, {size})" for k, w, n, c, size in rows)
    return rf"""
WITH d AS (SELECT doc_id, text, regexp_extract_all({_LOW}, '{_WORD}') AS w FROM documents),
p AS (SELECT doc_id, text, len(w) AS n_words, list_concat({", ".join(places)}) AS found FROM d),
templates(label, word, n, need, width) AS (VALUES {templates}),
held AS (SELECT doc_id, i, label, word, n, need, width FROM (SELECT DISTINCT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) s JOIN templates ON w[i] = word),
counts AS (SELECT doc_id, label, n, need, count(DISTINCT word) OVER (PARTITION BY doc_id, label ORDER BY i RANGE BETWEEN CURRENT ROW AND width - 1 FOLLOWING) AS c FROM held),
blocks AS (SELECT doc_id, list(DISTINCT label) AS labels, max(c / n) AS best FROM counts WHERE c >= need GROUP BY doc_id)
SELECT doc_id, n_words, len(found) AS n_base, list_min(list_transform(found, lambda x: x.at)) AS first_word, list_max(list_transform(found, lambda x: x.at)) AS last_word,
  array_to_string(list_sort(list_distinct(list_transform(found, lambda x: x.label))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(list_transform(found, lambda x: x.label), coalesce(labels, [])))), ',') AS labels,
  CASE WHEN len(found) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM p LEFT JOIN blocks USING (doc_id)"""


def secrets_sql() -> str:
    each = []
    for k, (kind, (_, pattern, least, group)) in enumerate(secrets.RULES.items()):
        x = pattern.pattern.replace("'", "''")
        x = f"(?i){x}" if pattern.flags & 2 else x
        each.append(f"""SELECT doc_id, '{kind}' AS kind, {k} AS rank, start, start + length(m[i]) AS stop FROM (
  SELECT doc_id, m, g, i, CAST(list_sum(list_transform(s[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda v: length(v))), 0) AS BIGINT) AS start FROM (
    SELECT doc_id, m, g, s, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(t, '{x}') AS m, regexp_extract_all(t, '{x}', {group}) AS g, string_split_regex(t, '{x}') AS s FROM d) a) b) c WHERE length(g[i]) >= {least}""")
    base = ", ".join(f"'{k}'" for k in secrets.BASE)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secrets.BASE)
    shown = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), spans AS ({" UNION ALL ".join(each)})
SELECT d.doc_id, {counts}, sha256(coalesce({shown} FILTER (kind IN ({base})), '')) AS base_sha256, coalesce({shown} FILTER (kind IS NOT NULL), '') AS spans
FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id"""


def ngram_join_sql(words: int = 5, percent: int = 80) -> str:
    """For small tables: it counts the overlap of every two documents that share a shingle."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + {words} - 1], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - {words} + 2))) AS k FROM d WHERE len(w) > 0) s),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b, root FROM reach JOIN sides ON a = node)
SELECT node AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(root) AS component_id FROM reach LEFT JOIN sizes ON doc_id = node GROUP BY node"""


def substring_dedup_sql(window: int = 13) -> str:
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT r, doc_id, k, array_to_string(w[k:k + {window} - 1], ' ') AS x FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - {window} + 2)) AS k FROM d WHERE len(w) >= {window}) s),
firsts AS (SELECT x, min(doc_id) AS least FROM grams GROUP BY x),
gone AS (SELECT r, list(DISTINCT p) AS places FROM (SELECT r, unnest(range(k, k + {window})) AS p FROM grams JOIN firsts USING (x) WHERE least < doc_id) g GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(len(places), 0) AS n_removed,
  sha256(array_to_string(CASE WHEN places IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(places, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (r)"""


def collocations_sql(longest: int = 4, least: int = 30, top: int = 2000, absorbed: int = 80) -> str:
    return rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOW}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, m, array_to_string(w[k:k + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM w, range(1, {longest} + 1) s(m) WHERE len(w) >= m) g),
f AS (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= {least}),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS v FROM f WHERE m > 1),
cuts AS (SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a // (x.a::HUGEINT + y.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(v[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(v[k + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, a, array_to_string(v[i:i + size - 1], ' ') AS phrase FROM (SELECT lang, a, v, size, unnest(range(1, m - size + 2)) AS i FROM c, range(2, {longest}) s(size) WHERE size < m) s),
gone AS (SELECT lang, phrase FROM c JOIN (SELECT lang, phrase, max(a) AS longer FROM inner_ GROUP BY ALL) i USING (lang, phrase) WHERE 100::HUGEINT * longer >= {absorbed}::HUGEINT * a)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best ANTI JOIN gone USING (lang, phrase)) b JOIN totals USING (lang)
WHERE rank <= {top}"""


def lexical_search_sql(k: int = 10) -> str:
    terms = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS w FROM documents),
b AS (SELECT row_number() OVER () AS q, item_id, {terms} AS w FROM benchmark),
sizes AS (SELECT count(*) FILTER (len(w) > 0) AS N, sum(len(w))::BIGINT AS L FROM d),
wanted AS (SELECT DISTINCT q, item_id, unnest(w) AS t FROM b),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) s SEMI JOIN wanted USING (t) GROUP BY ALL),
weights AS (SELECT t, floor(1000 * ln((2 * N + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, sizes GROUP BY t, N),
norms AS (SELECT r, doc_id, 10 + (90 * len(w) * N) // L AS m FROM d, sizes WHERE len(w) > 0),
scores AS (SELECT q, item_id, r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM wanted JOIN tf USING (t) JOIN weights USING (t) JOIN norms USING (r) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) s WHERE rank <= {k}"""
