"""DuckDB SQL of the queries of this package that SQL can express."""

MERKLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         coalesce(lead(coalesce(text, '')) OVER w, first_value(coalesce(text, '')) OVER w) AS nxt
  FROM documents WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, text)
), e AS (
  SELECT *, length(text) AS n, left(text, (length(text) - length(text) // 3)::BIGINT) || left(nxt, (length(text) // 3)::BIGINT) AS edited FROM d
), texts AS (
  SELECT doc_id, unnest(['own', 'edited', 'next']) AS kind, unnest([text, edited, nxt]) AS t FROM e
), cut AS (
  SELECT doc_id, kind, t, list_transform(string_split_regex(t, '\n[ \t\r]*\n[ \t\r\n]*'), lambda s: list_transform(string_split(s, chr(10)), lambda p: list_transform(regexp_extract_all(p, '[^.!?]{1,48}[.!?]*|[.!?]+'), lambda x: substr(md5(x), 1, 8)))) AS tree FROM texts
), par AS (
  SELECT doc_id, kind, t, list_transform(tree, lambda s: list_transform(s, lambda p: {'h': substr(md5(array_to_string(p, ',')), 1, 12), 'n': len(p), 'leaves': array_to_string(p, ',')})) AS ps FROM cut
), sec AS (
  SELECT doc_id, kind, t, list_transform(ps, lambda s: {'h': substr(md5(array_to_string(list_transform(s, lambda p: p.h), ',')), 1, 12), 'n': len(s),
    'paragraphs': array_to_string(list_transform(s, lambda p: p.h || ':' || p.n), ','),
    'leaves': array_to_string(list_filter(list_transform(s, lambda p: p.leaves), lambda x: x <> ''), ',')}) AS ss FROM par
), prints AS (
  SELECT doc_id, kind, substr(sha256(array_to_string(list_transform(ss, lambda s: s.h), ',') || '/' || t), 1, 32) || '.' ||
    array_to_string(list_transform(ss, lambda s: s.h || ':' || s.n), ',') || '.' ||
    array_to_string(list_transform(ss, lambda s: s.paragraphs), ',') || '.' ||
    array_to_string(list_filter(list_transform(ss, lambda s: s.leaves), lambda x: x <> ''), ',') AS fp FROM sec
), three AS (
  SELECT e.doc_id, e.n, e.edited, a.fp AS fa, b.fp AS fb, c.fp AS fc
  FROM e JOIN prints a ON a.doc_id = e.doc_id AND a.kind = 'own' JOIN prints b ON b.doc_id = e.doc_id AND b.kind = 'edited' JOIN prints c ON c.doc_id = e.doc_id AND c.kind = 'next'
), lists AS (
  SELECT *, list_distinct(list_filter(string_split(string_split(fa, '.')[4], ','), lambda x: x <> '')) AS la,
    list_distinct(list_filter(string_split(string_split(fb, '.')[4], ','), lambda x: x <> '')) AS lb,
    list_distinct(list_filter(string_split(string_split(fc, '.')[4], ','), lambda x: x <> '')) AS lc,
    list_transform(string_split(string_split(fa, '.')[3], ','), lambda p: substr(p, 1, 12)) AS pa,
    list_transform(string_split(string_split(fb, '.')[3], ','), lambda p: substr(p, 1, 12)) AS pb
  FROM three
)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, fa AS fingerprint, fb AS edited_fingerprint,
  CASE WHEN fa = fb THEN 1.0::DOUBLE WHEN len(la) + len(lb) = 0 THEN 0.0::DOUBLE ELSE round(2.0::DOUBLE * len(list_intersect(la, lb)) / (len(la) + len(lb)), 6) END AS near_edited,
  CASE WHEN fa = fc THEN 1.0::DOUBLE WHEN len(la) + len(lc) = 0 THEN 0.0::DOUBLE ELSE round(2.0::DOUBLE * len(list_intersect(la, lc)) / (len(la) + len(lc)), 6) END AS near_next,
  CASE WHEN left(fa, 32) = left(fb, 32) THEN []::INTEGER[] ELSE list_transform(list_filter(range(len(pb)), lambda k: NOT list_contains(pa, pb[k + 1])), lambda k: k::INTEGER) END AS edited_paragraphs
FROM lists
"""

WARC = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), k AS (
  SELECT payload_digest, max(page_id) AS keep FROM p WHERE payload_bytes >= 1000 GROUP BY 1 HAVING count(*) > 1
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN keep IS NOT NULL AND p.page_id IS DISTINCT FROM keep THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keep IS NOT NULL AND p.page_id IS DISTINCT FROM keep THEN keep END AS refers_to
FROM p LEFT JOIN k USING (payload_digest)
"""

LEXICAL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL
), sized AS (
  SELECT doc_id, k, terms, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0
), whole AS (
  SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM sized
), tf AS (
  SELECT k, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT k, doc_id, n, unnest(terms) AS term FROM sized) GROUP BY ALL
), df AS (
  SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE text IS NOT NULL
), scored AS (
  SELECT item_id, k, doc_id, sum(floor(1000.0::DOUBLE * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT *
    ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_docs) // n_terms)))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term), whole GROUP BY item_id, k, doc_id
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, k) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
"""
