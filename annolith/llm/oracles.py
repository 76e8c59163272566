"""DuckDB SQL for the corpus operators that SQL can express, over whole tables."""

BLANK = r"[\x20\x09-\x0D]"
TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

NEAR = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BLANK}+'), lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words
), grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach(x, y) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.y) AS component_id, s.doc_id = min(r.y) AS kept
FROM sets s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, len(s.s)
"""

LINES = f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), trimmed AS (SELECT *, trim(line, {TRIM}) AS t FROM lines
), spread AS (
  SELECT t, count(DISTINCT coalesce('=' || source, 'null')) AS sites FROM trimmed WHERE t <> '' GROUP BY t
), marked AS (SELECT l.*, coalesce(s.sites, 0) >= 8 AS gone FROM trimmed l LEFT JOIN spread s ON l.t = s.t
), done AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept_text
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, n_lines, n_removed, CASE WHEN n_removed = 0 THEN d.text ELSE kept_text END AS text
FROM done JOIN documents d USING (doc_id)
"""

EXACT = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '{BLANK}', '', 'g') AS n FROM documents
), ranked AS (
  SELECT *, count(*) OVER (PARTITION BY n) AS group_size,
    first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS keep_id
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM ranked
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (SELECT page_id, h, octet_length(encode(h)) AS n, sha1(h) || '00' AS x, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(x, 1 + ((5 * i) // 4)::INT, 3))::INT >> (7 - (5 * i) % 4)::INT) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM d
"""

#: crc32 of a text's UTF-8 bytes: the table of the polynomial, then a step for each byte.
CRC_TABLE = "(SELECT list(list_reduce([n] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS crc FROM range(256) r(n))"


def crc32(x: str) -> str:
    """As an expression over x beside the table's column crc."""
    octets = f"list_transform(range(1, octet_length(encode({x})) + 1), lambda i: ('0x' || substr(hex(encode({x})), (2 * i - 1)::INT, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce([4294967295::BIGINT] || {octets}, lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])))"


RESAMPLED = rf"""
WITH words AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM (SELECT doc_id, text FROM documents UNION ALL SELECT NULL, text FROM benchmark)
), numbered AS (SELECT doc_id, w, row_number() OVER () AS r, count(doc_id) OVER (PARTITION BY doc_id) > 0 AS mine FROM words
), told AS (SELECT r, doc_id, mine, unnest(w) AS f FROM numbered
), buckets AS (SELECT f, {crc32("f")} % 10000 AS b FROM (SELECT DISTINCT f FROM told), {CRC_TABLE}
), placed AS (SELECT r, mine, b FROM told JOIN buckets USING (f)
), sums AS (SELECT b, count(*) FILTER (WHERE mine) AS s, count(*) FILTER (WHERE NOT mine) AS t FROM placed GROUP BY b
), gains AS (
  SELECT b, floor(1000.0::DOUBLE * ln(((t + 1) * ((SELECT sum(s) FROM sums) + 10000))::DOUBLE / ((s + 1) * ((SELECT sum(t) FROM sums) + 10000))::DOUBLE))::BIGINT AS g FROM sums
), weighed AS (
  SELECT n.doc_id, len(n.w) AS n_features, coalesce((SELECT sum(g) FROM placed p JOIN gains USING (b) WHERE p.r = n.r), 0)::BIGINT AS total FROM numbered n WHERE mine
), scored AS (
  SELECT doc_id, n_features, CASE WHEN n_features = 0 THEN 0 ELSE (total - ((total % n_features) + n_features) % n_features) // n_features END AS weight,
    floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS noise
  FROM weighed
), ranked AS (
  SELECT *, weight + noise AS score, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id) AS place, count(*) FILTER (WHERE n_features >= 20) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight::BIGINT AS weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM ranked
"""


TRIE = f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(text, '') AS text, md5(coalesce(role, '')) || md5(coalesce(text, '')) AS k,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), text NULLS FIRST) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (SELECT c, c - c % 100 AS base, {crc32("c::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT c FROM t), {CRC_TABLE}
), whole AS (
  SELECT v.c, 0 AS part, b.pos, b.k, b.text FROM convs v JOIN t b ON b.c = v.base AND b.pos < v.h
  UNION ALL SELECT v.c, 1, o.pos, o.k, o.text FROM convs v JOIN t o ON o.c = v.c AND o.pos >= v.h
), lists AS (
  SELECT v.c, coalesce(list(w.k ORDER BY part, pos) FILTER (WHERE w.k IS NOT NULL), []) AS ks, coalesce(list(length(w.text) ORDER BY part, pos) FILTER (WHERE w.k IS NOT NULL), []) AS ls
  FROM convs v LEFT JOIN whole w USING (c) GROUP BY v.c
), prefixes AS (
  SELECT c, d, array_to_string(ks[1:d], ',') AS key, CASE WHEN d > 0 THEN array_to_string(ks[1:d - 1], ',') END AS above, CASE WHEN d > 0 THEN ls[d] ELSE 0 END AS chars, d = len(ks) AS ends
  FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS d FROM lists)
), nodes AS (
  SELECT d, key, any_value(above) AS above, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM prefixes GROUP BY d, key
), children AS (SELECT d - 1 AS d, above AS key, count(*) AS n FROM nodes WHERE d > 0 GROUP BY d, above
), under AS (
  -- A node's first member names its path, so each node below meets its ancestors once.
  SELECT p.d, p.key, sum(n.saved) AS saved, count(*) FILTER (WHERE ch.n IS NULL) AS leaves
  FROM nodes n LEFT JOIN children ch ON ch.d = n.d AND ch.key = n.key JOIN prefixes p ON p.c = n.conv_id AND p.d <= n.d GROUP BY p.d, p.key
)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(ch.n, 0) AS n_children, u.leaves AS n_leaves, u.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN under u ON u.d = n.d AND u.key = n.key LEFT JOIN children ch ON ch.d = n.d AND ch.key = n.key LEFT JOIN nodes up ON up.d = n.d - 1 AND up.key = n.above
"""


def all_sql() -> dict[str, str]:
    return {"op3_minhash_near_dedup": NEAR, "op6_line_dedup": LINES, "op7_exact_dedup": EXACT, "op8_warc_archive": WARC, "op11_prefix_trie": TRIE, "op13_importance_resampling": RESAMPLED}
