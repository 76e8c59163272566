"""DuckDB SQL for the queries of the catalogue. Shared steps are common table expressions."""

from __future__ import annotations

from annolith.operators.render import CLIP_STYLE, STYLE

def key_form(x: str) -> str:
    return rf"lower(trim(regexp_replace({x}, '\s+', ' ', 'g')))"


def comparison_form(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(strip_accents(replace({x}, 'ß', 'ss'))), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def set_hash(column: str, where: str) -> str:
    return f"sha1(coalesce(string_agg(DISTINCT {column}, '||' ORDER BY {column}) FILTER (WHERE {where}), ''))"


MONTH = "['janeiro','fevereiro','março','abril','maio','junho','julho','agosto','setembro','outubro','novembro','dezembro']"
DATE_LABEL = f"(day(ts)::VARCHAR || ' de ' || {MONTH}[month(ts)] || ' de ' || year(ts)::VARCHAR)"

TALKS = f"""talks AS (
  SELECT conv_id, turn, conv_id * 1000000 + turn AS seq, 'Conversation ' || conv_id AS title, 'corpus' AS author,
    sha1({key_form("'Conversation ' || conv_id")} || '||corpus') AS book_key,
    CASE role WHEN 'user' THEN 'highlight' WHEN 'assistant' THEN 'note' WHEN 'system' THEN 'bookmark' ELSE 'unknown' END AS type,
    turn * 10 AS start_pos, turn * 10 + 9 AS end_pos, text AS content, count(*) OVER (PARTITION BY conv_id) AS turns
  FROM conversations
), hashed AS (
  SELECT *, sha1(type || '|' || start_pos || '|' || end_pos || '|None|' || {key_form("content")}) AS eh,
    sha1(type || '|' || start_pos || '|' || end_pos || '|' || {key_form("content")}) AS hh
  FROM talks
)"""

BOOKS = f"""{TALKS}, books AS (
  SELECT book_key, any_value(title) AS title, any_value(author) AS author, any_value(turns) AS turns,
    {set_hash("eh", "true")} AS content_hash, {set_hash("hh", "type = 'highlight'")} AS highlight_hash,
    string_agg(DISTINCT eh, ',' ORDER BY eh) AS entry_list,
    count(DISTINCT hh) FILTER (WHERE type = 'highlight') AS n_high,
    count(DISTINCT hh) FILTER (WHERE type = 'highlight' AND turn >= 2) AS n_high_2,
    count(DISTINCT hh) FILTER (WHERE type = 'highlight' AND turn >= 4) AS n_high_4,
    {set_hash("eh", "turn < 2")} AS then_hash, {set_hash("hh", "type = 'highlight' AND turn < 2")} AS then_high,
    string_agg(DISTINCT eh, ',' ORDER BY eh) FILTER (WHERE turn < 2) AS then_list,
    count(*) FILTER (WHERE type = 'highlight' AND turn < 2) AS then_highlights,
    count(*) FILTER (WHERE type = 'note' AND turn < 2) AS then_notes,
    {set_hash("eh", "turn < 4")} AS sent_hash,
    count(*) FILTER (WHERE type = 'highlight' AND turn < 4) AS sent_highlights,
    count(*) FILTER (WHERE type = 'highlight') AS highlight_count, count(*) FILTER (WHERE type = 'note') AS note_count,
    count(*) FILTER (WHERE type = 'bookmark') AS bookmark_count
  FROM hashed GROUP BY book_key
), classed AS (
  SELECT *, CASE WHEN turns < 2 THEN 'novo' WHEN turns < 3 THEN 'nunca_exportado' WHEN content_hash <> sent_hash THEN 'com_novidades' ELSE 'sem_novidades' END AS status,
    CASE WHEN turns < 3 THEN n_high WHEN sent_highlights > 0 THEN n_high_4 ELSE n_high_2 END AS new_highlights_count
  FROM books
), listed AS (
  SELECT *, CASE status WHEN 'novo' THEN 'Novo' WHEN 'nunca_exportado' THEN 'Pendente' WHEN 'com_novidades' THEN 'Alterado' ELSE 'Exportado' END AS status_label,
    CASE status WHEN 'novo' THEN 0 WHEN 'com_novidades' THEN 1 WHEN 'nunca_exportado' THEN 2 ELSE 3 END AS priority,
    status <> 'sem_novidades' AS default_selected,
    CASE WHEN turns >= 2 THEN '2024-01-10 06:00' ELSE '-' END AS last_analysis_display,
    CASE WHEN turns >= 3 THEN '2024-01-11 21:40' ELSE '-' END AS last_export_display
  FROM classed
)"""

EVENTS = """events2 AS (
  SELECT event_id AS seq, event_id AS start_pos, event_id + 3 AS end_pos, user_id, event_type AS type, props AS content, ts,
    sha1('user ' || user_id || '||events') AS book_key FROM events
)"""

TEXT_PAIRS = f"""{TALKS}, texts AS (SELECT *, {comparison_form("content")} AS t FROM talks
), words AS (SELECT *, list_distinct(list_filter(string_split(t, ' '), lambda w: w <> '')) AS w FROM texts
), p AS (
  SELECT a.seq AS old_seq, b.seq AS new_seq, a.t AS old_t, b.t AS new_t, a.w AS old_w, b.w AS new_w
  FROM words a JOIN words b ON a.conv_id = b.conv_id AND a.type = b.type AND a.seq < b.seq
)"""


def _fields(line: str, end: str) -> str:
    """The metadata lines; line has {n} for the label and {v} for the value."""
    one = lambda n, v: line.format(n=n, v=v)
    positions = f"CASE WHEN marks > 0 THEN {one('Posições marcadas', 'positions')} ELSE '' END"
    return " || ".join([one("Autor", "'corpus'"), one("Total de destaques", "highlights"), one("Total de notas", "notes"), positions, one("Período", "'Período desconhecido'"), one("Gerado em", "'15 de janeiro de 2024'"), end])


#: Entries that the last export of their book did not hold.
FRESH = "NOT EXISTS (SELECT 1 FROM hashed s WHERE s.turns >= 3 AND s.turn < 4 AND s.book_key = h.book_key AND s.eh = h.eh)"


def _rendered(entry: str, before: str, after: str = "''", between: str = "''", where: str = "true") -> str:
    return f"""WITH {TALKS}, parts AS (
  SELECT *, 'Posição: ' || start_pos || '-' || end_pos AS place, coalesce(content, '') AS c FROM hashed h WHERE {where}
), shown AS (SELECT *, CASE WHEN type = 'bookmark' OR c <> '' THEN {entry} END AS part FROM parts
), g AS (
  SELECT book_key, any_value(title) AS title, any_value(title) || ' - corpus' AS full_title, count(*) FILTER (WHERE type = 'highlight') AS highlights,
    count(*) FILTER (WHERE type = 'note') AS notes, count(*) FILTER (WHERE type = 'bookmark') AS marks,
    string_agg(start_pos::VARCHAR, ', ' ORDER BY start_pos, seq) FILTER (WHERE type = 'bookmark') AS positions,
    coalesce(string_agg(part, {between} ORDER BY start_pos, seq), '') AS body, count(part) AS n_parts
  FROM shown GROUP BY book_key
), rendered AS (SELECT *, {before} || body || {after} AS content FROM g) SELECT book_key, content FROM rendered"""


NL = "chr(10)"


def text(x: str) -> str:
    """A Python text as an SQL literal."""
    return " || chr(10) || ".join("'" + line.replace("'", "''") + "'" for line in x.split("\n"))


def escaped(x: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{raw}', '{safe}')"
    return x


def _page(title: str, style: str, head: str) -> str:
    return f"""{text('<!DOCTYPE html>')} || {NL} || '<html lang="pt-BR">' || {NL} || '<head>' || {NL} || '<meta charset="UTF-8">' || {NL}
      || '<meta name="viewport" content="width=device-width, initial-scale=1.0">' || {NL} || '<title>' || {escaped(title)} || '</title>' || {NL} || {head}
      || {text("<style>" + style + "</style>")} || {NL} || '</head>' || {NL} || '<body>' || {NL} || '<h1>' || {escaped(title)} || '</h1>' || {NL}"""


END = f"'</body>' || {NL} || '</html>'"
PREFIX = "CASE type WHEN 'note' THEN 'NOTA ' WHEN 'bookmark' THEN 'MARCADOR ' ELSE '' END"
HTML = _rendered(
    f"""'<div class="entry ' || CASE type WHEN 'note' THEN 'note' ELSE 'highlight' END || '">' || {NL} || '<div class="entry-meta">' || {PREFIX} || {escaped("place")} || '</div>' || {NL}
      || '<div class="entry-content">' || {escaped("c")} || '</div>' || {NL} || '</div>' || {NL}""",
    _page("full_title", STYLE, "''") + f" || '<div class=\"metadata\">' || {NL} || " + _fields(f"('<p><strong>{{n}}:</strong> ' || {{v}} || '</p>' || {NL})", f"'</div>' || {NL}"),
    END,
)
_NAMES = ("type", "title", "author", "contributors", "pages", "language", "isbn", "created", "source", "format", "genres", "series", "volume", "started", "finished", "status", "rating", "documented")
_KNOWN = {"type": "' \"livro\"'", "title": "' \"' || title || '\"'", "author": "' \"corpus\"'", "created": "' 2024-01-15'", "format": f"{NL} || '  - \"ebook\"'", "documented": "' true'"}
FRONT = f"'---' || {NL} || " + f" || {NL} || ".join(f"'{n}:'" + (f" || {_KNOWN[n]}" if n in _KNOWN else "") for n in _NAMES) + f" || {NL} || '---' || {NL}"
QUOTE = f"array_to_string(list_transform(string_split(c, {NL}), lambda l: CASE WHEN l = '' THEN '>' ELSE '> ' || l END), {NL})"


def _info(line: str, by: str) -> str:
    """The fields of the metadata callout, joined; {n} and {v} as in _fields."""
    one = lambda n, v: line.format(n=n, v=v)
    positions = f"CASE WHEN marks > 0 THEN {by} || {one('Posições marcadas', 'positions')} ELSE '' END"
    return f"{one('Total de destaques', 'highlights')} || {by} || {one('Total de notas', 'notes')} || {positions} || {by} || {one('Período', chr(39) + 'Período desconhecido' + chr(39))} || {by} || {one('Gerado em', chr(39) + '15 de janeiro de 2024' + chr(39))}"


VAULT = _rendered(
    f"CASE type WHEN 'bookmark' THEN '**Marcador** — ' || place WHEN 'note' THEN '> [!note] Nota — ' || place || {NL} || {QUOTE} ELSE '> [!quote] ' || place || {NL} || {QUOTE} END",
    f"{FRONT} || {NL} || '# Citações e Destaques' || {NL} || {NL} || '> [!info]- Metadados do recorte' || {NL} || " + _info("'> **{n}**: ' || {v}", f"'  ' || {NL}") + f" || CASE WHEN n_parts > 0 THEN {NL} || {NL} ELSE '' END",
    NL,
    f"{NL} || {NL}",
)
PARAGRAPHS = f"""array_to_string(list_transform(list_filter(string_split_regex(c, '\\n[ \\t]*\\n'), lambda q: regexp_replace(q, '\\s', '', 'g') <> ''),
      lambda q: '<p>' || replace({escaped("q")}, {NL}, '<br>') || '</p>'), '')"""


def _callout(kind: str, fold: str, title: str, body: str) -> str:
    return f"""'<div class="callout" data-callout="{kind}"{fold}><div class="callout-title"><div class="callout-title-inner">' || {escaped(title)} || '</div></div><div class="callout-content">' || {body} || '</div></div>'"""


_BEFORE_CLIPS = (
    """'<script type="application/ld+json">{"@context":"https://schema.org","@type":"Book","name":"' || title || '","author":[{"@type":"Person","name":"corpus"}],"bookFormat":"EBook"}</script>' || """
    + NL
)
CLIP = _rendered(
    f"CASE type WHEN 'bookmark' THEN '<p><strong>Marcador</strong> — ' || {escaped('place')} || '</p>' WHEN 'note' THEN {_callout('note', '', chr(39) + 'Nota — ' + chr(39) + ' || place', PARAGRAPHS)} ELSE {_callout('quote', '', 'place', PARAGRAPHS)} END",
    _page("title", CLIP_STYLE, _BEFORE_CLIPS)
    + f""" || '<p>corpus</p>' || {NL} || '<div data-testid="highlights">' || {NL} || """
    + _callout("info", ' data-callout-fold="-"', "'Metadados do recorte'", "'<p>' || " + _info("'<strong>{n}</strong>: ' || {v}", "'<br>'") + " || '</p>'")
    + f" || CASE WHEN n_parts > 0 THEN {NL} ELSE '' END",
    f"{NL} || '</div>' || {NL} || {END}",
    NL,
)
TXT = _rendered(
    f"CASE type WHEN 'note' THEN 'NOTA ' WHEN 'bookmark' THEN 'MARCADOR ' ELSE '' END || place || {NL} || CASE WHEN c = '' THEN '' ELSE c || {NL} || {NL} END",
    f"full_title || {NL} || repeat('=', length(full_title)) || {NL} || {NL} || " + _fields(f"('{{n}}: ' || {{v}} || {NL})", f"{NL} || repeat('-', 50) || {NL} || {NL}"),
)
_MARKDOWN = (
    f"CASE type WHEN 'note' THEN '- **NOTA** ' || place || {NL} || '**' || c || '**' WHEN 'bookmark' THEN '- **MARCADOR** ' || place ELSE '- ' || place || {NL} || c END || {NL} || {NL}",
    f"'# ' || full_title || {NL} || {NL} || " + _fields(f"('**{{n}}**: ' || {{v}} || '  ' || {NL})", f"{NL} || '---' || {NL} || {NL}"),
)
MARKDOWN, MARKDOWN_FRESH = _rendered(*_MARKDOWN), _rendered(*_MARKDOWN, where=FRESH)
PATH = "lower(replace(b.title, ' ', '-')) || '-corpus'"
BOTH = f"""both_ AS (SELECT 'markdown' AS format, 'md' AS ext, 'text/markdown; charset=utf-8' AS mime_type, book_key, content FROM ({MARKDOWN})
  UNION ALL SELECT 'html', 'html', 'text/html; charset=utf-8', book_key, content FROM ({HTML}))"""


def fold(length: int, kind: str, moment: str) -> str:
    """The fold of events, entry by entry within an island of ranges that touch. Ranges all have that length and are never
    equal, so position_overlap is the one rule that can hold; texts have two words: related if one holds the other."""
    units, share = "(x.e - e.start_pos + 1)", f"((x.e - e.start_pos + 1)::DOUBLE / {length})"
    mine = "{'opened': e.seq, 's': e.start_pos, 'e': e.end_pos, 'ts': e.ts, 't': e.t}"
    return f"""{EVENTS}, placed AS (
  SELECT * REPLACE ({kind} AS type, {moment} AS ts, start_pos + {length} - 1 AS end_pos), {comparison_form("content")} AS t FROM events2
), opened AS (SELECT *, coalesce(start_pos > lag(end_pos) OVER w, true)::INT AS opens FROM placed WINDOW w AS (PARTITION BY book_key, type ORDER BY seq)
), numbered AS (SELECT *, sum(opens) OVER (PARTITION BY book_key, type ORDER BY seq) AS island FROM opened
), e AS (SELECT *, row_number() OVER (PARTITION BY book_key, type, island ORDER BY seq) AS k FROM numbered
), fold AS (
  SELECT book_key, type, island, k, seq, [{mine}] AS slots, 'append' AS action, NULL::VARCHAR AS reason, NULL::INT AS priority, NULL::DOUBLE AS score, seq AS matched_slot FROM e WHERE k = 1
  UNION ALL
  SELECT book_key, type, island, k, seq,
    CASE WHEN best = 0 THEN list_append(slots, mine) WHEN better THEN list_transform(slots, lambda x, i: CASE WHEN i = pos THEN {{'opened': x.opened, 's': mine.s, 'e': mine.e, 'ts': mine.ts, 't': mine.t}} ELSE x END) ELSE slots END,
    CASE WHEN best = 0 THEN 'append' WHEN better THEN 'replace' ELSE 'drop' END,
    CASE WHEN best > 0 THEN 'position_overlap' || CASE WHEN better THEN '_replaced_by_preferred_record' ELSE '_kept_existing_preferred_record' END END,
    CASE WHEN best > 0 THEN 80 END, CASE WHEN best > 0 THEN best END, CASE WHEN best > 0 THEN held.opened ELSE seq END
  FROM (
    SELECT *, (held.ts IS NULL AND mine.ts IS NOT NULL) OR held.ts < mine.ts OR (held.ts IS NOT DISTINCT FROM mine.ts AND (length(held.t) < length(mine.t) OR (length(held.t) = length(mine.t) AND held.e < mine.e))) AS better
    FROM (
      SELECT *, slots[pos] AS held FROM (
        SELECT *, list_max(shares) AS best, list_position(shares, list_max(shares)) AS pos FROM (
          SELECT e.book_key, e.type, e.island, e.k, e.seq, f.slots, {mine} AS mine,
            list_transform(f.slots, lambda x: CASE WHEN {units} > 0 AND ({share} >= 0.6 OR {units} >= 3 OR abs(epoch_us(e.ts) - epoch_us(x.ts)) <= 900000000)
                AND e.t <> '' AND x.t <> '' AND (contains(e.t, x.t) OR contains(x.t, e.t)) THEN {share} ELSE 0.0::DOUBLE END) AS shares
          FROM fold f JOIN e ON e.book_key = f.book_key AND e.type = f.type AND e.island = f.island AND e.k = f.k + 1))))
)"""


_OLD, _NEW = comparison_form("c0"), comparison_form("c1")
#: Books of two entries: the rungs by what the variants are made to be. A text of 40 to 180
#: characters with a strange word in its middle keeps nearly all characters; one with another character there all but that one.
RUNGS = f"""WITH v AS (
  SELECT *, turn * 100 AS s, length(t) // 2 AS half, unnest(range(11)) AS variant FROM (SELECT conv_id, turn, text AS t FROM conversations WHERE length(text) BETWEEN 40 AND 180)
), c AS (
  SELECT *, (conv_id * 1000000 + turn) * 100 + variant * 2 AS seq, sha1('turn ' || conv_id || ' ' || turn || ' ' || variant || '||corpus') AS book_key,
    CASE WHEN variant = 8 THEN '' ELSE t END AS c0,
    CASE variant WHEN 0 THEN t || '!' WHEN 1 THEN left(t, half) WHEN 2 THEN substr(t, half + 1) WHEN 3 THEN t WHEN 4 THEN left(t, half) || ' zzqy ' || substr(t, half + 1)
      WHEN 5 THEN array_to_string(list_reverse(string_split(t, ' ')), ' ') WHEN 6 THEN left(t, half) WHEN 7 THEN left(t, half) || '§' || substr(t, half + 2) WHEN 8 THEN '...' WHEN 9 THEN '§§' ELSE t END AS c1
  FROM v
), f AS (SELECT *, {_OLD} AS a, {_NEW} AS b, length(c1) AS n FROM c
), r AS (
  SELECT *, CASE WHEN length(a) <= length(b) THEN a <> '' AND contains(b, a) ELSE b <> '' AND contains(a, b) END AS holds,
    least(length(a), length(b)) >= 40 OR least(length(a), length(b)) >= 0.45 * greatest(length(a), length(b)) AS near,
    list_distinct(string_split(a, ' ')) AS wa, list_distinct(string_split(b, ' ')) AS wb
  FROM f
), d AS (
  SELECT *, CASE
    WHEN variant = 0 AND a = b THEN 'exact_duplicate'
    WHEN variant IN (1, 4) AND holds THEN 'same_start_containment'
    WHEN variant IN (0, 2) AND holds THEN 'same_range_containment'
    WHEN variant IN (3, 5) AND a <> '' AND ((holds AND near) OR len(list_intersect(wa, wb)) / greatest(len(wa), len(wb)) >= 0.75) THEN 'position_overlap'
    WHEN variant = 4 AND len(list_intersect(wa, wb)) / len(wa) >= 0.75 THEN 'same_start_expansion'
    WHEN variant IN (6, 7, 9) AND holds AND near THEN 'text_containment_without_position'
    WHEN variant = 7 AND 2.0 * (n - 1) / (2 * n) >= 0.8 THEN 'similarity_fallback'
    WHEN variant = 8 THEN 'similarity_fallback_empty_content' END AS why
  FROM r
), e AS (
  SELECT *, length(b) > length(a) OR (length(b) = length(a) AND variant IN (3, 5)) AS better FROM d
)
SELECT book_key, seq, 'append' AS action, NULL::VARCHAR AS reason, NULL::INT AS priority, NULL::DOUBLE AS score, seq AS matched_slot FROM e
UNION ALL
SELECT book_key, seq + 1, CASE WHEN why IS NULL THEN 'append' WHEN better THEN 'replace' ELSE 'drop' END,
  why || CASE WHEN better THEN '_replaced_by_preferred_record' ELSE '_kept_existing_preferred_record' END,
  CASE WHEN why LIKE 'exact%' THEN 100 WHEN why LIKE 'same_start_c%' THEN 90 WHEN why LIKE 'same_range%' THEN 85 WHEN why LIKE 'pos%' THEN 80 WHEN why LIKE 'same_start_e%' THEN 75 WHEN why LIKE 'text%' THEN 60 WHEN why IS NOT NULL THEN 50 END,
  CASE WHEN why LIKE 'pos%' THEN 0.6 WHEN why = 'similarity_fallback' THEN round((n - 1)::DOUBLE / n, 9) WHEN why IS NOT NULL THEN 1.0 END::DOUBLE,
  CASE WHEN why IS NULL THEN seq + 1 ELSE seq END
FROM e"""
WORD_SETS = f"""WITH t AS (
  SELECT doc_id, sha1({key_form("source")} || '||' || {key_form("lang")}) AS book_key, {comparison_form("coalesce(text, '')")} AS t FROM documents
), w AS (SELECT *, list_sort(list_distinct(list_filter(string_split(t, ' '), lambda x: x <> ''))) AS w FROM t
), classed AS (SELECT *, min(doc_id) OVER (PARTITION BY book_key, w) AS class_seq FROM w
), reps AS (SELECT book_key, class_seq, any_value(w) AS w, count(*) AS copies FROM classed GROUP BY book_key, class_seq)"""
HELD_TEXTS = f"""WITH t AS (
  SELECT doc_id, sha1({key_form("source")} || '||' || {key_form("lang")}) AS book_key, {comparison_form("coalesce(text, '')")} AS t FROM documents
), reps AS (SELECT book_key, t, min(doc_id) AS class_seq, count(*) AS copies FROM t WHERE t <> '' GROUP BY book_key, t)"""
FOLD = fold(4, "type", "ts")
CROWDED = fold(301, "'highlight'", "CASE WHEN seq % 4 <> 0 THEN ts END")
HELD = "SELECT book_key, type, matched_slot AS slot_seq, max(seq) AS seq FROM fold WHERE action <> 'drop' GROUP BY book_key, type, matched_slot"
FILES = f"""files AS (SELECT format || '/' || {PATH} || '.' || ext AS path, sha1(content) AS sha1 FROM both_ JOIN books b ON b.book_key = both_.book_key)"""
CLIPPINGS = """string_agg(title || ' (corpus)' || chr(10) || '- Seu ' || CASE type WHEN 'highlight' THEN 'destaque' WHEN 'note' THEN 'nota' WHEN 'bookmark' THEN 'marcador' ELSE 'recorte' END
              || ' posição ' || start_pos || '-' || end_pos || ' | ' || chr(10) || chr(10) || content || chr(10) || '==========' || chr(10), '' ORDER BY seq)"""


def all_sql() -> dict[str, str]:
    return {
        "dedup_rungs": RUNGS,
        "split_scan": f"""WITH {TALKS}, one AS (
              SELECT conv_id // 100 AS hundred, row_number() OVER (PARTITION BY conv_id // 100 ORDER BY seq) - 1 AS seq, title || ' (corpus)' || chr(10) || '- Seu '
                || CASE type WHEN 'highlight' THEN 'destaque' WHEN 'note' THEN 'nota' WHEN 'bookmark' THEN 'marcador' ELSE 'recorte' END || ' posição ' || start_pos || '-' || end_pos || ' | ' || chr(10) || chr(10) || content AS raw FROM talks
            ), whole AS (SELECT hundred, string_agg(raw || chr(10) || '==========' || chr(10), '' ORDER BY seq) AS w FROM one GROUP BY hundred)
            SELECT hundred, seq, sha1(trim(raw)) AS raw_sha1, octet_length(encode(w)) AS size, sha1(w) AS analysis_id FROM one JOIN whole USING (hundred)""",
        "word_set_pairs": f"""{WORD_SETS}, p AS (
              SELECT a.book_key, a.class_seq AS old_seq, b.class_seq AS new_seq, len(list_intersect(a.w, b.w)) AS shared, greatest(len(a.w), len(b.w)) AS n, a.copies AS old_copies, b.copies AS new_copies
              FROM reps a JOIN reps b ON a.book_key = b.book_key AND a.class_seq < b.class_seq AND len(a.w) > 0 AND len(b.w) > 0)
            SELECT book_key, old_seq, new_seq, shared, round(shared::DOUBLE / n, 9) AS both_ways, old_copies, new_copies FROM p WHERE shared::DOUBLE / n >= 0.75""",
        "word_set_classes": f"{WORD_SETS} SELECT book_key, doc_id AS seq, class_seq FROM classed",
        "contained_documents": f"""{HELD_TEXTS} SELECT a.book_key, a.class_seq AS short_seq, b.class_seq AS long_seq,
            length(a.t) >= 40 OR length(a.t) / length(b.t) >= 0.45 AS nearby, a.copies AS short_copies, b.copies AS long_copies
            FROM reps a JOIN reps b ON a.book_key = b.book_key AND a.class_seq <> b.class_seq AND length(a.t) < length(b.t) AND contains(b.t, a.t)""",
        "book_snapshot_counts": f"WITH {BOOKS} SELECT book_key, title, author, highlight_count, note_count, bookmark_count FROM books",
        "book_keys": f"""WITH n AS (SELECT DISTINCT source AS title, lang AS author FROM documents UNION ALL SELECT DISTINCT p_name, p_brand FROM part)
            SELECT title, author, sha1({key_form("title")} || '||' || {key_form("author")}) AS book_key FROM n""",
        "entry_signatures": f"WITH {TALKS} SELECT book_key, seq, eh AS entry_hash, hh AS highlight_hash FROM hashed",
        "snapshot_hashes": f"WITH {BOOKS} SELECT book_key, content_hash, highlight_hash, entry_list, n_high::INT AS n_highlight_hashes FROM books",
        "entry_sort": f"""WITH {EVENTS} SELECT book_key, row_number() OVER (PARTITION BY book_key ORDER BY start_pos, ts, seq)::INT AS place, type,
            NULL::BIGINT AS page, start_pos, end_pos, content, {DATE_LABEL} AS date_formatted FROM events2""",
        "status_sort": f"WITH {BOOKS} SELECT book_key, priority, lower(title) AS sort_title, lower(author) AS sort_author FROM listed",
        "status_classify": f"""WITH {BOOKS} SELECT book_key, status, status_label, new_highlights_count, new_highlights_count > 0 AS has_new_highlights,
            status <> 'sem_novidades' AS has_changes_since_export, default_selected, turns >= 2 AS was_processed_before, turns >= 3 AS was_exported_before,
            last_analysis_display, last_export_display FROM listed""",
        "books_table": f"""WITH {BOOKS} SELECT book_key, title, author, highlight_count AS highlights, note_count AS notes, bookmark_count AS bookmarks, status, status_label,
            new_highlights_count, new_highlights_count > 0 AS has_new_highlights, status <> 'sem_novidades' AS has_changes_since_export, default_selected,
            CASE WHEN turns >= 2 THEN '2024-01-10T09:00:00+00:00' END AS last_analysis_at, last_analysis_display,
            CASE WHEN turns >= 3 THEN '2024-01-12T00:40:00+00:00' END AS last_export_at, last_export_display,
            CASE WHEN turns >= 3 THEN 'markdown,txt' ELSE '' END AS last_export_formats,
            turns >= 2 AS was_processed_before, turns >= 3 AS was_exported_before, false AS forced_reprocess FROM listed""",
        "detected_status": f"""WITH {BOOKS} SELECT book_key, CASE WHEN turns < 2 THEN 'novo' WHEN content_hash = then_hash THEN 'sem_mudancas' ELSE 'atualizado' END AS detected_status,
            CASE WHEN turns < 2 THEN n_high WHEN content_hash = then_hash THEN 0 ELSE n_high_2 END AS detected_new FROM books""",
        "new_entries_anti": f"""WITH {TALKS} SELECT book_key, seq, eh AS entry_hash FROM hashed h
            WHERE NOT EXISTS (SELECT 1 FROM hashed s WHERE s.turns >= 3 AND s.turn < 4 AND s.book_key = h.book_key AND s.eh = h.eh)""",
        "known_keys_semi": f"""WITH ids AS (SELECT DISTINCT conv_id FROM conversations), asked AS (SELECT conv_id AS asked FROM ids UNION ALL SELECT conv_id + 10 FROM ids)
            SELECT sha1({key_form("'Conversation ' || asked")} || '||corpus') AS book_key, asked FROM asked WHERE asked IN (SELECT conv_id FROM ids)""",
        "range_overlap_pairs": f"""WITH {EVENTS}, p AS (SELECT a.seq AS old_seq, b.seq AS new_seq, a.end_pos - b.start_pos + 1 AS units, abs(epoch_us(a.ts) - epoch_us(b.ts)) AS us
              FROM events2 a JOIN events2 b ON a.book_key = b.book_key AND a.seq < b.seq AND b.start_pos <= a.end_pos)
            SELECT old_seq, new_seq, units, round(units / 4.0, 6)::DOUBLE AS share,
              CASE WHEN units / 4.0 >= 0.6 OR units >= 3 OR us <= 900000000 THEN round(units / 4.0, 6)::DOUBLE ELSE 0.0::DOUBLE END AS material, false AS same_range FROM p""",
        "same_session_pairs": f"""WITH {EVENTS} SELECT a.seq AS old_seq, b.seq AS new_seq FROM events2 a JOIN events2 b
            ON a.book_key = b.book_key AND a.type = b.type AND a.seq < b.seq AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 900000000""",
        "token_overlap_pairs": f"""WITH {TEXT_PAIRS} SELECT old_seq, new_seq,
            CASE WHEN len(new_w) > 0 THEN round(len(list_intersect(new_w, old_w))::DOUBLE / len(new_w), 6) ELSE 0.0 END AS new_in_old,
            CASE WHEN old_t <> '' AND new_t <> '' THEN round(len(list_intersect(new_w, old_w))::DOUBLE / greatest(len(new_w), len(old_w)), 6) ELSE 0.0 END AS both_ways FROM p""",
        "containment_pairs": f"""WITH {TEXT_PAIRS}, c AS (SELECT *, old_t <> '' AND new_t <> '' AND CASE WHEN length(new_t) <= length(old_t) THEN contains(old_t, new_t) ELSE contains(new_t, old_t) END AS k FROM p)
            SELECT old_seq, new_seq, k AS contains,
              k AND (least(length(old_t), length(new_t)) >= 40 OR least(length(old_t), length(new_t)) / greatest(length(old_t), length(new_t), 1) >= 0.45) AS nearby FROM c""",
        "exact_duplicates": f"""WITH d AS (SELECT doc_id, sha1({key_form("source")} || '||' || {key_form("lang")}) AS book_key, sha1({comparison_form("text")}) AS text_hash FROM documents)
            SELECT book_key, text_hash, min(doc_id) AS first_seq, count(*) AS copies FROM d GROUP BY book_key, text_hash HAVING count(*) > 1""",
        "normal_forms": f"WITH {TALKS} SELECT seq, {comparison_form('content')} AS comparison, {key_form('content')} AS key FROM talks",
        "slugs": r"""WITH n AS (SELECT DISTINCT p_brand || ': ' || p_name AS name FROM part)
            SELECT name, left(strip_accents(replace(lower(regexp_replace(trim(regexp_replace(name, '\s+', ' ', 'g')), '[<>:"/\\|?*]', '', 'g')), ' ', '-')), 100) AS slug FROM n""",
        "author_options": "SELECT DISTINCT lang AS author FROM documents",
        "filter_rows": f"WITH {BOOKS} SELECT book_key, title, status FROM listed WHERE default_selected AND contains(lower(title || ' ' || author), 'conversation 1')",
        "batch_selection": f"WITH {BOOKS} SELECT book_key, default_selected AND status <> 'com_novidades' AS selected FROM listed",
        "selection_summary": f"WITH {BOOKS} SELECT count(*) AS selected_books, coalesce(sum(new_highlights_count), 0)::BIGINT AS selected_highlights, 2 AS active_formats FROM listed WHERE default_selected",
        "mark_rows_exported": f"""WITH {BOOKS} SELECT book_key, 'sem_novidades' AS status, 'Exportado' AS status_label,
            CASE WHEN default_selected THEN 0 ELSE new_highlights_count END AS new_highlights_count,
            CASE WHEN default_selected THEN '2024-01-15 10:00' ELSE last_export_display END AS last_export_display,
            CASE WHEN default_selected THEN 'markdown' ELSE 'markdown,txt' END AS formats FROM listed""",
        "entry_search": f"WITH {TALKS} SELECT book_key, seq FROM talks WHERE type = 'note' AND contains(lower(content), 'tion')",
        "indexed_search": f"""SELECT sha1({key_form("source")} || '||' || {key_form("lang")}) AS book_key, doc_id AS seq FROM documents WHERE contains(lower(text), 'license')""",
        "history_tail": "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 200",
        "latest_analyses": "SELECT o_custkey::VARCHAR AS analysis_id, max(o_orderkey) AS saved_no, arg_max(o_orderstatus, o_orderkey) AS filename FROM orders GROUP BY o_custkey ORDER BY saved_no DESC LIMIT 5",
        "format_location": f"""WITH {TALKS}, {EVENTS} SELECT seq, type, 'Posição: ' || start_pos || '-' || end_pos AS location FROM talks
            UNION ALL SELECT seq, type, 'Posição: ' || start_pos || '-' || end_pos || ' | ' || {DATE_LABEL} FROM events2""",
        "display_time": """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || '+00:00' AS iso,
            strftime(ts - INTERVAL 3 HOUR, '%Y-%m-%d %H:%M') AS shown FROM events""",
        "date_labels": f"SELECT event_id, {DATE_LABEL} AS label, strftime(ts, '%Y-%m-%d') AS day FROM events",
        "parse_roundtrip": rf"""WITH {TALKS} SELECT book_key, row_number() OVER (PARTITION BY book_key ORDER BY seq) - 1 AS seq, type, title, author, NULL::BIGINT AS page,
            start_pos, end_pos, regexp_replace(content, '^\s+|\s+$', '', 'g') AS content FROM talks""",
        "render_txt": TXT,
        "render_markdown": MARKDOWN,
        "render_html": HTML,
        "vault_note": VAULT,
        "clip_page": CLIP,
        "export_files": f"""WITH {BOOKS} SELECT 'markdown' AS format, 'markdown/' || {PATH} || '.md' AS path, m.book_key, length(content)::INT AS n_chars
            FROM ({MARKDOWN_FRESH}) m JOIN books b ON b.book_key = m.book_key""",
        "encoded_files": f"""WITH {BOOKS}, {BOTH} SELECT {PATH} || '.' || ext AS filename, format, mime_type, base64(encode(content)) AS content_base64
            FROM both_ JOIN books b ON b.book_key = both_.book_key""",
        "note_blocks": f"""WITH {TALKS}, shown AS (SELECT *, 'Posição: ' || start_pos || '-' || end_pos AS place FROM talks WHERE type = 'bookmark' OR coalesce(content, '') <> '')
            SELECT book_key, 0 AS place, 'callout' AS kind, 'info' AS type, 'Metadados do recorte' AS title, NULL AS text, NULL AS location FROM talks GROUP BY book_key
            UNION ALL SELECT book_key, row_number() OVER (PARTITION BY book_key ORDER BY start_pos, seq)::INT, CASE type WHEN 'bookmark' THEN 'marker' ELSE 'callout' END,
              CASE type WHEN 'bookmark' THEN NULL WHEN 'note' THEN 'note' ELSE 'quote' END, CASE type WHEN 'bookmark' THEN NULL WHEN 'note' THEN 'Nota — ' || place ELSE place END,
              CASE type WHEN 'bookmark' THEN NULL ELSE content END, CASE type WHEN 'bookmark' THEN place END FROM shown""",
        "dedup_events": f"WITH RECURSIVE {FOLD} SELECT book_key, type, seq, action, reason, priority, score, matched_slot FROM fold",
        "dedup_crowded": f"WITH RECURSIVE {CROWDED} SELECT book_key, type, seq, action, reason, priority, score, matched_slot FROM fold",
        "dedup_crowded_survivors": f"WITH RECURSIVE {CROWDED} SELECT book_key, type, seq, slot_seq FROM ({HELD})",
        "dedup_crowded_report": f"""WITH RECURSIVE {CROWDED} SELECT f.seq, 'User ' || e.user_id AS title, f.reason, e.start_pos, e.end_pos, left(e.content, 120) AS content_preview
            FROM fold f JOIN placed e ON e.seq = f.seq WHERE f.action <> 'append'""",
        "dedup_metrics": f"""WITH RECURSIVE {CROWDED} SELECT 'test' AS analysis_id, count(*) FILTER (WHERE action = 'append') AS total_entries, count(*) FILTER (WHERE action <> 'append') AS duplicates_removed,
            count(DISTINCT book_key) AS books_processed, 0::BIGINT AS exact_duplicates_removed, 0::BIGINT AS same_start_containment_conflicts, 0::BIGINT AS same_start_expansion_conflicts,
            0::BIGINT AS same_range_containment_conflicts, count(*) FILTER (WHERE reason LIKE 'position_overlap%') AS position_overlap_conflicts, 0::BIGINT AS similarity_fallback_removed,
            count(*) FILTER (WHERE action = 'replace') AS records_replaced FROM fold""",
        "parse_pages": f"WITH {TALKS} SELECT book_key, row_number() OVER (PARTITION BY book_key ORDER BY seq) - 1 AS seq, turn + 1 AS page, start_pos, end_pos FROM talks",
        "parse_errors": """SELECT user_id::VARCHAR AS analysis_id, count(*) FILTER (WHERE day(last_day(ts::DATE)) < 31) AS errors, count(*) FILTER (WHERE day(last_day(ts::DATE)) = 31) AS entries
            FROM events GROUP BY user_id""",
        "repaired_texts": "SELECT doc_id, sha1(coalesce(text, '')) AS repaired, sha1(coalesce(text, '')) AS left_alone FROM documents",
        "position_predicates": """WITH r AS (SELECT user_id, event_id AS seq, CASE WHEN event_type = 'click' THEN 'highlight' ELSE event_type END AS type, CASE WHEN event_id % 3 <> 0 THEN event_id % 4 END AS s,
              CASE WHEN event_id % 5 <> 0 THEN event_id % 4 + 2 END AS e FROM events
            ), p AS (SELECT *, lag(seq) OVER w AS old_seq, lag(type) OVER w AS old_type, lag(s) OVER w AS old_s, lag(e) OVER w AS old_e FROM r WINDOW w AS (PARTITION BY user_id ORDER BY seq)
            ), q AS (SELECT *, s IS NULL OR e IS NULL OR old_s IS NULL OR old_e IS NULL AS unplaced FROM p WHERE old_seq IS NOT NULL
            ), u AS (SELECT *, CASE WHEN unplaced THEN 0 ELSE greatest(0, least(e, old_e) - greatest(s, old_s) + 1) END AS units FROM q)
            SELECT seq AS new_seq, type = old_type AS same_type, type = old_type AND s IS NOT DISTINCT FROM old_s AS same_start, coalesce(s = old_s AND e = old_e, false) AS same_range, unplaced, units,
              CASE WHEN units > 0 THEN round(units / 3.0, 6)::DOUBLE ELSE 0.0::DOUBLE END AS share FROM u""",
        "settings_forms": """WITH f AS (SELECT c_custkey AS k, c_custkey % 3 <> 0 AS md, c_custkey % 2 = 0 AS html, c_nationkey % 2 = 1 AS txt, c_custkey % 7 = 0 AS obsidian FROM customer)
            SELECT k AS request, concat_ws(',', CASE WHEN md THEN 'markdown' END, CASE WHEN html THEN 'html' END, CASE WHEN txt THEN 'txt' END, CASE WHEN obsidian THEN 'obsidian' END) AS formats,
              k % 5 <> 0 AS remove_duplicates, k % 4 <> 0 AS metadata, CASE WHEN k % 2 = 1 THEN 0.5 + (k % 4) / 8 ELSE 0.8 END::DOUBLE AS similarity, CASE WHEN k % 3 = 1 THEN k % 30 ELSE 15 END::DOUBLE AS session,
              concat_ws(',', CASE WHEN md THEN 'markdown' END, CASE WHEN html THEN 'html' END, 'txt', CASE WHEN obsidian THEN 'obsidian' END) AS with_txt, false AS bookmarks, true AS same_when_stored FROM f""",
        "local_days": "SELECT event_id, strftime(ts - INTERVAL 3 HOUR, '%Y-%m-%d') AS day FROM events",
        "export_totals": f"WITH {BOOKS} SELECT count(*) + 10 AS books, sum(turns)::BIGINT AS entries FROM listed WHERE default_selected",
        "visible_counts": f"""WITH {BOOKS} SELECT s.status, (SELECT count(*) FROM listed)::INT AS books, count(l.book_key) AS visible, count(l.book_key) FILTER (WHERE default_selected) AS visible_selected,
            CASE WHEN count(l.book_key) > 0 AND count(l.book_key) = count(l.book_key) FILTER (WHERE default_selected) THEN 'all' WHEN count(l.book_key) FILTER (WHERE default_selected) > 0 THEN 'some' ELSE 'none' END AS header
            FROM (VALUES ('novo'), ('com_novidades'), ('nunca_exportado'), ('sem_novidades')) s(status) LEFT JOIN listed l ON l.status = s.status GROUP BY s.status""",
        "zip_listing": f"WITH {BOOKS}, {BOTH}, {FILES} SELECT (row_number() OVER (ORDER BY path) - 1)::INT AS place, path, true AS deflated, sha1 FROM files",
        "folder_files": f"WITH {BOOKS}, {BOTH}, {FILES} SELECT path, sha1, 0 AS failed FROM files",
        "history_books": f"""WITH {BOOKS} SELECT book_key, title, content_hash, highlight_count, '2024-01-15T12:00:00+00:00' AS last_analysis_at, CASE WHEN turns >= 3 THEN '2024-01-12T00:40:00+00:00' END AS last_export_at,
            CASE WHEN turns >= 3 THEN then_hash END AS last_export_signature, CASE WHEN turns >= 3 THEN 'markdown,txt' END AS formats, 2::BIGINT AS events,
            CASE WHEN content_hash = then_hash THEN 'sem_mudancas' ELSE 'atualizado' END AS detected_status, true AS forced FROM books""",
        "stored_uploads": f"""WITH {TALKS}, f AS (SELECT book_key, {CLIPPINGS} AS text FROM talks GROUP BY book_key)
            SELECT book_key AS analysis_id, book_key || '.txt' AS path, octet_length(encode(text)) AS size, sha1(text) AS text_sha1, 'true' AS markdown FROM f""",
        "mark_exported_events": f"""WITH {BOOKS} SELECT book_key, sha1(book_key || '|2024-01-15T13:00:00+00:00|markdown,txt|' || then_hash) AS export_id, '2024-01-15T13:00:00+00:00' AS exported_at,
            'markdown,txt' AS formats, then_hash AS content_hash, '2024-01-10T09:00:00+00:00' AS processed_at, turns >= 3 AND sent_hash = then_hash AS reexport_without_changes FROM books WHERE turns >= 2""",
        "processing_events": f"""WITH {BOOKS} SELECT book_key, sha1('2024-01-15T12:00:00+00:00|7') AS process_id,
            CASE WHEN turns < 2 THEN 'novo' WHEN content_hash = then_hash THEN 'sem_mudancas' ELSE 'atualizado' END AS detected_status,
            CASE WHEN turns < 2 THEN n_high WHEN content_hash = then_hash THEN 0 ELSE n_high_2 END AS new_highlights_count, content_hash, highlight_count FROM books""",
        "history_import": f"""WITH {BOOKS} SELECT book_key, title, 'Autor desconhecido' AS author, then_list AS entries, then_hash AS content_hash, then_high AS highlight_hash,
            then_highlights AS highlight_count, 0::BIGINT AS note_count, '2024-01-10T09:00:00+00:00' AS last_analysis_at,
            CASE WHEN turns >= 3 THEN '2024-01-12T00:40:00+00:00' END AS last_export_at, CASE WHEN turns >= 3 THEN sent_hash END AS last_export_signature FROM books WHERE turns >= 2""",
    }
