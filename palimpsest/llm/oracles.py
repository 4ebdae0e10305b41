"""DuckDB SQL for the queries that SQL can express. Written apart from the operators: plain joins, lists and regular expressions."""

from __future__ import annotations

from palimpsest.llm.quality_rules import DENSE, ENDS, PHRASES, SEPARATORS, Rules
from palimpsest.llm.url_filter import BLOCK_GLOBS, ENCODED, SITE_RULES

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _glob_regex(glob: str) -> str:
    host, path = glob.split("#")
    escape = lambda s, star: "".join(star if c == "*" else f"\\{c}" if c in ".-/" else c for c in s)
    return f"{escape(host, '[^#]*')}#{escape(path, '.*')}"


_DECODED = "array_to_string(list_transform(regexp_extract_all({0}, '{1}|%|[^%]+'), lambda x: CASE WHEN regexp_full_match(x, '{1}') THEN chr(CAST('0x' || substr(x, 2) AS INT)) ELSE x END), '')"

URL_FILTER = f"""
WITH parts AS (
  SELECT page_id,
         {_LOWER.format("regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)")} AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
decoded AS (
  SELECT *, regexp_replace(regexp_replace({_LOWER.format(_DECODED.format("host", ENCODED))}, '^.*@', '', 's'), ':[0-9]*$', '') AS h,
         string_split(substr({_LOWER.format(_DECODED.format("path", ENCODED))}, 2), '/') AS segments
  FROM parts),
forms AS (
  SELECT *, rtrim(h, '.') AS chost,
         '/' || array_to_string(list_reduce(list_transform(segments, lambda x: [x]), lambda a, x: CASE x[1] WHEN '..' THEN a[1 : len(a) - 1] WHEN '.' THEN a ELSE list_concat(a, x) END, CAST([] AS VARCHAR[]))
                                || CASE WHEN segments[-1] IN ('.', '..') THEN [''] ELSE [] END, '/') AS cpath
  FROM decoded),
fits AS (
  SELECT *, CASE {" ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in sorted(SITE_RULES, key=lambda r: -len(r[0] + r[1])))} END AS rule,
         {" + ".join(f"CAST(regexp_full_match('.' || chost || '#' || cpath, '{_glob_regex(g)}', 's') AS BIGINT)" for g in BLOCK_GLOBS)} AS n_globs
  FROM forms)
SELECT page_id, host, path, rule,
       CASE {" ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for h, p, v in SITE_RULES)} WHEN n_globs > 0 THEN 'block' ELSE 'allow' END AS verdict,
       n_globs, chost || cpath AS canonical
FROM fits
"""

_ALNUM_WORDS = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATE = f"""
WITH items AS (SELECT item_id, {_ALNUM_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
item_windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS window_text
  FROM items, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM item_windows),
docs AS (SELECT doc_id, {_ALNUM_WORDS} AS w FROM documents),
doc_windows AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS window_text
  FROM docs, sizes, unnest(range(1, greatest(len(w) - size, -1) + 2)) AS r(i)),
found AS (SELECT doc_id, item_id, i, size FROM doc_windows JOIN item_windows USING (size, window_text)),
hits AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT doc_id, i, size FROM found), unnest(range(0, size)) AS r(k) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names
          FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
_R = Rules()
_ENDS = ENDS.replace("'", "''")
_SEPARATORS = ", ".join(f"'{x}'" for x in SEPARATORS)
_DENSE = "[" + "".join(f"\\x{{{ord(a):X}}}-\\x{{{ord(z):X}}}" for a, z in DENSE) + "]"
_CLOSING = f"(contains('{_ENDS}', tail) OR ascii(tail) >= 128 AND NOT regexp_matches(tail, '[\\p{{L}}\\p{{M}}\\p{{N}}]'))"

QUALITY_RULES = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
lines AS (
  SELECT doc_id, i, line, {_WORDS.format("line")} AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs)),
facts AS (
  SELECT len(w) AS n, len(list_distinct(w)) AS n_distinct, len(list_filter(w, lambda x: x IN ({_SEPARATORS}))) AS n_bars, doc_id, i,
         length(array_to_string(w, '')) AS chars, length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols,
         length(regexp_replace(line, '[^!]', '', 'g')) AS marks, right(w[-1], 1) AS tail, lower(line) AS low,
         left(w[1], 1) AS head, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS repeated
  FROM lines WHERE len(w) > 0),
sized AS (
  SELECT *, {_CLOSING} AS closed, regexp_matches(head, '[\\p{{Ll}}\\p{{Lo}}\\p{{Lm}}\\p{{M}}]') OR ascii(head) >= 128 AND regexp_matches(head, '\\p{{N}}') AS low_head,
         CASE WHEN regexp_matches(head, '[0-9]') AND n > 1 THEN greatest(n, {_R.max_menu_words}) WHEN regexp_matches(head, '{_DENSE}') THEN greatest(n, (chars + 1) // 2) ELSE n END AS size
  FROM facts),
said AS (SELECT doc_id, min(i) AS first_said, max(i) AS last_said FROM sized WHERE closed AND (n > {_R.max_menu_words} OR chars >= {_R.min_sentence_chars}) GROUP BY doc_id),
linked AS (
  SELECT *, size <= {_R.max_menu_words} AND NOT closed AND (NOT low_head OR coalesce(i < first_said OR i > last_said, false)) AS link FROM sized LEFT JOIN said USING (doc_id)),
runs AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - row_number() OVER (PARTITION BY doc_id, link ORDER BY i) AS run FROM linked),
shaped AS (
  SELECT *, link AND count(*) OVER same >= {_R.min_menu_lines} AND 100 * sum(size) OVER same <= {_R.mean_menu_words} * count(*) OVER same AS menu
  FROM runs WINDOW same AS (PARTITION BY doc_id, link, run)),
judged AS (
  SELECT *, 100 * symbols > {_R.max_symbols} * chars
         OR n >= {_R.min_words} AND 100 * marks > {_R.max_marks} * n
         OR n >= {_R.min_words} AND 100 * n_bars >= {_R.max_bars} * n
         OR n >= {_R.min_varied} AND 100 * (n - n_distinct) >= {_R.max_same} * n
         OR n >= {_R.min_sentence} AND NOT contains('{_ENDS}', tail) AND (ascii(tail) < 128 OR regexp_matches(tail, '[\\p{{Ll}}\\p{{Lu}}\\p{{Lt}}]'))
         OR menu
         OR repeated
         OR {" OR ".join(f"contains(low, '{p}')" for p in PHRASES)} AS fails
  FROM shaped),
by_doc AS (
  SELECT doc_id, sum(CASE WHEN repeated THEN 1 ELSE 0 END) AS n_dup_lines, sum(CASE WHEN fails THEN 1 ELSE 0 END) AS n_lines_removed,
         sum(CASE WHEN fails THEN chars ELSE 0 END) AS lost_chars
  FROM judged GROUP BY doc_id),
grams AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS g FROM docs, unnest(range(1, greatest(len(w) - 4, 0) + 1)) AS r(i)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, unnest(range(0, 5)) AS r(k) GROUP BY doc_id),
counted AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         CAST(coalesce(n_lines_removed, 0) AS BIGINT) AS n_lines_removed, CAST(coalesce(lost_chars, 0) AS BIGINT) AS lost_chars
  FROM docs LEFT JOIN by_doc USING (doc_id) LEFT JOIN repeats USING (doc_id))
SELECT *, n_words < {_R.min_doc_words} OR 100 * n_repeat_words > {_R.max_repeat} * n_words AS base_failed,
       NOT (n_words < {_R.min_doc_words} OR 100 * n_repeat_words > {_R.max_repeat} * n_words) AND 100 * lost_chars <= {_R.max_lost} * word_chars AS kept
FROM counted
"""

_HOST = f"CASE WHEN contains(url, '://') THEN {_LOWER.format("regexp_extract(url, '://([^/?#]*)', 1)")} END"


def _line_dedup(table: str, row_id: str, site: str, text: str, kept: str) -> str:
    """Lines without those on more than 5 % of their site's rows; kept: the columns that stay as they are."""
    return f"""
WITH sited AS (SELECT *, {site} AS site FROM {table}),
lines AS (
  SELECT {row_id}, site, i, line, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS core
  FROM (SELECT {row_id}, site, unnest(string_split({text}, chr(10))) AS line, generate_subscripts(string_split({text}, chr(10)), 1) AS i FROM sited)),
sizes AS (SELECT site, count(*) AS n_rows FROM sited GROUP BY site),
common AS (
  SELECT c.site, core FROM (SELECT site, core, count(DISTINCT {row_id}) AS n FROM lines WHERE core <> '' GROUP BY site, core) c JOIN sizes s ON c.site IS NOT DISTINCT FROM s.site
  WHERE n > 1 AND 100 * n > 5 * n_rows),
judged AS (SELECT l.*, c.core IS NOT NULL AS dropped FROM lines l LEFT JOIN common c ON l.core = c.core AND l.site IS NOT DISTINCT FROM c.site),
by_row AS (
  SELECT {row_id}, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '') AS clean,
         count(*) FILTER (core <> '') AS n_lines, count(*) FILTER (dropped) AS n_dropped
  FROM judged GROUP BY {row_id})
SELECT d.{row_id}, {kept}, CASE WHEN d.{text} IS NOT NULL THEN clean END AS {text}, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped
FROM {table} d LEFT JOIN by_row USING ({row_id})
"""


LINE_DEDUP = _line_dedup("documents", "doc_id", "source", "text", "source")
LINE_DEDUP_BY_HOST = _line_dedup("pages", "page_id", _HOST, "html", "url")

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, {1 + 10 * g}, 10) AS BIGINT) >> {35 - 5 * k}) & 31 AS INT), 1)"
    for g in range(4)
    for k in range(8)
)

WARC = f"""
WITH payloads AS (SELECT page_id, sha1(coalesce(html, '')) AS hex, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first_id FROM payloads)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM firsts
"""

NGRAM_JOIN = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_WORDS.format(_LOWER.format("text"))} AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
  FROM docs, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sizes
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(least(e, d.doc_id), d.doc_id) AS class_id, coalesce(n_links, 0) AS n_links
FROM docs d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a) USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, min(b) AS e FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE shared = x.n AND shared = y.n GROUP BY a) USING (doc_id)
"""

_DRAW = "CAST('0x' || substr(digest, {}, 8) AS BIGINT)"

FILL_MIDDLE = f"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS digest,
         regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u
  FROM documents),
cuts AS (
  SELECT *, len(u) AS n, least({_DRAW.format(1)} % (len(u) + 1), {_DRAW.format(9)} % (len(u) + 1)) AS a, greatest({_DRAW.format(1)} % (len(u) + 1), {_DRAW.format(9)} % (len(u) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {_DRAW.format(17)} % 100 >= 50 THEN 'plain'
              WHEN {_DRAW.format(25)} % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM docs),
parts AS (SELECT *, array_to_string(u[1 : a], '') AS p, array_to_string(u[a + 1 : b], '') AS m, array_to_string(u[b + 1 :], '') AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""

_STAMP = (
    "^(?:(20[0-9][0-9])-([0-9][0-9])-([0-9][0-9])|(20[0-9][0-9])([0-9][0-9])([0-9][0-9])|([0-9][0-9])[.]([0-9][0-9])[.](20[0-9][0-9])"
    "|([0-9][0-9]) (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) (20[0-9][0-9])|([0-9][0-9])/([0-9][0-9])/(20[0-9][0-9]))"
    "(?:[T ]([0-9][0-9]):([0-9][0-9])(?::([0-9][0-9]))?(?: ?([AP]M))?(?: ?(Z|([+-])([0-9][0-9]):?([0-9][0-9])))?)?$"
)
_GROUPS = ["y1", "m1", "d1", "y2", "m2", "d2", "d3", "m3", "y3", "d4", "b", "y4", "s1", "s2", "ys", "h", "mi", "s", "half", "off", "sign", "oh", "om"]
_OFFSET = "CAST(epoch(timezone(zone, to_timestamp({0}))) AS BIGINT) - ({0})"


def _settled(name: str) -> str:
    """Common table expressions that place the wall seconds `name` in their zone, as utc_`name` and unsure_`name`."""
    return f"""
{name}_around AS (SELECT stamp_id, zone, {name} AS w, {_OFFSET.format(name + " - 86400")} AS a, {_OFFSET.format(name + " + 86400")} AS b FROM fields WHERE {name} IS NOT NULL AND off = ''),
{name}_tried AS (SELECT *, {_OFFSET.format("w - a")} = a AS a_fits, {_OFFSET.format("w - b")} = b AS b_fits FROM {name}_around),
{name}_local AS (SELECT stamp_id, CASE WHEN a = b OR a_fits AND NOT b_fits THEN w - a ELSE w - b END AS utc_{name}, a <> b AND a_fits = b_fits AS unsure_{name} FROM {name}_tried),"""


TIMESTAMPS = f"""
WITH trimmed AS (SELECT stamp_id, source, zone, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS raw FROM stamps),
taken AS (SELECT stamp_id, source, zone, raw, regexp_extract(raw, '{_STAMP}', {_GROUPS}) AS g FROM trimmed),
split AS (SELECT stamp_id, source, zone, raw, unnest(g) FROM taken),
timed AS (
  SELECT *, TRY_CAST(h AS INT) AS hh, s1 <> '' AS slashed,
         TRY_CAST(CASE WHEN off IN ('', 'Z') THEN 0 WHEN CAST(oh AS INT) <= 14 AND CAST(om AS INT) < 60 THEN (CAST(oh AS INT) * 3600 + CAST(om AS INT) * 60) * CASE sign WHEN '-' THEN -1 ELSE 1 END END AS BIGINT) AS offset_s,
         TRY_CAST(CASE WHEN y1 <> '' THEN y1 || '-' || m1 || '-' || d1 WHEN y2 <> '' THEN y2 || '-' || m2 || '-' || d2 WHEN y3 <> '' THEN y3 || '-' || m3 || '-' || d3
                       WHEN y4 <> '' THEN y4 || '-' || lpad(CAST(1 + (position(b IN 'JanFebMarAprMayJunJulAugSepOctNovDec') - 1) // 3 AS VARCHAR), 2, '0') || '-' || d4
                       WHEN ys <> '' THEN ys || '-' || s2 || '-' || s1 END AS DATE) AS day1,
         TRY_CAST(CASE WHEN ys <> '' THEN ys || '-' || s1 || '-' || s2 END AS DATE) AS day2
  FROM split),
clocked AS (
  SELECT *, CASE WHEN h = '' THEN 0
                 WHEN CAST(mi AS INT) < 60 AND coalesce(TRY_CAST(s AS INT), 0) < 60 AND CASE half WHEN '' THEN hh < 24 ELSE hh BETWEEN 1 AND 12 END
                 THEN CASE half WHEN '' THEN hh WHEN 'AM' THEN hh % 12 ELSE hh % 12 + 12 END * 3600 + CAST(mi AS INT) * 60 + coalesce(TRY_CAST(s AS INT), 0) END AS of_day
  FROM timed),
fields AS (
  SELECT *, CASE WHEN offset_s IS NOT NULL THEN CAST(epoch(day1) AS BIGINT) + of_day END AS w1, CASE WHEN offset_s IS NOT NULL THEN CAST(epoch(day2) AS BIGINT) + of_day END AS w2 FROM clocked),
{_settled("w1")}{_settled("w2")}
placed AS (
  SELECT f.stamp_id, source, raw, slashed, CASE WHEN off = '' THEN utc_w1 ELSE w1 - offset_s END AS u1, CASE WHEN off = '' THEN utc_w2 ELSE w2 - offset_s END AS u2,
         s1 = s2 AS alike, coalesce(unsure_w1, false) AS unsure1, coalesce(unsure_w2, false) AS unsure2
  FROM fields f LEFT JOIN w1_local USING (stamp_id) LEFT JOIN w2_local USING (stamp_id)),
votes AS (
  SELECT source, count(*) FILTER (u1 IS NOT NULL AND u2 IS NULL) AS day_votes, count(*) FILTER (u1 IS NULL AND u2 IS NOT NULL) AS month_votes
  FROM placed WHERE slashed GROUP BY source),
judged AS (
  SELECT p.*, slashed AND u1 IS NOT NULL AND u2 IS NOT NULL AND NOT alike AS asked, coalesce(day_votes, 0) AS dv, coalesce(month_votes, 0) AS mv,
         CASE WHEN regexp_full_match(raw, '[0-9]{{10}}') THEN CAST(raw AS BIGINT) * 1000000 WHEN regexp_full_match(raw, '[0-9]{{13}}') THEN CAST(raw AS BIGINT) * 1000 END AS epoch_us
  FROM placed p LEFT JOIN votes v ON p.source IS NOT DISTINCT FROM v.source),
chosen AS (SELECT *, CASE WHEN asked THEN mv > 10 * dv ELSE slashed AND u1 IS NULL END AS second FROM judged)
SELECT stamp_id, coalesce(epoch_us, CASE WHEN second THEN u2 ELSE u1 END * 1000000) AS utc_us,
       CASE WHEN epoch_us IS NOT NULL THEN 'epoch' WHEN u1 IS NULL AND u2 IS NULL THEN 'bad' WHEN NOT asked THEN 'plain' WHEN dv > 10 * mv OR mv > 10 * dv THEN 'votes' ELSE 'default' END AS rule,
       epoch_us IS NULL AND (u1 IS NOT NULL OR u2 IS NOT NULL) AND (asked OR CASE WHEN second THEN unsure2 ELSE unsure1 END) AS ambiguous
FROM chosen
"""
