"""Queries that run the formats' own readers, parsers, rules and sinks, with the DuckDB SQL that must return the same rows.

Dumps and drafts are made from the supplied documents: tokens, head lines and brackets are put in by literal replacements, the same in the
query and in its SQL. Files are written to the shared folder by the library's sinks and read again by its readers.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase
from unicodedata import normalize

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import blocks, fixed
from palimpsest.functions import text as t
from palimpsest.operators.segment import bracket_entries, headline_entries, headline_fields
from palimpsest.plans.catalogue import _DROPS, _HEADWORD, _KEY, _SIGNATURE, _rewritten, _t, query
from palimpsest.plans.extract import AFTER, BEFORE, HEX_BYTES, SAMPLES, block_samples, known_windows
from palimpsest.plans.restore import Restored, apply_rules, restore_headlines, restore_pronunciations
from palimpsest.sources.block_ranges import read_ranges
from palimpsest.sources.readers import lines_of, read_drafts, read_dump, read_text_lines, read_token_map, read_token_rows
from palimpsest.sources.scratch import scratch
from palimpsest.sources.sinks import write_html, write_jsonl, write_report, write_tsv

TOKENS = {"hA121": "ə", "hA126": "ɪ", "zA423": "<subentry>", "zA425": "<label>", "zA426": "</label>", "zA42D": "<usage>"}
_TOKEN = r"\[([zh]A[0-9A-Fa-f]{3})\]"


def _put_sql(pairs: dict[str, str]) -> str:
    """Literal replacements of the text one after the other, as t.literally makes them. Line ends and single quotes are spelled out."""
    sql = "text"
    for pair in pairs.items():
        old, new = ("'" + x.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'" for x in pair)
        sql = f"replace({sql}, {old}, {new})"
    return sql


def _mapped(sql: str) -> str:
    for token, value in TOKENS.items():
        sql = f"replace({sql}, '[{token}]', '{value}')"
    return sql


_BLANKS = "' ' || chr(9) || chr(10) || chr(13)"
_STRIP = f"trim({{}}, {_BLANKS})"


def _readable(sql: str) -> str:
    """clean_body of texts whose white space is spaces, tabs and line ends; of wide characters, NFKC meets these brackets only."""
    for wide, narrow in ("［[", "］]", "（(", "）)"):
        sql = f"replace({sql}, '{wide}', '{narrow}')"
    for mark, shown in fixed.BODY_MARKUP.items():
        quoted = "'" + shown.replace("\n", "' || chr(10) || '") + "'"
        sql = f"replace({sql}, '{mark}', {quoted})"
    sql = f"regexp_replace({sql}, '<label>([^\\n]*?)</label>', '〔\\1〕', 'g')"
    lines = f"list_transform(string_split({sql}, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'), ' '))"
    return _STRIP.format(f"regexp_replace(array_to_string({lines}, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')")


def _unresolved(sql: str) -> str:
    return f"CAST(len(regexp_extract_all({sql}, '{_TOKEN}')) AS VARCHAR) AS unresolved, array_to_string(list_sort(list_distinct(regexp_extract_all({sql}, '{_TOKEN}', 1))), ',') AS tokens"


# Parsers.

_BRACKETS = {
    " the ": "\nthe［tei [hA121]］\n", " and ": "\nand［plain］\n", " of ": "\nof[a［[hA126]］\n", " to ": "\n to x ［aud [hA126][hA1FF]］\n",
    " in ": " [zA423]in  [zA425]n[zA426] [hA1FE] ", " is ": " [zA42D]is[zA427] ",
}
_HEAD_SQL = r"^\s*([^\[]+?)［([^］]+)］$"
_BRACKET_ENTRIES = f"""
lines AS (
  SELECT doc_id, i - 1 AS ord, parts[i] AS line, i < len(parts) AS ended
  FROM (SELECT doc_id, string_split({_put_sql(_BRACKETS)}, chr(10)) AS parts FROM documents WHERE length(text) > 0), unnest(range(1, len(parts) + 1)) AS r(i)),
cut AS (SELECT *, regexp_matches(line, '{_HEAD_SQL}') AS head FROM lines),
segs AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY ord) AS seg FROM cut),
raw AS (
  SELECT doc_id, max(ord) FILTER (head) AS ord, max(line) FILTER (head) AS line, bool_or(ended) FILTER (head) AS ended,
         {_STRIP.format("coalesce(string_agg(line, chr(10) ORDER BY ord) FILTER (NOT head), '')")} AS body_raw
  FROM segs WHERE seg > 0 GROUP BY doc_id, seg),
parsed AS (
  SELECT doc_id, ord, {_STRIP.format(f"regexp_extract(line, '{_HEAD_SQL}', 1)")} AS headword, {_STRIP.format(f"regexp_extract(line, '{_HEAD_SQL}', 2)")} AS pronunciation, body_raw
  FROM raw WHERE ended),
entries AS (
  SELECT *, {_mapped('body_raw')} AS body_mapped, {_KEY.format(_rewritten(_mapped('pronunciation')))} AS normalized
  FROM parsed WHERE regexp_matches(pronunciation, '{_TOKEN}'))"""


@query(f"""
WITH {_BRACKET_ENTRIES}
SELECT CAST(doc_id AS VARCHAR) AS file, ord, headword, {_HEADWORD.format('headword')} AS headword_key, pronunciation, normalized, md5(body_raw) AS body_raw, md5(body_mapped) AS body_mapped,
       md5({_readable('body_mapped')}) AS readable, substr({_readable('body_mapped')}, 1, 220) AS snippet, {_unresolved('body_mapped')}
FROM entries""")
def p_bracket_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    dumps = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), t.literally(F.col("text"), _BRACKETS).alias("text"))
    return bracket_entries(dumps, TOKENS).select(
        "file", F.col("ord").cast("bigint").alias("ord"), "headword", F.col("headword_normalized").alias("headword_key"), F.col("pronunciation_raw").alias("pronunciation"),
        F.col("pronunciation_normalized").alias("normalized"), *[F.md5(c).alias(c) for c in ("body_raw", "body_mapped")], F.md5("body_readable").alias("readable"),
        F.col("body_snippet").alias("snippet"), F.col("body_unresolved_count").alias("unresolved"), F.col("body_unresolved_tokens").alias("tokens"),
    )


_HEADLINES = {
    " the ": "\nthe【x】\n〈n〉 ", " and ": "\n↓and\n【y】rest [hA1FF] ", " of ": "\n【z】tail ", " in ": "\n[zA423]in【w】\n（p） ", " is ": "\n[ID=7]\nis it\n〈v〉[hA121] ",
    " to ": "\n\n↑to\n", " for ": "\n【open\n「q ",
}
_FIX = "CASE WHEN starts_with({0}, '[zA423]') THEN trim(substr({0}, 8), ' ') ELSE trim({0}, ' ') END"
for _old, _new in fixed.HEADER_LITERALS.items():
    _FIX = f"replace({_FIX}, '{_old}', '{_new}')"
_BODY_START = "(" + " OR ".join(f"starts_with({{0}}, '{s}')" for s in fixed.BODY_STARTS) + " OR regexp_matches({0}, '^[0-9０-９]'))"
_ORTHOGRAPHY = "^【([^】]+)】([^\\n]*)"
def _headline_entries_sql(text: str) -> str:
    """Common table expressions up to `entries`, the head-line entries of a text for each document."""
    return f"""
lines AS (
  SELECT doc_id, i - 1 AS ord, {_STRIP.format('parts[i]')} AS line
  FROM (SELECT doc_id, string_split({text}, chr(10)) AS parts FROM documents WHERE length({text}) > 0), unnest(range(1, len(parts) + 1)) AS r(i)),
filled AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY ord) AS following FROM lines WHERE line <> ''),
own AS (SELECT *, {_FIX.format('line')} AS fixed, {_FIX.format('following')} AS after, starts_with({_FIX.format('line')}, '↓') OR starts_with({_FIX.format('line')}, '↑') AS marked FROM filled),
judged AS (
  SELECT *, CASE WHEN starts_with(line, '[ID=') OR following IS NULL THEN false WHEN marked AND starts_with(after, '【') THEN true WHEN starts_with(fixed, '【') THEN true
                 WHEN {_BODY_START.format('fixed')} THEN false WHEN contains(fixed, '【') THEN true ELSE {_BODY_START.format('following')} END AS begins
  FROM own),
taking AS (SELECT *, begins AND marked AND starts_with(after, '【') AND regexp_matches(after, '{_ORTHOGRAPHY}') AS takes FROM judged),
taken AS (SELECT *, coalesce(lag(takes) OVER (PARTITION BY doc_id ORDER BY ord), false) AS taken FROM taking),
heads AS (SELECT *, begins AND NOT taken AS head, starts_with(fixed, '【') AND NOT marked AND regexp_matches(fixed, '{_ORTHOGRAPHY}') AS alone FROM taken),
segs AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY ord) AS seg FROM heads),
parts AS (
  SELECT doc_id, max(ord) FILTER (head) AS ord,
         max(CASE WHEN takes THEN fixed || '【' || regexp_extract(after, '{_ORTHOGRAPHY}', 1) || '】' WHEN alone THEN '【' || regexp_extract(fixed, '{_ORTHOGRAPHY}', 1) || '】' ELSE fixed END) FILTER (head) AS header,
         max(CASE WHEN takes THEN trim(regexp_extract(after, '{_ORTHOGRAPHY}', 2), ' ') WHEN alone THEN trim(regexp_extract(fixed, '{_ORTHOGRAPHY}', 2), ' ') ELSE '' END) FILTER (head) AS inline,
         coalesce(list(line ORDER BY ord) FILTER (NOT head AND NOT taken), []) AS body
  FROM segs WHERE seg > 0 GROUP BY doc_id, seg),
raw AS (SELECT doc_id, ord, header, array_to_string(list_filter(list_concat([inline], body), lambda x: x <> ''), chr(10)) AS body_raw FROM parts),
mapped AS (SELECT *, {_FIX.format(_mapped('header'))} AS header_mapped, {_mapped('body_raw')} AS body_mapped FROM raw),
entries AS (SELECT *, {_readable('body_mapped')} AS readable FROM mapped)"""


@query(f"""
WITH {_headline_entries_sql(_put_sql(_HEADLINES))}
SELECT CAST(doc_id AS VARCHAR) AS file, ord, header, {_KEY.format('header')} AS header_key, {_KEY.format('header_mapped')} AS mapped_key, {_KEY.format("split_part(header_mapped, '【', 1)")} AS head_part,
       md5(body_raw) AS body_raw, md5(readable) AS readable, substr({_SIGNATURE.format('readable')}, 1, 80) AS signature, substr({_SIGNATURE.format('readable')}, 1, 40) AS prefix_signature, {_unresolved('body_mapped')}
FROM entries""")
def p_headline_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    dumps = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), t.literally(F.col("text"), _HEADLINES).alias("text"))
    return headline_entries(lines_of(dumps), TOKENS).select(
        "file", F.col("ord").cast("bigint").alias("ord"), F.col("headword_line").alias("header"), F.col("headword_line_normalized").alias("header_key"), F.col("headword_line_mapped_normalized").alias("mapped_key"),
        F.col("headword_line_head_part").alias("head_part"), F.md5("body_raw").alias("body_raw"), F.md5("body_readable").alias("readable"), F.col("body_signature").alias("signature"),
        F.col("body_prefix_signature").alias("prefix_signature"), F.col("body_unresolved_count").alias("unresolved"), F.col("body_unresolved_tokens").alias("tokens"),
    )


# Text functions of the formats.

_HEADER = "CASE WHEN lang = 'de' THEN '[zA423] ' ELSE '' END || split_part(text, ' ', 1) || CASE WHEN lang = 'fr' THEN '' ELSE '【' || split_part(text, ' ', 2) || '】' END || CASE WHEN lang = 'en' THEN ' ' || split_part(text, ' ', 3) ELSE '' END"


@query(f"""
WITH made AS (SELECT doc_id, regexp_replace({_HEADER}, '\\s+', ' ', 'g') AS header FROM documents), fixed AS (SELECT doc_id, {_FIX.format('header')} AS h FROM made)
SELECT doc_id, h AS fixed, {_KEY.format("split_part(h, '【', 1)")} AS head_part, {_BODY_START.format('h')} AS body_start,
       CASE WHEN regexp_matches(h, '^【([^】]+)】$') THEN regexp_extract(h, '^【([^】]+)】$', 1) WHEN contains(h, '【') THEN split_part(h, '【', 1) ELSE h END AS headword,
       CASE WHEN contains(h, '【') AND NOT regexp_matches(h, '^【([^】]+)】$') THEN split_part(split_part(h, '【', 2), '】', 1) END AS orthography,
       CASE WHEN regexp_matches('【' || h, '^【([^】]+)】') THEN '【' || regexp_extract('【' || h, '^【([^】]+)】', 1) || '】' END AS bracket
FROM fixed""")
def t_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = lambda n: F.split_part(F.col("text"), F.lit(" "), F.lit(n))
    lang = F.col("lang")
    header = F.concat(F.when(lang == "de", "[zA423] ").otherwise(""), word(1), F.when(lang == "fr", "").otherwise(F.concat(F.lit("【"), word(2), F.lit("】"))), F.when(lang == "en", F.concat(F.lit(" "), word(3))).otherwise(""))
    docs = _t(spark, sf_dir, "documents").select("doc_id", t.fix_header(t.one_space(header)).alias("h"))
    own = F.col("h")
    parts = t.header_parts(own)
    return docs.select(
        "doc_id", own.alias("fixed"), t.head_part(own).alias("head_part"), t.is_body_start(own).alias("body_start"), parts["headword"].alias("headword"), parts["orthography"].alias("orthography"),
        t.orthography_line(F.concat(F.lit("【"), own))["orthography"].alias("bracket"),
    )


_MARKED = {". ": ".<subentry> ", ", ": " <label>x</label>\t", " the ": "<usage>the\n\n\n", " of ": "<sense-group>of <derived>"}


@query(f"SELECT doc_id, md5({_readable(_put_sql(_MARKED))}) AS readable FROM documents")
def t_clean_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(t.clean_body(t.literally(F.col("text"), _MARKED))).alias("readable"))


@query("""
SELECT doc_id, lower(regexp_replace(substr(hex(encode(text)), 1, 256), '(..)', '\\1 ', 'g')) || '.' AS bytes, printf('%04X', doc_id) AS number,
       md5(trim(regexp_replace(regexp_replace(replace(text, ' the ', '⟦1F41⟧ ' || chr(9)), '⟦1F[0-9A-F]{2}⟧', '', 'g'), '[ \\t]+', ' ', 'g'), ' ' || chr(10))) AS preview
FROM documents""")
def b_hex_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.replace("text", F.lit(" the "), F.lit("⟦1F41⟧ \t"))
    raw = t.hex_bytes(F.substring(F.encode("text", "UTF-8"), 1, HEX_BYTES))
    ended = F.ltrim(F.concat(raw, F.lit(" .")))  # no space where there are no bytes
    return _t(spark, sf_dir, "documents").select("doc_id", ended.alias("bytes"), t.hex_number(F.col("doc_id")).alias("number"), F.md5(t.preview(shown)).alias("preview"))


# Blocks.

#: Controls, line ends and filler put into documents, so that their bytes are blocks of all kinds of units.
_CODED = {" the ": "\x1fA\x1f\n", " and ": "\x1f\x1f\x1f", " of ": " \x00\r", " in ": "\t\t\x80\n\n\n\n\n"}


def _quoted(text: str) -> str:
    """Text as SQL, its control characters by number."""
    parts = [f"chr({ord(c)})" if ord(c) < 32 else "'" + c.replace("'", "''") + "'" for c in text]
    return f"({' || '.join(parts)})"


def _coded_sql(column: str) -> str:
    for old, new in _CODED.items():
        column = f"replace({column}, '{old}', {_quoted(new)})"
    return column


_CELLS_SQL = "SELECT string_split('" + blocks.cells().replace("'", "''") + "', '') AS cells"
_SHOWN_SQL = f"""list_transform(u, lambda x: CASE WHEN length(x) = 1 AND x IN (chr(10), chr(13)) THEN chr(10) WHEN length(x) = 1 AND x = chr(0) THEN ''
  WHEN length(x) = 1 AND unicode(x) BETWEEN 32 AND 126 THEN x WHEN length(x) = 1 THEN ' ' WHEN x[1] = chr(31) AND x[2] IN (chr(10), chr(13)) THEN chr(10)
  WHEN x[1] = chr(31) THEN '⟦1F' || printf('%02X', unicode(x[2])) || '⟧' ELSE cells[94 * (unicode(x[1]) - 33) + unicode(x[2]) - 32] END)"""


def _nfkc_sql(column: str) -> str:
    """NFKC of what blocks can show, character by character."""
    changed = {c: n for c in sorted(set(blocks.cells())) if (n := normalize("NFKC", c)) != c}
    alone = {c: n for c, n in changed.items() if len(n) == 1}
    for c, n in changed.items():
        if len(n) > 1:
            column = f"replace({column}, '{c}', {_quoted(n)})"
    return f"translate({column}, {_quoted(''.join(alone))}, {_quoted(''.join(alone.values()))})"


_WIDE_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || '　'"


def _decoded_sql(chunks: str) -> str:
    """Common table expressions from chunks (a table with h, the bytes as hex digits) to decoded: text, preview, score, controls, n_units."""
    score = " + ".join(f"{p} * length(regexp_replace(preview, '{c.replace('[', '[^', 1) if c.startswith('[') else f'[^{c}]'}', '', 'g'))" for p, c in fixed.SCRIPT_SCORES)
    return f"""
cells AS ({_CELLS_SQL}),
signs AS (SELECT *, array_to_string(list_transform(range(0, strlen(h) // 2), lambda k: chr(CAST('0x' || substr(h, 2 * k + 1, 2) AS INT))), '') AS s FROM {chunks}),
units AS (SELECT * EXCLUDE s, regexp_extract_all(s, '(?s)\\x1F.|[\\x21-\\x7E]{{2}}|.') AS u FROM signs),
shown AS (
  SELECT * EXCLUDE (u, cells), trim(regexp_replace(regexp_replace(array_to_string({_SHOWN_SQL}, ''), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), {_WIDE_BLANKS}) AS text,
         list_transform(list_filter(u, lambda x: length(x) = 2 AND x[1] = chr(31)), lambda x: '1F' || printf('%02X', unicode(x[2]))) AS codes,
         len(list_filter(u, lambda x: x NOT IN (chr(0), chr(10), chr(13)))) AS n_units
  FROM units, cells),
previewed AS (SELECT *, trim(regexp_replace(regexp_replace({_nfkc_sql('text')}, '⟦1F[0-9A-F]{{2}}⟧', '', 'g'), '[ \\t]+', ' ', 'g'), {_WIDE_BLANKS}) AS preview FROM shown),
decoded AS (
  SELECT *, {score} AS score,
         array_to_string(list_transform(list_sort(list_distinct(codes)), lambda c: c || ':' || len(list_filter(codes, lambda x: x = c))), ',') AS controls
  FROM previewed)"""


def _controls(codes: Column) -> Column:
    """A map of counts as text, by code."""
    return F.array_join(F.transform(F.array_sort(F.map_keys(codes)), lambda c: F.concat(c, F.lit(":"), codes[c].cast("string"))), ",")


@query(f"""
WITH docs AS (SELECT doc_id, hex(encode({_coded_sql('text')})) AS whole FROM documents WHERE text IS NOT NULL),
chunks AS (SELECT doc_id, i AS block, substr(whole, i * 4096 + 1, 4096) AS h FROM docs, unnest(range(0, strlen(whole) // 4096)) AS r(i)),
{_decoded_sql('chunks')}
SELECT doc_id, block, printf('%04X', block) AS block_hex, score, md5(text) AS text, md5(preview) AS preview, controls, n_units AS n_tokens FROM decoded""")
def b_decode_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 2,048 bytes of every document, decoded; the rest at the end is dropped."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.encode(t.literally(F.col("text"), _CODED), "UTF-8").alias("content"))
    cut = docs.withColumn("n", F.floor(F.length("content") / 2048)).where("n > 0").select("doc_id", "content", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("block"))
    chunks = cut.select("doc_id", "block", F.expr("substring(content, cast(block * 2048 + 1 as int), 2048)").alias("chunk"))
    read = blocks.with_decoded(chunks).withColumn("shown", blocks.preview(F.col("text")))
    controls = _controls(blocks.control_counts(F.col("codes"), F.col("counts")))
    return read.select("doc_id", "block", t.hex_number(F.col("block")).alias("block_hex"), t.script_score(F.col("shown")).alias("score"), F.md5("text").alias("text"), F.md5("shown").alias("preview"), controls.alias("controls"), F.col("n_units").alias("n_tokens"))


_FILE_DOCS, _FILE_SIZES, _FILE_KNOWN = 250, [512, 2048], [3, 15, 900]


def _block_files(spark: SparkSession, sf_dir: str) -> list[tuple[str, str]]:
    """Files of some 250 documents each, their texts with controls one after the other; (name, path) of each."""
    path = scratch(spark)
    docs = _t(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / _FILE_DOCS).alias("part"), "doc_id", t.literally(F.coalesce("text", F.lit("")), _CODED).alias("value"))
    docs.repartition("part").sortWithinPartitions("part", "doc_id").drop("doc_id").write.partitionBy("part").option("lineSep", "\n").text(path)
    files = spark.read.format("binaryFile").load(path).select("path").collect()  # a listing, no contents
    return sorted((r["path"].rsplit("part=", 1)[1].split("/")[0], r["path"]) for r in files)


_BLOCKS_SQL = f"""
files AS (SELECT doc_id // {_FILE_DOCS} AS part, hex(encode(string_agg({_coded_sql("coalesce(text, '')")} || chr(10), '' ORDER BY doc_id))) AS whole FROM documents GROUP BY 1),
sized AS (SELECT *, strlen(whole) // 2 // size AS n FROM files, (SELECT unnest({_FILE_SIZES}) AS size))"""


@query(f"""
WITH {_BLOCKS_SQL},
chunks AS (
  SELECT part, size, i AS block, substr(whole, i * size * 2 + 1, size * 2) AS h FROM sized, unnest(range(0, n)) AS r(i)
  WHERE i % greatest(1, n // 400) = 0 OR i IN {tuple(_FILE_KNOWN)}),
{_decoded_sql('chunks')},
ranked AS (SELECT *, row_number() OVER (PARTITION BY part, size ORDER BY score DESC, block) AS rn FROM decoded WHERE score > 80 OR block IN {tuple(_FILE_KNOWN)})
SELECT part || ':' || size || ':' || block AS id, printf('%04X', block) AS block_hex, block * size AS at, score, row_number() OVER (PARTITION BY part, size ORDER BY rn) AS rank,
       md5(substr(text, 1, 3000)) AS text, md5(substr(preview, 1, 3000)) AS preview, controls, trim(lower(regexp_replace(substr(h, 1, 256), '(..)', '\\1 ', 'g'))) AS bytes
FROM ranked WHERE rn <= 40 OR block IN {tuple(_FILE_KNOWN)}""")
def b_block_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as block files, of which only the sampled blocks are read: the best 40 of each file and size, then the known ones."""
    read = read_ranges(spark, _block_files(spark, sf_dir), _FILE_SIZES, _FILE_KNOWN, samples=SAMPLES)
    got = block_samples(read, known=_FILE_KNOWN)
    return got.select(
        "id", "block_hex", F.col("offset").alias("at"), F.col("score").cast("bigint").alias("score"), F.col("rank").cast("bigint").alias("rank"), F.md5("decoded_with_controls").alias("text"),
        F.md5("normalized_preview").alias("preview"), _controls(F.col("control_codes")).alias("controls"), F.col("raw_hex_first_128").alias("bytes"),
    )


@query(f"""
WITH {_BLOCKS_SQL},
chunks AS (
  SELECT part, size, known, greatest(0, known - 2) AS first, least(n, known + 6) AS stop, substr(whole, greatest(0, known - 2) * size * 2 + 1, (least(n, known + 6) - greatest(0, known - 2)) * size * 2) AS h
  FROM sized, (SELECT CAST(unnest({_FILE_KNOWN}) AS BIGINT) AS known) WHERE known < n),
{_decoded_sql('chunks')}
SELECT part || ':' || size || ':' || known || ':window' AS id, printf('%04X', known) AS known_hex, first, stop - 1 AS last, first * size AS at, md5(substr(text, 1, 12000)) AS text, md5(substr(preview, 1, 12000)) AS preview, controls
FROM decoded""")
def b_known_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the same files only the blocks around the known ones are read."""
    got = known_windows(read_ranges(spark, _block_files(spark, sf_dir), _FILE_SIZES, _FILE_KNOWN, window=(BEFORE, AFTER)))
    return got.select(
        "id", F.col("known_block_hex").alias("known_hex"), F.col("window_start_block").alias("first"), F.col("window_end_block").alias("last"), F.col("offset").alias("at"),
        F.md5("decoded_with_controls").alias("text"), F.md5("normalized_preview").alias("preview"), _controls(F.col("control_codes")).alias("controls"),
    )


# Rules and restorations.

_CLUED = "つかまえる。「とんぼを―」" + "皮算用"


@query(f"""
WITH entries AS (SELECT doc_id, CASE WHEN lang = 'es' THEN 'と・る【捕る】' ELSE 'x' || doc_id END AS header, 'body ' || doc_id AS body FROM documents),
last AS (SELECT arg_max(body, doc_id) AS body FROM entries WHERE header = 'と・る【捕る】')
SELECT doc_id,
       CASE WHEN source = 'src0' THEN NULL WHEN lang = 'de' AND (SELECT body FROM last) IS NOT NULL THEN 'body_clue_known' WHEN lang = 'fr' THEN 'inline_source_line_split' WHEN lang = 'en' THEN 'head_only_source_line' END AS method,
       CASE WHEN source = 'src0' THEN NULL WHEN lang = 'de' THEN (SELECT body FROM last) WHEN lang = 'fr' THEN 'わずかの間も、もちこたえられない。' WHEN lang = 'en' THEN '' END AS body,
       CASE WHEN source = 'src0' THEN NULL WHEN lang = 'de' AND (SELECT body FROM last) IS NOT NULL THEN 'と・る【捕る】' WHEN lang = 'fr' THEN 'ひとたまりも―ない' WHEN lang = 'en' THEN 'ひらべった・い' END AS header
FROM documents""")
def j_apply_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as drafts: German ones have the clues in their bodies, French and English ones a header that a rule names, those of src0 are restored already."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    lang = F.col("lang")
    header = F.when(lang == "es", "と・る【捕る】").otherwise(F.concat(F.lit("x"), F.col("doc_id").cast("string")))
    body = F.concat(F.lit("body "), F.col("doc_id").cast("string"))
    made = docs.select(F.lit("f").alias("file"), F.col("doc_id").alias("ord"), *[header.alias(c) for c in ("headword_line", "headword_line_mapped")], *[body.alias(c) for c in ("body_raw", "body_mapped", "body_readable")])
    entries = headline_fields(made)
    shape = F.lit(None).cast(entries.select(F.struct(*entries.columns).alias("x")).schema["x"].dataType)
    rows = docs.select(
        "doc_id", F.when(lang == "fr", fixed.MANUAL_HEADERS[0][0]).when(lang == "en", fixed.MANUAL_HEADERS[1][0]).otherwise("none").alias("header_key"),
        F.when(lang == "de", F.concat(F.lit("pre "), F.lit(_CLUED))).otherwise("nothing").alias("body_key"), shape.alias("row"), F.lit(None).cast("string").alias("method"), (F.col("source") == "src0").alias("restored"),
    )
    return apply_rules(rows, entries).select("doc_id", "method", F.col("row.body_readable").alias("body"), F.col("row.headword_line").alias("header"))


_SPOKEN = "replace(replace(text, '. ', '［' || CASE WHEN source = 'src0' THEN 'ai' ELSE 'ei' END || ' [hA121]］' || chr(10)), ', ', ' [zA423]' || chr(10))"
_FIRST_HEAD = r"list_filter(list_transform(string_split(replace(text, ', ', chr(10)), '. ')[1:1], lambda x: trim(string_split(x, chr(10))[-1], ' ')), lambda x: true)[1]"


_RESTORED_SPOKEN = f"""
lines AS (
  SELECT doc_id, i - 1 AS ord, parts[i] AS line, i < len(parts) AS ended
  FROM (SELECT doc_id, string_split({_SPOKEN}, chr(10)) AS parts FROM documents WHERE length(text) > 0), unnest(range(1, len(parts) + 1)) AS r(i)),
cut AS (SELECT *, regexp_matches(line, '{_HEAD_SQL}') AS head FROM lines),
segs AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY ord) AS seg FROM cut),
raw AS (
  SELECT doc_id, max(ord) FILTER (head) AS ord, max(line) FILTER (head) AS line, bool_or(ended) FILTER (head) AS ended, {_STRIP.format("coalesce(string_agg(line, chr(10) ORDER BY ord) FILTER (NOT head), '')")} AS body_raw
  FROM segs WHERE seg > 0 GROUP BY doc_id, seg),
entries AS (
  SELECT CAST(doc_id AS VARCHAR) AS file, ord, {_STRIP.format(f"regexp_extract(line, '{_HEAD_SQL}', 1)")} AS headword, {_STRIP.format(f"regexp_extract(line, '{_HEAD_SQL}', 2)")} AS pron, body_raw FROM raw WHERE ended),
keyed AS (SELECT *, {_KEY.format(_rewritten(_mapped('pron')))} AS spoken, unnest([{{'m': 1, 'k': headword}}, {{'m': 2, 'k': {_HEADWORD.format('headword')}}}], recursive := true) FROM entries),
looks AS (SELECT m, k, arg_min(pron, (file, ord)) AS pron, arg_min(spoken, (file, ord)) AS spoken, arg_min(body_raw, (file, ord)) AS body_raw FROM keyed GROUP BY m, k HAVING count(DISTINCT spoken) = 1),
drafts AS (SELECT doc_id, lang, source, {_FIRST_HEAD} AS w FROM documents),
named AS (
  SELECT doc_id, CASE WHEN lang = 'fr' THEN 'zzz' WHEN lang = 'de' THEN translate(w, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE w END AS h, CASE WHEN lang = 'fr' THEN w END AS o FROM drafts WHERE source <> 'src3'),
wanted AS (
  SELECT doc_id, unnest([{{'s': 1, 'm': 1, 'k': h}}, {{'s': 2, 'm': 2, 'k': {_HEADWORD.format('h')}}}, {{'s': 3, 'm': 2, 'k': CASE WHEN o <> '' THEN {_HEADWORD.format('o')} END}}], recursive := true)
  FROM named),
hits AS (SELECT doc_id, min(s) AS s, arg_min(pron, s) AS pron, arg_min(spoken, s) AS spoken, arg_min(body_raw, s) AS body_raw FROM wanted JOIN looks USING (m, k) GROUP BY doc_id)"""
_SPOKEN_METHOD = "CASE s WHEN 1 THEN 'headword_exact' WHEN 2 THEN 'headword_normalized' WHEN 3 THEN 'orthography_normalized' END"


def _restored_pronunciations(spark: SparkSession, sf_dir: str) -> Restored:
    """The whole restoration: documents are the dump, and drafts that seek their first entry by its headword, by that in capitals, or by the orthography."""
    docs = _t(spark, sf_dir, "documents")
    spoken = F.when(F.col("source") == "src0", "ai").otherwise("ei")
    dump = F.replace(F.replace(F.col("text"), F.lit(". "), F.concat(F.lit("［"), spoken, F.lit(" [hA121]］\n"))), F.lit(", "), F.lit(" [zA423]\n"))
    dumps = docs.select(F.col("doc_id").cast("string").alias("file"), dump.alias("text"))
    first = F.replace(F.substring_index("text", ". ", 1), F.lit(", "), F.lit("\n"))
    word = F.btrim(F.substring_index(first, "\n", -1), F.lit(" "))
    lang = F.col("lang")
    ids = F.col("doc_id").cast("string")
    drafts = docs.select(
        F.lit("drafts").alias("file"), F.col("doc_id").alias("ord"), ids.alias("id"), F.when(lang == "fr", "zzz").when(lang == "de", F.translate(word, ascii_lowercase, ascii_uppercase)).otherwise(word).alias("headword"),
        F.when(lang == "fr", word).alias("orthography"), F.struct(F.when(F.col("source") == "src3", "other").otherwise(fixed.DEFAULT_SOURCE).alias("source_id")).alias("source"),
        F.struct(F.lit("1").alias("block_guess"), F.lit("2").alias("byte_offset_guess")).alias("location"), F.struct(F.lit("n").alias("normalized")).alias("body"),
    ).withColumn("_raw", F.to_json(F.struct("id", F.array(F.lit("note")).alias("notes"))))
    return restore_pronunciations(drafts, dumps, TOKENS)


@query(f"""
WITH {_RESTORED_SPOKEN}
SELECT CAST(doc_id AS VARCHAR) AS id, source <> 'src3' AS mine, {_SPOKEN_METHOD} AS method,
       pron, spoken, md5(body_raw) AS body, md5({_readable(_mapped('body_raw'))}) AS readable, CASE WHEN s IS NULL THEN 1 ELSE 3 END AS n_notes
FROM drafts LEFT JOIN hits USING (doc_id)""")
def p_restore_pronunciations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drafts with what was restored, read from their finished lines."""
    got = _restored_pronunciations(spark, sf_dir).rows
    shape = "id string, notes array<string>, body struct<restored_old_text_raw:string,restored_old_text_readable:string>, pronunciation struct<raw:string,normalized:string,match_method:string>"
    rows = got.select("id", "mine", F.from_json("line", shape).alias("j"))
    return rows.select(
        "id", "mine", F.col("j.pronunciation.match_method").alias("method"), F.col("j.pronunciation.raw").alias("pron"), F.col("j.pronunciation.normalized").alias("spoken"),
        F.md5("j.body.restored_old_text_raw").alias("body"), F.md5("j.body.restored_old_text_readable").alias("readable"), F.size("j.notes").alias("n_notes"),
    )


@query(f"""
WITH {_RESTORED_SPOKEN}, found AS (SELECT d.doc_id, h, o, s, pron, spoken, body_raw FROM named d JOIN hits USING (doc_id))
SELECT CAST(doc_id AS VARCHAR) AS id, '{fixed.DEFAULT_SOURCE}' AS source_id, h AS headword, o AS orthography, pron AS pronunciation_raw, spoken AS pronunciation_normalized, {_SPOKEN_METHOD} AS match_method,
       '1' AS block_guess, '2' AS byte_offset_guess, 'n' AS body_snippet, substr({_readable(_mapped('body_raw'))}, 1, 220) AS body_restored_snippet,
       len(regexp_extract_all({_mapped('body_raw')}, '{_TOKEN}')) AS unresolved, row_number() OVER (ORDER BY doc_id) <= 240 AS sampled
FROM found""")
def p_verified_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of what was restored, with what its sample of the first 240 rows holds."""
    got = _restored_pronunciations(spark, sf_dir)
    sample = got.sample.select("ord", F.struct("id", "headword", "orthography", "pronunciation", "match_method", "body_restored_snippet").alias("shown"))
    rows = got.index.join(sample, "ord", "left")
    same = F.struct("id", "headword", "orthography", F.col("pronunciation_normalized").alias("pronunciation"), "match_method", "body_restored_snippet")
    return rows.select(
        "id", "source_id", "headword", "orthography", "pronunciation_raw", "pronunciation_normalized", "match_method", "block_guess", "byte_offset_guess", "body_snippet", "body_restored_snippet",
        F.col("body_unresolved_count").cast("bigint").alias("unresolved"), F.col("shown").eqNullSafe(same).alias("sampled"),
    )


@query(f"""
WITH {_RESTORED_SPOKEN},
sums AS (SELECT (SELECT count(*) FROM drafts) AS total, (SELECT count(*) FROM named) AS filtered, count(*) AS verified, count(*) FILTER (s = 1) AS one, count(*) FILTER (s = 2) AS two, count(*) FILTER (s = 3) AS three,
                CAST(coalesce(sum(len(regexp_extract_all({_mapped('body_raw')}, '{_TOKEN}'))), 0) AS BIGINT) AS unresolved FROM hits),
keys AS (SELECT m, count(*) AS n, count(*) FILTER (spoken_ways = 1) AS usable FROM (SELECT m, k, count(DISTINCT spoken) AS spoken_ways FROM keyed GROUP BY m, k) GROUP BY m),
named_counts AS (
  SELECT unnest([{{'name': 'total_entries', 'n': total}}, {{'name': 'filtered_entries', 'n': filtered}}, {{'name': 'verified_matches', 'n': verified}}, {{'name': 'headword_exact', 'n': one}},
    {{'name': 'headword_normalized', 'n': two}}, {{'name': 'orthography_normalized', 'n': three}}, {{'name': 'restored_body_total', 'n': verified}}, {{'name': 'unmatched_filtered', 'n': filtered - verified}}], recursive := true) FROM sums)
SELECT name, n FROM named_counts WHERE n > 0
UNION ALL SELECT 'restored_body_unresolved_tokens', unresolved FROM sums WHERE verified > 0
UNION ALL SELECT 'old_rows', count(*) FROM entries
UNION ALL SELECT CASE m WHEN 1 THEN 'exact_keys' ELSE 'normalized_keys' END, n FROM keys
UNION ALL SELECT CASE m WHEN 1 THEN 'exact_lookup_keys' ELSE 'normalized_lookup_keys' END, usable FROM keys
UNION ALL SELECT CASE m WHEN 1 THEN 'ambiguous_exact_keys' ELSE 'ambiguous_normalized_keys' END, n - usable FROM keys
UNION ALL SELECT 'verified_per_million', CAST(round_even(verified / filtered, 6) * 1000000 AS BIGINT) FROM sums""")
def k_pronunciation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the pronunciations' restoration, one figure a row."""
    report = _restored_pronunciations(spark, sf_dir).report
    lookup = F.from_json(F.to_json("lookup"), "map<string,bigint>")
    ratio = F.create_map(F.lit("verified_per_million"), F.round(F.col("coverage.verified_ratio") * 1_000_000).cast("bigint"))
    return report.select(F.explode(F.map_concat("merge_counts", lookup, ratio)).alias("name", "n"))


#: A dump entry for each document, with headers of all kinds, and a draft for each, whose number says what it can be found by.
_IDS = "CAST(doc_id AS VARCHAR)"
_OWN_HEADER = f"""CASE WHEN doc_id % 1000 = 5 THEN '{fixed.MANUAL_CLUES[0][1]}' WHEN doc_id % 10 = 7 THEN 'dup【x】' WHEN doc_id % 10 = 8 THEN 'はん【[zA42E]】' WHEN doc_id % 10 = 9 THEN 'g' || {_IDS}
  WHEN doc_id % 10 = 6 THEN '[zA423]k' || {_IDS} || '【y】' ELSE 'h' || {_IDS} || '【' || coalesce(source, 's') || '】' END"""
_DUMP_TEXT = f"({_OWN_HEADER} || chr(10) || '〈n〉 ' || CASE WHEN doc_id % 3 = 0 THEN '[hA1FF] [hA121] ' ELSE '' END || coalesce(text, ''))"
_DRAFT_HEADER = f"""CASE WHEN doc_id % 12 IN (0, 6) THEN {_FIX.format(f'({_OWN_HEADER})')} WHEN doc_id % 12 = 1 THEN 'h' || {_IDS} || '【zz】' WHEN doc_id % 12 = 11 THEN 'dup【x】'
  WHEN doc_id % 12 = 8 THEN '{fixed.MANUAL_HEADERS[0][0]}' WHEN doc_id % 12 = 9 THEN '{fixed.MANUAL_HEADERS[1][0]}' ELSE 'none' || {_IDS} END"""
_DRAFT_BODY = f"""CASE doc_id % 12 WHEN 2 THEN '〈n〉 ' || coalesce(text, '') WHEN 3 THEN '〈n〉 ' || substr(coalesce(text, ''), 1, 60) || 'ZZZZ' || substr(coalesce(text, ''), 61)
  WHEN 7 THEN 'pre ' || '{"".join(fixed.MANUAL_CLUES[0][0])}' ELSE 'nothing ' || {_IDS} END"""
_METHOD_NAMES = ["header_normalized_exact", "head_part_unique", "body_signature_unique", "body_prefix_signature_unique"]
_RESTORED_HEADLINES = f"""
{_headline_entries_sql(_DUMP_TEXT)},
keyed AS (
  SELECT *, row_number() OVER (ORDER BY doc_id, ord) - 1 AS place, {_KEY.format('header_mapped')} AS mapped_key, {_KEY.format("split_part(header_mapped, '【', 1)")} AS head_part,
         {_SIGNATURE.format('readable')} AS sig, starts_with(header_mapped, '【') AS bracket,
         list_sort(list_distinct(regexp_extract_all(body_mapped, '{_TOKEN}', 1))) AS tokens
  FROM entries),
looks AS (
  SELECT 0 AS s, mapped_key AS k, max(place) AS place FROM keyed GROUP BY mapped_key
  UNION ALL SELECT 1, head_part, min(place) FROM keyed WHERE NOT bracket GROUP BY head_part HAVING count(*) = 1
  UNION ALL SELECT 2, substr(sig, 1, 80), min(place) FROM keyed GROUP BY 2 HAVING count(*) = 1 AND NOT bool_or(bracket)
  UNION ALL SELECT 3, substr(sig, 1, 40), min(place) FROM keyed GROUP BY 2 HAVING count(*) = 1 AND NOT bool_or(bracket)),
drafts AS (SELECT doc_id, {_DRAFT_HEADER} AS header_key, {_DRAFT_BODY} AS body, doc_id % 12 = 10 AS flagged FROM documents),
signed AS (SELECT *, {_KEY.format("split_part(header_key, '【', 1)")} AS part, {_SIGNATURE.format('body')} AS own_sig FROM drafts),
wanted AS (
  SELECT doc_id, unnest([{{'s': 0, 'k': header_key}}, {{'s': 1, 'k': CASE WHEN part <> '' THEN part END}}, {{'s': 2, 'k': substr(own_sig, 1, 80)}}, {{'s': 3, 'k': substr(own_sig, 1, 40)}}], recursive := true)
  FROM signed),
hits AS (SELECT doc_id, min(s) AS s, arg_min(place, s) AS place FROM wanted JOIN looks USING (s, k) GROUP BY doc_id),
first AS (
  SELECT d.*, s, place, coalesce(mapped_key, header_key) AS along_key, flagged OR s IS NOT NULL AS found, sum((flagged OR s IS NOT NULL)::INT) OVER (ORDER BY d.doc_id) AS grp
  FROM drafts d LEFT JOIN hits USING (doc_id) LEFT JOIN (SELECT place, mapped_key FROM keyed) USING (place)),
islands AS (SELECT grp, min(doc_id) AS start, count(*) AS n FROM first WHERE NOT found GROUP BY grp),
bounded AS (
  SELECT i.*, a.along_key AS k1, b.along_key AS k2 FROM islands i JOIN first a ON a.found AND a.doc_id = start - 1 JOIN first b ON b.found AND b.doc_id = start + n),
one AS (
  SELECT grp, min(start) AS start, min(a.place) AS p FROM bounded JOIN keyed a ON a.mapped_key = k1 JOIN keyed b ON b.place = a.place + n + 1 AND b.mapped_key = k2
  GROUP BY grp HAVING count(*) = 1),
bridged AS (SELECT doc_id, p + 1 + doc_id - start AS filler FROM first JOIN one USING (grp) WHERE NOT found),
clued AS (SELECT max(place) AS clue_place FROM keyed WHERE mapped_key = '{fixed.MANUAL_CLUES[0][1]}'),
chosen AS (
  SELECT f.*, filler, CASE WHEN NOT found AND filler IS NULL AND {" AND ".join(f"contains(body, '{c}')" for c in fixed.MANUAL_CLUES[0][0])} THEN clue_place END AS by_clue
  FROM first f LEFT JOIN bridged USING (doc_id), clued),
placed AS (
  SELECT doc_id, header_key, body, flagged, coalesce(filler, place, by_clue) AS spot,
         CASE WHEN filler IS NOT NULL THEN 'positional_window_unique' WHEN s IS NOT NULL THEN {_METHOD_NAMES}[s + 1] WHEN by_clue IS NOT NULL THEN '{fixed.MANUAL_CLUES[0][2]}'
              WHEN NOT flagged THEN CASE header_key {" ".join(f"WHEN '{h}' THEN '{m}'" for h, _, _, m in fixed.MANUAL_HEADERS)} END END AS method
  FROM chosen),
rows AS (
  SELECT p.doc_id, p.header_key, p.body, flagged, method,
         CASE method {" ".join(f"WHEN '{m}' THEN '{line}'" for _, line, _, m in fixed.MANUAL_HEADERS)} ELSE mapped_key END AS entry_key,
         CASE method {" ".join(f"WHEN '{m}' THEN '{body}'" for _, _, body, m in fixed.MANUAL_HEADERS)} ELSE readable END AS entry_body, coalesce(tokens, []) AS tokens
  FROM placed p LEFT JOIN (SELECT place AS spot, mapped_key, readable, tokens FROM keyed) USING (spot))"""


def _restored_headlines(spark: SparkSession, sf_dir: str) -> Restored:
    """The whole restoration of drafts by head lines: a dump entry and a draft for each document."""
    docs = _t(spark, sf_dir, "documents")
    n, ids, text = F.col("doc_id"), F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))
    clue, headers = fixed.MANUAL_CLUES[0], fixed.MANUAL_HEADERS
    plain = F.concat(F.lit("h"), ids, F.lit("【"), F.coalesce("source", F.lit("s")), F.lit("】"))
    kinds = [(7, F.lit("dup【x】")), (8, F.lit("はん【[zA42E]】")), (9, F.concat(F.lit("g"), ids)), (6, F.concat(F.lit("[zA423]k"), ids, F.lit("【y】")))]
    header = F.when(n % 1000 == 5, clue[1])
    for rest, value in kinds:
        header = header.when(n % 10 == rest, value)
    header = header.otherwise(plain)
    dump = F.concat(header, F.lit("\n〈n〉 "), F.when(n % 3 == 0, "[hA1FF] [hA121] ").otherwise(""), text)
    dumps = docs.select(F.lpad(ids, 18, "0").alias("file"), dump.alias("text"))
    m = n % 12
    sought = (
        F.when(m.isin(0, 6), t.fix_header(header)).when(m == 1, F.concat(F.lit("h"), ids, F.lit("【zz】"))).when(m == 11, "dup【x】")
        .when(m == 8, headers[0][0]).when(m == 9, headers[1][0]).otherwise(F.concat(F.lit("none"), ids))
    )
    body = (
        F.when(m == 2, F.concat(F.lit("〈n〉 "), text)).when(m == 3, F.concat(F.lit("〈n〉 "), F.substring(text, 1, 60), F.lit("ZZZZ"), F.substring(text, 61, 2147483647)))
        .when(m == 7, F.lit("pre " + "".join(clue[0]))).otherwise(F.concat(F.lit("nothing "), ids))
    )
    none = F.lit(None)
    canonical = F.struct(body.alias("body"), none.cast("string").alias("body_quality"), none.cast("boolean").alias("review_ready"), F.when(m == 10, "earlier").alias("body_match_method"), none.cast("array<string>").alias("body_unresolved_tokens"))
    fields = [ids.alias("id"), none.cast("string").alias("headword"), none.cast("string").alias("orthography"), F.struct(sought.alias("normalized")).alias("header"), canonical.alias("canonical"), F.struct((m == 10).alias("body_restored_from_old_text")).alias("master_status")]
    drafts = docs.select(F.lit("drafts").alias("file"), n.alias("ord"), *fields).withColumn("_raw", F.to_json(F.struct("id", "header", "canonical", "master_status", F.array(F.lit("draft")).alias("notes"))))
    return restore_headlines(drafts, lines_of(dumps), TOKENS, "dump")


@query(f"""
WITH {_RESTORED_HEADLINES}, shaped AS (SELECT *, regexp_matches(entry_key, '^【([^】]+)】$') AS alone, contains(entry_key, '【') AND contains(entry_key, '】') AS paired FROM rows)
SELECT {_IDS} AS id, method, flagged OR method IS NOT NULL AS restored, CASE WHEN method IS NULL THEN header_key ELSE entry_key END AS header, CASE WHEN method IS NOT NULL THEN header_key END AS first_header,
       CASE WHEN method IS NULL THEN NULL WHEN alone THEN regexp_extract(entry_key, '^【([^】]+)】$', 1) WHEN paired THEN split_part(entry_key, '【', 1) ELSE entry_key END AS headword,
       CASE WHEN method IS NOT NULL AND paired AND NOT alone THEN split_part(regexp_extract(entry_key, '【(.*)$', 1), '】', 1) END AS orthography,
       md5(CASE WHEN method IS NULL THEN body ELSE entry_body END) AS body, CASE WHEN method IS NOT NULL THEN len(tokens) END AS n_left,
       CASE WHEN method IS NOT NULL THEN len(tokens) = 0 AND entry_body <> '' END AS ready, CASE WHEN method = 'positional_window_unique' THEN 'old-text' WHEN method IS NOT NULL THEN 'dump' END AS body_source,
       CASE WHEN method IS NULL THEN 1 ELSE 2 END AS n_notes
FROM shaped""")
def p_restore_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _restored_headlines(spark, sf_dir).rows
    shape = (
        "id string, headword string, orthography string, notes array<string>, header struct<normalized:string,extracted_normalized:string>, "
        "canonical struct<body:string,body_source:string,review_ready:boolean,body_unresolved_tokens:array<string>>"
    )
    rows = got.select("method", "restored", F.from_json("line", shape).alias("j"))
    left = F.col("j.canonical.body_unresolved_tokens")
    return rows.select(
        "j.id", "method", "restored", F.col("j.header.normalized").alias("header"), F.col("j.header.extracted_normalized").alias("first_header"), "j.headword", "j.orthography",
        F.md5("j.canonical.body").alias("body"), F.when(left.isNotNull(), F.size(left)).cast("bigint").alias("n_left"), F.col("j.canonical.review_ready").alias("ready"),
        "j.canonical.body_source", F.size("j.notes").alias("n_notes"),
    )


@query(f"""
WITH {_RESTORED_HEADLINES},
counts AS (
  SELECT count(*) AS total, count(*) FILTER (flagged OR method IS NOT NULL) AS restored, CAST(coalesce(sum(CASE WHEN method IS NOT NULL THEN len(tokens) END), 0) AS BIGINT) AS unresolved FROM rows),
named AS (
  SELECT unnest([{{'name': 'total_entries', 'n': total}}, {{'name': 'restored_matches', 'n': restored}}, {{'name': 'unmatched_entries', 'n': total - restored}}, {{'name': 'restored_unresolved_tokens', 'n': unresolved}}], recursive := true) FROM counts
  UNION ALL SELECT 'match_method:' || coalesce(method, 'earlier'), count(*) FROM rows WHERE flagged OR method IS NOT NULL GROUP BY 1)
SELECT name, n, (SELECT count(*) FROM keyed) AS old_rows, round_even(restored / total, 6) AS ratio FROM named, counts WHERE n > 0 OR name = 'restored_unresolved_tokens'""")
def k_headline_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the whole restoration: its counters, one a row, with the dump's size and the share that was restored."""
    report = _restored_headlines(spark, sf_dir).report
    return report.select(F.explode("merge_counts").alias("name", "n"), "old_rows", F.col("coverage.restored_ratio").alias("ratio"))


# Files.


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ord, doc_id, lang, md5(text) AS text FROM documents")
def k_jsonl_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/documents.jsonl"
    write_jsonl(_t(spark, sf_dir, "documents").select("doc_id", "lang", "text"), path, [F.col("doc_id")])
    return read_drafts(spark, path, "doc_id bigint, lang string, text string").select("ord", "doc_id", "lang", F.md5("text").alias("text"))


@query("""
SELECT 0 AS ord, 'c_custkey' || chr(9) || 'c_name' || chr(9) || 'c_mktsegment' AS line
UNION ALL SELECT row_number() OVER (ORDER BY c_name DESC, c_custkey), concat_ws(chr(9), CAST(c_custkey AS VARCHAR), c_name, c_mktsegment) FROM customer""")
def k_tsv_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/customer.tsv"
    write_tsv(_t(spark, sf_dir, "customer"), path, ["c_custkey", "c_name", "c_mktsegment"], [F.desc("c_name"), F.col("c_custkey")])
    return read_text_lines(spark, path).select("ord", "line")


@query("""
SELECT row_number() OVER (ORDER BY p_size, p_partkey) AS place, '<section><h2>' || replace(p_name || ' <&>', '<&>', '&lt;&amp;&gt;') || '</h2><small>' || p_brand || '</small><h3>Type</h3><pre>' || p_type || '</pre></section>' AS line
FROM part ORDER BY p_size, p_partkey LIMIT 80""")
def k_html_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of at most 80 sections, which is what the export shows."""
    path = f"{scratch(spark)}/part.html"
    parts = _t(spark, sf_dir, "part").withColumn("name", F.concat("p_name", F.lit(" <&>")))
    write_html(parts, path, "Parts", "The smallest.", "name", F.col("p_brand"), [("Type", "p_type")], [F.col("p_size"), F.col("p_partkey")], 80)
    lines = read_text_lines(spark, path).where(F.startswith("line", F.lit("<section>")))
    return lines.select((F.col("ord") - lines.agg(F.min("ord")).first()[0] + 1).alias("place"), "line")


@query("SELECT count(*) AS entries, count(DISTINCT source) AS sources, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents")
def k_report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/report.json"
    sums = _t(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("source").alias("sources"), F.sum("n_chars").alias("chars"))
    write_report(sums.select(F.struct("entries", "sources").alias("counts"), "chars"), path)
    return spark.read.schema("counts struct<entries:bigint,sources:bigint>, chars bigint").json(path, multiLine=True).select("counts.*", "chars")


@query("""
WITH plain AS (SELECT regexp_replace(replace(replace(text, ' the ', ' あ '), ' of ', ' カ '), '[^\\x00-\\x7Fあカ]', '?', 'g') AS text FROM documents)
SELECT md5(line) AS line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM plain) GROUP BY 1""")
def s_cp932_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as CP932 files with line ends of two characters, their bytes written as they are, then read as dumps."""
    path = scratch(spark)
    plain = F.regexp_replace(t.literally(F.col("text"), {" the ": " あ ", " of ": " カ "}), "[^\\x00-\\x7Fあカ]", "?")
    digits = F.hex(F.encode(F.replace(plain, F.lit("\n"), F.lit("\r\n")), "UTF-8"))
    coded = t.literally(digits, {x.encode().hex().upper(): x.encode("cp932").hex().upper() for x in "あカ"})
    _t(spark, sf_dir, "documents").select(F.unhex(coded).cast("string").alias("value")).write.option("lineSep", "\r\n").text(path)
    return read_dump(spark, path).groupBy(F.md5("line").alias("line")).agg(F.count(F.lit(1)).alias("n"))


_MAP_SQL = "SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'hA' ELSE 'zA' END || printf('%03X', s_suppkey // 2 % 4096) AS token, arg_max(s_name, s_suppkey) AS value FROM supplier GROUP BY 1"


def _map_file(spark: SparkSession, sf_dir: str) -> str:
    """A token map as a JSON document: a token for each supplier, the last one of a token naming it, as two letters and three digits name 8,192."""
    path = f"{scratch(spark)}/map.json"
    kind = F.when(F.col("s_suppkey") % 2 == 0, "hA").otherwise("zA")
    named = _t(spark, sf_dir, "supplier").groupBy(F.concat(kind, t.hex_number(F.floor(F.col("s_suppkey") / 2) % 4096, 3)).alias("token")).agg(F.max_by("s_name", "s_suppkey").alias("s_name"))
    entry = F.struct(F.col("s_name").alias("value"), F.lit("k").alias("kind"), F.lit("high").alias("confidence"), F.array(F.lit("e")).alias("evidence"))
    rows = named.select("token", entry.alias("x"))
    write_report(rows.agg(F.map_from_entries(F.collect_list(F.struct("token", "x"))).alias("tokens")).select(F.lit("solved").alias("status"), F.lit("all").alias("scope"), "tokens"), path)
    return path


@query(f"SELECT token, value, 'k' AS kind, 'high' AS confidence, 1 AS n_evidence, replace('a [' || token || '] [zA42]', '[' || token || ']', value) AS shown FROM ({_MAP_SQL})")
def s_token_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _map_file(spark, sf_dir)
    rows, tokens = read_token_rows(spark, path), read_token_map(spark, path)
    shown = t.map_tokens(F.concat(F.lit("a ["), "token", F.lit("] [zA42]")), tokens)
    return rows.select("token", "value", "kind", "confidence", F.size("evidence").alias("n_evidence"), shown.alias("shown"))


@query(f"""
WITH whole AS ({_MAP_SQL}), counts AS (SELECT count(*) AS n, count(*) FILTER (token LIKE 'hA%') AS spoken, count(*) FILTER (token LIKE 'zA%') AS common FROM whole)
SELECT 'missing' AS kind, n - spoken - common AS n FROM counts UNION ALL SELECT 'extra', 0 UNION ALL SELECT 'shared', 0 UNION ALL SELECT 'spoken', spoken FROM counts UNION ALL SELECT 'common', common FROM counts""")
def map_split_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A token map split in two, as files that are read again: the parts share no token and make up the whole."""
    whole = read_token_rows(spark, _map_file(spark, sf_dir)).select("token", "value")
    folder = scratch(spark)
    for kind, name in (("hA", "spoken"), ("zA", "common")):
        part = whole.where(F.startswith("token", F.lit(kind))).select("token", F.struct("value").alias("x"))
        write_report(part.agg(F.map_from_entries(F.collect_list(F.struct("token", "x"))).alias("tokens")), f"{folder}/{name}.json")
    spoken, common = (read_token_rows(spark, f"{folder}/{name}.json").select("token", "value") for name in ("spoken", "common"))
    joined = spoken.unionByName(common)
    kinds = {"missing": whole.exceptAll(joined), "extra": joined.exceptAll(whole), "shared": spoken.join(common, "token", "left_semi"), "spoken": spoken, "common": common}
    out = None
    for kind, df in kinds.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""
SELECT doc_id, source <> 'src0' AS edited, md5(text) AS text, CASE WHEN source = 'src0' THEN 'old' ELSE source END AS mark, true AS stable FROM documents WHERE text IS NOT NULL AND source IS NOT NULL""")
def n_rows_without_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without edits pass byte for byte, whatever their spacing; edits that set values give the same line again, however often they run."""
    docs = _t(spark, sf_dir, "documents").where("text is not null and source is not null")
    raw = F.concat(F.lit('{ "mark" :"old",  "text":'), F.substring(F.to_json(F.struct("text")), 9, 2147483647))
    edited = F.col("source") != "src0"
    made = docs.select("doc_id", "source", raw.alias("raw"), F.when(edited, t.edits(("set", "mark", F.col("source")))).alias("changes"))
    once = made.withColumn("once", t.edit_json("raw", "changes")).withColumn("twice", t.edit_json("once", "changes"))
    stable = (F.col("once") == F.col("twice")) & (F.col("changes").isNotNull() | (F.col("once") == F.col("raw")))
    fields = F.from_json("once", "mark string, text string")
    return once.select("doc_id", F.col("changes").isNotNull().alias("edited"), F.md5(fields["text"]).alias("text"), fields["mark"].alias("mark"), stable.alias("stable"))
