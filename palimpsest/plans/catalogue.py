"""Queries over the supplied tables, one for each kind of operator, and the DuckDB SQL that must return the same rows.

The dictionary files that the operators are made for aren't among the tables, so the queries run over tables of like shape: labelled documents play
the drafts and the others the old entries, users' events the ordered sequences, and so on. Most call the library's own functions; plain filters, counts,
anti-joins and set operations are written out here, as they are in the plans that use them. Long texts are returned as MD5 sums of the whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import fixed
from palimpsest.functions import text as t
from palimpsest.operators import choose, lookup, segment
from palimpsest.operators.islands import positional_fill
from palimpsest.operators.order import in_blocks, next_filled, running_count
from palimpsest.plans.extract import control_totals
from palimpsest.sources.readers import lines_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents with a label, as drafts, and those without, as old entries."""
    docs, labels = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels").select("doc_id")
    return docs.join(labels, "doc_id", "left_semi"), docs.join(labels, "doc_id", "left_anti")


_SIDES = "drafts AS (SELECT * FROM documents SEMI JOIN labels USING (doc_id)), old AS (SELECT * FROM documents ANTI JOIN labels USING (doc_id))"
# The tables' texts have no other white space than spaces, tabs and line ends, and NFKC leaves them as they are.
_KEY = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_DROPS = fixed.SIGNATURE_DROPS.replace("'", "''")
_SIGNATURE = rf"regexp_replace({_KEY}, '[{_DROPS}\s]+', '', 'g')"
_HEADWORD = r"trim(regexp_replace(regexp_replace(lower(trim({}, ' ' || chr(10) || chr(9) || chr(13))), '[‐-―−]+', '-', 'g'), '\s+', ' ', 'g'), ' -')"


# Filters, projections and scans.


@query("SELECT doc_id, source, source = 'src0' AS mine, md5(CASE WHEN source = 'src0' THEN replace(text, ' ', '_') ELSE text END) AS shown FROM documents")
def f_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = F.col("source") == "src0"
    shown = F.when(mine, F.replace("text", F.lit(" "), F.lit("_"))).otherwise(F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", "source", mine.alias("mine"), F.md5(shown).alias("shown"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 0 AND (o_totalprice > 250000 OR o_orderkey IN (15, 12596))")
def f_threshold_or_allow(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return orders.where((F.col("o_orderkey") >= 0) & ((F.col("o_totalprice") > 250000) | F.col("o_orderkey").isin(*[15, 12596])))


@query("SELECT doc_id, len(regexp_extract_all(text, '[0-9]+')) AS n FROM documents WHERE regexp_matches(text, '[0-9]+')")
def f_regex_token_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.regexp_count("text", F.lit("[0-9]+")).cast("bigint")
    return _t(spark, sf_dir, "documents").where(F.col("text").rlike("[0-9]+")).select("doc_id", n.alias("n"))


@query("""
WITH cut AS (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS parts FROM documents WHERE length(text) > 0)
SELECT CAST(doc_id AS VARCHAR) AS file, i - 1 AS ord, md5(parts[i]) AS line FROM cut, unnest(range(1, len(parts) + 1)) AS r(i)""")
def s_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), "text")
    return lines_of(texts, ends="\\n").select("file", F.col("ord").cast("bigint").alias("ord"), F.md5("line").alias("line"))


# Text functions.


@query("""
SELECT doc_id, md5(replace(replace(replace(text, 'th', 'ɪ'), 'er', '<subentry>'), 'on', '[hA1FF]')) AS mapped,
       len(regexp_extract_all(replace(text, 'on', '[hA1FF]'), '\\[hA1FF\\]')) AS n_left
FROM documents""")
def t_token_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = t.literally(F.col("text"), {"th": "[hA126]", "er": "[zA423]", "on": "[hA1FF]"})
    mapped = t.map_tokens(coded, {"hA126": "ɪ", "zA423": "<subentry>"})
    docs = _t(spark, sf_dir, "documents").select("doc_id", mapped.alias("mapped"))
    return docs.select("doc_id", F.md5("mapped").alias("mapped"), F.size(t.tokens_in(F.col("mapped"))).cast("bigint").alias("n_left"))


def _rewritten(column: str) -> str:
    for pattern, value in fixed.PRONUNCIATION:
        column = f"regexp_replace({column}, '{pattern}', '{value}', 'g')"
    return column


@query(f"SELECT doc_id, md5({_KEY.format(_rewritten('text'))}) AS cleaned FROM documents")
def t_ordered_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(t.clean_pronunciation(F.col("text"))).alias("cleaned"))


@query(f"SELECT doc_id, substr({_SIGNATURE.format('text')}, 1, 80) AS signature, substr({_SIGNATURE.format('text')}, 1, 40) AS prefix_signature FROM documents")
def t_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", t.signature(F.col("text")).alias("signature"))
    return docs.withColumn("prefix_signature", t.prefix_signature(F.col("signature")))


@query(f"SELECT doc_id, md5({_HEADWORD.format('text')}) AS key FROM documents")
def t_headword_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(t.headword_key(F.col("text"))).alias("key"))


@query("""
SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped FROM pages""")
def t_html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", F.md5(t.escape_html(F.col("html"))).alias("escaped"))


@query(f"SELECT doc_id, {' + '.join(f'''{p} * length(regexp_replace(text, '{c.replace('[', '[^', 1) if c.startswith('[') else f'[^{c}]'}', '', 'g'))''' for p, c in fixed.SCRIPT_SCORES)} AS score FROM documents")
def b_script_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", t.script_score(F.col("text")).cast("bigint").alias("score"))


# Aggregations.


@query(f"""
WITH rows AS (SELECT d.doc_id, {_SIGNATURE.format('d.text')} AS whole, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id))
SELECT substr(whole, 1, 80) AS key, min(doc_id) AS first_id, count(*) AS variants, count(DISTINCT toxic) AS raw_variants, count(DISTINCT quality) = 1 AS usable
FROM rows GROUP BY 1""")
def a_choose_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    rows = docs.select("doc_id", t.signature(F.col("text")).alias("sig"), "quality", "toxic")
    got = lookup.unique_or_none(rows, "sig", "quality", "toxic", ["doc_id"])
    return got.select("key", F.col("first.doc_id").alias("first_id"), "variants", "raw_variants", (F.col("distinct") == 1).alias("usable"))


@query("SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type, arg_min(value, event_id) AS value FROM events GROUP BY user_id")
def a_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.min_by(F.struct("event_type", "value"), "event_id")
    got = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("event_id"), first.alias("r"))
    return got.select("user_id", "event_id", "r.event_type", "r.value")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def a_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _t(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return lookup.last_of(events, "user_id", ["event_id"]).select(F.col("key").alias("user_id"), "row.event_id", "row.event_type", "row.value")


@query("""
SELECT user_id, name, n FROM (
  SELECT user_id, unnest([{'name': 'total', 'n': count(*)}, {'name': 'large', 'n': count(*) FILTER (value > 50)},
                          {'name': 'views', 'n': count(*) FILTER (event_type = 'view')}, {'name': 'k_total', 'n': CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT)}], recursive := true)
  FROM events GROUP BY user_id)
WHERE n > 0 OR name = 'total'""")
def a_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = _t(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("value") > 50).alias("large"), F.count_if(F.col("event_type") == "view").alias("views"),
        F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k_total"),
    )
    counts = choose.touched([(c, F.col(c)) for c in ("total", "large", "views", "k_total")], always=1)
    return sums.select("user_id", F.explode(counts).alias("name", "n"))


@query("""
WITH words AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[^\\x20\\n]+'))) AS word FROM documents)
SELECT word, count(*) AS n, min(doc_id) AS first FROM words GROUP BY word ORDER BY n DESC, first, word LIMIT 30""")
def a_most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _t(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[^\\x20\\n]+"), F.lit(0)))).alias("word"))
    return choose.top_counts(words, "word", "doc_id", 30)


@query("""
WITH words AS (SELECT lang, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents)
SELECT lang, CAST(sum(len(w)) AS BIGINT) AS occurrences, CAST(sum(len(list_distinct(w))) AS BIGINT) AS distinct_in_rows FROM words GROUP BY lang""")
def a_occurrence_vs_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _t(spark, sf_dir, "documents").select("lang", F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("w"))
    return words.groupBy("lang").agg(F.sum(F.size("w")).alias("occurrences"), F.sum(F.size(F.array_distinct("w"))).alias("distinct_in_rows"))


@query("""
SELECT lang, count(*) AS total, count(quality) AS matched, round_even(count(quality) / count(*), 6) AS coverage
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def a_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    sums = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("total"), F.count("quality").alias("matched"))
    return sums.withColumn("coverage", choose.ratio(F.col("matched"), F.col("total")))


@query("""
WITH counts AS (SELECT user_id, event_type AS code, count(*) AS n FROM events GROUP BY ALL)
SELECT code, CAST(sum(n) AS BIGINT) AS count FROM counts GROUP BY code""")
def a_control_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' counts of event types as maps, summed by key."""
    counts = _t(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id")
    maps = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("control_codes"))
    samples = maps.select(F.lit("events").alias("source_id"), F.lit(1).alias("block_size"), F.col("user_id").alias("rank"), "control_codes")
    return control_totals(samples).select("code", "count")


@query("""
WITH signs AS (SELECT unnest(regexp_extract_all(text, '[!-/:-@\\[-`{-~]')) AS symbol FROM documents), counts AS (SELECT symbol, count(*) AS n FROM signs GROUP BY symbol)
SELECT chr(CAST(code AS INT)) AS symbol, code, coalesce(n, 0) AS n FROM unnest(range(33, 127)) AS r(code) LEFT JOIN counts ON symbol = chr(CAST(code AS INT))
WHERE NOT regexp_matches(chr(CAST(code AS INT)), '[0-9A-Za-z]')""")
def t_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each symbol with its number, and how often the documents have it."""
    signs = _t(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[!-/:-@\\[-`{-~]"), F.lit(0))).alias("symbol"))
    counts = signs.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return t.symbols(spark).join(counts, "symbol", "left").select("symbol", "code", F.coalesce("n", F.lit(0)).alias("n"))


# Joins.


@query(f"""
WITH {_SIDES},
keyed AS (SELECT doc_id, lang, unnest([{{'m': 1, 'k': text}}, {{'m': 2, 'k': {_HEADWORD.format('text')}}}, {{'m': 3, 'k': substr({_SIGNATURE.format('text')}, 1, 80)}}], recursive := true) FROM old),
looks AS (SELECT m, k, min(doc_id) AS found_id, count(*) AS variants FROM keyed GROUP BY m, k HAVING count(DISTINCT lang) = 1),
wanted AS (SELECT doc_id, unnest([{{'m': 1, 'k': text}}, {{'m': 2, 'k': {_HEADWORD.format('text')}}}, {{'m': 3, 'k': substr({_SIGNATURE.format('text')}, 1, 80)}}], recursive := true) FROM drafts),
hits AS (SELECT doc_id, min(m) AS m, arg_min(found_id, m) AS found_id, arg_min(variants, m) AS variants FROM wanted JOIN looks USING (m, k) GROUP BY doc_id)
SELECT doc_id, CASE m WHEN 1 THEN 'exact' WHEN 2 THEN 'normalized' WHEN 3 THEN 'signature' END AS method, found_id, variants FROM drafts LEFT JOIN hits USING (doc_id)""")
def j_cascade_exact_norm_alt(spark: SparkSession, sf_dir: str) -> DataFrame:
    drafts, old = (_keyed(side) for side in _sides(spark, sf_dir))
    names = {"exact": "text", "normalized": "headword", "signature": "signature"}
    looks = [lookup.Look(F.col(c), "agree", value=F.col("lang")) for c in names.values()]
    found = lookup.match(drafts, ["doc_id"], [(m, F.col(c), n) for n, (m, c) in enumerate(names.items())], looks, old, ["doc_id"])
    return drafts.select("doc_id").join(found, "doc_id", "left").select("doc_id", "method", F.col("entry.doc_id").alias("found_id"), "variants")


def _keyed(side: DataFrame) -> DataFrame:
    own = F.col("text")
    return side.select("doc_id", "lang", "text", t.headword_key(own).alias("headword"), t.signature(own).alias("signature"))


def _only_sql(key: str, before: str = "true", after: str = "true", guard: str = "true") -> str:
    return f"""
WITH {_SIDES},
ones AS (SELECT {key} AS k, min(doc_id) AS found_id, min(lang) AS lang FROM old WHERE {before} GROUP BY 1 HAVING count(*) = 1),
wanted AS (SELECT doc_id, {key} AS own FROM drafts)
SELECT doc_id, found_id FROM wanted LEFT JOIN (SELECT * FROM ones WHERE {after}) ON own = k AND {guard}"""


def _only(spark: SparkSession, sf_dir: str, key: Column, before: Column | None = None, after: Column | None = None, guard: bool = False) -> DataFrame:
    drafts, old = (side.select("doc_id", "lang", key.alias("k")) for side in _sides(spark, sf_dir))
    own = F.col("k")
    found = lookup.match(drafts, ["doc_id"], [("unique", F.when(own != "", own) if guard else own, 0)], [lookup.Look(own, before=before, after=after)], old, ["doc_id"])
    return drafts.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.col("entry.doc_id").alias("found_id"))


@query(_only_sql(_KEY.format("split_part(text, chr(10), 1)"), before="lang <> 'de'", guard="own <> ''"))
def j_head_part_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _only(spark, sf_dir, t.text_key(F.substring_index("text", "\n", 1)), before=F.col("lang") != "de", guard=True)


@query(_only_sql(f"substr({_SIGNATURE.format('text')}, 1, 80)", after="lang <> 'de'"))
def j_body_signature_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _only(spark, sf_dir, t.signature(F.col("text")), after=F.col("lang") != "de")


@query(_only_sql(f"substr({_SIGNATURE.format('text')}, 1, 40)", after="lang <> 'de'"))
def j_prefix_signature_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _only(spark, sf_dir, t.prefix_signature(t.signature(F.col("text"))), after=F.col("lang") != "de")


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events in order, with their place from 0."""
    events = _t(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return events.withColumn("ord", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("bigint") - 1)


_SEQUENCE = "seq AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ord FROM events)"


@query(f"""
WITH {_SEQUENCE},
marked AS (SELECT *, event_type <> 'click' AS found, sum(CASE WHEN event_type <> 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ord) AS grp FROM seq),
islands AS (SELECT user_id, grp, min(ord) AS start, count(*) AS n FROM marked WHERE NOT found GROUP BY user_id, grp),
bounded AS (SELECT i.*, a.event_type AS k1, b.event_type AS k2 FROM islands i JOIN seq a ON a.user_id = i.user_id AND a.ord = start - 1 JOIN seq b ON b.user_id = i.user_id AND b.ord = start + n),
fits AS (SELECT i.user_id, grp, start, n, a.ord AS a_ord FROM bounded i JOIN seq a ON a.user_id = i.user_id AND a.event_type = k1 JOIN seq b ON b.user_id = i.user_id AND b.ord = a.ord + n + 1 AND b.event_type = k2),
one AS (SELECT user_id, grp, min(start) AS start, min(a_ord) AS a_ord FROM fits GROUP BY user_id, grp HAVING count(*) = 1)
SELECT m.user_id, m.ord, CAST(a_ord + 1 + m.ord - start AS BIGINT) AS other_ord FROM marked m JOIN one USING (user_id, grp) WHERE NOT found""")
def j_positional_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = _sequences(spark, sf_dir)
    rows = seq.select("user_id", "ord", F.col("event_type").alias("key"), (F.col("event_type") != "click").alias("found"))
    return positional_fill(rows, rows.select("user_id", "ord", "key"), ["user_id"])


@query("""
WITH lasts AS (SELECT p_brand, max(p_partkey) AS last_key FROM part GROUP BY p_brand)
SELECT p.p_partkey, CASE WHEN contains(p_type, 'STEEL') AND contains(p_type, 'ECONOMY') THEN 'clue' WHEN p_size = 7 THEN 'size' END AS method, last_key
FROM part p LEFT JOIN lasts l ON l.p_brand = CASE WHEN contains(p_type, 'STEEL') AND contains(p_type, 'ECONOMY') THEN 'Brand#11' WHEN p_size = 7 THEN p.p_brand END""")
def j_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    clue = F.col("p_type").contains("STEEL") & F.col("p_type").contains("ECONOMY")
    rules = [(clue, "clue", F.lit("Brand#11")), (F.col("p_size") == 7, "size", F.col("p_brand"))]
    method, want = F.lit(None).cast("string"), F.lit(None).cast("string")
    for holds, name, key in reversed(rules):
        method, want = F.when(holds, F.lit(name)).otherwise(method), F.when(holds, key).otherwise(want)
    lasts = lookup.last_of(part, "p_brand", ["p_partkey"]).select(F.col("key").alias("k"), F.col("row.p_partkey").alias("last_key"))
    return part.withColumn("method", method).withColumn("want", want).join(lasts, F.col("want") == F.col("k"), "left").select("p_partkey", "method", "last_key")


@query("SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)")
def j_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sides(spark, sf_dir)[1].select("doc_id", "source")


# Order, windows and choosing.


@query("""
WITH ranked AS (SELECT o_orderpriority, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders),
chosen AS (SELECT * FROM ranked WHERE rn <= 40 OR o_orderkey IN (1, 7, 15, 33))
SELECT o_orderpriority, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY rn) AS rank FROM chosen""")
def w_topk_forced(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    got = choose.topk_forced(orders, ["o_orderpriority"], "o_totalprice", "o_orderkey", 40, F.col("o_orderkey").isin(1, 7, 15, 33))
    return got.withColumn("rank", F.col("rank").cast("bigint"))


@query("""
WITH placed AS (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS place, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
SELECT l_suppkey, place, l_orderkey, l_linenumber FROM placed WHERE place % greatest(1, n // 10) = 0 OR place IN (3, 4000)""")
def w_strided_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")).cast("bigint") - 1
    picks = lines.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")).select("l_suppkey", F.explode(choose.strided(F.col("n"), 10, [3, 4000])).alias("place"))
    return lines.withColumn("place", place).join(picks, ["l_suppkey", "place"]).select("l_suppkey", "place", "l_orderkey", "l_linenumber")


@query(f"""
WITH {_SEQUENCE}, sized AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM seq),
known AS (SELECT user_id, event_id, greatest(0, ord - 2) AS first, least(n, ord + 6) AS stop FROM sized WHERE event_type = 'purchase')
SELECT k.user_id, k.event_id, CAST(first AS BIGINT) AS first, CAST(stop - 1 AS BIGINT) AS last, sum(s.value) AS value
FROM known k JOIN seq s ON s.user_id = k.user_id AND s.ord >= first AND s.ord < stop GROUP BY ALL""")
def w_context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = _sequences(spark, sf_dir)
    sizes = seq.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    known = seq.where("event_type = 'purchase'").join(sizes, "user_id").select("user_id", "event_id", choose.context(F.col("ord"), F.col("n"), 2, 5).alias("w"))
    places = known.select("user_id", "event_id", "w.first", (F.col("w.stop") - 1).alias("last")).withColumn("ord", F.explode(F.sequence("first", "last")))
    inside = places.join(seq.select("user_id", "ord", "value"), ["user_id", "ord"])
    return inside.groupBy("user_id", "event_id", "first", "last").agg(F.sum("value").alias("value"))


@query("""
WITH cut AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS seg FROM conversations)
SELECT conv_id, CAST(seg AS BIGINT) AS seg, min(turn) AS first_turn, md5(coalesce(string_agg(trim(text, ' ' || chr(9) || chr(10) || chr(13)), chr(10) ORDER BY turn) FILTER (trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''), '')) AS body
FROM cut WHERE seg > 0 GROUP BY conv_id, seg""")
def w_segment_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _t(spark, sf_dir, "conversations").withColumn("text", t.strip(F.col("text")))
    cut = running_count(turns, ["conv_id"], "turn", F.col("role") == "user", "seg", block=4).where("seg > 0")
    body = F.array_join(segment.in_order("text", "turn", F.col("text") != ""), "\n")
    return cut.groupBy("conv_id", "seg").agg(F.min("turn").alias("first_turn"), F.md5(body).alias("body"))


@query("""
WITH lines AS (SELECT doc_id, i - 1 AS ord, string_split(text, chr(10))[i] AS line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS r(i))
SELECT doc_id, ord, md5(first_value(CASE WHEN trim(line) <> '' THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS following FROM lines""")
def w_next_nonblank(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ord", "line"))
    dealt = in_blocks(lines, ["doc_id"], "ord", block=64)
    seen = next_filled(dealt, ["doc_id"], "ord", F.when(F.btrim("line") != "", F.col("line")), "following")
    return seen.select("doc_id", F.col("ord").cast("bigint").alias("ord"), F.md5("following").alias("following"))


@query("SELECT event_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS BIGINT) AS purchases FROM events")
def w_running_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _t(spark, sf_dir, "events").select("event_id", F.lit("").alias("part"), "event_type")
    return running_count(events, ["part"], "event_id", F.col("event_type") == "purchase", "purchases", block=4096).select("event_id", "purchases")


# Nested rows, reports and sets.


@query("""
SELECT doc_id, lang AS kept_lang, source AS first_source, 'restored' AS source, md5(text) AS body, length(text) > 1000 AS ready, 2 AS n_notes FROM documents""")
def n_nested_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.to_json(F.struct("doc_id", "lang", F.struct("source").alias("header"), F.array(F.lit("draft")).alias("notes")))
    changes = t.edits(
        ("default_from", "header.first_source", "header.source"), ("set", "header.source", "restored"), ("set", "canonical.body", F.md5("text")),
        ("set", "canonical.ready", F.length("text") > 1000), ("append", "notes", F.concat(F.lit("restored:"), "lang")),
    )
    shape = "doc_id bigint, lang string, header struct<source:string,first_source:string>, canonical struct<body:string,ready:boolean>, notes array<string>"
    docs = _t(spark, sf_dir, "documents").select(raw.alias("raw"), changes.alias("changes")).select(F.from_json(t.edit_json("raw", "changes"), shape).alias("j"))
    return docs.select("j.doc_id", F.col("j.lang").alias("kept_lang"), F.col("j.header.first_source").alias("first_source"), F.col("j.header.source").alias("source"), F.col("j.canonical.body").alias("body"), F.col("j.canonical.ready").alias("ready"), F.size("j.notes").alias("n_notes"))


@query("""
SELECT count(*) AS total_entries, count(quality) AS matched, count(*) - count(quality) AS unmatched, round_even(count(quality) / count(*), 6) AS coverage,
       CAST(sum(CASE WHEN quality IS NOT NULL THEN len(regexp_extract_all(text, '[0-9]+')) ELSE 0 END) AS BIGINT) AS tokens
FROM documents LEFT JOIN labels USING (doc_id)""")
def k_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    hit = F.col("quality").isNotNull()
    sums = rows.agg(F.count(F.lit(1)).alias("total_entries"), F.count_if(hit).alias("matched"), F.count_if(~hit).alias("unmatched"), F.coalesce(F.sum(F.when(hit, F.regexp_count("text", F.lit("[0-9]+")))), F.lit(0)).cast("bigint").alias("tokens"))
    return sums.withColumn("coverage", choose.ratio(F.col("matched"), F.col("total_entries")))


@query("""
SELECT 'both' AS kind, p_partkey AS key FROM part INTERSECT SELECT 'both', l_partkey FROM lineitem
UNION ALL SELECT * FROM (SELECT 'unsold', p_partkey FROM part EXCEPT SELECT 'unsold', l_partkey FROM lineitem)
UNION ALL SELECT * FROM (SELECT 'any', p_partkey FROM part UNION SELECT 'any', l_suppkey FROM lineitem)""")
def u_setops(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"))
    lines = _t(spark, sf_dir, "lineitem")
    sold, suppliers = lines.select(F.col("l_partkey").alias("key")), lines.select(F.col("l_suppkey").alias("key"))
    kinds = {"both": part.intersect(sold), "unsold": part.subtract(sold), "any": part.union(suppliers).distinct()}
    parts = [df.select(F.lit(k).alias("kind"), "key") for k, df in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
