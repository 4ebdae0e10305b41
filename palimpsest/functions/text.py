"""Text functions as column expressions. All run in the JVM but NFKC, for which Spark has no function: that is an Arrow UDF over whole batches."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from palimpsest.functions import fixed
from palimpsest.functions.profile import DEFAULT, Profile


def _same_in_nfkc() -> str:
    """A class of what isn't among the letters and signs that NFKC leaves as they are whatever stands beside them: no mark, and nothing that joins the sign before it."""
    blocks = [(0x0, 0x300), (0x370, 0x530), (0x2010, 0x2070), (0x3001, 0x3097), (0x30A1, 0x3100), (0x4E00, 0x9FFD)]
    out, first = "", None
    for first_of, stop in blocks:
        for code in range(first_of, stop + 1):
            same = code < stop and unicodedata.is_normalized("NFKC", chr(code)) and not unicodedata.combining(chr(code)) and unicodedata.category(chr(code)) != "Cn"
            if same and first is None:
                first = code
            elif not same and first is not None:
                out, first = out + rf"\x{{{first:X}}}-\x{{{code - 1:X}}}", None
    return f"[^{out}]"


_MAY_CHANGE = _same_in_nfkc()


@arrow_udf(StringType())
def nfkc(text: pa.Array) -> pa.Array:
    """Only texts with a sign that NFKC may change go through Python's tables, one by one. Arrow's own kernel leaves composed letters apart."""
    may = pc.fill_null(pc.match_substring_regex(text, _MAY_CHANGE), False)
    some = text.filter(may)
    return pc.replace_with_mask(text, may, pa.array([unicodedata.normalize("NFKC", x) for x in some.to_pylist()], text.type)) if len(some) else text


#: fixed.SPACE as a class that Java tests by a character's kind, and its characters one by one.
_SPACE = r"[\s\x1c-\x1f]"
_SPACES = "".join(c for c in map(chr, range(0x10000)) if re.match(f"[{fixed.SPACE}]", c))


def strip(text: Column) -> Column:
    """Without white space at both ends. Spark's trim by characters copies each character first, so it is only for texts that have other ends than spaces."""
    bare = F.trim(text)
    ends = [F.contains(F.lit(_SPACES), F.substring(bare, at, 1)) for at in (1, -1)]
    return F.when(ends[0] | ends[1], F.btrim(bare, F.lit(_SPACES))).otherwise(bare)


def one_space(text: Column) -> Column:
    """Each run of white space as one space. A space alone is no match, so that most texts are left as they are."""
    return F.regexp_replace(text, f"(?U){_SPACE}{{2,}}|[\\s\\x1c-\\x1f&&[^ ]]", " ")


def one_end(text: Column, ends: str = fixed.LINE_ENDS) -> Column:
    """All line ends as "\\n": those of two characters first, then each other one of the class `ends`."""
    joined = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    if not ends:
        return F.replace(joined, F.lit("\r"), F.lit("\n"))
    return F.regexp_replace(joined, r"[\v\x1c-\x1e&&[^\n]]" if ends == fixed.LINE_ENDS else f"[\r{ends}&&[^\n]]", "\n")


def literally(text: Column, pairs: dict[str, str]) -> Column:
    """Literal replacements, one after the other."""
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs.items(), text)


def _addressed(tokens: dict[str, str]) -> list[tuple[int, list[str | None], list[str | None]]]:
    """Tables (first address, codes, values) of a token map. A code's address is its letter and the number that its digits are.

    Codes that differ in the case of their digits share an address, so each further one goes to a further table: one table for most maps.
    """
    tables: list[dict[int, str]] = []
    for code in sorted(tokens):
        if not re.fullmatch("[zh]A[0-9A-Fa-f]{3}", code):
            continue  # no text holds it as a token
        address = 4096 * (code[0] == "z") + int(code[2:], 16)
        table = next((x for x in tables if address not in x), None)
        if table is None:
            tables.append(table := {})
        table[address] = code
    out = []
    for table in tables:
        first, last = min(table), max(table)
        codes = [table.get(k) for k in range(first, last + 1)]
        out.append((first, codes, [None if c is None else tokens[c] for c in codes]))
    return out


#: Tokens up to which a map is applied by a literal replacement for each.
_FEW = 32


def _independent(tokens: dict[str, str]) -> bool:
    """Whether no value can be read as a part of a token, whatever stands beside it: none is empty or has a bracket, and each has a sign that no token has."""
    return all(re.search(r"[^zhA-Fa-f0-9]", v) and not re.search(r"[\[\]]", v) for v in tokens.values())


def map_tokens(text: Column, tokens: dict[str, str], p: Profile = DEFAULT) -> Column:
    """Each token with its value, once from left to right; tokens that the map lacks stay, and values aren't read again. Maps of few tokens whose values can't be
    read as parts of tokens are literal replacements, in any order.

    The text is cut in front of each token, so that each piece has one token at most, at its start. The map is a literal array of the plan, in which a
    token's letter and digits are its place, so the map's size doesn't matter. A piece that doesn't begin with the token of its place stays. Of a profile with other tokens it is a literal map.
    """
    if p.token != fixed.TOKEN:
        return _map_others(text, tokens, p.token)
    few = {k: v for k, v in tokens.items() if v is not None and re.fullmatch("[zh]A[0-9A-Fa-f]{3}", k)}
    if len(few) <= _FEW and _independent(few):
        return literally(text, {f"[{k}]": v for k, v in few.items()})
    literal = lambda values: F.from_json(F.lit(json.dumps(values)), "array<string>")
    tables = [(first, literal([c and f"[{c}]" for c in codes]), literal(values)) for first, codes, values in _addressed(tokens)]
    if not tables:
        return text

    def piece(x: Column) -> Column:
        address = F.conv(F.substring(x, 4, 3), 16, 10).cast("int") + F.when(F.startswith(x, F.lit("[z")), 4096).otherwise(0)
        values = [F.when(F.get(codes, address - first) == F.substring(x, 1, 7), F.get(values, address - first)) for first, codes, values in tables]
        return F.when(F.startswith(x, F.lit("[")), F.coalesce(*[F.concat(v, F.substring(x, 8, 2147483647)) for v in values], x)).otherwise(x)

    return F.array_join(F.transform(F.split(text, f"(?={fixed.TOKEN})"), piece), "")


def _map_others(text: Column, tokens: dict[str, str], pattern: str) -> Column:
    """map_tokens for any token pattern."""
    if not tokens:
        return text
    values = F.create_map(*[F.lit(x) for pair in sorted(tokens.items()) for x in pair])

    def piece(x: Column) -> Column:
        code = F.regexp_extract(x, f"^(?:{pattern})", 1)
        value = F.when(code != "", F.try_element_at(values, code))
        return F.when(value.isNotNull(), F.concat(value, F.regexp_replace(x, f"^(?:{pattern})", ""))).otherwise(x)

    return F.array_join(F.transform(F.split(text, f"(?={pattern})"), piece), "")


def tokens_in(text: Column, p: Profile = DEFAULT) -> Column:
    """Codes of all tokens, in their order."""
    return F.regexp_extract_all(text, F.lit(p.token), F.lit(1))


def token_list(text: Column, p: Profile = DEFAULT) -> Column:
    """Different codes, sorted and joined with commas."""
    return F.array_join(F.array_sort(F.array_distinct(tokens_in(text, p))), ",")


def squeezed(text: Column) -> Column:
    """Each run of white space as one space, and none at the ends: as strip after one_space, with one pattern."""
    return F.btrim(one_space(text))


def clean_pronunciation(text: Column, p: Profile = DEFAULT) -> Column:
    """The rewrites in their order. Those without a sign of a pattern are literal, which takes no pattern's time."""
    rewrite = lambda t, r: F.regexp_replace(t, "(?U)" + r[0], r[1]) if re.search(r"[\\.^$|?*+()\[\]{}]", r[0]) else F.replace(t, F.lit(r[0]), F.lit(r[1]))
    return squeezed(reduce(rewrite, p.pronunciation, text))


#: White space that ends no line, once all line ends are "\n".
_IN_LINE = r"[\s\x1c-\x1f&&[^\n]]"


def clean_body(text: Column, p: Profile = DEFAULT) -> Column:
    """A mapped body as a reader sees it: markup as signs, NFKC, lines without extra white space, at most one blank line together. All lines are cleaned at once."""
    shown = F.regexp_replace(literally(text, p.body_markup), "<label>([^\\n]*?)</label>", "〔$1〕")
    spaced = F.regexp_replace(one_end(nfkc(shown)), "[ \\t]+", " ")
    tails = F.regexp_replace(spaced, rf"(?U)(?<!{_IN_LINE}){_IN_LINE}++\n", "\n")
    heads = F.regexp_replace(tails, rf"(?U)\n{_IN_LINE}++", "\n")
    return strip(F.regexp_replace(heads, "\\n{3,}", "\n\n"))


def headword_key(text: Column, p: Profile = DEFAULT) -> Column:
    # The ends' white space goes with the last step.
    # ASCII, whose bytes are as many as its characters, has one form, and isn't sent to Python.
    key = F.lower(F.coalesce(nfkc(F.when(F.octet_length(text) != F.length(text), text)), text))
    key = literally(key, dict.fromkeys(p.broken_hyphens, "-") | {"･": " "})
    return F.btrim(one_space(F.regexp_replace(key, f"[{p.hyphens}]+", "-")), F.lit(" -"))


def text_key(text: Column) -> Column:
    return squeezed(nfkc(text))


def fix_header(text: Column, p: Profile = DEFAULT) -> Column:
    """Without one leading head prefix, and with the literal corrections."""
    bare = F.when(F.startswith(text, F.lit(p.head_prefix)), F.substring(text, len(p.head_prefix) + 1, 2147483647)).otherwise(text)
    return literally(strip(bare), p.header_literals)


def head_part(text: Column) -> Column:
    """The key of what stands before the first 【."""
    return text_key(F.substring_index(text, "【", 1))


def signature(text: Column, p: Profile = DEFAULT) -> Column:
    """The first characters of the key that count. White space doesn't, so the key's own steps for it aren't needed."""
    return F.substring(F.regexp_replace(nfkc(text), rf"(?U)[{p.signature_drops}\s\x1c-\x1f]+", ""), 1, p.signature)


def prefix_signature(whole: Column, p: Profile = DEFAULT) -> Column:
    """Of a signature: the key has no line ends left, so the first line's signature is the first part of the whole one. White space alone gives ''."""
    return F.substring(whole, 1, p.prefix_signature)


def orthography_line(text: Column) -> Column:
    """(orthography in its brackets or null, rest) of a line that begins with 【…】."""
    pattern = "^【([^】]+)】([^\\n]*)"
    found = F.regexp_extract(text, pattern, 1)
    hit = found != ""
    return F.struct(
        F.when(hit, F.concat(F.lit("【"), found, F.lit("】"))).alias("orthography"),
        F.when(hit, strip(F.regexp_extract(text, pattern, 2))).otherwise(text).alias("rest"),
    )


def header_parts(header: Column) -> Column:
    """(headword, orthography) of a mapped header; the orthography is null where it has none of its own."""
    key = text_key(header)
    alone = F.regexp_extract(key, "^【([^】]+)】\\z", 1)
    both = key.contains("【") & key.contains("】")
    right = F.regexp_replace(key, "^[^【]*【", "")
    return F.struct(
        F.when(alone != "", alone).when(both, F.substring_index(key, "【", 1)).otherwise(key).alias("headword"),
        F.when(alone != "", F.lit(None).cast("string")).when(both, F.substring_index(right, "】", 1)).alias("orthography"),
    )


def is_body_start(line: Column, p: Profile = DEFAULT) -> Column:
    return reduce(lambda a, b: a | b, (F.startswith(line, F.lit(s)) for s in p.body_starts)) | line.rlike("^[0-9０-９]")


def escape_html(text: Column) -> Column:
    return literally(text, {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#x27;"})


def symbols(spark: SparkSession) -> DataFrame:
    """(symbol, code): the printable ASCII characters that are neither letters nor digits, with the number that enters each."""
    codes = spark.range(0x21, 0x7F).select(F.char("id").alias("symbol"), F.col("id").alias("code"))
    return codes.where(~F.col("symbol").rlike("[0-9A-Za-z]"))


def script_score(text: Column) -> Column:
    return reduce(lambda a, b: a + b, (F.regexp_count(text, F.lit(pattern)) * points for points, pattern in fixed.SCRIPT_SCORES)).cast("int")


def hex_bytes(data: Column) -> Column:
    """Two digits for each byte, in lower case, with spaces between."""
    return F.regexp_replace(F.lower(F.hex(data)), "(..)(?!\\z)", "$1 ")


def hex_number(number: Column, digits: int = 4) -> Column:
    digit = F.hex(number)
    return F.lpad(digit, F.greatest(F.lit(digits), F.length(digit)), F.lit("0"))


def preview(text: Column) -> Column:
    """Decoded text without control marks."""
    return without_marks(nfkc(text))


def without_marks(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(text, "⟦1F[0-9A-F]{2}⟧", ""), "[ \\t]+", " "))


@arrow_udf(StringType())
def edit_json(document: pa.Array, edits: pa.Array) -> pa.Array:
    """Applies edits to JSON objects and keeps all they don't name, with the order of keys. A null list of edits leaves the document as it is.

    An edit is [action, path, value]: "set" puts the value, "default" only where the key is absent ("default_from": the value found at a second
    path), "append" adds to a list. Parents that are absent are made.
    """
    out = []
    for text, changes in zip(document.to_pylist(), edits.to_pylist(), strict=True):
        if text is None or changes is None:
            out.append(text)
            continue
        root = json.loads(text)
        for action, path, value in json.loads(changes):
            *parents, last = path.split(".")
            at = root
            for name in parents:
                at = at.setdefault(name, {})
            if action == "set":
                at[last] = value
            elif action == "default_from":
                source = reduce(lambda d, k: d.get(k) if isinstance(d, dict) else None, value.split("."), root)
                at.setdefault(last, source)
            elif action == "append":
                at[last] = [*at.get(last, []), value]
            else:
                raise ValueError(f"no such edit: {action}")
        out.append(json.dumps(root, ensure_ascii=False))
    return pa.array(out, pa.string())


def edits(*changes: tuple[str, str, Column | str]) -> Column:
    """A JSON list of edits. Values are columns (any type; null stays null) or strings."""
    parts = []
    for action, path, value in changes:
        column = F.lit(value) if isinstance(value, str) else value
        text = F.to_json(F.struct(column.alias("v")), {"ignoreNullFields": "false"})
        parts.append(F.concat(F.lit(f'["{action}","{path}",'), F.substring(text, 6, 2147483647)))
    joined = [F.regexp_replace(p, r"\}\z", "]") for p in parts]
    return F.concat(F.lit("["), F.concat_ws(",", *joined), F.lit("]"))
