"""Decoding of binary blocks: controls, two-byte characters, ASCII and stray bytes, by functions of Spark alone.

Bytes are read as ISO-8859-1, so each is one character, and one pattern of alternatives cuts a block into its units from left to right: that is the
whole state machine. What a unit shows is found by its place in literal arrays: 256 entries for single bytes and for controls, 94 x 94 for the cells
of two bytes, made by rule from the codec.
"""

from __future__ import annotations

import json
from functools import lru_cache
from unicodedata import normalize

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as t

#: A control takes the byte behind it, whatever it is; two printable bytes other than the space are a cell; all else is a unit of one byte.
UNIT = r"(?s)\x1F.|[\x21-\x7E]{2}|."
#: First and last byte of a cell's two.
LOW, HIGH = 0x21, 0x7E
_SIDE = HIGH - LOW + 1


@lru_cache(maxsize=1)
def cells() -> str:
    """The character of each cell in its order, U+FFFD where there is none."""
    rows = range(LOW | 0x80, (HIGH | 0x80) + 1)
    shown = lambda pair: pair.decode("euc_jp", errors="replace")
    return "".join(x if len(x := shown(bytes((a, b)))) == 1 else "�" for a in rows for b in rows)


def single(byte: int) -> str:
    """What a byte shows that is a unit of its own."""
    return "\n" if byte in (0x0A, 0x0D) else "" if byte == 0 else chr(byte) if 0x20 <= byte <= HIGH else " "


def control(byte: int) -> str:
    """What a control shows whose second byte this is."""
    return "\n" if byte in (0x0A, 0x0D) else f"⟦1F{byte:02X}⟧"


def _literal(values: list[str]) -> Column:
    """An array of the plan, folded once."""
    return F.from_json(F.lit(json.dumps(values)), "array<string>")


def _tables() -> dict[str, Column]:
    of_bytes = {"single": single, "control": control, "hex": lambda b: f"{b:02X}"}
    return {name: _literal([f(b) for b in range(256)]) for name, f in of_bytes.items()} | {"cell": _literal(list(cells()))}


def units_of(chunk: Column) -> Column:
    """A block's units, each as a string of one or two characters that stand for its bytes; null for null."""
    return F.regexp_extract_all(F.decode(chunk, "ISO-8859-1"), F.lit(UNIT), F.lit(0))


_first = F.ascii


def _second(unit: Column) -> Column:
    return F.ascii(F.substring(unit, 2, 1))


def _is_control(unit: Column) -> Column:
    return (F.length(unit) == 2) & (_first(unit) == 0x1F)


def _counts_as_unit(unit: Column) -> Column:
    """Filler and line ends aren't units."""
    return ~unit.isin("\0", "\n", "\r")


def _cell(unit: Column, tables: dict[str, Column]) -> Column:
    return F.get(tables["cell"], (_first(unit) - LOW) * _SIDE + _second(unit) - LOW)


def with_decoded(chunks: DataFrame, chunk: str = "chunk") -> DataFrame:
    """chunks with text, codes (different controls in the order of their first place), counts (of these) and n_units; nulls for a null block."""
    tables = _tables()
    shown = lambda u: F.when(F.length(u) == 1, F.get(tables["single"], _first(u))).when(_first(u) == 0x1F, F.get(tables["control"], _second(u))).otherwise(_cell(u, tables))
    cut = chunks.select("*", units_of(F.col(chunk)).alias("_units"))
    every = F.transform(F.filter("_units", _is_control), lambda u: F.concat(F.lit("1F"), F.get(tables["hex"], _second(u))))
    read = cut.select(*chunks.columns, F.array_join(F.transform("_units", shown), "").alias("_text"), every.alias("_codes"), F.size(F.filter("_units", _counts_as_unit)).alias("n_units"))
    text = t.strip(F.regexp_replace(F.regexp_replace("_text", "[ \\t]+", " "), "\\n{3,}", "\n\n"))
    named = read.select(*chunks.columns, text.alias("text"), "_codes", F.array_distinct("_codes").alias("codes"), F.when(F.col(chunk).isNotNull(), F.col("n_units")).alias("n_units"))
    counts = F.transform("codes", lambda c: F.size(F.filter("_codes", lambda x: x == c)).cast("bigint"))
    return named.select(*chunks.columns, "text", "codes", counts.alias("counts"), "n_units")


@lru_cache(maxsize=1)
def _wide() -> dict[str, str]:
    """NFKC of the characters of cells that it changes. Marks that it sets apart stand behind a space each, so no character changes another."""
    return {c: n for c in sorted(set(cells())) if (n := normalize("NFKC", c)) != c}


def preview(text: Column) -> Column:
    """t.preview of decoded text (with_decoded), whose characters are known, so that its NFKC needs no Python."""
    changed = _wide()
    alone = {c: n for c, n in changed.items() if len(n) == 1}
    plain = F.translate(t.literally(text, {c: n for c, n in changed.items() if len(n) > 1}), "".join(alone), "".join(alone.values()))
    return t.without_marks(plain)


def block_units(chunk: Column) -> Column:
    """The units of each block, without filler and line ends: type, offset, code (of controls), hex and text; null for null."""
    tables = _tables()
    # One entry for each byte, null for the second one of a unit, so an entry's place is its offset.
    by_byte = F.flatten(F.transform(units_of(chunk), lambda u: F.when(F.length(u) == 2, F.array(u, F.lit(None).cast("string"))).otherwise(F.array(u))))

    def unit(u: Column, offset: Column) -> Column:
        two, is_control = F.length(u) == 2, _is_control(u)
        digits = F.concat(F.get(tables["hex"], _first(u)), F.when(two, F.get(tables["hex"], _second(u))).otherwise(""))
        is_ascii = (_first(u) >= 0x20) & (_first(u) <= HIGH)
        kind = F.when(is_control, "control").when(two, "jis0208").when(is_ascii, "ascii").otherwise("byte")
        text = F.when(is_control, F.lit(None).cast("string")).when(two, _cell(u, tables)).when(is_ascii, u)
        fields = [kind.alias("type"), offset.alias("offset"), F.when(is_control, digits).alias("code"), F.when(~is_control, digits).alias("hex"), text.alias("text")]
        return F.when(u.isNotNull() & _counts_as_unit(u), F.struct(*fields))

    return F.filter(F.transform(by_byte, unit), F.isnotnull)


def control_counts(codes: Column, counts: Column) -> Column:
    """How often each control code comes, as a map in the order of their first places."""
    return F.map_from_arrays(codes, counts)
